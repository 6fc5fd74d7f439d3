"""Texts as Arrow arrays inside tasks: bounded slices, words, ragged gathers; shared folders."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Between words: space and the characters 9 to 13.
BLANKS = " \t\n\x0b\f\r"
SLICE_BYTES = 8 << 20


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all other characters as they are."""
    return F.translate(text, UPPER, LOWER)


def text_slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the column `text` of a part has about `limit` bytes, one row at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0), dtype=np.int64)
    part = (np.cumsum(sizes) - sizes) // limit
    cuts = np.flatnonzero(np.diff(part)) + 1
    for start, stop in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        if stop > start:
            yield batch.slice(start, stop - start)


def words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of texts (null: none) as codes into a dictionary, and the offsets of each text's words."""
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    full = np.asarray(pc.binary_length(flat), dtype=np.int64) > 0
    before = np.concatenate([[0], np.cumsum(full)])
    coded = flat.filter(pa.array(full)).dictionary_encode()
    return coded.indices.to_numpy(), before[offsets - offsets[0]], coded.dictionary


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[i] .. starts[i] + lengths[i] - 1, one after the other."""
    lengths = lengths.astype(np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(lengths.sum())


def pieces(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """The bytes of data[offsets[i]:offsets[i + 1]]."""
    whole, size = data.tobytes(), data.itemsize
    ends = (offsets * size).tolist()
    return [whole[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder name under spark.checkpoint.dir, which driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = spark.sparkContext.getCheckpointDir()
        if known:
            base = known.rsplit("/", 1)[0]
        elif spark.sparkContext.master.startswith("local"):
            base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/../checkpoints"
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str, compression: str | None = None) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back: short lineage, safe from lost executors."""
    folder = shared_folder(df.sparkSession, purpose)
    df.write.parquet(folder, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
