"""Token ids in Simple-8b words, written to files and read back.

A 64-bit word holds a selector in its top four bits and, in the other sixty, as many ids of equal
width as fit. Ids of more than 60 bits take two words: one with the low bits (selector ESCAPE), one
with the high bits (selector HIGH). Words never cross a block of BLOCK ids, and a segment lists the
word at which each block begins, so that any block can be decoded alone and all of them at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry.llm.text import SLICE_BYTES, pieces, shared_folder, text_slices
from skerry.llm.tokens import FlatEncoder, public_library_encoder

#: Fixed by the format: ids in a word for selectors 0 to 13; each takes 60 // count bits.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1, 0], dtype=np.int64)
BITS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 60, 0], dtype=np.int64)
ESCAPE, HIGH = 14, 15
BLOCK = 4096
LOW60 = np.uint64((1 << 60) - 1)

SEGMENT = ("part int, segment int, before long, doc_ids array<long>, lengths array<long>, "
           "block_words array<int>, payload binary")


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, and the first word of each block."""
    ids = ids.astype(np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.arange(n, dtype=np.int64)
    # Width of each id as the first selector of one that takes it; past the end of a block none does.
    widest = np.full((-(-n // BLOCK), BLOCK), ESCAPE, dtype=np.int8)
    widest.reshape(-1)[:n] = np.searchsorted(np.uint64(1) << BITS[:ESCAPE].astype(np.uint64), ids, side="right")
    width = widest.copy()
    chosen = np.full(n, ESCAPE, dtype=np.int8)
    count = 1
    for selector in range(13, -1, -1):  # the last that fits holds the most
        for count in range(count + 1, int(COUNTS[selector]) + 1):  # widest of the next `count` ids
            np.maximum(widest[:, :1 - count], width[:, count - 1:], out=widest[:, :1 - count])
            widest[:, 1 - count] = ESCAPE
        fits = widest.reshape(-1)[:n] <= selector
        if selector < 13 and not fits.any():
            break  # nor will more ids in fewer bits each
        chosen[fits] = selector
    step = at + COUNTS[chosen]
    used = np.zeros(n, dtype=bool)
    ahead = np.arange(0, n, BLOCK)
    ends = np.minimum(ahead + BLOCK, n)
    while len(ahead):  # all blocks go on side by side
        used[ahead] = True
        ahead = step[ahead]
        ahead, ends = ahead[ahead < ends], ends[ahead < ends]
    starts = np.flatnonzero(used)
    selectors = chosen[starts].astype(np.int64)
    takes = 1 + (selectors == ESCAPE)
    place = np.cumsum(takes) - takes
    words = np.zeros(int(takes.sum()), dtype=np.uint64)
    for selector in np.unique(selectors).tolist():
        own = selectors == selector
        first, count, bits = starts[own], int(COUNTS[selector]), int(BITS[selector])
        word = np.full(len(first), selector << 60, dtype=np.uint64)
        for j in range(count):
            word |= (ids[first + j] & LOW60) << np.uint64(bits * j)
        words[place[own]] = word
        if selector == ESCAPE:
            words[place[own] + 1] = np.uint64(HIGH << 60) | ids[first] >> np.uint64(60)
    return words, place[np.searchsorted(starts, np.arange(0, n, BLOCK))]


def unpack(words: np.ndarray) -> np.ndarray:
    """All ids of whole blocks, as unsigned 64-bit integers."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selectors]
    place = np.cumsum(counts) - counts
    ids = np.zeros(int(counts.sum()), dtype=np.uint64)
    for selector in np.unique(selectors).tolist():
        own = selectors == selector
        if selector == HIGH:
            ids[place[own] - 1] |= (words[own] & LOW60) << np.uint64(60)
            continue
        bits = int(BITS[selector])
        mask = np.uint64((1 << bits) - 1)
        for j in range(int(COUNTS[selector])):
            ids[place[own] + j] |= (words[own] >> np.uint64(bits * j)) & mask
    return ids


def unpack_block(words: np.ndarray, block_words: np.ndarray, block: int) -> np.ndarray:
    """The ids of one block only."""
    stop = block_words[block + 1] if block + 1 < len(block_words) else len(words)
    return unpack(words[block_words[block]:stop])


def write_ids(docs: DataFrame, folder: str, end_id: int = 2, slice_bytes: int = SLICE_BYTES,
              encoder: Callable[[], FlatEncoder] = public_library_encoder) -> None:
    """Encode the texts of (doc_id, text), append `end_id` to each, and write segments to `folder`.

    One file per range of doc_id; segments are in ascending doc_id order, null first. A null or
    empty text has the end id alone, an empty table writes no segment, rows of equal doc_id keep
    side by side, other columns are left out."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, segment, before, encode_texts = TaskContext.get().partitionId(), 0, 0, encoder()
        for batch in batches:
            for rows in text_slices(batch, slice_bytes):
                ids, lengths = encode_texts.ids(rows.column("text"))
                ids = np.insert(ids.astype(np.uint64), np.cumsum(lengths), end_id)
                words, block_words = pack(ids)
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([part], pa.int32()), "segment": pa.array([segment], pa.int32()),
                    "before": pa.array([before], pa.int64()),
                    "doc_ids": pa.array([rows.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    "lengths": pa.array([(lengths + 1).tolist()], pa.list_(pa.int64())),
                    "block_words": pa.array([block_words.tolist()], pa.list_(pa.int32())),
                    "payload": pa.array([words.astype("<u8").tobytes()], pa.binary()),
                })
                segment, before = segment + 1, before + len(ids)

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
               .repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id"))
    ordered.mapInArrow(encode, SEGMENT).write.parquet(folder)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit) of the files."""
    segments = spark.read.schema(SEGMENT).parquet(folder)
    totals = (segments.select("part", F.expr("aggregate(lengths, 0L, (a, x) -> a + x)").alias("ids"))
              .groupBy("part").agg(F.sum("ids").alias("ids")))  # a row for each file
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("part_start"))
    placed = segments.join(F.broadcast(starts), "part").select(
        (F.col("part_start") + F.col("before")).alias("start"), "doc_ids", "lengths", "payload")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                lengths = row["lengths"].values.to_numpy(zero_copy_only=False).astype(np.int64)
                ids = unpack(np.frombuffer(row["payload"].as_py(), dtype="<u8")).astype("<u4")
                offsets = np.concatenate([[0], np.cumsum(lengths)])
                yield pa.RecordBatch.from_pydict({
                    "doc_id": row["doc_ids"].values,
                    "start": pa.array(row["start"].as_py() + offsets[:-1], pa.int64()),
                    "n_tokens": pa.array(lengths, pa.int64()),
                    "ids": pa.array(pieces(ids, offsets), pa.binary()),
                })

    return placed.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def write_and_read(docs: DataFrame, end_id: int = 2) -> DataFrame:
    """write_ids() into a new folder under spark.checkpoint.dir, then read_ids()."""
    folder = shared_folder(docs.sparkSession, "simple8b")
    write_ids(docs, folder, end_id)
    return read_ids(docs.sparkSession, folder)
