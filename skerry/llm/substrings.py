"""Substring dedup: passages that repeat across documents, found through super-k-mers of words.

A window is a number of consecutive words. Its minimiser is the least hash among the shorter runs of
words inside it. Consecutive windows of a document with the same minimiser overlap nearly wholly, so
they travel as one packed string of words to the minimiser's bucket, where all windows of the bucket
are sorted and compared word by word."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.neardup import mixed
from skerry.llm.text import ragged, stored, text_slices, words
from skerry.operators.joins import skew_safe_join

#: Consecutive windows that travel together at most; longer runs are cut, which loses no window.
RUN = 256
#: Windows that a bucket's different strings hold at most, which take some 50 MB to sort; those of
#: larger buckets travel singly.
BUCKET = 200_000
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
ODD = np.uint64(0x9E3779B97F4A7C15)

RUNS = "doc_id long, print long, minimiser long, digest binary, start int, n int"
STRINGS = "minimiser long, digest binary, least long, last long, n int, packed binary"
SEGMENTS = "digest binary, segments array<struct<first int, last int, least long>>"
WINDOWS = "window binary, digest binary, at int, least long, last long"


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of values[i:i + width] for every i at which that is whole."""
    reach, least = 1, values
    while 2 * reach <= width:
        least, reach = np.minimum(least[:-reach], least[reach:]), 2 * reach
    rest = width - reach
    return np.minimum(least[:len(least) - rest], least[rest:]) if rest else least


def super_kmers(texts: pa.Array, window: int, mer: int) -> tuple[np.ndarray, ...]:
    """Of all texts' windows the runs with one minimiser: text, first word, windows, minimiser, digest of the words."""
    codes, offsets, known = words(texts, lower=False)
    if len(codes) < window:
        none = np.zeros(0, np.int64)
        return none, none, none, none, []
    table = np.array([xxhash.xxh3_64_intdigest(w.as_buffer()) for w in known], dtype=np.uint64)
    hashed = table[codes]
    grams = len(hashed) - mer + 1
    h = np.full(grams, mer, dtype=np.uint64)
    for j in range(mer):
        h = mixed((h * ODD) ^ hashed[j:j + grams])
    least = sliding_least(h, window - mer + 1)
    counts = np.maximum(np.diff(offsets) - window + 1, 0)
    at, of = ragged(offsets[:-1], counts), np.repeat(np.arange(len(counts)), counts)
    values = least[at]
    fresh = np.ones(len(at), dtype=bool)
    fresh[1:] = (values[1:] != values[:-1]) | (of[1:] != of[:-1])
    place = np.arange(len(at))
    fresh |= (place - np.maximum.accumulate(np.where(fresh, place, 0))) % RUN == 0
    first = np.flatnonzero(fresh)
    n = np.diff(np.append(first, len(at)))
    starts = at[first]
    whole, ends = hashed.tobytes(), starts + n + window - 1
    digests = [xxhash.xxh3_128_digest(whole[8 * a:8 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    return of[first], starts - offsets[of[first]], n, values[first].view(np.int64), digests


def least_of_windows(rows: pa.RecordBatch, window: int) -> pa.RecordBatch:
    """For whole buckets of packed strings: where an earlier document has a string's windows.

    All windows, as rows of word codes, are sorted; equal ones take the least document of their
    strings. Neighbouring windows of a string with the same least document form a segment."""
    lists = pc.split_pattern(rows.column("packed").cast(pa.string()), " ")
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    codes = flat.dictionary_encode().indices.to_numpy().astype(np.int32)
    counts = np.diff(offsets) - window + 1
    at, of = ragged(offsets[:-1] - offsets[0], counts), np.repeat(np.arange(len(counts)), counts)
    least, last = (np.asarray(rows.column(c), dtype=np.int64) for c in ("least", "last"))
    matrix = np.lib.stride_tricks.sliding_window_view(codes, window)[at]
    key = np.ascontiguousarray(matrix).view(np.dtype((np.void, 4 * window))).ravel()
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    group = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
    own = np.minimum.reduceat(least[of[order]], np.flatnonzero(np.diff(group, prepend=-1)))
    found = np.empty(len(at), dtype=np.int64)
    found[order] = own[group]
    fresh = np.ones(len(at), dtype=bool)
    fresh[1:] = (found[1:] != found[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(fresh)
    stop = np.append(first[1:], len(at))
    matter = found[first] < last[of[first]]
    first, stop = first[matter], stop[matter]
    zero = np.cumsum(counts) - counts
    inner = (first - zero[of[first]]).astype(np.int32)
    segments = pa.StructArray.from_arrays(
        [pa.array(inner), pa.array(inner + (stop - first).astype(np.int32) - 1), pa.array(found[first])], ["first", "last", "least"])
    strings, sizes = np.unique(of[first], return_counts=True)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), segments)
    return pa.RecordBatch.from_arrays([rows.column("digest").take(pa.array(strings)), lists], ["digest", "segments"])


def whole_buckets(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows sorted by minimiser in batches of about `limit` bytes that end where a bucket ends."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        size += batch.nbytes
        held.append(batch)
        if size < limit:
            continue
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        keys = np.asarray(table.column("minimiser"), dtype=np.int64)
        cut = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on
        if cut:
            yield table.slice(0, cut)
        held, size = [table.slice(cut)], 0 if not cut else table.slice(cut).nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def remove_repeats(docs: DataFrame, window: int = 50, mer: int = 8, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_words, n_removed, removed (array of start, end in words) and kept (the words left,
    joined by one space) of every row of (doc_id, text).

    A word goes if a window of `window` words that covers it also starts in a document with a
    smaller doc_id; windows are those of the input. Words are what lies between spaces and the
    characters 9 to 13, unchanged.

    One scan gives the super-k-mers without their words: minimiser, digest, place. Only those whose
    minimiser occurs in more than one document go on, and of equal ones the words are fetched once,
    from the least document. A bucket with more than `bucket` windows in different strings (a passage
    in very many contexts) is not compared in one task: its windows travel singly and are grouped as they
    are. Nothing else depends on how often a passage occurs: equal strings collapse before any
    shuffle, and joins let adaptive execution split hot keys.

    A null text has no words; texts shorter than a window lose none; rows of equal doc_id are not
    earlier than each other, each is returned; rows without a doc_id take no part and are returned
    whole; other columns are left out; an empty table gives no rows. A document's own words, its
    runs and what is removed from it must fit into a task."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("print", F.xxhash64("text"))
    named = texts.where("doc_id IS NOT NULL")

    def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text_slices(batch, 4 << 20):
                of, start, n, minimiser, digests = super_kmers(rows.column("text"), window, mer)
                of = pa.array(of)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id").take(of), rows.column("print").take(of), pa.array(minimiser), pa.array(digests, pa.binary()),
                     pa.array(start, pa.int32()), pa.array(n, pa.int32())], ["doc_id", "print", "minimiser", "digest", "start", "n"])

    runs = stored(named.mapInArrow(runs_of, RUNS), "runs")
    shared = runs.groupBy("minimiser").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("minimiser")
    runs = stored(skew_safe_join(runs, shared, ["minimiser"], "left_semi"), "shared-runs")

    origin = F.min(F.struct("doc_id", "print", "start", "n", "minimiser")).alias("o")
    strings = runs.groupBy("digest").agg(origin, F.max("doc_id").alias("last")).select("o.*", "last", "digest")
    spans = strings.groupBy("doc_id", "print").agg(F.collect_list(F.struct("start", "n", "minimiser", "digest", "last")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text_slices(batch, 4 << 20):
                out: list[list] = [[], [], [], [], [], []]
                for doc_id, text, wanted in zip(rows.column("doc_id").to_pylist(), rows.column("text"), rows.column("spans").to_pylist(), strict=True):
                    own = WORD.findall(text.as_buffer())
                    for s in wanted:
                        packed = b" ".join(own[s["start"]:s["start"] + s["n"] + window - 1])
                        for column, value in zip(out, (s["minimiser"], s["digest"], doc_id, s["last"], s["n"], packed), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)],
                    ["minimiser", "digest", "least", "last", "n", "packed"])

    fetched = skew_safe_join(named, spans, ["doc_id", "print"]).dropDuplicates(["doc_id", "print"]).select("doc_id", "text", "spans")
    packed = stored(fetched.mapInArrow(cut, STRINGS), "strings")
    large = packed.groupBy("minimiser").agg(F.sum("n").alias("windows")).where(F.col("windows") > bucket).select("minimiser", F.lit(True).alias("large"))
    packed = skew_safe_join(packed, large, ["minimiser"], "left")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_buckets(batches):
            yield least_of_windows(rows, window)

    def singly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.column("packed")[i].as_py().split(b" ")
                n = len(own) - window + 1
                same = [pa.array([batch.column(c)[i].as_py()] * n, t) for c, t in (("digest", pa.binary()), ("least", pa.int64()), ("last", pa.int64()))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b" ".join(own[k:k + window]) for k in range(n)], pa.binary()), same[0], pa.array(range(n), pa.int32()), *same[1:]],
                    ["window", "digest", "at", "least", "last"])

    names = ["minimiser", "digest", "least", "last", "packed"]
    in_buckets = packed.where("large IS NULL").select(*names).repartition("minimiser").sortWithinPartitions("minimiser").mapInArrow(compare, SEGMENTS)
    single = packed.where("large").select(*names).mapInArrow(singly, WINDOWS)
    least = single.groupBy("window").agg(F.min("least").alias("first_doc"))
    single = skew_safe_join(single.drop("least"), least, ["window"]).where("first_doc < last")
    single = single.groupBy("digest").agg(F.collect_list(F.struct(F.col("at").alias("first"), F.col("at").alias("last"), F.col("first_doc").alias("least"))).alias("segments"))

    judged = skew_safe_join(runs.select("doc_id", "print", "start", "digest"), in_buckets.unionByName(single), ["digest"])
    covered = judged.select("doc_id", "print", "start", F.explode("segments").alias("s")).where("s.least < doc_id")
    cover = F.struct((F.col("start") + F.col("s.first")).alias("start"), (F.col("start") + F.col("s.last") + window).alias("end"))
    removed = covered.groupBy("doc_id", "print").agg(F.collect_set(cover).alias("covers"))

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text_slices(batch):
                yield without_covers(rows)

    out = "doc_id long, n_words long, n_removed long, removed array<struct<start int, end int>>, kept string"
    return skew_safe_join(texts, removed, ["doc_id", "print"], "left").select("doc_id", "text", "covers").mapInArrow(rebuilt, out)


def without_covers(rows: pa.RecordBatch) -> pa.RecordBatch:
    """The texts of (doc_id, text, covers) without the words that their covers name."""
    codes, offsets, known = words(rows.column("text"), lower=False)
    change = np.zeros(len(codes) + 1, dtype=np.int32)
    covers = rows.column("covers")
    sizes = np.asarray(pc.fill_null(pc.list_value_length(covers), 0), dtype=np.int64)
    flat = covers.flatten()
    base = np.repeat(offsets[:-1], sizes)
    np.add.at(change, base + np.asarray(flat.field("start"), dtype=np.int64), 1)
    np.add.at(change, base + np.asarray(flat.field("end"), dtype=np.int64), -1)
    gone = np.cumsum(change[:-1]) > 0
    kept_before = np.concatenate([[0], np.cumsum(~gone)])
    kept = pa.array(codes[~gone]) if len(codes) else pa.array([], pa.int32())
    lists = pa.ListArray.from_arrays(pa.array(kept_before[offsets], pa.int32()), known.take(kept))
    edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
    # A span that goes on over a document's end is two: cut at the offsets.
    starts, ends = edge[::2], edge[1::2]
    inner = np.searchsorted(offsets, ends, "left") - np.searchsorted(offsets, starts, "right")
    bounds = offsets[ragged(np.searchsorted(offsets, starts, "right"), inner)]
    starts, ends = np.sort(np.concatenate([starts, bounds])), np.sort(np.concatenate([ends, bounds]))
    full = ends > starts
    starts, ends = starts[full], ends[full]
    of = np.searchsorted(offsets, starts, "right") - 1
    spans = pa.StructArray.from_arrays([pa.array(starts - offsets[of], pa.int32()), pa.array(ends - offsets[of], pa.int32())], ["start", "end"])
    first = np.searchsorted(of, np.arange(len(offsets)))
    n_words = np.diff(offsets)
    return pa.RecordBatch.from_arrays(
        [rows.column("doc_id"), pa.array(n_words), pa.array(n_words - np.diff(kept_before[offsets])),
         pa.ListArray.from_arrays(pa.array(first, pa.int32()), spans), pc.binary_join(lists, " ")],
        ["doc_id", "n_words", "n_removed", "removed", "kept"])
