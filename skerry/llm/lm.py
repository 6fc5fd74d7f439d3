"""A hidden Markov language model, trained by Baum-Welch, that scores whole texts.

A state emits a symbol, one of `symbols` classes of words by hash, or the end; a word follows from
its class by its count. So the table that tasks get has a fixed size, however many words there are."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.llm.text import ragged, stored, text_slices, words

#: Words of a training sequence: longer texts are trained on in parts of this length, all of them.
PART = 512


class Hmm:
    """start: of a text, and of a later part of one; move: from state to state; emit: symbol by state."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def first(cls, prior: np.ndarray, states: int, seed: int) -> Hmm:
        """Around the symbols' frequencies, each state off by a random factor."""
        rng = np.random.default_rng(seed)
        emit = prior[:, None] * rng.uniform(0.3, 1.7, (len(prior), states))
        move = np.full((states, states), 0.2 / states) + 0.8 * np.eye(states)
        return cls(np.full((2, states), 1 / states), move, emit / emit.sum(axis=0))

    def refit(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray, prior: np.ndarray, weight: float) -> Hmm:
        """From expected counts, with `weight` imagined tokens of the prior in each state."""
        start, move = start + 1.0, move + 1.0
        emit = emit + weight * prior[:, None]
        return Hmm(start / start.sum(axis=1, keepdims=True), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def by_length(symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of sequences from long to short, and how many have more than t symbols, for each t."""
    order = np.argsort(-lengths, kind="stable")
    longest = int(lengths.max()) if len(lengths) else 0
    return order, len(lengths) - np.cumsum(np.bincount(lengths, minlength=longest + 1))[:longest]


def log_likelihood(model: Hmm, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log10 probability of each sequence symbols[start:start + length] by the scaled forward recursion."""
    order, going = by_length(symbols, starts, lengths)
    out, first = np.zeros(len(lengths)), starts[order]
    state = np.repeat(model.start[:1], len(order), axis=0)
    for t, n in enumerate(going):
        if t:
            state = state[:n] @ model.move
        state = state[:n] * model.emit[symbols[first[:n] + t]]
        scale = state.sum(axis=1)
        state /= scale[:, None]
        out[:n] += np.log10(scale)
    result = np.empty(len(lengths))
    result[order] = out
    return result


def expected_counts(model: Hmm, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, later: np.ndarray) -> tuple:
    """Baum-Welch counts (start, move, emit) of sequences; later: 1 for a part that is not its text's first."""
    order, going = by_length(symbols, starts, lengths)
    first, states = starts[order], model.move.shape[0]
    forward, scales = [], []
    state = model.start[later[order]]
    for t, n in enumerate(going):
        if t:
            state = state[:n] @ model.move
        state = state[:n] * model.emit[symbols[first[:n] + t]]
        scale = state.sum(axis=1, keepdims=True)
        state = state / scale
        forward.append(state)
        scales.append(scale)
    move, emit, seen, weights = np.zeros((states, states)), np.zeros(model.emit.shape), [], []
    after = np.zeros((0, states))
    for t in range(len(going) - 1, -1, -1):
        n, back = going[t], np.ones((going[t], states))
        if len(after):
            move += forward[t][:len(after)].T @ after
            back[:len(after)] = after @ model.move.T
        seen.append(symbols[first[:n] + t])
        weights.append(forward[t] * back)
        after = model.emit[seen[-1]] * back / scales[t]
    seen, weights = np.concatenate(seen or [np.zeros(0, np.int64)]), np.concatenate(weights or [np.zeros((0, states))])
    for s in range(states):
        emit[:, s] = np.bincount(seen, weights=weights[:, s], minlength=len(emit))
    start = np.zeros((2, states))
    if len(going):
        np.add.at(start, later[order], forward[0] * back)
    return start, move * model.move, emit


def to_planes(codes: np.ndarray) -> bytes:
    """32-bit integers as four runs of bytes; with frequent words first, the high ones compress to little."""
    return codes.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def coded(docs: DataFrame, held_out: Column) -> DataFrame:
    """A row for each slice of the texts: ids, held_out, lengths and word codes of its documents, its
    distinct words and their counts in documents that are not held out. Written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for rows in text_slices(batch):
                codes, offsets, known = words(rows.column("text"))
                held = np.asarray(rows.column("held_out"), dtype=bool)
                lengths = np.diff(offsets)
                frequent = np.argsort(-np.bincount(codes, minlength=len(known)), kind="stable")
                place = np.empty(len(known), dtype=np.int64)
                place[frequent] = np.arange(len(known))
                codes, known = place[codes], known.take(pa.array(frequent))
                counts = np.bincount(codes[np.repeat(~held, lengths)], minlength=len(known))
                yield pa.RecordBatch.from_pydict({
                    "slice": pa.array([number], pa.int64()), "doc_ids": pa.array([rows.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    "held": pa.array([held.tolist()], pa.list_(pa.bool_())), "lengths": pa.array([lengths.tolist()], pa.list_(pa.int64())),
                    "codes": pa.array([to_planes(codes)], pa.binary()),
                    "words": pa.array([known], pa.list_(pa.string())), "counts": pa.array([counts], pa.list_(pa.int64()))})
                number += 1

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                         F.coalesce(held_out, F.lit(False)).alias("held_out"))
    return stored(source.mapInArrow(run, "slice long, doc_ids array<long>, held array<boolean>, lengths array<long>, "
                                         "codes binary, words array<string>, counts array<long>"), "coded")


def symbols_of(row: dict, symbols: int, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of a coded row's documents with their ends, where each begins, how long it is; symbols of its words (`table`)."""
    if table is None:
        table = np.fromiter((zlib.crc32(w.encode()) % symbols for w in row["words"].as_py()), dtype=np.int64)
    lengths = row["lengths"].values.to_numpy(zero_copy_only=False).astype(np.int64)
    flat = table[from_planes(row["codes"].as_py())] if len(table) else np.zeros(0, np.int64)
    flat = np.insert(flat, np.cumsum(lengths), symbols)
    return flat, np.cumsum(lengths + 1) - lengths - 1, lengths + 1, table


def baum_welch(slices: DataFrame, model: Hmm, symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts over all documents of coded() that are not held out.

    Each task sums its slices; the sums are added up by symbol, so the driver gets one table of
    `symbols` rows whatever the size of the corpus."""
    states = model.move.shape[0]
    shared = slices.sparkSession.sparkContext.broadcast(model)
    names = [f"c{s}" for s in range(states)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: list[np.ndarray] | None = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                flat, starts, lengths, _ = symbols_of(row, symbols)
                kept = ~row["held"].values.to_numpy(zero_copy_only=False).astype(bool)
                starts, lengths = starts[kept], lengths[kept]
                parts = -(-lengths // PART)
                at = ragged(np.zeros(len(parts), np.int64), parts) * PART
                starts, lengths = np.repeat(starts, parts) + at, np.minimum(np.repeat(lengths, parts) - at, PART)
                for low in range(0, len(starts), 1000):
                    some = slice(low, low + 1000)
                    found = expected_counts(shared.value, flat, starts[some], lengths[some], (at[some] > 0).astype(np.int64))
                    sums = list(found) if sums is None else [a + b for a, b in zip(sums, found, strict=True)]
        if sums is not None:
            table = np.vstack([sums[2], sums[1], sums[0]])  # symbols and the end, then moves, then starts
            key = np.flatnonzero(table.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int32()), *[pa.array(table[key, s]) for s in range(states)]], ["key", *names])

    rows = slices.select("held", "lengths", "codes", "words").mapInArrow(run, ", ".join(["key int", *[f"{c} double" for c in names]]))
    table = np.zeros((symbols + 1 + states + 2, states))
    for row in rows.groupBy("key").agg(*[F.sum(c).alias(c) for c in names]).collect():
        table[row[0]] = row[1:]
    return table[-2:], table[symbols + 1:-2], table[:symbols + 1]


def score_texts(docs: DataFrame, held_out: Column, states: int = 8, symbols: int = 1 << 14, rounds: int = 3,
                weight: float = 50.0, seed: int = 11) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of (doc_id, text).

    Trained on the rows where `held_out` is not true, all of them in every round. The tokens are the
    words, A-Z lower-cased, and an end. base_score sums log10((c + 1) / (N + V + 1)) over the tokens; score is
    the model's log10 probability: of the symbols by the forward recursion over the whole text, and
    of each word in its class, (c + 1) / (C + V + 1) by the class's tokens C and distinct words V.

    A null or empty text is an end alone; repeated rows are scored and counted each; without
    training rows all counts are 0; other columns are left out; an empty table gives no rows."""
    spark = docs.sparkSession
    slices = coded(docs, held_out)
    entries = slices.select("slice", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "entry")).select(
        "slice", "place", F.col("entry.words").alias("word"), F.col("entry.counts").alias("n"))
    # A word has a row in each slice that it occurs in, so it meets in one task with as many rows as there are slices.
    of_word = Window.partitionBy("word")
    entries = stored(entries.select(
        "slice", "place", F.sum("n").over(of_word).alias("c"),
        (F.min(F.struct("slice", "place")).over(of_word) == F.struct("slice", "place")).alias("first"),
        (F.crc32(F.col("word").cast("binary")) % symbols).cast("int").alias("symbol")), "counts")
    classes = (entries.where("first AND c > 0").groupBy("symbol")
               .agg(F.sum("c").alias("tokens"), F.count(F.lit(1)).alias("words")).collect())  # at most `symbols` rows
    ends = slices.agg(F.coalesce(F.sum(F.expr("size(filter(held, x -> NOT x))")), F.lit(0))).first()[0]
    tokens, distinct = np.zeros(symbols + 1), np.zeros(symbols + 1)
    for row in classes:
        tokens[row["symbol"]], distinct[row["symbol"]] = row["tokens"], row["words"]
    tokens[symbols], distinct[symbols] = ends, ends > 0
    all_tokens, vocabulary = int(tokens.sum()), int(distinct.sum())
    room = tokens + distinct + 1
    prior = room / room.sum()
    model = Hmm.first(prior, states, seed)
    for _ in range(rounds if all_tokens else 0):
        model = model.refit(*baum_welch(slices, model, symbols), prior, weight)

    tables = entries.groupBy("slice").agg(F.sort_array(F.collect_list(F.struct("place", "c", "symbol"))).alias("pairs")).select(
        "slice", F.col("pairs.c").alias("c"), F.col("pairs.symbol").alias("symbols"))
    shared = spark.sparkContext.broadcast((model, np.log10(room)))
    bottom = np.log10(all_tokens + vocabulary + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, log_room = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                numbers = lambda name, row=row: row[name].values.to_numpy(zero_copy_only=False) if row[name].is_valid else np.zeros(0, np.int64)
                c = numbers("c").astype(np.float64)
                flat, starts, lengths, table = symbols_of(row, symbols, numbers("symbols").astype(np.int64))
                codes = from_planes(row["codes"].as_py())
                doc = np.repeat(np.arange(len(lengths)), lengths - 1)
                add = lambda of_word, doc=doc, codes=codes, n=len(lengths): np.bincount(doc, weights=of_word[codes], minlength=n)
                one = np.log10(c + 1)
                base = add(one - bottom) + np.log10(ends + 1) - bottom
                known = add((c > 0).astype(np.float64)) + (ends > 0)
                score = log_likelihood(fitted, flat, starts, lengths) + add(one - log_room[table])
                size = len(lengths)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": row["doc_ids"].values, "held_out": row["held"].values, "n_tokens": pa.array(lengths, pa.int64()),
                    "n_known": pa.array(known.round().astype(np.int64)), "train_tokens": pa.array(np.full(size, all_tokens), pa.int64()),
                    "base_score": pa.array(base, pa.float64()), "score": pa.array(score, pa.float64())})

    return slices.select("slice", "doc_ids", "held", "lengths", "codes").join(tables, "slice", "left").mapInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
