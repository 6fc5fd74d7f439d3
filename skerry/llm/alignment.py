"""Alignment of two tokenizers' ids of the same texts: overlaps by merge_asof, groups, links and their counts."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.text import ragged, stored, text_slices
from skerry.llm.tokens import FlatEncoder, encode_together, read_ranks, token_sizes
from skerry.operators.joins import skew_safe_join

#: Bytes of texts that are aligned in one go, and parts remembered by a worker: both bound its memory.
ALIGNED_BYTES, REMEMBERED = 1 << 20, 150_000
#: Links of a group that are listed one by one; those of larger groups are counted by distinct ids.
LISTED = 1 << 16

#: Ids of a vocabulary at most: a pair of them is kept in 32 bits.
MOST_IDS = 1 << 16

SLICES = ("slice string, texts array<struct<doc_id long, n_a long, n_b long, n_groups long, groups string>>, pairs array<long>, "
          "holders array<int>, codes binary, times binary, n_pairs array<int>")


class Side:
    """One tokenizer: ids(texts) gives flat ids and the ids of each text; the bytes of every id."""

    def __init__(self, ids: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], entries: list[bytes]):
        self.ids = ids
        self.lengths = np.array([len(e) for e in entries], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(entries), dtype=np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.data[ragged(self.starts[ids], self.lengths[ids])]


class BothIds:
    """Ids of two sides by one encoder, which has a part's ids of side a and then those of side b,
    MOST_IDS higher: texts are cut, and parts looked up, once for both."""

    def __init__(self, encoder: FlatEncoder):
        self.encoder, self.texts, self.found = encoder, None, {}

    def ids(self, texts: pa.Array, side: str) -> tuple[np.ndarray, np.ndarray]:
        if texts is not self.texts or side not in self.found:
            ids, lengths = self.encoder.ids(pc.binary_join_element_wise("", texts, " "))
            of_a = ids < MOST_IDS
            n_a = np.diff(np.concatenate([[0], np.cumsum(of_a)])[np.concatenate([[0], np.cumsum(lengths)])])
            self.texts, self.found = texts, {"a": (ids[of_a], n_a), "b": (ids[~of_a] - MOST_IDS, lengths - n_a)}
        return self.found.pop(side)


def one_after_the_other(ids_a: np.ndarray, n_a: np.ndarray, ids_b: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each part's ids of side a and then those of side b, MOST_IDS higher, flat, and their number."""
    lengths = n_a + n_b
    start = np.cumsum(lengths) - lengths
    ids = np.empty(int(lengths.sum()), np.uint32)
    ids[ragged(start, n_a)], ids[ragged(start + n_a, n_b)] = ids_a, ids_b + MOST_IDS
    return ids, lengths


@lru_cache(maxsize=1)
def public_sides() -> tuple[Side, Side]:
    """The public byte-level vocabulary on a space and the text, and the public pieces on the text."""
    import public_tokenizers as public
    import tiktoken
    from sentencepiece import SentencePieceProcessor

    ranks = read_ranks(public.path("byte_bpe_50k.tiktoken"))
    entries = [b""] * (max(ranks.values()) + 1)
    for entry, rank in ranks.items():
        entries[rank] = entry
    fast = tiktoken.Encoding("ranks", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sizes, slow = token_sizes(ranks), []
    pieces = SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    numbers = range(pieces.get_piece_size())
    of_piece = [bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode()
                for i in numbers]

    # Pieces have the sign for a space in front only, so no merge goes on over one and parts can be encoded
    # apart. The library puts a space before each, which is the one that the part has already.
    if any("▁" in pieces.id_to_piece(i).lstrip("▁") for i in numbers):
        raise ValueError("a piece goes on over a space")

    def other(text: str) -> list[int]:
        if not slow:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            slow.append(Tokenizer.from_file(public.path("byte_bpe_50k.json")))
            slow[0].encode_special_tokens = True
        return slow[0].encode(text, add_special_tokens=False).ids

    def of_a(text: str) -> list[int]:
        return fast.encode_ordinary(text) if text.isascii() or max(text) < "ɐ" else other(text)

    def of_b(strings: list[str]) -> list[list[int]]:
        return pieces.encode([s.removeprefix(" ") for s in strings], num_threads=1)

    def encode_all(strings: list[str]) -> list[list[int]]:
        return [[*of_a(s), *[MOST_IDS + i for i in own]] for s, own in zip(strings, of_b(strings), strict=True)]

    def encode_parts(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = of_b(parts)
        n_b = np.fromiter(map(len, lists), np.int64, len(lists))
        ids_b = np.fromiter(chain.from_iterable(lists), np.uint32, int(n_b.sum()))
        return one_after_the_other(*encode_together(parts, fast, sizes, other), ids_b, n_b)

    both = BothIds(FlatEncoder(encode_all, remembered=REMEMBERED, encode_parts=encode_parts))
    return Side(lambda texts: both.ids(texts, "a"), entries), Side(lambda texts: both.ids(texts, "b"), of_piece)


def faithful(side: Side, ids: np.ndarray, lengths: np.ndarray, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which texts (bytes side by side, with their sizes) the ids' entries join to."""
    ends = np.concatenate([[0], np.cumsum(lengths)])
    filled = np.concatenate([[0], np.cumsum(side.lengths[ids])])[ends]
    same = np.diff(filled) == sizes
    chosen = np.repeat(same, lengths)
    own = side.joined(ids[chosen])
    expected = data[np.repeat(same, sizes)]
    wrong = np.concatenate([[0], np.cumsum(own != expected)])
    borders = np.concatenate([[0], np.cumsum(sizes[same])])
    same[np.flatnonzero(same)] = np.diff(wrong[borders]) == 0
    return same


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """Pairs (token_a, token_b) of (doc, token, start) whose byte ranges overlap, in order.

    Each start finds the other side's token that covers it, in both directions; `start` counts on
    over documents, so both frames are sorted by it. Tokens are numbered from 0."""
    of_a, of_b = a.rename(columns={"token": "token_a"}), b.rename(columns={"token": "token_b"})
    both = [pd.merge_asof(of_a, of_b, on="start", by="doc"), pd.merge_asof(of_b, of_a, on="start", by="doc")]
    met = np.sort(np.concatenate([m["token_a"].to_numpy(np.int64) * len(b) + m["token_b"].to_numpy(np.int64) for m in both]))
    met = met[np.diff(met, prepend=-1) != 0]
    return pd.DataFrame({"token_a": met // max(len(b), 1), "token_b": met % max(len(b), 1)})


def align(texts: pa.Array, a: Side, b: Side) -> dict[str, np.ndarray]:
    """Of texts: whether each has tokens, the ids and counts of both sides, tokens of each group and groups of each text."""
    texts = pc.fill_null(texts, "")
    given = pc.binary_join_element_wise("", texts, " ")
    sizes = np.asarray(pc.binary_length(given), dtype=np.int64)
    offsets = np.frombuffer(given.buffers()[1], dtype=np.int32)[given.offset:given.offset + len(given) + 1]
    data = np.frombuffer(given.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]] if sizes.sum() else np.zeros(0, np.uint8)
    ok = sizes > 1
    sides = []
    for side in (a, b):
        ids, lengths = side.ids(texts)
        ids = np.asarray(ids).astype(np.int64)
        sides.append((ids, lengths))
        ok &= faithful(side, ids, lengths, data, sizes)
    found = {"ok": ok}
    frames, stops = [], []
    for name, side, (ids, lengths) in zip("ab", (a, b), sides, strict=True):
        chosen = np.repeat(ok, lengths)
        found[f"ids_{name}"], found[f"n_{name}"] = ids[chosen], np.where(ok, lengths, 0)
        sizes = side.lengths[ids[chosen]]
        stops.append(np.cumsum(sizes))
        doc = np.repeat(np.arange(len(ok)), found[f"n_{name}"])
        frames.append(pd.DataFrame({"doc": doc, "token": np.arange(len(doc)), "start": stops[-1] - sizes}))
    pairs = overlaps(*frames)
    of_a, of_b = pairs["token_a"].to_numpy(), pairs["token_b"].to_numpy()
    last = stops[0][of_a] == stops[1][of_b]
    for name, of in (("a", of_a[last]), ("b", of_b[last])):
        found[f"group_{name}"] = np.diff(of, prepend=-1)
    found["n_groups"] = np.bincount(frames[0]["doc"].to_numpy()[of_a[last]], minlength=len(ok))
    return found


def links(ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Group, pair (id of a * width + id of b) and how often, of all pairs within each group."""
    first_a, first_b = np.cumsum(group_a) - group_a, np.cumsum(group_b) - group_b
    small = group_a * group_b <= LISTED
    group_of_a = np.repeat(np.arange(len(group_a)), group_a)
    listed = small[group_of_a]
    of_a, of_group = ids_a[listed], group_of_a[listed]
    each = group_b[of_group]
    pair = np.repeat(of_a * width, each) + ids_b[ragged(first_b[of_group], each)]
    out = [(np.repeat(of_group, each), pair, np.ones(len(pair), np.int64))]
    for g in np.flatnonzero(~small).tolist():
        x, times_x = np.unique(ids_a[first_a[g]:first_a[g] + group_a[g]], return_counts=True)
        y, times_y = np.unique(ids_b[first_b[g]:first_b[g] + group_b[g]], return_counts=True)
        out.append((np.full(len(x) * len(y), g), np.add.outer(x * width, y).ravel(), np.multiply.outer(times_x, times_y).ravel()))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


@lru_cache(maxsize=1)
def id_names(size: int) -> pa.Array:
    """Every id below `size` followed by a comma, then by a bar, a semicolon and nothing."""
    ids = pa.array(range(size)).cast(pa.string())
    return pa.concat_arrays([pc.binary_join_element_wise(ids, end, "") for end in (",", "|", ";", "")])


def group_texts(ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, n_groups: np.ndarray, names: pa.Array) -> pa.Array:
    """Each text's groups as `a1,a2|b1;a3|b2,b3`. `names` are those of :func:`id_names`."""
    vocabulary, total = len(names) // 4, len(ids_a) + len(ids_b)
    after = np.cumsum(group_a + group_b)
    start = after - group_a - group_b
    place_a, place_b = ragged(start, group_a), ragged(start + group_a, group_b)
    kind = np.zeros(total, dtype=np.int64)
    kind[start + group_a - 1], kind[after - 1] = 1, 2
    stop = np.cumsum(n_groups)
    kind[after[stop[n_groups > 0] - 1] - 1] = 3
    ids = np.empty(total, dtype=np.int64)
    ids[place_a], ids[place_b] = ids_a, ids_b
    flat = names.take(pa.array(kind * vocabulary + ids))
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    tokens = np.concatenate([[0], after])[np.concatenate([[0], stop])]
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(tokens, pa.int32()), flat), "")


def align_slices(docs: DataFrame, sides: Callable[[], tuple[Side, Side]] = public_sides, size: int = MOST_IDS) -> DataFrame:
    """Slices of the rows of (doc_id, text), aligned: `texts` has a struct of doc_id, n_a, n_b,
    n_groups and groups for each, `pairs` the id pairs that the slice's texts hold linked and
    `holders` how many of them do; codes, times and n_pairs list each text's pairs by their places
    in `pairs`, and how often each is linked. `size` is more than any id of either side."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (a, b), task, number = sides(), TaskContext.get().partitionId(), 0
        names = id_names(size)
        for batch in batches:
            for rows in text_slices(batch, ALIGNED_BYTES):
                found = align(rows.column("text"), a, b)
                of_group = np.repeat(np.arange(rows.num_rows), found["n_groups"]).astype(np.uint64)
                ids = [found[n] for n in ("ids_a", "ids_b", "group_a", "group_b")]
                group, pair, each = links(*ids, size)
                held, place = np.unique(of_group[group] << np.uint64(32) | pair.astype(np.uint64), return_inverse=True)
                times = np.zeros(len(held), np.int64)
                np.add.at(times, place, each)
                pairs, codes, holders = np.unique((held & np.uint64(0xFFFFFFFF)).astype(np.int64), return_inverse=True, return_counts=True)
                n_pairs = np.bincount((held >> np.uint64(32)).astype(np.int64), minlength=rows.num_rows)
                texts = pa.StructArray.from_arrays(
                    [rows.column("doc_id"), *[pa.array(found[n], pa.int64()) for n in ("n_a", "n_b", "n_groups")],
                     group_texts(*ids, found["n_groups"], names)], ["doc_id", "n_a", "n_b", "n_groups", "groups"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{task}-{number}"]), _one(texts), _one(pa.array(pairs, pa.int64())), _one(pa.array(holders, pa.int32())),
                     pa.array([codes.astype("<u4").tobytes()], pa.binary()), pa.array([times.astype("<u8").tobytes()], pa.binary()),
                     _one(pa.array(n_pairs, pa.int32()))], ["slice", "texts", "pairs", "holders", "codes", "times", "n_pairs"])
                number += 1

    if size > MOST_IDS:
        raise ValueError(f"a pair of ids is kept in 32 bits: size is {MOST_IDS} at most")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(encode, SLICES)


def count_links(slices: DataFrame, size: int = MOST_IDS) -> DataFrame:
    """The columns of `texts` of every aligned text, with n_links, n_best and count_sum.

    The slices are written once. Pairs are summed over them, an id's highest count is found, and
    both are joined back to the slices, so that a slice meets the counts of its own pairs and no
    table of all pairs is sent about."""
    slices = stored(slices, "aligned", compression="zstd")
    held = slices.select("slice", F.explode(F.arrays_zip("pairs", "holders")).alias("p")).select(
        "slice", F.col("p.pairs").alias("pair"), F.col("p.holders").alias("holders"))
    counts = held.groupBy("pair").agg(F.sum("holders").alias("count")).withColumn("a", F.expr(f"pair div {size}"))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    counts = skew_safe_join(counts, most, ["a"]).select("pair", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))
    counts = stored(counts, "pairs", compression="zstd")
    known = skew_safe_join(held.select("slice", "pair"), counts, ["pair"]).groupBy("slice").agg(
        F.sort_array(F.collect_list(F.struct("pair", "count", "best"))).alias("known"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                codes, times = np.frombuffer(batch.column("codes")[i].as_buffer(), "<u4"), np.frombuffer(batch.column("times")[i].as_buffer(), "<u8").astype(np.int64)
                ends = np.concatenate([[0], np.cumsum(np.asarray(batch.column("n_pairs")[i].values, dtype=np.int64))])
                known = batch.column("known")[i].values
                weights = [np.ones(1, np.int64), *[np.asarray(known.field(n)) if known is not None else np.zeros(0, np.int64) for n in ("best", "count")]]
                totals = [np.concatenate([[0], np.cumsum(times * (w if k == 0 else w[codes]))]) for k, w in enumerate(weights)]
                texts = batch.column("texts")[i].values
                yield pa.RecordBatch.from_arrays([texts, *[pa.array(np.diff(t[ends])) for t in totals]], ["text", "n_links", "n_best", "count_sum"])

    of_text = slices.schema["texts"].dataType.elementType
    out = slices.select("slice", "texts", "codes", "times", "n_pairs").join(known, "slice", "left").mapInArrow(
        sums, f"text {of_text.simpleString()}, n_links long, n_best long, count_sum long")
    return out.select("text.*", "n_links", "n_best", "count_sum")


def aligned(docs: DataFrame, sides: Callable[[], tuple[Side, Side]] = public_sides, size: int = MOST_IDS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups, n_links, n_best and count_sum of every row of (doc_id, text).

    Groups are cut where tokens of both sides end, as `a1,a2|b1;a3|b2,b3` in ids; all pairs across a
    group are linked. A pair's count is how many rows hold it linked; count_sum adds the counts of a
    text's links, n_best counts the links whose pair has the highest count of its id of side a.

    A null or empty text, or one that a side's entries do not join to, has no tokens: zeros and empty
    groups. Repeated rows count as documents each; a null doc_id is returned like others; other
    columns are left out; an empty table gives no rows. A text's tokens must fit into a task."""
    return count_links(align_slices(docs, sides, size), size)


def _one(values: pa.Array) -> pa.Array:
    """One row that is a list of the values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
