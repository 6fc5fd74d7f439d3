"""Byte-level BPE: encoding by replaying the merges over a corpus of distinct parts, and decoding."""

from __future__ import annotations

import array
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.text import pieces, text_slices
from skerry.llm.tokens import PartEncoder, read_ranks


#: Bytes of matches whose merges are replayed together, and pairs remembered from one replay to the next.
REPLAY_BYTES, PAIRS = 1 << 18, 200_000
#: Matches of up to so many bytes are replayed in steps, all at once; longer ones position by position.
STEPPED_BYTES = 64
#: Bytes of texts encoded in one go, and parts and matches remembered by a worker: replay costs more than memory of
#: them, and parts that differ share matches.
ENCODED_BYTES, PARTS, MATCHES = 2 << 20, 200_000, 400_000

#: In place of the token of a pair that makes none: above all ranks.
NONE = np.iinfo(np.int64).max


def blocks(matches: list[bytes]) -> Iterator[list[bytes]]:
    """The matches in order, in lists of about REPLAY_BYTES, one match at least."""
    start = size = 0
    for i, match in enumerate(matches):
        size += len(match)
        if size >= REPLAY_BYTES:
            yield matches[start:i + 1]
            start, size = i + 1, 0
    if start < len(matches):
        yield matches[start:]


class MergeReplay:
    """Encodes many matches of the pattern at once.

    Short matches go through the merges in steps: each step applies the merge of lowest rank of
    every match, leftmost first, so a match of n tokens has one less after it or is done.

    Longer matches lie one after the other as one array of tokens, linked to their neighbours. An
    index has, for each pair of adjacent tokens that a merge joins, the positions of its left
    token. The merge of lowest rank is applied to all its positions, which changes only the pairs
    with the two neighbours; these enter the index. In vocabularies where such a new pair can rank
    lower than the merge that made it, the match is encoded alone instead."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.byte = [ranks[bytes([b])] for b in range(256)]
        self.pair = np.full((256, 256), -1)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.pair[token[0], token[1]] = rank
        self.merged = self._byte_pairs()
        self.keys, self.made = self._joins()

    def _joins(self) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of tokens that make one (left << 32 | right, ascending), and the token."""
        get, found = self.ranks.get, {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = get(token[:cut]), get(token[cut:])
                if left is not None and right is not None:
                    found[left << 32 | right] = rank
        keys = np.fromiter(found, np.int64, len(found))
        order = np.argsort(keys)
        return keys[order], np.fromiter(found.values(), np.int64, len(found))[order]

    def _byte_pairs(self) -> dict[tuple[int, int], int]:
        return {(self.byte[a], self.byte[b]): int(self.pair[a, b]) for a, b in np.argwhere(self.pair >= 0).tolist()}

    def _merge(self, left: int, right: int) -> int:
        """The token that a pair makes, -1 for none."""
        made = self.merged.get((left, right))
        if made is None:
            made = self.merged[left, right] = self.ranks.get(self.token[left] + self.token[right], -1)
        return made

    def alone(self, match: bytes) -> list[int]:
        """One match: always the leftmost pair of lowest rank."""
        tokens = [self.byte[b] for b in match]
        while len(tokens) > 1:
            made = [self._merge(a, b) for a, b in zip(tokens, tokens[1:], strict=False)]
            best = min((m for m in made if m >= 0), default=-1)
            if best < 0:
                break
            i = made.index(best)
            tokens[i:i + 2] = [best]
        return tokens

    def encode(self, matches: list[bytes]) -> list[list[int]]:
        """The ids of each match."""
        return [ids for block in blocks(matches) for ids in self._block(block)]

    def _block(self, matches: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(matches)
        short, long = [], []
        for i, match in enumerate(matches):
            rank = self.ranks.get(match)
            if rank is not None:
                out[i] = [rank]
            elif match:
                (short if len(match) <= STEPPED_BYTES else long).append(i)
        for where, replay in ((short, self._steps), (long, self._replay)):
            if where:
                for i, ids in zip(where, replay([matches[i] for i in where]), strict=True):
                    out[i] = ids
        return out

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The tokens that pairs make, NONE for none."""
        if not len(self.keys):
            return np.full(len(left), NONE)
        pair = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.made[at], NONE)

    def _steps(self, matches: list[bytes]) -> list[list[int]]:
        """Rows are matches of as many tokens as columns, from the most down to one; every step takes
        in the matches of that many bytes. `made` has the token of each pair of neighbours."""
        out: list[list[int]] = [[]] * len(matches)
        sizes = np.fromiter(map(len, matches), np.int64, len(matches))
        byte, most = np.array(self.byte, dtype=np.int64), int(sizes.max())
        pair = np.where(self.pair < 0, NONE, self.pair)
        who, tokens, made = np.zeros(0, np.int64), np.zeros((0, most), np.int64), np.zeros((0, most - 1), np.int64)
        for n in range(most, 0, -1):
            own = np.flatnonzero(sizes == n)
            if len(own):
                data = np.frombuffer(b"".join([matches[i] for i in own.tolist()]), np.uint8).reshape(-1, n)
                who, tokens = np.concatenate([who, own]), np.concatenate([tokens, byte[data]])
                made = np.concatenate([made, pair[data[:, :-1], data[:, 1:]]])
            if n > 1:
                at = made.argmin(axis=1)
                best = made[np.arange(len(at)), at]
                go = best < NONE
            else:
                go = np.zeros(len(who), dtype=bool)
            for i, ids in zip(who[~go].tolist(), tokens[~go].tolist(), strict=True):
                out[i] = ids
            if n == 1:
                break
            who, at, best = who[go], at[go], best[go]
            row = np.arange(len(who))
            kept = np.ones((len(who), n), dtype=bool)
            kept[row, at + 1] = False
            tokens = tokens[go]
            tokens[row, at] = best
            tokens = tokens[kept].reshape(len(who), n - 1)
            kept = np.ones((len(who), n - 1), dtype=bool)
            kept[row, at] = False
            made = made[go][kept].reshape(len(who), n - 2)
            for first in (at - 1, at):
                some = np.flatnonzero((first >= 0) & (first < n - 2))
                place = first[some]
                made[some, place] = self._rank(tokens[some, place], tokens[some, place + 1])
        return out

    def _replay(self, matches: list[bytes]) -> list[list[int]]:
        if len(self.merged) > PAIRS:
            self.merged = self._byte_pairs()
        out: list[list[int]] = [[]] * len(matches)
        where = list(range(len(matches)))
        get, known = self._merge, self.merged.get
        # Position of a byte: its place among all bytes, and one free position after each match before it.
        data = np.frombuffer(b"".join([matches[i] for i in where]), np.uint8)
        lengths = np.array([len(matches[i]) for i in where], dtype=np.int64)
        owner = np.repeat(np.arange(len(where)), lengths)
        at, size = np.arange(len(data)) + owner, len(data) + len(where)
        begins = (np.cumsum(lengths) - lengths + np.arange(len(where))).tolist()
        whole = np.full(size, -1)
        whole[at] = np.array(self.byte)[data]
        tokens = whole.tolist()
        right, left = list(range(1, size + 1)), list(range(-1, size - 1))
        made_of = np.where(owner[:-1] == owner[1:], self.pair[data[:-1], data[1:]], -1)
        by_rank = np.argsort(made_of, kind="stable")[np.count_nonzero(made_of < 0):]
        ranks, cuts = np.unique(made_of[by_rank], return_index=True)
        index = dict(zip(ranks.tolist(), map(np.ndarray.tolist, np.split(at[by_rank], cuts[1:])), strict=False))
        heap, odd = list(index), set()
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            for i in sorted(index.pop(rank)):
                a = tokens[i]
                j = right[i]
                if a < 0 or j >= size:
                    continue
                b = tokens[j]
                if b < 0 or known((a, b), -1) != rank:
                    continue
                k = right[j]
                tokens[i], tokens[j], right[i] = rank, -2, k
                if k < size:
                    left[k] = i
                    c = tokens[k]
                    if c >= 0:
                        made = known((rank, c))
                        if made is None:
                            made = get(rank, c)
                        if made >= 0:
                            if made <= rank:
                                odd.add(i)
                            if made not in index:
                                index[made] = []
                                heapq.heappush(heap, made)
                            index[made].append(i)
                h = left[i]
                if h >= 0 and tokens[h] >= 0:
                    made = known((tokens[h], rank))
                    if made is None:
                        made = get(tokens[h], rank)
                    if made >= 0:
                        if made <= rank:
                            odd.add(i)
                        if made not in index:
                            index[made] = []
                            heapq.heappush(heap, made)
                        index[made].append(h)
        final = np.array(tokens, dtype=np.int64)
        ends = np.array([*begins[1:], size], dtype=np.int64)
        again = set(np.searchsorted(ends, sorted(odd), side="right").tolist()) if odd else set()
        kept = np.flatnonzero(final >= 0)
        flat, cuts = final[kept].tolist(), np.searchsorted(kept, [*begins, size]).tolist()
        for n, i in enumerate(where):
            out[i] = self.alone(matches[i]) if n in again else flat[cuts[n]:cuts[n + 1]]
        return out


class MatchMemory:
    """Ids of matches as bytes (unsigned 32-bit); unknown matches are replayed together. At most
    `remembered` stay, in two halves: when the newer is full, the older is forgotten."""

    def __init__(self, replay: MergeReplay, remembered: int = MATCHES):
        self.replay, self.half, self.newer, self.older = replay, remembered // 2, {}, {}

    def ids(self, matches: set[str]) -> dict[str, bytes]:
        newer, older = self.newer.get, self.older.get
        met = {m: newer(m) or older(m) for m in matches}
        new = [m for m, ids in met.items() if ids is None]
        for match, ids in zip(new, self.replay.encode([m.encode() for m in new]), strict=True):
            met[match] = array.array("I", ids).tobytes()
        if len(self.newer) + len(met) > self.half:
            self.older, self.newer = self.newer, {}
        self.newer.update(islice(met.items(), self.half - len(self.newer)))
        return met


@lru_cache(maxsize=2)
def replay_encoder(ranks_path: str, pattern: str) -> PartEncoder:
    """Parts of texts are cut into matches of the pattern; distinct ones are the corpus."""
    memory, find = MatchMemory(MergeReplay(read_ranks(ranks_path))), regex.compile(pattern).findall

    def encode(parts: list[str]) -> list[array.array]:
        matches = [find(p) for p in parts]
        ids = memory.ids(set(chain.from_iterable(matches)))
        return [array.array("I", ids[own[0]] if len(own) == 1 else b"".join([ids[m] for m in own])) for own in matches]

    return PartEncoder(encode, PARTS)


@lru_cache(maxsize=2)
def _token_bytes(ranks_path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ranks = read_ranks(ranks_path)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    lengths = np.array([len(t) for t in tokens], dtype=np.int64)
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(lengths) - lengths, lengths


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit) of the texts of (doc_id, text).

    One row per row: a null or empty text has no ids, repeated rows repeat, other columns are left
    out, an empty table gives no rows. No shuffle; a task holds one slice of its texts and a
    bounded memory of parts it has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = replay_encoder(ranks_path, pattern)
        for batch in batches:
            for rows in text_slices(batch, ENCODED_BYTES):
                ids, lengths = encoder.ids(rows.column("text"))
                offsets = np.concatenate([[0], np.cumsum(lengths)])
                yield pa.RecordBatch.from_pydict({
                    "doc_id": rows.column("doc_id"), "n_tokens": pa.array(lengths, pa.int64()),
                    "ids": pa.array(pieces(ids.astype("<u4"), offsets), pa.binary())})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode_ids(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """The rows of encode_texts() with `decoded`, the bytes of the ids; null ids decode to null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from skerry.llm.text import ragged

        data, starts, sizes = _token_bytes(ranks_path)
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                rows = batch.slice(low, 500)
                decoded = []
                for ids in rows.column("ids"):
                    ids = ids.as_py()
                    if ids is not None:
                        codes = np.frombuffer(ids, "<u4")
                        ids = data[ragged(starts[codes], sizes[codes])].tobytes()
                    decoded.append(ids)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(decoded, pa.binary())], [*rows.schema.names, "decoded"])

    return encoded.mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")
