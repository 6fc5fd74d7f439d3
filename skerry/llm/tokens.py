"""Token ids of many texts at once, by the public byte-level vocabularies.

The vocabularies' pattern always begins a new match at a space before a character that is not
white space, so a text can be cut there and each distinct part be encoded once. Texts in which a
space stands before white space or at the end are encoded whole. The encoder of a single part or
text is a parameter; the default has the library calls."""

from __future__ import annotations

import array
import base64
import os
import re
from collections.abc import Callable, Sequence
from functools import lru_cache
from itertools import chain, islice
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from skerry.llm.text import ragged

if TYPE_CHECKING:
    import tiktoken

#: Parts remembered by a worker at most, in two halves: when the newer is full, the older is forgotten. Results are the same.
REMEMBERED = 250_000
#: A space before white space or at the end of the text.
UNCUT = " (?:[ \\t-\\r\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200b}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]|\\z)"


class PartEncoder:
    """ids(texts): flat ids and the number of ids of each text. encode_all: ids of each of many strings."""

    def __init__(self, encode_all: Callable[[list[str]], list[list[int]]], remembered: int = REMEMBERED):
        self.encode_all, self.half, self.newer, self.older = encode_all, remembered // 2, {}, {}

    def _parts(self, parts: list[str], remember: bool) -> list[bytes]:
        met = {p: self.newer.get(p) or self.older.get(p) for p in parts}
        missing = [p for p, ids in met.items() if ids is None]
        for part, ids in zip(missing, self.encode_all(missing), strict=True):
            met[part] = array.array("I", ids).tobytes()
        if remember:
            if len(self.newer) + len(missing) > self.half:
                self.older, self.newer = self.newer, {}
            self.newer.update(islice(met.items(), self.half - len(self.newer)))
        return [met[p] for p in parts]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "")
        uncut = np.asarray(pc.match_substring_regex(texts, UNCUT), dtype=bool)
        lists = pc.split_pattern(pc.if_else(pa.array(uncut), "", texts), " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
        offsets = offsets - offsets[0]
        first = flat.take(pa.array(offsets[:-1])).to_pylist()
        for i in np.flatnonzero(uncut).tolist():
            first[i] = texts[i].as_py()
        coded = flat.dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        inner = np.ones(len(codes), dtype=bool)
        inner[offsets[:-1]] = False
        used = np.zeros(len(coded.dictionary), dtype=bool)
        used[codes[inner]] = True
        place = np.cumsum(used) - 1
        parts = [" " + p for p in coded.dictionary.filter(pa.array(used)).to_pylist()]
        codes[inner] = place[codes[inner]]
        codes[offsets[:-1]] = len(parts) + np.arange(len(first))
        found = self._parts(parts, True) + self._parts(first, False)  # whole texts and openings rarely recur
        lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        values = np.frombuffer(b"".join(found), dtype=np.uint32)
        each = lengths[codes]
        ids = values[ragged((np.cumsum(lengths) - lengths)[codes], each)]
        before = np.concatenate([[0], np.cumsum(each)])
        return ids, np.diff(before[offsets])


class FlatEncoder:
    """As PartEncoder, with the ids of all remembered parts side by side in one array.

    Texts that hold one of the strings `whole` are encoded whole, like those with a space before
    white space. When more than `remembered` parts are known, all are forgotten. `encode_parts`, if
    given, has flat ids and the number of ids of parts that begin with a space before a character
    that is not white space; others go through `encode_all`."""

    def __init__(self, encode_all: Callable[[list[str]], list[list[int]]], whole: Sequence[str] = (), remembered: int = REMEMBERED,
                 encode_parts: Callable[[list[str]], tuple[np.ndarray, np.ndarray]] | None = None):
        self.encode_all, self.remembered, self.encode_parts = encode_all, remembered, encode_parts or self._encoded
        self.uncut = "|".join([UNCUT, *[re.escape(w) for w in whole]])
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _encoded(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = self.encode_all(strings)
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.uint32, int(lengths.sum())), lengths

    def _numbers(self, parts: list[str]) -> np.ndarray:
        """The place of each part among the known; unknown ones are encoded and join them."""
        if len(self.known) > self.remembered:
            self._forget()
        get = self.known.get
        numbers = np.fromiter((get(p, -1) for p in parts), np.int64, len(parts))
        new = np.flatnonzero(numbers < 0)
        if len(new):
            fresh, first = [parts[i] for i in new.tolist()], len(self.known)
            ids, lengths = self.encode_parts(fresh)
            self.flat, self.lengths = np.concatenate([self.flat, ids]), np.concatenate([self.lengths, lengths])
            numbers[new] = np.arange(first, first + len(fresh))
            self.known.update(zip(fresh, range(first, first + len(fresh)), strict=True))
        return numbers

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "")
        uncut = np.asarray(pc.match_substring_regex(texts, self.uncut), dtype=bool)
        lists = pc.split_pattern(pc.if_else(pa.array(uncut), "", texts), " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
        offsets = offsets - offsets[0]
        openings = flat.take(pa.array(offsets[:-1])).to_pylist()  # no space before; these and whole texts rarely recur
        for i in np.flatnonzero(uncut).tolist():
            openings[i] = texts[i].as_py()
        coded = flat.dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        inner = np.ones(len(codes), dtype=bool)
        inner[offsets[:-1]] = False
        used = np.zeros(len(coded.dictionary), dtype=bool)
        used[codes[inner]] = True
        place = np.zeros(len(used), np.int64)
        place[used] = self._numbers([" " + p for p in coded.dictionary.filter(pa.array(used)).to_pylist()])
        opening_ids, opening_lengths = self._encoded(openings)
        codes = place[codes]
        codes[offsets[:-1]] = len(self.lengths) + np.arange(len(openings))
        lengths, values = np.concatenate([self.lengths, opening_lengths]), np.concatenate([self.flat, opening_ids])
        each = lengths[codes]
        ids = values[ragged((np.cumsum(lengths) - lengths)[codes], each)]
        before = np.concatenate([[0], np.cumsum(each)])
        return ids, np.diff(before[offsets])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def token_sizes(ranks: dict[bytes, int]) -> np.ndarray:
    """The number of bytes of every token, by rank."""
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    sizes[list(ranks.values())] = [len(t) for t in ranks]
    return sizes


def encode_together(parts: list[str], fast: tiktoken.Encoding, sizes: np.ndarray, other: Callable[[str], list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids and the number of ids of parts that begin with a space before a character that is not
    white space. Those in Latin script go through `fast`, whose tokens have so many bytes, one after
    the other as one text: a match begins with each of them."""
    latin = np.fromiter((p.isascii() or max(p) < "ɐ" for p in parts), bool, len(parts))
    together = "".join(p for p, own in zip(parts, latin.tolist(), strict=True) if own)
    others = [other(parts[i]) for i in np.flatnonzero(~latin).tolist()]
    coded = np.array(fast.encode_ordinary(together), np.uint32)
    ends = np.cumsum(np.asarray(pc.binary_length(pa.array(parts, pa.string())), np.int64)[latin])
    lengths = np.zeros(len(parts), np.int64)
    lengths[latin] = np.diff(np.searchsorted(np.cumsum(sizes[coded]), ends) + 1, prepend=0)
    lengths[~latin] = [len(o) for o in others]
    ids, own = np.empty(int(lengths.sum()), np.uint32), np.repeat(latin, lengths)
    ids[own], ids[~own] = coded, list(chain.from_iterable(others))
    return ids, lengths


@lru_cache(maxsize=2)
def library_encoder(vocabulary: str, ranks: str, pattern: str) -> FlatEncoder:
    """By the tokenizers file `vocabulary` as the library encodes without special tokens around a
    text: strings of added tokens inside a text are those tokens, and texts with one are encoded
    whole by the library. Other parts in Latin script go through the rank file `ranks`."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tiktoken
    from tokenizers import Tokenizer

    tokens = read_ranks(ranks)
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=tokens, special_tokens={})
    sizes = token_sizes(tokens)
    slow = Tokenizer.from_file(vocabulary)
    added = [token.content for token in slow.get_added_tokens_decoder().values()]

    def encode(text: str) -> list[int]:
        if (text.isascii() or max(text) < "ɐ") and not any(a in text for a in added):
            return fast.encode_ordinary(text)
        return slow.encode(text, add_special_tokens=False).ids

    def other(text: str) -> list[int]:
        return slow.encode(text, add_special_tokens=False).ids

    return FlatEncoder(lambda strings: [encode(s) for s in strings], added, encode_parts=lambda parts: encode_together(parts, fast, sizes, other))


def public_library_encoder() -> FlatEncoder:
    """The 50k byte-level vocabulary of the public tokenizers, with its added tokens."""
    import public_tokenizers as public

    return library_encoder(public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
