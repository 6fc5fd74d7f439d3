"""Substring dedup, cross-tokenizer alignment and the conversation trie against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skerry.llm import alignment, prefixtrie, substrings

SPACES = re.compile("[^\x20\x09-\x0d]+")


# Substring dedup


def without_repeats(rows, window):
    """(doc_id, n_words, n_removed, kept) by a dictionary of all windows."""
    split = [(d, SPACES.findall(t or "")) for d, t in rows]
    first = {}
    for d, w in split:
        for i in range(len(w) - window + 1):
            key = tuple(w[i:i + window])
            if d is not None:
                first[key] = min(first.get(key, d), d)
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i:i + window])] < d:
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def repeating_rows():
    rng = random.Random(3)
    passage = [f"p{i}é" for i in range(17)]
    loose = lambda n: [rng.choice("ab cd ef gh ij kl mn op qr st uv wx".split()) + str(rng.randrange(9)) for _ in range(n)]
    rows = [(None, None), (1, None), (2, ""), (3, " \n\t "), (4, "one two"), (9, " ".join(passage)), (None, " ".join(passage))]
    rows += [(20 + i, "\n".join(loose(rng.randrange(30))) + "  " + " ".join(passage) + "\t" + " ".join(loose(rng.randrange(30)))) for i in range(25)]
    rows += [(60, "same " * 1000), (61, "same " * 700 + "end"), (62, "same " * 5), (5, "x y " * 300), (70, "x y " * 40)]
    copy = " ".join(loose(60))
    rows += [(80 + i, copy) for i in range(12)] + [(80, copy), (80, "other " + copy), (80, "other " + copy), (7, copy[20:])]
    near = copy.split()
    rows += [(100 + i, " ".join(near[:3 * i] + [f"e{i}"] + near[3 * i + 1:])) for i in range(15)]
    return rows


@pytest.mark.parametrize("bucket", [substrings.BUCKET, 100, 1])
def test_repeats_equal_brute_force(spark, bucket):
    rows = repeating_rows()
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, print string, digest int").repartition(3)
    found = substrings.remove_repeats(docs, window=6, mer=3, bucket=bucket).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in found), key=repr) == without_repeats(rows, 6)
    texts = defaultdict(list)
    for d, t in rows:
        texts[d].append(SPACES.findall(t or ""))
    for r in found:
        assert sum(s.end - s.start for s in r.removed) == r.n_removed
        assert all(a.end < b.start for a, b in zip(r.removed, r.removed[1:], strict=False))
        assert any(" ".join(x for i, x in enumerate(w) if not any(s.start <= i < s.end for s in r.removed)) == r.kept for w in texts[r.doc_id])


def test_repeats_of_production_windows(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    shared = [word() for _ in range(80)]
    rows = [(i, " ".join([word() for _ in range(rng.randrange(90))] + (shared[i % 3 * 10:] if i % 2 else shared[:45]) + [word() for _ in range(40)])) for i in range(40)]
    found = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in found), key=repr) == without_repeats(rows, 50)
    assert sum(r.n_removed for r in found) > 500


def test_repeats_of_an_empty_table(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_buckets_stay_whole():
    rows = [pa.RecordBatch.from_pydict({"minimiser": pa.array(v, pa.int64()), "packed": pa.array([b"x" * 50] * len(v))})
            for v in ([1, 1, 2], [2, 2], [2, 3, 3, 3], [4], [], [4, 5])]
    parts = [p["minimiser"].to_pylist() for p in substrings.whole_buckets(iter(rows), limit=100)]
    assert sum(parts, []) == [1, 1, 2, 2, 2, 2, 3, 3, 3, 4, 4, 5]
    assert all(not set(a) & set(b) for a, b in zip(parts, parts[1:], strict=False))


# Cross-tokenizer alignment


def brute_alignment(rows):
    """Rows of (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) by the libraries as they come."""
    import public_tokenizers as public
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(c): c for c in printable} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in printable)}
    docs = []
    for d, text in rows:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
        pieces = [b.id_to_piece(i) for i in ids_b]
        bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        whole = (" " + text).encode() if text else b""
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            ids_a, ids_b, bytes_a, bytes_b = [], [], [], []
        groups, i, j, at_a, at_b, open_a, open_b = [], 0, 0, 0, 0, [], []
        while i < len(ids_a) or j < len(ids_b):
            if at_a <= at_b and i < len(ids_a):
                open_a.append(ids_a[i])
                at_a += len(bytes_a[i])
                i += 1
            else:
                open_b.append(ids_b[j])
                at_b += len(bytes_b[j])
                j += 1
            if at_a == at_b:
                groups.append((open_a, open_b))
                open_a, open_b = [], []
        docs.append((d, len(ids_a), len(ids_b), groups, Counter((x, y) for xs, ys in groups for x in xs for y in ys)))
    count = Counter(p for *_, pairs in docs for p in pairs)
    most = {}
    for (x, _), n in count.items():
        most[x] = max(most.get(x, 0), n)
    return sorted(((d, na, nb, len(g), sum(pairs.values()), sum(n for p, n in pairs.items() if count[p] == most[p[0]]),
                    sum(n * count[p] for p, n in pairs.items()),
                    ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in g)) for d, na, nb, g, pairs in docs), key=repr)


def test_alignment_equals_brute_force(spark):
    plain = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars < 4000").limit(60).collect()]
    odd = [None, "", " ", "  ", " x", "x ", "a  b", "a\tb\r\n c", "x<|endoftext|>y", "<s> </s> <unk> <0x41>", "▁a b", "a▁", "中文 字符，混合 text", "é é \U0001f600\U0001f468‍\U0001f469",
           "\x00 \x7f �", "1234567890" * 20, "aaaa" * 400, "ﬁ ½ Ⅷ", "ab " * 300, "\n\n\n", "don't I'll we've", " x　y"]
    rows = list(enumerate(plain + odd)) + [(None, "x y"), (3, plain[3]), (3, "again")]
    docs = spark.createDataFrame([(d, t, 5) for d, t in rows], "doc_id long, text string, pairs int").repartition(4)
    found = alignment.aligned(docs).collect()
    assert sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in found), key=repr) == brute_alignment(rows)


def test_alignment_of_an_empty_table(spark):
    assert alignment.aligned(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_links_of_large_groups(monkeypatch):
    rng = np.random.default_rng(5)
    group_a, group_b = np.array([1, 30, 2, 40]), np.array([3, 50, 1, 1])
    ids_a, ids_b = rng.integers(0, 9, group_a.sum()), rng.integers(0, 9, group_b.sum())

    def counted():
        found = Counter()
        for g, p, n in zip(*alignment.links(ids_a, ids_b, group_a, group_b, 100), strict=True):
            found[int(g), int(p)] += int(n)
        return found

    listed = counted()
    monkeypatch.setattr(alignment, "LISTED", 10)
    assert counted() == listed and sum(listed.values()) == int((group_a * group_b).sum())


def test_overlaps_cover_each_other():
    import pandas as pd

    a = pd.DataFrame({"doc": [0, 0, 0, 1], "token": [0, 1, 2, 3], "start": [0, 2, 5, 6]})
    b = pd.DataFrame({"doc": [0, 0, 1, 1], "token": [0, 1, 2, 3], "start": [0, 3, 6, 8]})
    found = alignment.overlaps(a, b)
    assert list(zip(found["token_a"], found["token_b"], strict=True)) == [(0, 0), (1, 0), (1, 1), (2, 1), (3, 2), (3, 3)]


# Prefix trie


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children, leaves, saved = Counter(n[:-1] for n in members if n), Counter(), Counter()
    for n, cs in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += children[n] == 0
            saved[n[:d]] += (len(cs) - 1) * len(n[-1][1].encode()) if n else 0
    out = []
    for n, cs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in cs if paths[c] == n))
        out.append((min(cs), len(n), min(members[n[:-1]]) if n else None, len(cs), children[n], leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversation_rows():
    rng = random.Random(6)
    says = lambda: rng.choice(["hi", "Grüße", "", None, "x" * 200, "more"])
    rows = [(None, 0, "user", "lost"), (3, None, "user", "no turn"), (3, 0, None, None), (3, 0, "user", "tie"), (3, 0, "user", "tie"), (3, 0, "bot", "tie")]
    for c in rng.sample(range(4, 60_000), 250):
        rows += [(c, t, rng.choice(["user", "bot"]), says()) for t in range(rng.randrange(1, 6))]
    for c in range(100_000, 400_000, 3001):  # one sequence that many share, over several chunks of ids
        rows += [(c, t, "user", f"same {t}") for t in range(12)]
    for c in range(500_000, 500_040):
        rows += [(c, t, "user", f"deep {t}" if t < 30 else f"{c % 4} {t}") for t in range(33)]
    return rows


@pytest.mark.parametrize("shards", [None, 1, 5, 40])
def test_trie_equals_brute_force(spark, shards):
    rows = conversation_rows()
    table = spark.createDataFrame([(*r, 1, b"") for r in rows], "conv_id long, turn long, role string, text string, path int, key binary").repartition(4)
    found = prefixtrie.prefix_trie(table, shards=shards).drop("turn_digest")
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute_trie(rows)


def test_trie_of_turnless_and_empty_tables(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert prefixtrie.prefix_trie(spark.createDataFrame([], kind)).collect() == []
    rows = [(c, 0, "user", "once") for c in range(41, 80) if c % 5]  # shorter than what it drops
    assert sorted((tuple(r) for r in prefixtrie.prefix_trie(spark.createDataFrame(rows, kind), shards=3).drop("turn_digest").collect()), key=repr) == brute_trie(rows)


def test_splitters_are_cut_and_bounded():
    step = prefixtrie.STEP
    paths = [bytes([a]) * step + bytes([b]) * step * 40 for a in range(20) for b in range(5)]
    borders = prefixtrie.choose_splitters(paths, 20)
    assert borders == sorted(borders) and all(len(b) <= 2 * step for b in borders) and len(borders) == 19
    assert len(prefixtrie.choose_splitters(paths, 20, most_bytes=200)) < 10


def test_turn_digest_names_the_turn(spark):
    table = spark.createDataFrame([(10, 0, "user", "hé")], "conv_id long, turn long, role string, text string")
    entry = table.select(prefixtrie.turn_entry(F.col("role"), F.col("text")).alias("e")).first().e
    node = prefixtrie.prefix_trie(table).where("depth = 1").first()
    assert entry[:32] == node.turn_digest and int(entry[32:], 16) == 3


def test_texts_are_cut_once_for_both_sides(monkeypatch):
    """Ids are those of the libraries, whole texts at a time; one memory of parts serves both sides."""
    import public_tokenizers as public
    import pyarrow as pa
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    from skerry.llm import tokens

    cuts, split = [], tokens.pc.split_pattern
    monkeypatch.setattr(tokens.pc, "split_pattern", lambda *given: cuts.append(given) or split(*given))
    library = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    pieces = SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    texts = ["one two one", "", "Ünder Größe naïve", "два слова, 漢字 kana", "a <|endoftext|> b", " leading  double\n line ", "tab\there 12345", None]
    a, b = alignment.public_sides.__wrapped__()
    for some in (texts, texts[::-1]):
        given = pa.array([t or "" for t in some])
        (ids_a, n_a), (ids_b, n_b) = a.ids(given), b.ids(given)
        wanted_a = [library.encode(" " + (t or ""), add_special_tokens=False).ids for t in some]
        wanted_b = [pieces.encode(t or "") for t in some]
        assert (n_a.tolist(), n_b.tolist()) == (list(map(len, wanted_a)), list(map(len, wanted_b)))
        assert (ids_a.tolist(), ids_b.tolist()) == (sum(wanted_a, []), sum(wanted_b, []))
    assert len(cuts) == 2
