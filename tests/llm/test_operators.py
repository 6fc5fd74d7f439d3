"""Each operator against brute force on small tables with nulls, empty texts, ties, repeats and clashing columns."""

import base64
import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skerry.llm import ann, bpe, components, lm, neardup, packing, pii, quality, sharding, simple8b, urls
from skerry.llm.queries import QUERIES, URL_SQL

SMALL = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, shard string, verdict int, component_id int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def rows(spark):
    real = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    texts = real + [None, "", "  \n ", "one", "One", "a b c", real[0], real[0], "é ü  ñ \u00a0 x", "😀 <|endoftext|> tab\tx ",
                    "long " * 3000 + "end", "x" * 5000, "1 " * 700, "mail a.b@c.d.com or +1 (234) 555-7712, card 4111 1111 1111 1111, ip 1.2.3.4"]
    return [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or ""), "x", 1, 2) for i, t in enumerate(texts)] + [(5, real[5], "en", "s1", 1, "x", 1, 2)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def token_ids():
    import public_tokenizers as public
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def test_simple8b_round_trip(spark, docs, rows, empty):
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0, np.uint64), np.zeros(10_000, np.uint64), rng.integers(0, 50_257, 9_000).astype(np.uint64),
                np.array([1, 2 ** 64 - 1, 0, 2 ** 60, 2 ** 60 - 1, 2 ** 32], np.uint64)):
        packed, blocks = simple8b.pack(ids)
        assert (simple8b.unpack(packed) == ids).all()
        for b in range(len(blocks)):
            part = ids[b * simple8b.BLOCK:(b + 1) * simple8b.BLOCK]
            assert (simple8b.unpack_block(packed, blocks, b) == part).all()
    encode, start, wanted = token_ids(), 0, []
    for doc_id, text, *_ in sorted(rows, key=lambda r: r[0]):
        ids = np.array([*encode(text), 2], "<u4")
        wanted.append((doc_id, start, len(ids), ids.tobytes()))
        start += len(ids)
    found = sorted((r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in simple8b.write_and_read(docs).collect())
    assert found == wanted
    assert simple8b.write_and_read(empty).isEmpty()


def test_packing(docs, rows, empty):
    encode, sequences, whole = token_ids(), defaultdict(int), defaultdict(list)
    found = packing.pack_documents(docs).collect()
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sequences[r.sequence_id] and r.length * 4 == len(r.ids) > 0
        sequences[r.sequence_id] += r.length
        whole[r.doc_id].append((r.start, bytes(r.ids)))
    assert max(sequences.values()) <= packing.WINDOW
    assert sum(v < packing.WINDOW for v in sequences.values()) <= docs.rdd.getNumPartitions()
    for doc_id, text, *_ in rows:
        copies = 2 if doc_id == 5 else 1
        assert len(b"".join(b for _, b in whole[doc_id])) == copies * 4 * (len(encode(text)) + 1)
        if copies == 1:
            assert b"".join(b for _, b in sorted(whole[doc_id])) == np.array([*encode(text), 0], "<u4").tobytes()
    assert packing.pack_documents(empty).isEmpty()


def test_merge_replay(docs, rows, empty):
    import public_tokenizers as public
    import tiktoken

    path = public.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("t", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    wanted = sorted((r[0], np.array(library.encode_ordinary(r[1] or ""), "<u4").tobytes(), (r[1] or "").encode()) for r in rows)
    found = bpe.decode_ids(bpe.encode_texts(docs, path, public.PATTERN), path).collect()
    assert sorted((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in found) == wanted
    assert bpe.decode_ids(bpe.encode_texts(empty, path, public.PATTERN), path).isEmpty()
    replay = bpe.MergeReplay(ranks)
    some = [bytes(np.random.default_rng(i).integers(97, 101, 30).astype(np.uint8)) for i in range(50)]
    assert replay.encode(some) == [replay.alone(m) for m in some]


def test_sharding(docs, rows, empty):
    by = defaultdict(list)
    for r in rows:
        text = (r[1] or "").encode()
        by["" if r[3] is None else "=" + r[3]].append((hashlib.md5(f"42:{r[0]}".encode()).hexdigest(), r[0], zlib.crc32(text), len(text) + 1))
    order = sorted(((2 * k + 1) / (2 * len(v)), s, k, *x[1:]) for s, v in by.items() for k, x in enumerate(sorted(v)))
    n, wanted, at = len(order), [], 0
    for shard in range(16):
        for slot in range(n // 16 + (shard < n % 16)):
            wanted.append((order[at][3], order[at][5], order[at][4], shard, slot))
            at += 1
    found = sharding.interleaved(docs).collect()
    assert sorted((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in found) == sorted(wanted)
    assert sharding.interleaved(empty).isEmpty()


def test_quality(docs, rows, empty):
    found = quality.judged(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        w, seen, covered = words(r.text), defaultdict(list), set()
        for i in range(len(w) - 2):
            seen[tuple(w[i:i + 3])].append(i)
        for at in seen.values():
            if len(at) > 1:
                covered |= {i + j for i in at for j in range(3)}
        lines = [x for x in (r.text or "").split("\n") if words(x)]
        wanted = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r.text or "")), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == wanted
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.base_failed and r.kept)
        assert r.verdict == 1 and r.shard == "x"
    assert quality.judged(empty).isEmpty()


def test_distance_is_jensen_shannon(spark):
    rng = np.random.default_rng(3)
    p, q = rng.dirichlet(np.ones(5)), rng.dirichlet(np.ones(5))
    m = (p + q) / 2
    wanted = np.sqrt(0.5 * (p * np.log2(p / m)).sum() + 0.5 * (q * np.log2(q / m)).sum())
    found = spark.range(1).select(quality.distance(F.array(*map(F.lit, p.tolist())), q.tolist())).first()[0]
    assert abs(found - wanted) < 1e-12


def test_labelled_documents(spark):
    """Rules keep nearly all good documents and drop nearly all bad ones."""
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    found = quality.judged(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    good = [r.kept for r in found if labels.get(r.doc_id) == 1 and not r.base_failed]
    bad = [r.kept for r in found if labels.get(r.doc_id) == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.1


def test_verdicts_do_not_depend_on_the_table(spark):
    """A third of all rows being copies of one bad text, without listed words or with some, changes no verdict."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    wanted = {r.doc_id: r.kept for r in quality.judged(docs).collect()}
    assert not wanted[67] and not wanted[101]
    for bad in (67, 101):
        copies = docs.where(F.col("doc_id") == bad).crossJoin(spark.range(len(wanted) // 2)).select((F.col("id") + 10 ** 6).alias("doc_id"), "text")
        found = {r.doc_id: r.kept for r in quality.judged(docs.unionByName(copies)).collect()}
        assert not any(found[i] for i in found if i >= 10 ** 6)
        assert {i: kept for i, kept in found.items() if i < 10 ** 6} == wanted
    assert not quality.judged(docs.where("doc_id = 67")).first().kept


def test_references_weigh_each_text_once(spark):
    good = spark.createDataFrame([(0, "the " * 50 + "word " * 50), (1, "the " * 25 + "word " * 75), (1, "the " * 25 + "word " * 75),
                                  (2, "###### " * 100)], "doc_id long, text string")
    found = quality.references(quality.measured(good))
    assert set(found) == {"en"} and abs(found["en"]["common"][0] - 0.375) < 1e-12
    assert quality.measured(good).where("language IS NULL").count() == 1
    for name, own in quality.REFERENCES.items():
        assert len(own["common"]) == len(quality.COMMON_WORDS[name].split()) + 1 and len(own["classes"]) == len(quality.CLASSES) + 1
        assert all(abs(sum(shares) - 1) < 1e-9 for shares in own.values())


def test_urls(spark, rows):
    pages = [(i, u, 0) for i, u in enumerate([None, "", "no scheme", "http://", "HTTP://A.Example.ORG/en/1x?y", "x://example.org", "x://example.org/es/#",
             "x://notexample.org/es/", "a://b.com/fr/://c", "a://com/de/", "x://example.org/en/2"] + ["x://example.org/en/1"] * 3)]
    rules = spark.createDataFrame([("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
                                   ("com", "/fr/", "allow"), ("com", "/de/", "block"), (None, "/", "block")], "host string, path string, verdict string")
    df = spark.createDataFrame(pages, "page_id long, url string, verdict int")
    duckdb = pytest.importorskip("duckdb").connect()
    duckdb.execute("CREATE TABLE pages AS SELECT * FROM (VALUES " + ", ".join(
        f"({i}, {'NULL' if u is None else chr(39) + u + chr(39)})" for i, u, _ in pages) + ") AS t(page_id, url)")
    found = urls.judge(df, rules).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, duckdb.execute(URL_SQL).fetchall()))
    assert urls.judge(df.where("false"), rules).isEmpty()
    assert {r.verdict for r in urls.judge(df, rules.where("false")).collect()} == {"allow"}


def links(sets, percent=80):
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_near_duplicates(spark, rows, empty):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 500, 130)]
    texts = [r[1] for r in rows[:-1]]
    for _ in range(150):  # copies at similarities on both sides of the bound
        own = list(base)
        for at in rng.integers(0, len(own), rng.integers(1, 6)):
            own[at] = f"x{rng.integers(0, 10 ** 6)}"
        texts.append(" ".join(own))
    sets = {}
    for i, t in enumerate(texts):
        w = words((t or "").translate(LOWER))
        sets[i] = {tuple(w[k:k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} - {()}
    df = spark.createDataFrame([*enumerate(texts), (5, texts[5])], "doc_id long, text string").withColumn("id", F.lit(1))
    found = neardup.near_duplicates(df).collect()
    wanted = links(sets)
    assert len(found) == len(texts) + 1
    assert {r.doc_id: r.component_id for r in found} == wanted
    assert all(r.n_shingles == len(sets[r.doc_id]) and r.kept == (r.doc_id == r.component_id) for r in found)
    assert neardup.near_duplicates(empty).isEmpty()


def test_near_duplicates_of_a_document_with_several_texts(spark):
    """Doc 5 has three texts, with a near copy of each; the copy of one of them has a copy of a smaller id."""
    whole = [[f"t{t}w{i}" for i in range(80)] for t in range(3)]
    near = [" ".join([*own[:-1], "other"]) for own in whole]
    rows = [(5, " ".join(own)) for own in whole] + list(zip((9, 12, 14), near, strict=True))
    rows += [(2, near[1]), (20, "alone"), (21, None), (7, " ".join(whole[2])), (30, "x"), (30, "y")]
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == len(rows)
    wanted = {**{i: 2 for i in (2, 5, 7, 9, 12, 14)}, 20: 20, 21: 21, 30: 30}
    assert {(r.doc_id, r.component_id) for r in found} == set(wanted.items())
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_chunk_keys_leave_no_pair_out():
    keys = neardup.chunk_keys(96, 38, 1)
    rng = np.random.default_rng(2)
    for _ in range(200):
        wrong = set(rng.choice(96, 38, replace=False).tolist())
        assert any(not wrong & set(key) for key in keys)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 99), (99, 98), (200, 200), (7, 300)]
    found = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 300: 0, 98: 98, 99: 98, 100: 98}


def test_forward_is_exact():
    rng = np.random.default_rng(4)
    model = lm.Hmm(rng.dirichlet(np.ones(3), 2), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(4), 3).T)
    symbols = rng.integers(0, 4, 11)
    starts, lengths = np.array([0, 5, 5]), np.array([5, 0, 6])
    found = lm.log_likelihood(model, symbols, starts, lengths)
    for n in (0, 2):
        total = 0.0
        for path in np.ndindex(*[3] * lengths[n]):
            p = model.start[0][path[0]]
            for t, s in enumerate(path):
                p *= model.emit[symbols[starts[n] + t], s] * (model.move[path[t - 1], s] if t else 1)
            total += p
        assert abs(found[n] - np.log10(total)) < 1e-9
    start, move, emit = lm.expected_counts(model, symbols, starts[[0, 2]], lengths[[0, 2]], np.zeros(2, np.int64))
    assert abs(start.sum() - 2) < 1e-9 and abs(move.sum() - 9) < 1e-9 and abs(emit.sum() - 11) < 1e-9


def test_scores(spark, docs, rows, empty):
    held = F.col("doc_id") % 3 == 0
    found = lm.score_texts(docs, held, rounds=2).collect()
    tokens = [(r[0], [*words((r[1] or "").translate(LOWER)), None]) for r in rows]
    counts = defaultdict(int)
    for i, own in tokens:
        if i % 3:
            for w in own:
                counts[w] += 1
    n, v, by = sum(counts.values()), len(counts), dict(tokens)
    assert len(found) == len(rows)
    for r in found:
        own = by[r.doc_id]
        base = sum(np.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in own)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(w in counts for w in own), n)
        assert abs(r.base_score - base) < 1e-9 * max(1, abs(base)) and np.isfinite(r.score) and r.score < 0
    assert lm.score_texts(empty, held).isEmpty()
    alone = lm.score_texts(docs, F.lit(True)).collect()
    assert {r.base_score for r in alone} == {0.0} and {r.train_tokens for r in alone} == {0}


def test_scores_beat_counts_on_held_out_texts(spark):
    found = QUERIES["op1_hmm_scores"](spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert found[0] > found[1]


def _nearest_hits(found, data, asked, k=10):
    """How many of the true neighbours of `asked` were found; ranks, order and distances are checked."""
    by, hits = defaultdict(list), 0
    for r in found:
        by[r.query_id].append(r)
    for q, own in ((q, sorted(by[q], key=lambda r: r["rank"])) for q in asked):
        distance = np.sqrt(((data - data[q]) ** 2).sum(axis=1))
        distance[q] = np.inf
        assert [r["rank"] for r in own] == list(range(1, k + 1)) and [(r.score, r.vec_id) for r in own] == sorted((r.score, r.vec_id) for r in own)
        assert all(r.score == distance[r.vec_id] for r in own) and len({r.vec_id for r in own}) == k
        hits += len({r.vec_id for r in own} & set(np.lexsort((np.arange(len(data)), distance))[:k].tolist()))
    assert set(by) == set(asked)
    return hits


@pytest.mark.parametrize("settings", [{}, {"sample": 1500}, {"sample": 40}])
def test_neighbours(spark, monkeypatch, settings):
    monkeypatch.setattr(ann, "BLOCK", 40)  # common vectors in many blocks, queries in several groups
    monkeypatch.setattr(ann, "ASKED", 12)
    rng = np.random.default_rng(6)
    data = rng.normal(size=(1500, 16))
    data[100:400] = data[7]  # a common vector, and ties
    rows = [(i, v.tolist(), 0) for i, v in enumerate(data)] + [(5000, None, 0), (5001, [0.0] * 16, 0), (5002, [float("nan")] * 16, 0),
                                                               (5003, [None] * 16, 0), (None, [1.0], 0)]
    rows += rows[900:910] * 3  # repeated rows
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    asked = range(0, 1500, 50)
    found = ann.nearest(df, df.where("vec_id % 50 = 0"), **settings).collect()
    hits = _nearest_hits(found, data, asked)
    assert hits >= 0.9 * 10 * len(asked) or settings == {"sample": 40}
    assert ann.nearest(df.where("false"), df).isEmpty() and ann.nearest(df, df.where("false")).isEmpty()


def test_neighbours_of_mixed_lengths(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8 if i % 3 else 5).tolist()) for i in range(300)]
    rows += [(1000, [1.0]), (1001, [3.0]), (1002, [1e200, 1.0]), (1003, [-1e200, 1.0]), (1004, [1.0, 2.0, 3.0]), (1, [0.5] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    by = defaultdict(list)
    for r in ann.nearest(df, df.where("vec_id >= 1000 OR vec_id < 10"), k=400).collect():
        by[r.query_id].append((r.score, r.vec_id))
    for q in [*range(10), *range(1000, 1005)]:
        best = {}
        for mine in (v for i, v in rows if i == q):
            for i, v in rows:
                if i != q and len(v) == len(mine):
                    with np.errstate(over="ignore"):
                        score = float(np.sqrt(((np.array(v) - np.array(mine)) ** 2).sum()))
                    best[i] = min(best.get(i, np.inf), score)
        expected = sorted((score, i) for i, score in best.items())
        assert [i for _, i in sorted(by[q])] == [i for _, i in expected], q
        assert np.allclose([score for score, _ in sorted(by[q])], [score for score, _ in expected], rtol=1e-12)


def test_recall_with_the_parameters_of_the_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>")).collect()
    place = {r[0]: i for i, r in enumerate(sorted(rows))}
    assert sorted(place.values()) == [place[i] for i in sorted(place)] and list(place) == list(range(len(rows)))
    data = np.array([r[1] for r in sorted(rows)])
    asked = range(0, len(data), 100)
    assert _nearest_hits(QUERIES["op8_projection_forest"](spark, "/root/testdata/sf0.1").collect(), data, asked) >= 0.9 * 10 * len(asked)


def test_training_texts_are_drawn_before_they_meet(spark, monkeypatch):
    monkeypatch.setattr(pii, "SAMPLE_DOCS", 20)
    seen = []
    monkeypatch.setattr(pii, "train", lambda examples: seen.append(len(examples)))
    number = F.format_string("call 030 555 77%02d today", F.col("id") % 89)
    copies = spark.range(3000).select(F.lit(1).alias("doc_id"), F.lit("call 030 555 7713 today").alias("text"))
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), number.alias("text")).unionByName(copies)
    pii.train_on(docs)
    pii.train_on(copies)
    pii.train_on(docs.where("false"))
    own = seen[2]
    assert own < seen[0] <= own + 20 and own <= seen[1] <= own + 1


def test_patterns_and_model(spark, docs, rows, empty):
    found = {r.doc_id: r for r in pii.find_spans(docs).collect()}
    kinds = [s.kind for s in found[len(rows) - 2].base]
    assert kinds == ["email", "ip", "card", "phone"]
    assert all({tuple(s) for s in r.base} <= {tuple(s) for s in r.spans} for r in found.values())
    model = pii.train_on(docs)
    text = "ring (030) 555-7713 in 2019 at 12.5%"
    assert pii.added(model, [text], [[]]) == [[(5, 19, "phone")]]
    masked = {r.doc_id: r for r in pii.masked(docs, model).collect()}
    wanted = "mail [email] or [phone], card [card], ip [ip]"
    assert masked[len(rows) - 2].text == wanted and masked[len(rows) - 2].n_chars == len(wanted)
    assert masked[60].text is None and masked[61].text == ""
    assert pii.masked(docs, model).schema.names == docs.schema.names
    assert pii.find_spans(empty).isEmpty()


def test_viterbi_and_marginals_against_all_paths():
    rng = np.random.default_rng(8)
    labels = len(pii.LABELS)
    moves, scores = rng.normal(size=(labels, labels)), [rng.normal(size=(n, labels)) for n in (3, 1)]
    padded, lengths = pii.padded(scores)
    paths, (own, _) = pii.viterbi(moves, padded, lengths), pii.marginals(moves, padded, lengths)
    for n, score in enumerate(scores):
        value = {p: sum(score[t, s] + moves[p[t - 1] if t else 0, s] for t, s in enumerate(p)) + moves[p[-1], 0]
                 for p in np.ndindex(*[labels] * len(score))}
        assert tuple(paths[n, :len(score)]) == max(value, key=value.get)
        total = sum(map(np.exp, value.values()))
        for t in range(len(score)):
            assert abs(own[n, t, 1] - sum(np.exp(v) for p, v in value.items() if p[t] == 1) / total) < 1e-9


def test_parts_of_a_run_are_decoded_as_the_whole():
    rng = np.random.default_rng(9)
    labels = len(pii.LABELS)
    moves = np.where(pii.FORBIDDEN, -1e4, rng.normal(size=(labels, labels)))
    score = rng.normal(size=(23, labels))
    whole, length = pii.padded([score])
    path, (own, _) = pii.viterbi(moves, whole, length)[0], pii.marginals(moves, whole, length)
    for size in (1, 5, 22):
        parts = [score[low:low + size] for low in range(0, 23, size)]
        scores, lengths = pii.padded(parts)
        paths = pii.viterbi(moves, scores, lengths, *pii.ends(moves, parts, pii.most))
        found, _ = pii.marginals(moves, scores, lengths, *pii.ends(moves, parts, pii.log_sum))
        assert np.concatenate([x[:n] for x, n in zip(paths, lengths, strict=True)]).tolist() == path.tolist()
        assert np.abs(np.concatenate([x[:n] for x, n in zip(found, lengths, strict=True)]) - own[0]).max() < 1e-9


def test_number_across_word_200_of_a_run():
    moves = np.where(pii.FORBIDDEN, -1e4, 0.0)
    model = pii.Crf(np.zeros((pii.FEATURES, len(pii.LABELS))), moves)
    for word, label in (("2019", "O"), ("(030)", "B-phone"), ("555-7713", "I-phone")):
        model.weights[pii.features(word)[0], pii.LABELS.index(label)] = 10
    texts = ["2019 " * n + "(030) 555-7713" + " 2020" * 300 for n in (0, 3, 198, 199, 200, 399, 599)]
    found = pii.added(model, [*texts, "2019"], [[]] * 8)
    assert found == [[(t.index("("), t.index("(") + 14, "phone")] for t in texts] + [[]]


def test_features_of_the_whole_word():
    long = "word," * 20
    plain, number = pii.features(long + "word"), pii.features(long + "(030)555-7713")
    assert plain[0] == number[0] and plain[1] != number[1] and plain[4] != number[4] and plain[5] != number[5]
    assert pii.features("555-7713")[1:2] == pii.features("x" * 100 + "5557713")[1:2]


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    good = corpus_pipeline.keep_good(spark, docs, SMALL)
    assert good.columns == docs.columns
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in quality.judged(docs).where("kept").collect()}
    ones = corpus_pipeline.keep_one_of_each(spark, docs.unionByName(docs.limit(3)), SMALL)
    kept = [r.doc_id for r in ones.collect()]
    assert sorted(kept) == sorted({r.doc_id for r in neardup.near_duplicates(docs).where("kept").collect()})
    result = corpus_pipeline.run(spark, SMALL)
    assert result.columns == ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    assert {r.doc_id for r in result.collect()} <= {r.doc_id for r in good.collect()}


def test_pipeline_near_duplicates_by_five_words(spark):
    """Pairs on both sides of the bound, and between the measures by four and by five words."""
    texts = []
    for pair, (size, edits) in enumerate([(200, 5), (400, 9), (400, 11), (200, 2), (200, 12), (400, 8)]):
        own = [f"p{pair}w{i}" for i in range(size)]
        texts.append(" ".join(own))
        for e in range(edits):
            own[(2 * e + 1) * size // (2 * edits)] = f"p{pair}x{e}"
        texts.append(" ".join(own))
    first = {}
    for width in (4, 5):
        cut = {i: t.split() for i, t in enumerate(texts)}
        first[width] = links({i: {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} for i, w in cut.items()})
    assert [i for i in first[4] if first[4][i] != first[5][i]] == [1, 3, 5]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    found = sorted(r.doc_id for r in stage(spark, docs, SMALL).collect())
    assert found == [i for i in first[5] if first[5][i] == i]


def test_replay_in_blocks_equals_matches_alone(monkeypatch):
    import public_tokenizers as public

    from skerry.llm import bpe as operator
    from skerry.llm.tokens import read_ranks

    monkeypatch.setattr(operator, "REPLAY_BYTES", 40)
    monkeypatch.setattr(operator, "PAIRS", 30)
    matches = [w.encode() for w in ("unquestionably", " Zusammenhänge", "x" * 100, "", " 1234567", "ÅÄÖåäö", " repetitively")] * 3
    assert [m for block in operator.blocks(matches) for m in block] == matches
    replay = operator.MergeReplay(read_ranks(public.path("byte_bpe_multi_50k.tiktoken")))
    ids = replay.encode(matches)
    assert ids == [replay.alone(m) for m in matches]
    assert replay.encode(matches) == ids and replay.encode([]) == []


def test_ids_with_added_tokens_are_the_librarys():
    import public_tokenizers as public
    import pyarrow as pa
    from tokenizers import Tokenizer

    from skerry.llm.tokens import public_library_encoder

    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y z", " <|endoftext|>  ", "<|endoftext", "plain text", None, "",
             "中文 <|endoftext|>字", "a  b", "tail ", "new\nline <|endoftext|>\n", "é plain é"] * 3
    tokenizer = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    encoder = public_library_encoder()
    for _ in range(2):
        ids, lengths = encoder.ids(pa.array(texts))
        assert [list(x) for x in np.split(ids, np.cumsum(lengths)[:-1])] == want
        encoder.remembered = 0  # everything is forgotten before the next
    encoder.remembered = 250_000


def test_new_parts_are_encoded_in_one_call():
    """Only openings go one by one; parts in other scripts mix with those in Latin script."""
    import public_tokenizers as public
    import pyarrow as pa
    from tokenizers import Tokenizer

    from skerry.llm.tokens import library_encoder

    tokenizer = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    encoder, single = library_encoder.__wrapped__(public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN), []
    encode_all = encoder.encode_all
    encoder.encode_all = lambda strings: single.extend(strings) or encode_all(strings)
    texts = ["One it's\n two\tthree 中文 x1,y é", "привет wörld\n\n 123 don't", "", "a  b", None]
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    ids, lengths = encoder.ids(pa.array(texts))
    assert [list(x) for x in np.split(ids, np.cumsum(lengths)[:-1])] == want
    assert single == ["One", "привет", "", "a  b", ""]


def test_words_of_simple8b_are_chosen_at_block_ends():
    """Each word takes as many ids as fit in it and in its block."""
    rng = np.random.default_rng(2)
    for n in (1, simple8b.BLOCK - 1, simple8b.BLOCK, simple8b.BLOCK + 1, 2 * simple8b.BLOCK + 59):
        ids = rng.integers(0, 1 << 20, n).astype(np.uint64) >> rng.integers(0, 20, n).astype(np.uint64)
        want, at = [], 0
        while at < n:
            left = min(simple8b.BLOCK - at % simple8b.BLOCK, n - at)
            selector = next(s for s in range(14) if simple8b.COUNTS[s] <= left and not (
                ids[at:at + simple8b.COUNTS[s]] >> np.uint64(simple8b.BITS[s])).any())
            want.append(selector)
            at += int(simple8b.COUNTS[selector])
        packed, _ = simple8b.pack(ids)
        assert (packed >> np.uint64(60)).tolist() == want and (simple8b.unpack(packed) == ids).all()


def test_matches_are_replayed_once_for_parts_that_share_them(monkeypatch):
    import public_tokenizers as public

    path, replayed = public.path("byte_bpe_multi_50k.tiktoken"), []
    encode_matches = bpe.MergeReplay.encode
    monkeypatch.setattr(bpe.MergeReplay, "encode", lambda self, matches: replayed.extend(matches) or encode_matches(self, matches))
    encode = bpe.replay_encoder.__wrapped__(path, public.PATTERN).encode_all
    found = [list(ids) for ids in [*encode([" zyxwvut,", " qrstu"]), *encode([" zyxwvut.", " qrstu!,"])]]
    assert replayed.count(b" zyxwvut") == replayed.count(b" qrstu") == 1
    replay = bpe.MergeReplay(bpe.read_ranks(path))
    assert found == [sum(map(replay.alone, m), []) for m in (
        [b" zyxwvut", b","], [b" qrstu"], [b" zyxwvut", b"."], [b" qrstu", b"!,"])]


def test_parts_of_addresses_may_be_long():
    zeros = "0" * 6000
    assert [s for s in pii.patterns(f"{zeros}.1.1.1 {zeros}7.1.1.1 {zeros}256.1.1.1 1.1.1.{zeros}") if s[2] == "ip"] == [
        (0, 6006, "ip"), (6007, 12014, "ip"), (18025, 24031, "ip")]


def test_long_hosts_and_any_extra_column(spark):
    long = "a." * 20_000 + "example.org"
    pages = spark.createDataFrame(
        [(1, f"http://{long}/es/x", 1, 2, 3), (2, f"http://{'b.' * 30_000}net/", 1, 2, 3), (3, "http://org/", 1, 2, 3)],
        "page_id long, url string, best int, _slot int, digest int")
    rules = spark.createDataFrame([("org", "/", "allow"), ("example.org", "/es/", "block")], "host string, path string, verdict string")
    found = {r.page_id: (r.rule, r.verdict, r.best) for r in urls.judge(pages.drop("_slot"), rules).collect()}
    assert found == {1: ("example.org/es/", "block", 1), 2: (None, "allow", 1), 3: ("org/", "allow", 1)}


def test_short_matches_are_replayed_in_steps(monkeypatch):
    """All at once, as each match alone would be, in any vocabulary; only long ones position by position."""
    one_by_one, slow = [], bpe.MergeReplay._replay
    monkeypatch.setattr(bpe.MergeReplay, "_replay", lambda self, matches: one_by_one.extend(matches) or slow(self, matches))
    rng = np.random.default_rng(7)
    letters = [bytes([b]) for b in range(256)]
    for merges in ([], [b"ab", b"abc", b"bc", b"aa", b"aaa", b"aaaa", b"abcabc", b"ca"], [b"abca", b"ca", b"ab", b"bca", b"aa", b"caab"]):
        ranks = {token: rank for rank, token in enumerate(letters + merges)}
        replay = bpe.MergeReplay(ranks)
        some = [bytes(rng.integers(97, 100, n).astype(np.uint8)) for n in (1, 2, 3, 4, 7, 20, 64) for _ in range(40)] + [b"a" * 9, b"", b"a" * 65]
        assert replay.encode(some) == [replay.alone(m) if m not in ranks else [ranks[m]] for m in some]
    assert one_by_one == [b"a" * 65] * 3
