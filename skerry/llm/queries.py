"""The registered queries of this folder: each operator over its whole table, and the result's digests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm import (
    alignment, ann, bpe, lm, neardup, packing, pii, prefixtrie, quality, sharding, simple8b, substrings, urls,
)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return lm.score_texts(documents(spark, sf_dir), number % 7 == 2)


def minhash_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


def stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleaved(documents(spark, sf_dir)).withColumn("grown_shard", F.lit(None).cast("int"))


def divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "class_distance", "common_distance")


#: Host, path, verdict.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urls.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


URL_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut),
rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
judged AS (
  SELECT page_id, host, path, (SELECT max_by(struct_pack(r := h || p, v := v), length(h || p)) FROM rules
    WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS best FROM parts)
SELECT page_id, host, path, best.r AS rule, coalesce(best.v, 'allow') AS verdict FROM judged
"""


def bpe_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    ranks = public.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.decode_ids(bpe.encode_texts(documents(spark, sf_dir), ranks, public.PATTERN), ranks)
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir)).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def _digest(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def crf_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(documents(spark, sf_dir))
    kinds = F.col("base.kind")
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(_digest("base").cast("binary"), 256).alias("base_sha256"), _digest("spans").alias("spans"))


def simple8b_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.write_and_read(documents(spark, sf_dir)).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def super_kmer_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


REPEATS_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (
  SELECT r, doc_id, i, md5(array_to_string(list_slice(words, i, i + 49), ' ')) AS k
  FROM d, unnest(range(1, len(words) - 48)) AS t(i)),
firsts AS (SELECT k, min(doc_id) AS least FROM windows GROUP BY k),
gone AS (
  SELECT DISTINCT r, i + j AS p FROM windows JOIN firsts USING (k), unnest(range(50)) AS t(j) WHERE least < doc_id),
places AS (SELECT r, list(p) AS ps, count(*) AS n FROM gone GROUP BY r),
words AS (SELECT d.r, i, d.words[i] AS w FROM d JOIN places USING (r), unnest(range(1, len(d.words) + 1)) AS t(i)),
kept AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone ON words.r = gone.r AND words.i = gone.p GROUP BY r)
SELECT doc_id, len(words) AS n_words, coalesce(n, 0) AS n_removed,
       sha256(CASE WHEN n IS NULL THEN array_to_string(words, ' ') ELSE coalesce(kept.text, '') END) AS kept_sha256
FROM d LEFT JOIN places USING (r) LEFT JOIN kept USING (r)
"""


def merge_asof_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digested(text: Column) -> Column:
        digest = F.when(text["n_a"] > 0, F.sha2(text["groups"].cast("binary"), 256)).otherwise("")
        return F.struct(*[text[c].alias(c) for c in ("doc_id", "n_a", "n_b", "n_groups")], digest.alias("groups_sha256"))

    slices = alignment.align_slices(documents(spark, sf_dir)).withColumn("texts", F.transform("texts", digested))
    return alignment.count_links(slices)


def splitter_skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("turn_digest")


TRIE_SQL = r"""
WITH RECURSIVE t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i,
         struct_pack(k := sha256(coalesce(role, '') || chr(0) || coalesce(text, '')), b := strlen(coalesce(text, ''))) AS turn
  FROM conversations WHERE conv_id IS NOT NULL),
-- crc32 by bits: the register after each digit of the id, eight shifts a byte.
ids AS (SELECT DISTINCT conv_id, conv_id::VARCHAR AS s FROM t),
crc(conv_id, s, step, reg) AS (
  SELECT conv_id, s, 0, 4294967295::BIGINT FROM ids
  UNION ALL
  SELECT conv_id, s, step + 1,
         CASE WHEN (CASE WHEN step % 8 = 0 THEN xor(reg, ascii(s[step // 8 + 1])::BIGINT) ELSE reg END) & 1 = 1
              THEN xor((CASE WHEN step % 8 = 0 THEN xor(reg, ascii(s[step // 8 + 1])::BIGINT) ELSE reg END) >> 1, 3988292384::BIGINT)
              ELSE (CASE WHEN step % 8 = 0 THEN xor(reg, ascii(s[step // 8 + 1])::BIGINT) ELSE reg END) >> 1 END
  FROM crc WHERE step < 8 * length(s)),
h AS (SELECT conv_id, xor(reg, 4294967295::BIGINT) % 9 AS h FROM crc WHERE step = 8 * length(s)),
rebuilt AS (
  SELECT h.conv_id, t.i, t.turn FROM h JOIN t ON t.conv_id = h.conv_id - h.conv_id % 5 AND t.i <= h.h
  UNION ALL
  SELECT h.conv_id, t.i + 1000000, t.turn FROM h JOIN t USING (conv_id) WHERE t.i > h.h),
paths AS (
  SELECT h.conv_id, coalesce(list(turn.k ORDER BY i) FILTER (i IS NOT NULL), []) AS ks, coalesce(list(turn.b ORDER BY i) FILTER (i IS NOT NULL), []) AS bs
  FROM h LEFT JOIN rebuilt USING (conv_id) GROUP BY h.conv_id),
members AS (
  SELECT conv_id, d AS depth, md5(array_to_string(ks[1:d], ' ')) AS node, CASE WHEN d > 0 THEN md5(array_to_string(ks[1:d - 1], ' ')) END AS up,
         CASE WHEN d > 0 THEN bs[d] ELSE 0 END AS b, len(ks) = d AS ends
  FROM paths, unnest(range(len(ks) + 1)) AS u(d)),
nodes AS (
  SELECT node, depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(b) AS b,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM members GROUP BY node, depth),
sized AS (
  SELECT n.*, (SELECT count(*) FROM nodes c WHERE c.up = n.node AND c.depth = n.depth + 1) AS n_children FROM nodes n),
above AS (
  SELECT DISTINCT s.node, s.depth, s.n_children, s.n_convs, s.b, m.node AS top, m.depth AS top_depth
  FROM sized s JOIN members own ON own.node = s.node AND own.depth = s.depth AND own.conv_id = s.conv_id
  JOIN members m ON m.conv_id = own.conv_id AND m.depth <= s.depth),
sums AS (
  SELECT top, top_depth, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * b) AS saved_tokens FROM above GROUP BY top, top_depth)
SELECT s.conv_id, s.depth, p.conv_id AS parent_conv_id, s.n_convs, s.n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, s.ends_sha256
FROM sized s JOIN sums ON top = s.node AND top_depth = s.depth LEFT JOIN nodes p ON p.node = s.up AND p.depth = s.depth - 1
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hmm_scores": hmm_scores,
    "op2_minhash_multi_index": minhash_multi_index,
    "op3_stratified_shards": stratified_shards,
    "op4_divergence_rules": divergence_rules,
    "op5_url_rules": url_rules,
    "op6_bpe_replay": bpe_replay,
    "op7_squares_packing": squares_packing,
    "op8_projection_forest": projection_forest,
    "op9_crf_spans": crf_spans,
    "op10_simple8b_files": simple8b_files,
    "op11_super_kmer_repeats": super_kmer_repeats,
    "op12_merge_asof_alignment": merge_asof_alignment,
    "op13_splitter_skeleton": splitter_skeleton,
}
SQL = {"op5_url_rules": URL_SQL, "op11_super_kmer_repeats": REPEATS_SQL, "op13_splitter_skeleton": TRIE_SQL}
