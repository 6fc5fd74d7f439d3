"""Near-duplicates: MinHash signatures, joined by a multi-index for Hamming distance, confirmed on full sets."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skerry.llm.components import components
from skerry.llm.text import pieces, ragged, stored, text_slices, words
from skerry.operators.joins import skew_safe_join

#: Members of a key whose signatures are compared with each other in one go, and of a bundle of full sets.
BLOCK, BUNDLE = 1000, 200
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(h: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * MIX[0]
    h = (h ^ (h >> np.uint64(27))) * MIX[1]
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles of `width` words, and their offsets.

    A text of fewer words has one shingle, all of them; one without words has none."""
    codes, offsets, known = words(texts)
    table = np.array([xxhash.xxh3_64_intdigest(w.as_py()) for w in known], dtype=np.uint64)
    hashed, lengths = (table[codes] if len(table) else np.zeros(0, np.uint64)), np.diff(offsets)
    odd = np.uint64(0x9E3779B97F4A7C15)
    starts, counts = offsets[:-1], np.where(lengths >= width, lengths - width + 1, np.minimum(lengths, 1))
    at = ragged(starts, counts)
    taken = np.repeat(np.minimum(lengths, width), counts)
    h = taken.astype(np.uint64)
    for j in range(width):
        inside = taken > j
        h[inside] = mixed((h[inside] * odd) ^ hashed[at[inside] + j])
    ends = np.cumsum(counts)
    sets = [np.unique(h[a:b]) for a, b in zip(ends - counts, ends, strict=True)]
    return (np.concatenate(sets) if sets else h), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def signatures(flat: np.ndarray, offsets: np.ndarray, size: int, seed: int) -> np.ndarray:
    """For each set (of one hash at least) `size` MinHash components of 16 bits."""
    rng = np.random.default_rng(seed)
    factors, adds = rng.integers(1, 1 << 63, size, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, size, dtype=np.uint64)
    out = np.empty((len(offsets) - 1, size), dtype=np.uint16)
    for low in range(0, len(offsets) - 1, 64):
        cut = offsets[low:low + 65]
        part = flat[cut[0]:cut[-1]]
        for k in range(size):
            least = np.minimum.reduceat((part ^ adds[k]) * factors[k], cut[:-1] - cut[0])
            out[low:low + 64, k] = (mixed(least) >> np.uint64(48)).astype(np.uint16)
    return out


def chunk_keys(size: int, most: int, errors: int) -> list[tuple[int, ...]]:
    """Components that make up each key.

    Signatures that differ in `most` components at most have, if the components are cut into
    most // (errors + 1) + 1 chunks, a chunk with `errors` differences at most: else they would
    differ in more. A chunk has a key for each choice of `errors` components that may be wrong,
    made of the others."""
    chunks = np.array_split(np.arange(size), most // (errors + 1) + 1)
    return [tuple(int(c) for c in chunk if c not in wrong) for chunk in chunks
            for wrong in combinations(chunk, min(errors, len(chunk) - 1))]


def near_duplicates(docs: DataFrame, width: int = 4, percent: int = 80, size: int = 96, most: int = 38,
                    errors: int = 1, seed: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of (doc_id, text).

    Rows with equal shingle sets are one class, represented by its smallest doc_id. The classes'
    signatures of `size` components meet by the keys of chunk_keys(), which brings together every
    pair that differs in `most` components at most: at a similarity of 0.8 a pair differs in 0.2 *
    size on average, and in more than `most` of 96 with a probability near one in a million. Pairs
    are linked where 100 * intersection >= percent * union of the full sets.

    Not all pairs of a key are made. First every class is compared with one other of the least id
    that it shares a key with, then, again and again, every part of a component with the least
    component that it meets, until that links nothing more. What is left are keys whose members lie
    in different components: there all pairs of signatures across components are compared, block by
    block. For the pairs within `most`, a class is sent once to each bundle of classes that it may be
    linked with, and compared with the bundle's full sets there; a pair is never a row, and of the
    links found one for each component is kept. Pairs within a component cannot change it.

    Without words or text: n_shingles 0, linked with nothing. Rows of one doc_id are one document: they
    are returned each, linked with each other and, where their texts differ, with the partners of all of them. So a
    class's id may name several sets, which are compared one by one. Rows with a null doc_id take no part and are returned with a null component, kept;
    other columns are left out; an empty table gives no rows."""
    keys = chunk_keys(size, most, errors)

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text_slices(batch):
                flat, offsets = shingle_sets(rows.column("text"), width)
                counts = np.diff(offsets)
                full = np.flatnonzero(counts > 0)
                found = signatures(flat, np.concatenate([offsets[:-1][full], offsets[-1:]]), size, seed) if len(full) else None
                prints, signed = [None] * len(counts), [None] * len(counts)
                for i, own in enumerate(pieces(flat, offsets)):
                    prints[i] = xxhash.xxh3_128_digest(own) if own else None
                for i, row in zip(full.tolist(), found if found is not None else [], strict=True):
                    signed[i] = row.tobytes()
                yield pa.RecordBatch.from_pydict({"doc_id": rows.column("doc_id"), "n_shingles": pa.array(counts, pa.int64()),
                                                  "print": pa.array(prints, pa.binary()), "signature": pa.array(signed, pa.binary())})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = stored(texts.mapInArrow(sets_of, "doc_id long, n_shingles long, print binary, signature binary"), "signed")
    classes = stored(rows.where("print IS NOT NULL AND doc_id IS NOT NULL").groupBy("print").agg(
        F.min("doc_id").alias("id"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n")), "classes")

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column("id"), dtype=np.int64)
            data = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16).reshape(-1, size).astype(np.uint64)
            for low in range(0, len(ids), 2000):
                part = data[low:low + 2000]
                for at, components_of in enumerate(keys):
                    h = np.full(len(part), at, dtype=np.uint64)
                    for c in components_of:
                        h = mixed((h << np.uint64(16)) ^ (h >> np.uint64(48)) ^ part[:, c])
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids[low:low + 2000])], ["key", "id"])

    of_key = Window.partitionBy("key")
    met = (classes.select("id", "signature").mapInArrow(keys_of, "key long, id long")
           .withColumn("least", F.min("id").over(of_key)).withColumn("greatest", F.max("id").over(of_key))
           .where("least < greatest"))
    met = stored(met.select("key", "id", "least"), "keys")
    ids = met.select("id").distinct()

    def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                flat, offsets = shingle_sets(part.column("text"), width)
                own = pieces(flat, offsets)
                yield pa.RecordBatch.from_pydict({"print": pa.array([xxhash.xxh3_128_digest(s) for s in own], pa.binary()),
                                                  "n": pa.array(np.diff(offsets), pa.int64()), "set": pa.array(own, pa.binary())})

    # An id has a set for each of its classes, and may belong to rows of other classes too.
    wanted = classes.join(ids, "id", "left_semi").select("print", "id")
    sets = stored(texts.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")
                  .mapInArrow(full_sets, "print binary, n long, set binary").join(wanted, "print")
                  .groupBy("print").agg(F.first("id").alias("id"), F.first("n").alias("n"), F.first("set").alias("set")), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets are similar enough."""
        sized = sets.select("id", "print", "n")
        some = skew_safe_join(skew_safe_join(pairs, sized.toDF("a", "print_a", "na"), ["a"]), sized.toDF("b", "print_b", "nb"), ["b"])
        some = some.where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)").select("a", "b", "print_a", "print_b")
        some = skew_safe_join(some, sets.select(F.col("print").alias("print_b"), F.col("set").alias("set_b")), ["print_b"])
        some = skew_safe_join(some, sets.select(F.col("print").alias("print_a"), F.col("set").alias("set_a")), ["print_a"])

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                alike = np.zeros(batch.num_rows, dtype=bool)
                for i, (x, y) in enumerate(zip(batch.column("set_a"), batch.column("set_b"), strict=True)):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    alike[i] = 100 * both >= percent * (len(x) + len(y) - both)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(alike))

        return some.select("a", "b", "set_a", "set_b").mapInArrow(compare, "a long, b long")

    pairs = met.where("id <> least").groupBy("id").agg(F.min("least").alias("least")).select(F.col("least").alias("a"), F.col("id").alias("b"))
    links = stored(confirmed(pairs).unionByName(_of_one_document(rows, classes)), "confirmed")
    while True:
        labels = components(links)
        placed = skew_safe_join(met.select("key", "id"), labels, ["id"], "left").select(
            "key", "id", F.coalesce("component", "id").alias("component"))
        placed = (placed.withColumn("least", F.min(F.struct("component", "id")).over(of_key))
                  .withColumn("greatest", F.max("component").over(of_key)).where("least.component < greatest"))
        placed = stored(placed.select("key", "id", "component", "least"), "open")
        # One pair for each component: with the least component that it shares a key with.
        best = _best(placed)
        new = stored(confirmed(best.join(links, ["a", "b"], "left_anti")), "confirmed")
        if new.isEmpty():
            break
        links = links.unionByName(new)

    rest = stored(_bundled(*_across(placed, pairs, classes, size, most), sets, percent), "confirmed")
    labels = components(links.unionByName(rest))
    of_class = classes.join(labels, "id", "left").select("print", F.coalesce("component", "id").alias("component_id"))
    named = skew_safe_join(rows.drop("signature"), of_class, ["print"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return named.select("doc_id", "n_shingles", component.alias("component_id"),
                        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _of_one_document(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a < b) between the classes that one doc_id has rows in: of the least with each other one."""
    own = rows.where("print IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "print")
    several = own.groupBy("doc_id").agg(F.min("print").alias("x"), F.max("print").alias("y")).where("x <> y").select("doc_id")
    held = skew_safe_join(own.join(several, "doc_id", "left_semi").distinct(), classes.select("print", "id"), ["print"])
    held = held.select("doc_id", "id").distinct()
    least = held.groupBy("doc_id").agg(F.min("id").alias("a"))
    return skew_safe_join(held, least, ["doc_id"]).where("a < id").select("a", F.col("id").alias("b")).distinct()


def _best(placed: DataFrame) -> DataFrame:
    """For each component a pair (a < b) with the least component that it shares a key with."""
    pair = F.struct(F.col("least.component").alias("to"), F.col("least.id").alias("x"), F.col("id").alias("y"))
    best = placed.where("component > least.component").groupBy("component").agg(F.min(pair).alias("pair"))
    return best.select(F.least("pair.x", "pair.y").alias("a"), F.greatest("pair.x", "pair.y").alias("b")).distinct()


def _across(placed: DataFrame, pairs: DataFrame, classes: DataFrame, size: int, most: int) -> tuple[DataFrame, DataFrame]:
    """The members of open keys in bundles (id, component, bundle), and which of them are to be
    compared with which bundles (id, bundle): all bundles of a root of which a class with a larger id,
    in another component, differs in `most` components at most.

    A root is the least id that classes meet; a bundle has about BUNDLE of those that share it. A key's members are
    dealt into blocks; each pair of blocks is compared in one go."""
    members = placed.select("id", "component").distinct()
    rooted = skew_safe_join(members, pairs.select(F.col("b").alias("id"), F.col("a").alias("root")), ["id"], "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "id"))
    many = rooted.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BUNDLE).cast("int").alias("parts"))
    members = stored(skew_safe_join(rooted, many, ["root"]).select(
        "id", "component", "root", F.xxhash64("root", F.pmod(F.xxhash64("id"), F.col("parts"))).alias("bundle")), "members")

    counts = placed.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = skew_safe_join(placed.select("key", "id"), counts, ["key"])
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = dealt.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", "id", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    dealt = skew_safe_join(dealt, members.drop("bundle").join(classes.select("id", "signature"), "id"), ["id"])

    def compare(own: pd.DataFrame) -> Iterator[pd.DataFrame]:
        own = own.sort_values("id")
        data = np.frombuffer(b"".join(own["signature"]), np.uint16).reshape(-1, size)
        ids, component, side, root = (own[c].to_numpy() for c in ("id", "component", "block", "root"))
        within = own["i"].iloc[0] == own["j"].iloc[0]
        for x in range(len(ids) - 1):
            rest = np.flatnonzero((component[x + 1:] != component[x]) & ((side[x + 1:] != side[x]) | within)) + x + 1
            if len(rest):
                rest = rest[(data[rest] != data[x]).sum(axis=1) <= most]
                if len(rest):
                    yield pd.DataFrame({"id": ids[x], "root": np.unique(root[rest])})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:  # sorted by key and blocks: the last group may go on in the next frame
            whole = frame if held is None else pd.concat([held, frame])
            last = whole.iloc[-1]
            open_rows = ((whole["key"] == last["key"]) & (whole["i"] == last["i"]) & (whole["j"] == last["j"])).to_numpy()
            held, whole = whole[open_rows], whole[~open_rows]
            found = [f for _, own in whole.groupby(["key", "i", "j"], sort=False) for f in compare(own)]
            if found:
                yield pd.concat(found).drop_duplicates()
        if held is not None:
            yield from compare(held)

    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    near = dealt.mapInPandas(run, "id long, root long").distinct()
    return members, skew_safe_join(near, members.select("root", "bundle").distinct(), ["root"]).select("id", "bundle")


def _bundled(members: DataFrame, asked: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a < b) between the classes asked about and those of the bundles: of each class the
    least one to each component.

    The rows of a bundle come first, then, one after the other, those to compare with it; so a task
    holds one bundle, however many ask."""
    asked = stored(asked, "asked")
    full = sets.select("id", "set")
    known = members.join(asked.select("bundle").distinct(), "bundle", "left_semi").select("bundle", F.lit(0).alias("role"), "id", "component")
    asking = skew_safe_join(asked, members.select("id", "component"), ["id"]).select("bundle", F.lit(1).alias("role"), "id", "component")
    rows = skew_safe_join(known.unionByName(asking), full, ["id"]).select("bundle", "role", "id", "component", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ready = None, [], None
        for batch in batches:
            out = []
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("bundle", "role", "id", "component")]
            for bundle, role, own, component, data in zip(*columns, batch.column("set"), strict=True):
                found = np.frombuffer(data.as_buffer(), np.uint64)
                if bundle != now:
                    now, held, ready = bundle, [], None
                if role == 0:
                    held.append((own, component, found))
                    continue
                if ready is None and held:
                    lengths = np.array([len(h[2]) for h in held])
                    flat = np.concatenate([h[2] for h in held])
                    order = np.argsort(flat, kind="stable")
                    ready = (np.array([h[0] for h in held]), np.array([h[1] for h in held]), lengths,
                             flat[order], np.repeat(np.arange(len(held)), lengths)[order])
                if ready is None:
                    continue
                ids, components_of, lengths, flat, owners = ready
                first, last = np.searchsorted(flat, found, "left"), np.searchsorted(flat, found, "right")
                both = np.bincount(owners[ragged(first, last - first)], minlength=len(ids))
                alike = (100 * both >= percent * (len(found) + lengths - both)) & (components_of != component) & (ids > own)
                if alike.any():
                    nearest = pd.Series(ids[alike]).groupby(components_of[alike]).min()
                    out.extend((own, b) for b in nearest)
            yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return rows.repartition("bundle").sortWithinPartitions("bundle", "role").mapInArrow(run, "a long, b long")
