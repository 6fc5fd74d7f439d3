"""Prefix trie of conversations: shared openings as nodes, by sorted shards and a skeleton of splitters."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.llm.text import stored

#: Bytes of a turn in a path: 16 of its digest, 8 with the length of its text.
STEP = 24
#: Conversations ending at a node whose ids form one chunk: those that share conv_id >> CHUNK.
CHUNK = 12
#: Paths drawn for splitters, turns of a drawn path, and bytes of the skeleton's keys, at most.
DRAWN, DEEPEST, SKELETON_BYTES = 100_000, 4096, 16 << 20
#: Rows of a shard: LEAST_ROWS while the shards are few, MOST_ROWS then.
LEAST_ROWS, MOST_ROWS = 500, 50_000

NODES = ("skeleton boolean, key binary, parent_key binary, turn_digest string, conv_id long, depth long, parent_conv_id long, "
         "n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")


def turn_entry(role: Column, text: Column) -> Column:
    """A turn as hexadecimal digits: the digest of role and text, then the bytes of the text."""
    size = F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0")
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.concat(F.substring(F.sha2(whole.cast("binary"), 256), 1, 32), size)


def rebuilt_paths(conversations: DataFrame, cycle: int = 5, modulus: int = 9) -> DataFrame:
    """conv_id and path of every conversation, rebuilt: the first h turns of conversation
    conv_id - conv_id % cycle, then its own after its first h; h = crc32(conv_id as text) % modulus.

    Turns are ordered by turn, null first; equal ones by role, the text's first 64 characters, then
    digest. A conversation and the one it begins with are placed together, so turns move once."""
    conv, text = F.col("conv_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    role, turn = F.coalesce(F.col("role").cast("string"), F.lit("")), F.col("turn").cast("long")
    turns = conversations.select(
        (conv - conv % cycle).alias("base"), conv.alias("conv_id"),
        F.struct(turn.isNotNull().alias("known"), F.coalesce(turn, F.lit(0)).alias("turn"), role.alias("role"),
                 F.substring(text, 1, 64).alias("opening"), turn_entry(role, text).alias("entry")).alias("turn"),
    ).where("conv_id IS NOT NULL")
    whole = turns.repartition("base").groupBy("base", "conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    whole = whole.select("base", "conv_id", F.transform("turns", lambda t: t["entry"]).alias("own"))
    heads = whole.where("conv_id = base").select("base", F.slice("own", 1, modulus - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % modulus).cast("int")
    head = F.array_join(F.slice(F.coalesce("head", F.array().cast("array<string>")), F.lit(1), h), "")
    rest = F.array_join(F.slice("own", h + 1, F.greatest(F.size("own") - h, F.lit(0))), "")
    return whole.join(heads, "base", "left").select("conv_id", F.unhex(F.concat(head, rest)).alias("path"))


def common_turns(a: bytes, b: bytes) -> int:
    """Turns that two paths begin with alike."""
    n = min(len(a), len(b)) // STEP * STEP
    if a[:n] == b[:n]:
        return n // STEP
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int(np.argmax(x != y)) // STEP


def choose_splitters(drawn: list[bytes], shards: int, most_bytes: int = SKELETON_BYTES) -> list[bytes]:
    """At most shards - 1 borders between sorted paths, each cut to the turns that tell it from the
    drawn path before it. Their prefixes are the skeleton: if its keys take more than `most_bytes`,
    every second border goes until they do not."""
    drawn = sorted(set(drawn))
    places = sorted({len(drawn) * i // shards for i in range(1, shards)} - {0})
    borders = sorted({drawn[p][:(common_turns(drawn[p - 1], drawn[p]) + 1) * STEP] for p in places})
    while sum((len(b) // STEP + 1) * len(b) // 2 for b in borders) > most_bytes:
        borders = borders[1::2]
    return borders


class Shard:
    """The nodes of one shard, whose rows (path, members, least member, ids as text) come sorted.

    Open nodes are a stack; a node is finished when a path leaves it. Nodes that begin a border may
    go on in other shards: they give one row with what this shard knows of them, less what is below
    other such nodes. Children of a finished node wait for its conv_id."""

    def __init__(self, low: bytes, high: bytes):
        self.borders, self.path, self.stack = (low, high), b"", [self._node(True)]

    def _node(self, skeleton: bool) -> dict:
        return {"skeleton": skeleton, "n": 0, "least": None, "children": 0, "leaves": 0, "saved": 0, "ends": None, "waiting": []}

    def add(self, path: bytes, n: int, least: int, ids: str) -> Iterator[tuple]:
        shared = common_turns(self.path, path)
        yield from self.close(shared)
        self.path = path
        for depth in range(shared + 1, len(path) // STEP + 1):
            skeleton = self.stack[-1]["skeleton"] and any(b.startswith(path[:depth * STEP]) for b in self.borders)
            self.stack.append(self._node(skeleton))
        node = self.stack[-1]
        node["n"] += n
        node["least"] = least if node["least"] is None else min(node["least"], least)
        if node["ends"] is None:
            node["ends"] = hashlib.sha256(ids.encode())
        else:
            node["ends"].update(b"," + ids.encode())

    def close(self, depth: int) -> Iterator[tuple]:
        """Finish the open nodes below `depth`; -1 finishes the root too."""
        while len(self.stack) > depth + 1:
            node, level = self.stack.pop(), len(self.stack)
            key = self.path[:level * STEP]
            turn = key[-STEP:-8].hex() if level else None
            ends = node["ends"].hexdigest() if node["ends"] else None
            if node["skeleton"]:
                yield (True, key, None, turn, node["least"], level, None, node["n"], node["children"], node["leaves"], node["saved"], ends)
                continue
            leaves = node["leaves"] if node["children"] else 1
            saved = node["saved"] + (node["n"] - 1) * int.from_bytes(key[-8:], "big")
            row = (False, None, None, turn, node["least"], level, None, node["n"], node["children"], leaves, saved,
                   ends or hashlib.sha256().hexdigest())
            for child in node["waiting"]:
                yield (*child[:6], node["least"], *child[7:])
            above = self.stack[-1]
            above["n"] += node["n"]
            above["least"] = node["least"] if above["least"] is None else min(above["least"], node["least"])
            above["children"] += 1
            above["leaves"] += leaves
            above["saved"] += saved
            if above["skeleton"]:
                yield (*row[:2], key[:-STEP], *row[3:])
            else:
                above["waiting"].append(row)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def prefix_trie(conversations: DataFrame, cycle: int = 5, modulus: int = 9, shards: int | None = None) -> DataFrame:
    """The nodes of the trie of rebuilt conversations (see rebuilt_paths): turn_digest (hexadecimal,
    of the last turn), conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Paths of equal conversations collapse to chunks of ids first, so a sequence that very many
    conversations share is a few rows. Chunks are sorted in shards between splitter paths, drawn by
    digest. A shard finishes every node that does not begin a splitter. Those that do, the skeleton,
    of a bounded size, are summed over shards, then over the nodes below them, and give their
    children's parent_conv_id. The ids that end at a node are hashed as they stream by, since a list
    of them has no bound.

    Rows without a conv_id belong to no conversation and are left out; null role and text are empty;
    repeated turns stay; other columns are left out; an empty table has no conversations and no
    nodes. A conversation's path, 24 bytes a turn, must fit into a task."""
    spark = conversations.sparkSession
    paths = rebuilt_paths(conversations, cycle, modulus)
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    chunks = stored(paths.groupBy("path", F.shiftright("conv_id", CHUNK).alias("chunk")).agg(
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), ids.alias("ids")), "chunks")
    known = chunks.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.length("path")), F.lit(0)).alias("bytes")).first()
    if shards is None:
        most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), known["rows"] // MOST_ROWS)
        shards = max(1, min(known["rows"] // LEAST_ROWS, most, DRAWN // 20))
    drawn = min(20 * shards, DRAWN, (32 << 20) * known["rows"] // max(known["bytes"], 1))
    share = int(min(1.0, drawn / max(known["rows"], 1)) * (1 << 30))
    sample = chunks.where(F.pmod(F.xxhash64("path"), F.lit(1 << 30)) < share).select(F.substring("path", 1, DEEPEST * STEP).alias("path"))
    borders = choose_splitters([bytes(r.path) for r in sample.distinct().collect()], shards) if shards > 1 else []
    splitters = spark.sparkContext.broadcast(borders)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = [bisect_right(splitters.value, p) for p in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), *batch.columns], ["shard", *batch.schema.names])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(name, {"boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string(), "long": pa.int64()}[kind])
                            for name, kind in (c.split(" ") for c in NODES.split(", "))])
        at, open_shard, rows = None, None, []
        for batch in batches:
            for shard, path, n, least, ids in zip(*(batch.column(c).to_pylist() for c in ("shard", "path", "n", "least", "ids")), strict=True):
                if shard != at:
                    if open_shard:
                        rows.extend(open_shard.close(-1))
                    bounds = [b"", *splitters.value, b""]
                    at, open_shard = shard, Shard(bounds[shard], bounds[shard + 1])
                rows.extend(open_shard.add(path, n, least, ids))
                if len(rows) >= 10_000:
                    yield _batch(rows, schema)
                    rows = []
        if open_shard:
            rows.extend(open_shard.close(-1))
        if rows:
            yield _batch(rows, schema)

    dealt = chunks.mapInArrow(placed, "shard int, path binary, chunk long, n long, least long, ids string")
    dealt = dealt.repartition(len(borders) + 1, "shard").sortWithinPartitions("shard", "path", "chunk")
    nodes = stored(dealt.mapInArrow(walk, NODES), "nodes")
    bones = _reduced(nodes.where("skeleton"))
    above = bones.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent"))
    finished = nodes.where("NOT skeleton").join(F.broadcast(above), "parent_key", "left").withColumn(
        "parent_conv_id", F.coalesce("parent_conv_id", "parent"))
    bones = bones.withColumn("parent_key", F.when(F.col("depth") > 0, F.expr(f"substring(key, 1, length(key) - {STEP})"))).join(
        F.broadcast(above), "parent_key", "left").withColumn("parent_conv_id", F.col("parent"))
    out = ["turn_digest", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return finished.select(*out).unionByName(bones.select(*out))


def _reduced(partial: DataFrame) -> DataFrame:
    """The skeleton's nodes, whole: what shards know of a node is summed, then what is below it in
    the skeleton, by the prefixes of its key."""
    prefixes = F.explode(F.expr(f"transform(sequence(0, depth), d -> substring(key, 1, cast(d * {STEP} AS int)))")).alias("prefix")
    own = partial.groupBy("key", "depth", "turn_digest").agg(
        F.sum("n_convs").alias("n"), F.min("conv_id").alias("least"), F.sum("n_children").alias("children"),
        F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.max("ends_sha256").alias("ends"))
    direct = F.col("depth") == (F.length("prefix") / STEP).cast("long") + 1
    below = own.select(prefixes, "depth", "n", "least").groupBy("prefix").agg(
        F.sum("n").alias("n_convs"), F.min("least").alias("conv_id"), F.count_if(direct).alias("more"))
    known = own.join(below, own["key"] == below["prefix"]).withColumn("n_children", F.col("children") + F.col("more"))
    size = F.conv(F.hex(F.expr("substring(key, -8)")), 16, 10).cast("long")
    known = known.withColumns({
        "leaf": F.col("leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0),
        "save": F.col("saved") + F.when(F.col("depth") > 0, (F.col("n_convs") - 1) * size).otherwise(0)})
    sums = known.select(prefixes.alias("top"), "leaf", "save").groupBy("top").agg(F.sum("leaf").alias("n_leaves"), F.sum("save").alias("saved_tokens"))
    return known.join(sums, known["key"] == sums["top"]).select(
        "key", "turn_digest", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends", F.sha2(F.lit(b""), 256)).alias("ends_sha256"))
