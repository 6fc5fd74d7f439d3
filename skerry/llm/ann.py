"""Nearest neighbours by a forest of random-projection trees."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors of a leaf, and queries, that one task compares at once.
BLOCK, ASKED = 8_000, 8_192
#: Numbers in the vectors of a sample, at most about (64 MB).
VALUES = 8_000_000


@dataclass
class Tree:
    """Inner nodes: `planes` (dimensions + 1: offset last) and two children each; a child -1 - k is leaf k,
    which has sizes[k] of the rows that the tree was grown on."""

    planes: np.ndarray
    children: np.ndarray
    sizes: np.ndarray


def grow(vectors: np.ndarray, leaf: int, rng: np.random.Generator) -> Tree:
    """Split by the plane between two random rows, at the median, down to `leaf` rows."""
    planes, children, sizes = [], [], []

    def split(rows: np.ndarray) -> int:
        if len(rows) > leaf:
            for _ in range(5):
                a, b = vectors[rng.choice(rows, 2, replace=False)]
                normal = a - b
                length = np.linalg.norm(normal)
                if length > 0:
                    side = vectors[rows] @ (normal / length)
                    cut = np.median(side)
                    low, high = rows[side < cut], rows[side >= cut]
                    if len(low) and len(high):
                        node = len(planes)
                        planes.append(np.append(normal / length, -cut))
                        children.append([0, 0])
                        children[node] = [split(low), split(high)]
                        return node
        sizes.append(len(rows))
        return -len(sizes)

    split(np.arange(len(vectors)))
    width = vectors.shape[1] + 1
    return Tree(np.array(planes).reshape(-1, width), np.array(children, dtype=np.int64).reshape(-1, 2), np.array(sizes))


def leaf_of(tree: Tree, vectors: np.ndarray) -> np.ndarray:
    node = np.zeros(len(vectors), dtype=np.int64) if len(tree.planes) else np.full(len(vectors), -1)
    going = np.flatnonzero(node >= 0)
    while len(going):
        planes = tree.planes[node[going]]
        side = np.einsum("ij,ij->i", vectors[going], planes[:, :-1]) + planes[:, -1] >= 0
        node[going] = tree.children[node[going], side.astype(np.int64)]
        going = going[node[going] >= 0]
    return -1 - node


def search(trees: list[Tree], vector: np.ndarray, rows: float) -> list[tuple[int, int]]:
    """Leaves (tree, leaf) in the order of one queue shared by all trees, until they hold `rows` of
    the rows that the trees were grown on, a row counting once for each tree.

    An entry's priority is the sum of squared distances to the planes that its path crossed to the
    far side."""
    queue = [(0.0, t, 0 if len(tree.planes) else -1) for t, tree in enumerate(trees)]
    heapq.heapify(queue)
    found, held = [], 0
    sides = [tree.planes[:, :-1] @ vector + tree.planes[:, -1] for tree in trees]
    while queue and held < rows:
        crossed, t, node = heapq.heappop(queue)
        while node >= 0:
            side = float(sides[t][node])
            near, far = trees[t].children[node][int(side >= 0)], trees[t].children[node][int(side < 0)]
            heapq.heappush(queue, (crossed + side * side, t, int(far)))
            node = int(near)
        found.append((t, -1 - node))
        held += trees[t].sizes[-1 - node]
    return found


@dataclass
class Forest:
    """Trees over the sampled rows `ids`, `vectors` of one length; `leaves` holds each row's leaf by tree,
    `blocks` the number of blocks into which each leaf of each tree is cut."""

    trees: list[Tree]
    ids: np.ndarray
    vectors: np.ndarray
    leaves: list[np.ndarray]
    blocks: list[np.ndarray]

    def visited(self, vector: np.ndarray, share: float, k: int) -> list[tuple[int, int]]:
        return search(self.trees, vector, max(share * len(self.ids), min(k + 1, len(self.ids))) * len(self.trees))

    def known(self, query: int, vector: np.ndarray, found: list[tuple[int, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k nearest sampled rows in the leaves `found`."""
        inside = np.zeros(len(self.ids), dtype=bool)
        for t in range(len(self.trees)):
            opened = np.zeros(len(self.blocks[t]), dtype=bool)
            opened[[leaf for tree, leaf in found if tree == t]] = True
            inside |= opened[self.leaves[t]]
        rows = np.flatnonzero(inside & (self.ids != query))
        scores = distances(self.vectors[rows], vector)
        order = np.lexsort((self.ids[rows], scores))[:k]
        return self.ids[rows][order], scores[order]


def plant(ids: np.ndarray, vectors: np.ndarray, trees: int, parts: int, scale: float, rng: np.random.Generator) -> Forest:
    """A forest whose trees have about `parts` leaves; each sampled row stands for `scale` rows."""
    leaf = max(25, -(-len(ids) // parts))
    grown = [grow(vectors, leaf, rng) for _ in range(trees if len(ids) > leaf else 1)]
    blocks = [np.ceil(np.maximum(tree.sizes, 1) * scale / BLOCK).astype(np.int64) for tree in grown]
    return Forest(grown, ids, vectors, [leaf_of(tree, vectors) for tree in grown], blocks)


def distances(data: np.ndarray, vector: np.ndarray) -> np.ndarray:
    return np.sqrt(((data - vector) ** 2).sum(axis=1))


def within(data: np.ndarray, vectors: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Row by query: may the distance be `bounds` at most? By products, with room for their rounding."""
    with np.errstate(all="ignore"):
        rows, asked = (data ** 2).sum(axis=1)[:, None], (vectors ** 2).sum(axis=1)[None, :]
        room = 1e-13 * data.shape[1] * (rows + asked)
        return ~(rows + asked - 2 * (data @ vectors.T) > bounds[None, :] ** 2 * (1 + 1e-12) + room)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, trees: int = 6, share: float = 0.2,
            sample: int = 50_000, parts: int = 64, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of `queries` its `k` nearest other rows of `vectors`.

    Both have vec_id and embedding. Trees are grown on about `sample` rows, fewer if these would hold
    more than VALUES numbers, those of the smallest digests of vec_id, down to about `parts` leaves, so
    the forest that tasks get is bounded; every row is placed in one leaf of each tree. A query visits
    leaves until they hold `share` of the sampled rows of all trees, and more than `k` rows in any case.

    The sampled rows of the visited leaves are known where the query is: the k-th of their distances
    bounds what can be among the k nearest. All rows of those leaves are then reranked, in groups of
    about BLOCK rows and ASKED queries: products sort out what lies beyond the bound, distances of the
    rest are taken in double precision, the best `k` of each group are merged. A leaf that holds many
    rows, of one common vector say, is cut into as many blocks as its part of the sample calls for.

    Vectors of different lengths are not compared; each length has its own forest, one leaf if the
    sample has few rows of it. Vectors that are null, zero, or hold null or non-finite components take
    no part. Ties go to the smaller vec_id. Repeated vec_ids are one candidate each, their nearest
    vector; a query's own vec_id is none of its candidates. Empty tables give no rows, other columns
    are left out."""
    spark = vectors.sparkSession
    whole = F.expr("embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) "
                   "AND abs(x) < double('Infinity')) AND exists(embedding, x -> x <> 0)")
    usable = lambda df: df.where("vec_id IS NOT NULL").select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(whole)
    vectors, queries = usable(vectors), usable(queries)
    schema = "query_id long, rank int, vec_id long, score double"
    total, width = vectors.agg(F.count("*"), F.avg(F.size("embedding"))).first()
    if not total:
        return spark.createDataFrame([], schema)
    wanted = max(1, min(sample, int(VALUES / width)))
    drawn = vectors if total <= wanted else vectors.where(
        F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)) < int(wanted / total * (1 << 40)))
    # Repeated ids collapse before they travel, so a common id cannot fill the sample.
    lengths: dict[int, list] = {}
    for row in drawn.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).orderBy("vec_id").toLocalIterator():
        lengths.setdefault(len(row["embedding"]), []).append((row["vec_id"], row["embedding"]))
    scale = total / max(1, sum(map(len, lengths.values())))
    rng = np.random.default_rng(seed)
    planted = {d: plant(np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64), trees, parts, scale, rng)
               for d, rows in sorted(lengths.items())}
    forests = spark.sparkContext.broadcast(planted)
    askings = max(1, -(-queries.count() // ASKED))

    def forest_for(d: int) -> Forest:
        """A length without a sampled row has one leaf."""
        return forests.value.get(d) or plant(np.zeros(0, dtype=np.int64), np.zeros((0, d)), 1, parts, scale, np.random.default_rng(0))

    def by_length(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[Forest, np.ndarray, np.ndarray, np.ndarray]]:
        for frame in frames:
            for low in range(0, len(frame), 4096):
                part = frame.iloc[low:low + 4096]
                for d, same in part.groupby(part["embedding"].map(len)):
                    yield (forest_for(int(d)), same["vec_id"].to_numpy(), np.stack(same["embedding"].to_numpy()).astype(np.float64),
                           same["mix"].to_numpy().astype(np.uint64) >> np.uint64(20))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for forest, ids, data, mix in by_length(frames):
            packed = [row.tobytes() for row in data]
            for t, tree in enumerate(forest.trees):
                found = leaf_of(tree, data)
                block = (mix % forest.blocks[t][found].astype(np.uint64)).astype(np.int64)
                for asking in range(askings):
                    yield pd.DataFrame({"width": data.shape[1], "tree": t, "leaf": found, "block": block, "asking": asking,
                                        "bound": np.nan, "id": ids, "data": packed})

    def visit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for forest, ids, data, mix in by_length(frames):
            out = []
            for query, vector, asking in zip(ids, data, mix % np.uint64(askings), strict=True):
                found = forest.visited(vector, share, k)
                scores = forest.known(query, vector, found, k)[1]
                bound = scores[-1] if len(scores) == k else np.inf
                for t, leaf in found:
                    out.extend((data.shape[1], t, leaf, b, int(asking), bound, query, vector.tobytes())
                               for b in range(int(forest.blocks[t][leaf])))
            yield pd.DataFrame(out, columns=["width", "tree", "leaf", "block", "asking", "bound", "id", "data"])

    def known(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for forest, ids, data, _ in by_length(frames):
            for query, vector in zip(ids, data, strict=True):
                near, scores = forest.known(query, vector, forest.visited(vector, share, k), k)
                yield pd.DataFrame({"query_id": query, "vec_id": near, "score": scores})

    def compare(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        asked = frame["bound"].notna().to_numpy()
        parts = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})]
        if not asked.any() or asked.all():
            return parts[0]
        unpack = lambda rows: np.frombuffer(b"".join(rows), dtype=np.float64).reshape(-1, key[0])
        ids, data = frame["id"].to_numpy()[~asked], unpack(frame["data"][~asked])
        names, sought, bounds = frame["id"].to_numpy()[asked], unpack(frame["data"][asked]), frame["bound"].to_numpy()[asked]
        for low in range(0, len(names), 256):
            close = within(data, sought[low:low + 256], bounds[low:low + 256])
            for column in np.flatnonzero(close.any(axis=0)):
                query = names[low + column]
                rows = np.flatnonzero(close[:, column] & (ids != query))
                score = distances(data[rows], sought[low + column])
                # Copies of an id in a group count once, so that they cannot push out others.
                order = np.lexsort((ids[rows], score))
                best = order[np.sort(np.unique(ids[rows][order], return_index=True)[1])][:k]
                parts.append(pd.DataFrame({"query_id": query, "vec_id": ids[rows][best], "score": score[best]}))
        return pd.concat(parts)

    mixed = F.xxhash64("vec_id", "embedding").alias("mix")
    columns = "width int, tree int, leaf long, block long, asking int, bound double, id long, data binary"
    result = "query_id long, vec_id long, score double"
    copies = vectors.select("*", mixed).dropDuplicates(["mix", "vec_id", "embedding"])
    sought = queries.select("*", mixed)
    placed = copies.mapInPandas(place, columns).unionByName(sought.mapInPandas(visit, columns))
    found = placed.groupBy("width", "tree", "leaf", "block", "asking").applyInPandas(compare, result)
    # What is known from the sample is given as it is; each group adds at most k within the bound.
    order = F.array_sort(F.collect_list(F.struct("score", "vec_id")))
    return (found.unionByName(sought.mapInPandas(known, result))
            .groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
            .groupBy("query_id").agg(F.slice(order, 1, k).alias("best"))
            .select("query_id", F.posexplode("best").alias("pos", "near"))
            .select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "near.vec_id", "near.score"))
