"""Approximate nearest neighbours by a forest of random-projection trees.

Nearness is the largest inner product. Vectors get one more component that makes their norms equal, so that
splits by direction suit it; queries are scaled to that norm. A tree has one random direction a level (those of
a tree are orthogonal, as far as the dimension allows) and splits every node at its median, so that leaves hold
about ``LEAF`` vectors and trees grow deeper with the corpus. Medians come from a bounded sample of hash-chosen
vectors (``SAMPLE``); below the level where that is too thin for a node of its own, the level's median serves
all nodes. Every vector is then sent down every tree.

A query walks all trees through one priority queue, the leaf with the least sum of crossed margins first, until
it has taken as many leaves as hold ``CANDIDATES`` * n ** ``POWER`` vectors. Vectors and queries are dealt by
(tree, group of neighbouring leaves), so a query travels only to groups of which it takes a leaf, and is
multiplied there with the vectors of its leaves alone. The best are scored in double precision on the original
vectors. Equal vectors are one entry with its least ids, as no more of them can be among the nearest.

``CANDIDATES`` and ``POWER`` are what vectors without clusters need for a recall over 0.9; where vectors have
clusters, far fewer serve.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import tidy

#: Vectors that the trees are fitted on, at most, and the least of them that make a median.
SAMPLE, LEAST = 65_536, 8
TREES, LEAF = 4, 64
CANDIDATES, POWER = 3.3, 0.85
#: Vectors in a group of leaves, and queries that meet them in one task.
GROUP, QUERY_BLOCK = 131_072, 65_536


class Forest:
    """Trees for about ``n`` vectors. Leaves of a tree are numbered by their path: one bit a level."""

    def __init__(self, sample: np.ndarray, norm: float, n: int, trees: int = TREES, leaf: int = LEAF, seed: int = 11):
        self.norm, self.trees, rng = norm, trees, np.random.default_rng(seed)
        self.depth = max(0, int(np.ceil(np.log2(max(1, n) / leaf))))
        x = self.lift(sample)
        dim = x.shape[1]
        drawn = [[np.linalg.qr(rng.standard_normal((dim, dim)))[0].T for _ in range(0, self.depth, dim)] for _ in range(trees)]
        self.directions = np.array([np.concatenate([*d, np.zeros((0, dim))])[: self.depth] for d in drawn]).reshape(trees, self.depth, dim)
        #: For each level the cut of each node, or of all nodes.
        self.cuts: list[np.ndarray] = []
        at, node = self._along(x), np.zeros((len(x), trees), dtype=np.int64)
        for level in range(self.depth):
            nodes = 1 << level if len(x) >= LEAST << level else 1
            cut = np.zeros((trees, nodes))
            for t in range(trees):
                values = at[:, t, level]
                if nodes == 1:
                    cut[t] = np.median(values) if len(x) else 0.0
                    continue
                order = np.argsort(node[:, t], kind="stable")
                edges = np.searchsorted(node[order, t], np.arange(nodes + 1))
                for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    cut[t, i] = np.median(values[order[a:b]]) if b > a else 0.0
            self.cuts.append(cut)
            node = self._step(level, node, at[:, :, level])

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0.0, self.norm**2 - (x * x).sum(axis=1)))
        return np.hstack([x, rest[:, None]])

    def _along(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.directions.reshape(-1, x.shape[1]).T).reshape(len(x), self.trees, self.depth)

    def _step(self, level: int, node: np.ndarray, at: np.ndarray) -> np.ndarray:
        cut = self.cuts[level]
        own = cut[np.arange(self.trees), node] if cut.shape[1] > 1 else cut[:, 0]
        return 2 * node + (at >= own)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector in each tree."""
        at, node = self._along(self.lift(x)), np.zeros((len(x), self.trees), dtype=np.int64)
        for level in range(self.depth):
            node = self._step(level, node, at[:, :, level])
        return node

    def taken(self, queries: np.ndarray, leaves: int) -> Iterator[list[tuple[int, int]]]:
        """The ``leaves`` (tree, leaf) that each query takes."""
        scaled = queries * (self.norm / np.linalg.norm(queries, axis=1, keepdims=True))
        along = self._along(np.hstack([scaled, np.zeros((len(queries), 1))]))
        cuts, depth = [c.tolist() for c in self.cuts], self.depth
        single = [len(c[0]) == 1 for c in cuts]
        for row in along.tolist():
            queue = [(0.0, t, 0, 0) for t in range(self.trees)]
            out = []
            while queue and len(out) < leaves:
                cost, t, level, node = heapq.heappop(queue)
                values = row[t]
                while level < depth:
                    margin = values[level] - cuts[level][t][0 if single[level] else node]
                    node = 2 * node + (margin >= 0)
                    level += 1
                    heapq.heappush(queue, (cost + abs(margin), t, level, node ^ 1))
                out.append((t, node))
            yield out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dim)


def _with_leaves(forest, dim: int):
    @tidy
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            if batch.num_rows:
                leaves = forest.value.leaves(_matrix(batch.column(1), dim))
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(leaves) + 1, dtype=np.int32) * leaves.shape[1]), pa.array(leaves.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), rows], ["id", "v", "leaves"])

    return run


def _with_groups(forest, dim: int, leaves: int, bits: int):
    """For each query the groups that it visits: tree, group, and a bitmap of the group's leaves that it takes."""

    @tidy
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("t", pa.int32()), ("g", pa.int64()), ("bits", pa.binary())]))
        for batch in stream:
            for a in range(0, batch.num_rows, 256):
                rows, found = batch.slice(a, 256), []
                for taken in forest.value.taken(_matrix(rows.column(1), dim), leaves):
                    groups: dict[tuple[int, int], np.ndarray] = {}
                    for t, leaf in taken:
                        groups.setdefault((t, leaf >> bits), np.zeros(1 << bits, dtype=bool))[leaf & ((1 << bits) - 1)] = True
                    found.append([{"t": t, "g": g, "bits": np.packbits(flags).tobytes()} for (t, g), flags in groups.items()])
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(found, kind)], ["id", "v", "groups"])

    return run


def _best(ids: np.ndarray, x: np.ndarray, edges: np.ndarray, query_ids: np.ndarray, q: np.ndarray, taken: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
    """For each query the k best of the vectors in its leaves: query, id, score. ``edges``: where leaves begin."""
    step = max(16, min(512, (1 << 22) // max(1, len(x))))
    for a in range(0, len(q), step):
        part, flags = q[a : a + step], taken[a : a + step]
        scores = np.full((len(part), len(x)), -np.inf)
        for leaf in np.flatnonzero(flags.any(axis=0)):
            b, e = edges[leaf], edges[leaf + 1]
            if e > b:
                who = np.flatnonzero(flags[:, leaf])
                scores[who, b:e] = part[who] @ x[b:e].T
        n = min(k, len(x))
        least = np.partition(scores, len(x) - n, axis=1)[:, len(x) - n]
        for i in range(len(part)):
            floor = least[i] - 1e-9 * (1 + abs(least[i])) if np.isfinite(least[i]) else -np.inf
            found = np.flatnonzero((scores[i] >= floor) & np.isfinite(scores[i]))
            exact = (part[i] * x[found]).sum(axis=1)
            for j in np.lexsort((ids[found], -exact))[:k]:
                yield int(query_ids[a + i]), int(ids[found[j]]), float(exact[j])


def _search(k: int, dim: int, bits: int):
    """Rows of (tree, group, block of queries) sorted by these, kind (0 vectors, 1 queries) and leaf. A task holds one
    group's vectors; queries stream past them."""

    @tidy
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, parts, ready = None, [], None
        kinds = (pa.int64(), pa.int64(), pa.float64())
        for batch in stream:
            if not batch.num_rows:
                continue
            where = np.stack([batch.column(i).to_numpy() for i in range(4)])
            cut = np.flatnonzero((where[:, 1:] != where[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *cut], [*cut, batch.num_rows], strict=True):
                *at, kind = where[:, a].tolist()
                rows = batch.slice(a, b - a)
                if at != group:
                    group, parts, ready = at, [], None
                ids, x = rows.column(5).to_numpy(), _matrix(rows.column(6), dim)
                if kind == 0:
                    parts.append((ids, x, rows.column(4).to_numpy()))
                    continue
                if not parts:
                    continue
                if ready is None:
                    ready = [np.concatenate([p[i] for p in parts]) for i in range(3)]
                    ready[2] = np.searchsorted(ready[2], np.arange((1 << bits) + 1))
                raw = np.frombuffer(b"".join(rows.column(7).to_pylist()), dtype=np.uint8).reshape(b - a, -1)
                found = list(_best(*ready, ids, x, np.unpackbits(raw, axis=1)[:, : 1 << bits].astype(bool), k))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate(kinds)], ["q", "rep", "score"])

    return run


def nearest(
    vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
    trees: int = TREES, leaf: int = LEAF, candidates: float = CANDIDATES,
) -> DataFrame:
    """The k nearest found for every row that ``queries`` holds for: query_id, rank (from 1), ``id_col``, score.

    Candidates are all rows but those with the query's own id; equal scores go to the smaller id. Rows
    without id, and vectors that are null, empty, zero, or hold null or non-finite components take no part,
    nor do vectors whose length isn't the most frequent one (of equally frequent ones the larger). Of rows
    with one id the least vector counts. Fewer than k candidates: all of them. Extra columns are not read,
    unless ``queries`` does. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    scratch, number = Scratch(spark), F.col("v")
    # Vectors travel as they are stored; every product is of double precision.
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    good = number.isNotNull() & (F.size("v") > 0) & F.forall(number, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(number, lambda c: c != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v"), F.coalesce(queries, F.lit(False)).alias("asked")).where(F.col("id").isNotNull() & good)
    rows = scratch.keep(rows.groupBy("id").agg(F.min("v").alias("v"), F.max("asked").alias("asked")))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    empty = spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    if lengths is None:
        return empty
    dim = lengths["n"]
    rows = rows.where(F.size("v") == dim)
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
    classes = scratch.keep(ranked.groupBy("v").agg(F.min("id").alias("rep"), F.array_sort(F.collect_list("id")).alias("ids")))
    n, norm = classes.agg(F.count("*"), F.max(F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda s, c: s + c * c))).first()
    sample = _matrix(classes.orderBy(F.xxhash64("rep")).limit(SAMPLE).select("v").toArrow().column(0).combine_chunks(), dim)
    model = Forest(sample, float(np.sqrt(norm)), n, trees, leaf)
    forest = spark.sparkContext.broadcast(model)
    # Leaves to take; those of a small corpus hold fewer than a whole leaf's vectors.
    take = int(np.ceil(candidates * n**POWER / (n / (1 << model.depth))))
    # Groups of 2 ** bits leaves: of a bounded size, and some for each tree also in a small corpus.
    bits = max(0, min(model.depth, int(np.log2(GROUP / leaf)), max(4, model.depth - 2)))

    asked = scratch.keep(rows.where("asked").select("id", "v"))
    # One search for each distinct query vector, named by its least query id.
    single = asked.groupBy("v").agg(F.min("id").alias("id")).select("id", "v")
    probed = scratch.keep(single.mapInArrow(_with_groups(forest, dim, take, bits), f"id long, v {kind}, groups array<struct<t: int, g: bigint, bits: binary>>"))
    blocks = max(1, -(-probed.count() // QUERY_BLOCK))
    left = classes.select(F.col("rep").alias("id"), "v").mapInArrow(_with_leaves(forest, dim), f"id long, v {kind}, leaves array<long>")
    left = left.select("id", "v", F.posexplode("leaves").alias("t", "leaf"), F.lit(None).cast("binary").alias("bits"))
    left = left.select("t", F.shiftright("leaf", bits).alias("g"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("y"), F.lit(0).alias("kind"), F.col("leaf").bitwiseAND(F.lit((1 << bits) - 1)).alias("at"), "id", "v", "bits")
    right = probed.select("id", "v", F.explode("groups").alias("e"))
    right = right.select("e.t", "e.g", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("y"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("at"), "id", "v", "e.bits")
    tasks = trees * (1 << (model.depth - bits)) * blocks
    dealt = left.unionByName(right).repartition(tasks, "t", "g", "y").sortWithinPartitions("t", "g", "y", "kind", "at")
    found = dealt.mapInArrow(_search(k + 1, dim, bits), "q long, rep long, score double")
    order = [F.desc("score"), F.asc("rep")]
    # Trees find the same vectors; their scores are equal.
    found = found.groupBy("q", "rep").agg(F.max("score").alias("score"))
    found = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("r") <= k + 1)
    # From vectors to ids: k + 1 for each distinct query vector, then k for each query but itself.
    named = found.join(classes.select("rep", "ids"), "rep").select("q", "score", F.explode("ids").alias("id"))
    named = named.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc("id")))).where(F.col("r") <= k + 1).select("q", "score", "id")
    who = asked.join(probed.select(F.col("id").alias("q"), "v"), "v").select("q", F.col("id").alias("query_id"))
    out = who.join(named, "q").where(F.col("query_id") != F.col("id"))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id")))).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
