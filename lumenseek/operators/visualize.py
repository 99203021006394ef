"""Points for plots: an even sample of vectors and the query, reduced to two or three dimensions."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import preview

#: Rows in a range in which positions are counted, ranges at most, and sampled ids for each: a bounded sort on the driver.
RANGE_ROWS, MOST_RANGES, SAMPLES = 8192, 4096, 32


def even_sample(rows: DataFrame, m: int, id_col: str = "chunk_id") -> DataFrame:
    """At most m rows, evenly spread over the order of ids, with their position (0-based). Ids are of any type that has
    an order, and need not be dense. Positions come from counts of id ranges, so that no task sorts the table."""
    n = rows.count()
    if n <= m:
        return rows.withColumn("position", (F.row_number().over(Window.orderBy(id_col)) - 1).cast("long"))
    numbered = _positions(rows, n, id_col)
    step = float(n - 1) / float(max(1, m - 1))
    i = F.floor(F.col("position") / step)
    at = lambda j: F.when(j >= m - 1, F.lit(n - 1).cast("long")).otherwise(F.floor(j * F.lit(step)).cast("long"))
    return numbered.where((F.col("position") == at(i)) | (F.col("position") == at(i + 1)))


def _positions(rows: DataFrame, n: int, id_col: str) -> DataFrame:
    ranges = max(1, min(MOST_RANGES, -(-n // RANGE_ROWS)))
    drawn = rows.select(F.col(id_col).alias("i")).where(F.col("i").isNotNull() & (F.rand(31) < min(1.0, SAMPLES * ranges / n)))
    ids = sorted(r.i for r in drawn.collect()) if ranges > 1 else []
    cuts = sorted({ids[len(ids) * j // ranges] for j in range(1, ranges)}) if ids else []
    place = F.lit(0)
    if cuts:  # how many cuts are not above the id, by binary search
        table = F.from_json(F.lit(json.dumps(cuts)), f"array<{rows.schema[id_col].dataType.simpleString()}>")
        steps = F.array(*[F.lit(1 << s) for s in range(len(cuts).bit_length() - 1, -1, -1)])
        place = F.aggregate(steps, F.lit(0), lambda at, w: F.when(F.get(table, at + w - 1) <= F.col(id_col), at + w).otherwise(at))
    ranged = rows.withColumn("_range", place)
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(id_col)) - 1
    return ranged.withColumn("_k", inside).join(before, "_range").withColumn("position", (F.col("_before") + F.col("_k")).cast("long")).drop("_range", "_k", "_before")


def plot_points(vectors: DataFrame, chunks: DataFrame, hits: DataFrame, max_points: int, id_col: str = "chunk_id") -> DataFrame:
    """id, source, chunk_idx, text (a preview), score (0..1; 0 for what was not retrieved) and position of the sampled
    vectors. ``chunks`` without chunk_index: 0."""
    sample = even_sample(vectors.select(id_col), max(1, max_points - 1), id_col)
    scored = sample.join(hits.select(id_col, F.col("score").alias("_s")), id_col, "left")
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("_s", F.lit(0.0))))
    index = F.col("chunk_index") if "chunk_index" in chunks.columns else F.lit(0)
    return scored.join(chunks, id_col).select(F.col(id_col).alias("id"), "source", index.alias("chunk_idx"), preview(F.col("text")).alias("text"), score.alias("score"), "position")


def pca(x: np.ndarray, dims: int) -> np.ndarray:
    centred = x - x.mean(axis=0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    out = centred @ axes[:dims].T
    return np.hstack([out, np.zeros((len(x), dims - out.shape[1]))])


def tsne(x: np.ndarray, dims: int = 2, rounds: int = 1000, seed: int = 0) -> np.ndarray:
    """Exact t-SNE with perplexity min(30, n - 1), started from principal components."""
    n = len(x)
    if n < 4:
        return pca(x, dims)
    square = ((x[:, None] - x[None]) ** 2).sum(axis=2) if n <= 600 else np.maximum(0, (x * x).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * x @ x.T)
    target, p = np.log(min(30.0, n - 1)), np.zeros((n, n))
    for i in range(n):
        low, high, beta = 0.0, np.inf, 1.0
        others = np.delete(square[i], i)
        for _ in range(50):
            w = np.exp(-(others - others.min()) * beta)
            w /= w.sum()
            entropy = -(w * np.log(np.maximum(w, 1e-300))).sum()
            if abs(entropy - target) < 1e-5:
                break
            low, high = (beta, high) if entropy > target else (low, beta)
            beta = beta * 2 if high == np.inf else (low + high) / 2
        p[i, np.arange(n) != i] = w
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    y = pca(x, dims)
    y = y / max(1e-12, y[:, 0].std()) * 1e-4 + np.random.default_rng(seed).normal(0, 1e-6, (n, dims))
    speed = np.zeros_like(y)
    for r in range(rounds):
        q = 1 / (1 + np.maximum(0, (y * y).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * y @ y.T))
        np.fill_diagonal(q, 0)
        pull = ((12.0 if r < 100 else 1.0) * p - q / q.sum()) * q
        slope = 4 * (pull.sum(axis=1)[:, None] * y - pull @ y)
        speed = (0.5 if r < 100 else 0.8) * speed - max(10.0, n / 12) * slope
        y = y + speed - speed.mean(axis=0)
    return y


def umap(x: np.ndarray, dims: int = 2, neighbours: int = 15, min_dist: float = 0.1, rounds: int = 200, seed: int = 0) -> np.ndarray:
    """A fuzzy neighbour graph by cosine distance, laid out by seeded attraction and repulsion."""
    n = len(x)
    if n < 4:
        return pca(x, dims)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    k, rng = min(neighbours, n - 1), np.random.default_rng(seed)
    far = 1 - unit @ unit.T
    np.fill_diagonal(far, np.inf)
    near = np.argsort(far, axis=1)[:, :k]
    d = np.take_along_axis(far, near, axis=1)
    gap = np.maximum(0, d - d[:, :1])
    weight = np.exp(-gap / np.maximum(gap.mean(axis=1, keepdims=True), 1e-9))
    graph = np.zeros((n, n))
    np.put_along_axis(graph, near, weight, axis=1)
    graph = graph + graph.T - graph * graph.T
    a, b = np.nonzero(np.triu(graph))
    strength = graph[a, b]
    y = pca(unit, dims)
    y = y / max(1e-12, np.abs(y).max()) * 10
    for r in range(rounds):
        step = 1.0 - r / rounds
        go = rng.random(len(a)) < strength
        i, j = a[go], b[go]
        diff = y[i] - y[j]
        size = (diff * diff).sum(axis=1, keepdims=True)
        pull = np.clip(-2 * np.maximum(0, np.sqrt(size) - min_dist) / (1 + size) * diff / np.maximum(np.sqrt(size), 1e-9), -4, 4)
        np.add.at(y, i, step * pull / 2)
        np.add.at(y, j, -step * pull / 2)
        other = rng.integers(0, n, len(i))
        diff = y[i] - y[other]
        size = (diff * diff).sum(axis=1, keepdims=True)
        np.add.at(y, i, step * np.clip(2 * diff / ((0.01 + size) * (1 + size)), -4, 4) / 2)
    return y


def reduce_points(x: np.ndarray, method: str = "umap", dims: int = 2) -> np.ndarray:
    if method not in ("umap", "tsne", "pca"):
        raise ValueError("method must be umap, tsne or pca")
    if dims not in (2, 3):
        raise ValueError("dims must be 2 or 3")
    return {"umap": umap, "tsne": tsne, "pca": pca}[method](np.asarray(x, dtype=np.float64), dims)


def visualize(vectors: DataFrame, chunks: DataFrame, hits: DataFrame, query_vector: list[float], method: str = "umap", dims: int = 2, max_points: int = 1000, id_col: str = "chunk_id") -> DataFrame:
    """Plot table: id, x, y, z (null in two dimensions), source, chunk_idx, text, score, is_query and the row's key.
    ``id`` is a point's place among all vectors; the query is point -1 and counts towards ``max_points``. The sample, of
    the size asked for, is laid out on the driver."""
    if max_points < 1:
        raise ValueError("max_points must be positive")
    points = plot_points(vectors, chunks, hits, max_points, id_col)
    rows = points.join(vectors.select(F.col(id_col).alias("id"), "embedding"), "id").orderBy("position").collect()
    x = np.array([query_vector, *(r.embedding for r in rows)], dtype=np.float64)
    at = reduce_points(x, method, dims)
    place = lambda i: [float(v) for v in at[i]] + [None] * (3 - dims)
    table = [(-1, *place(0), None, -1, "QUERY", 1.0, True, None)]
    table += [(r.position, *place(i + 1), r.source, r.chunk_idx, r.text, r.score, False, str(r.id)) for i, r in enumerate(rows)]
    return vectors.sparkSession.createDataFrame(table, "id long, x double, y double, z double, source string, chunk_idx int, text string, score double, is_query boolean, key string")
