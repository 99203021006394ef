"""Dense search, merging of query variants, hybrid fusion and reranking, for many queries at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import dot, dynamic_alpha, fuse
from ..functions.text import tokens

#: Queries that are sent to all tasks or held by one (2 MB at 64 dimensions), and vectors in a block beyond that.
QUERY_BLOCK, VECTOR_BLOCK = 4096, 65_536


def top_k(rows: DataFrame, k: int, by: list[Column], per: str = "query_id") -> DataFrame:
    """The first k rows of each group, with rank; Spark cuts groups before and after the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(per).orderBy(*by))).where(F.col("rank") <= k)


def dense_scores(vectors: DataFrame, queries: DataFrame, id_col: str = "chunk_id", vector_col: str = "embedding") -> DataFrame:
    """Inner products of all vectors with a query set: query_id, variant_no, ``id_col``, score. One row for each pair,
    for query sets of a few rows; :func:`dense_search` finds the best of large ones without making the pairs."""
    asked = queries.select("query_id", "variant_no", F.col("embedding").alias("_query"))
    return vectors.crossJoin(asked).select("query_id", "variant_no", id_col, dot(F.col(vector_col), F.col("_query")).alias("score"))


def best_columns(scores: np.ndarray, names: Callable[[], list], k: int, least_score: float = -np.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best columns of each row of ``scores``, above ``least_score``: row, column, score; by score (9 digits), then
    name."""
    who, what, found_scores = [], [], []
    rounded, n = np.where(np.isnan(scores), -np.inf, np.round(scores, 9)), min(k, scores.shape[1])
    least = np.partition(rounded, scores.shape[1] - n, axis=1)[:, scores.shape[1] - n]
    for i in range(len(scores)):
        found = np.flatnonzero((rounded[i] >= least[i]) & (scores[i] > least_score))
        if len(found) > k:  # ties at the edge
            every = names()
            found = np.array(sorted(found, key=lambda j: (-rounded[i, j], every[j]))[:k])
        who.append(np.full(len(found), i))
        what.append(found)
        found_scores.append(scores[i, found])
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([*who, none]), np.concatenate([*what, none]), np.concatenate([*found_scores, none.astype(float)])


def best_of(ids: pa.Array, x: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of a block for each query: query row, block row, score."""
    names = cache(ids.to_pylist)
    parts = [best_columns(q[a : a + 256] @ x.T, names, k) for a in range(0, len(q), 256)]
    rows = [p[0] + a for p, a in zip(parts, range(0, len(q), 256), strict=True)]
    return np.concatenate(rows), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])


class Best:
    """The k best of each query among all that a task sees: by score (9 digits), then id. What it holds between two cuts is
    bounded by queries x k and one batch."""

    def __init__(self, queries: int, k: int):
        self.k, self.least = k, np.full(queries, -np.inf)  # a query's k-th best so far
        self.parts: list[pa.Table] = []
        self.rows, self.room = 0, max(4 * queries * k, 4096)

    def add(self, query: np.ndarray, ids: pa.Array, at: np.ndarray, score: np.ndarray) -> None:
        """Scores of the rows ``at`` of ``ids``."""
        rounded = np.round(score, 9)
        good = np.flatnonzero(rounded >= self.least[query])
        if len(good):
            self.parts.append(pa.table({"q": query[good], "r": -rounded[good], "id": ids.take(pa.array(at[good])), "s": score[good]}))
            self.rows += len(good)
        if self.rows > self.room:
            self._cut()

    def _cut(self) -> None:
        whole = pa.concat_tables(self.parts)
        whole = whole.sort_by([("q", "ascending"), ("r", "ascending"), ("id", "ascending")])
        q = whole.column("q").to_numpy()
        first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        last = place == self.k - 1
        self.least[q[last]] = -whole.column("r").to_numpy()[last]
        self.parts = [whole.filter(pa.array(place < self.k)).combine_chunks()]
        self.rows = self.parts[0].num_rows

    def batches(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self._cut()
            yield from self.parts[0].select(["q", "id", "s"]).rename_columns(["q", "id", "score"]).to_batches()


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _schema(vectors: DataFrame, id_col: str) -> str:
    return f"q long, id {vectors.schema[id_col].dataType.simpleString()}, score double"


def _scan_all(vectors: DataFrame, q: np.ndarray, k: int, id_col: str, vector_col: str) -> DataFrame:
    """The k best of each task (rows of ``q`` by number), over all its batches: no vector moves."""
    sent, dim = vectors.sparkSession.sparkContext.broadcast(q), q.shape[1]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(sent.value), k)
        for batch in stream:
            if batch.num_rows:
                row, at, score = best_of(batch.column(0), matrix(batch.column(1), dim), sent.value, k)
                best.add(row, batch.column(0), at, score)
        yield from best.batches()

    return vectors.select(id_col, vector_col).mapInArrow(run, _schema(vectors, id_col))


def _in_blocks(vectors: DataFrame, asked: DataFrame, n: int, dim: int, k: int, id_col: str, vector_col: str) -> DataFrame:
    """The k best of each block of vectors for each block of queries: a task multiplies two blocks."""
    xs, ys = max(1, -(-vectors.count() // VECTOR_BLOCK)), -(-n // QUERY_BLOCK)
    kind = vectors.schema[id_col].dataType.simpleString()
    some = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = vectors.select(deal(id_col, xs).alias("x"), some(ys).alias("y"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("q"), F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    right = asked.select(some(xs).alias("x"), deal("q", ys).alias("y"), F.lit(0).alias("kind"), "q", F.lit(None).cast(kind).alias("id"), F.col("v").cast("array<double>").alias("v"))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in stream:
            if not batch.num_rows:
                continue
            x, y, kinds = (batch.column(i).to_numpy() for i in range(3))
            cut = np.flatnonzero((x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for a, b in zip([0, *cut], [*cut, len(x)], strict=True):
                rows = batch.slice(a, b - a)
                if (x[a], y[a]) != group:
                    group, held = (x[a], y[a]), []
                if kinds[a] == 0:
                    held.append((rows.column(3).to_numpy(zero_copy_only=False).astype(np.int64), matrix(rows.column(5), dim)))
                elif held:
                    names, q = (np.concatenate([h[i] for h in held]) for i in (0, 1))
                    row, at, score = best_of(rows.column(4), matrix(rows.column(5), dim), q, k)
                    yield pa.RecordBatch.from_arrays([pa.array(names[row]), rows.column(4).take(pa.array(at)), pa.array(score)], ["q", "id", "score"])

    return left.unionByName(right).repartition(xs * ys, "x", "y").sortWithinPartitions("x", "y", "kind").mapInArrow(run, _schema(vectors, id_col))


def dense_search(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "chunk_id", vector_col: str = "embedding") -> DataFrame:
    """The k best of each variant, merged per query by the largest score: query_id, ``id_col``, score, rank.
    All merged hits stay. Ties go to the smaller id. Vectors that are null, or not as long as the queries, take no
    part. A query set of up to ``QUERY_BLOCK`` rows is sent to the vectors; a larger one is multiplied block by block."""
    rows = asked_vectors(queries)
    names = queries.select("query_id", "variant_no").schema
    some = rows.limit(QUERY_BLOCK + 1).toArrow()  # bounded, as its size decides
    spark = vectors.sparkSession
    if not some.num_rows:
        return spark.createDataFrame([], names).crossJoin(vectors.select(id_col).limit(0)).select("query_id", id_col, F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    dim = len(some.column(2)[0])
    fit = vectors.where(F.col(vector_col).isNotNull() & (F.size(vector_col) == dim))
    if some.num_rows <= QUERY_BLOCK:
        q = matrix(some.column(2).combine_chunks(), dim)
        keys = spark.createDataFrame(some.select([0, 1]).append_column("q", pa.array(np.arange(len(q)))))
        found = _scan_all(fit, q, k, id_col, vector_col).join(F.broadcast(keys), "q")
    else:
        asked = rows.withColumn("q", F.xxhash64("query_id", "variant_no"))
        found = _in_blocks(fit, asked, asked.count(), dim, k, id_col, vector_col).join(asked.select("query_id", "variant_no", "q"), "q")
    return merged_variants(found.select("query_id", "variant_no", F.col("id").alias(id_col), "score"), k, id_col)


def asked_vectors(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", "variant_no", F.col("embedding").cast("array<double>").alias("v")).where("v is not null")


def merged_variants(scored: DataFrame, k: int, id_col: str) -> DataFrame:
    """The k best of each variant (query_id, variant_no, ``id_col``, score), merged per query by the largest score, with rank."""
    best = [F.desc(F.round("score", 9)), F.col(id_col)]
    cut = scored.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "variant_no").orderBy(*best))).where(F.col("r") <= k)
    merged = cut.groupBy("query_id", id_col).agg(F.max("score").alias("score"))
    return merged.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*best)))


def hybrid(dense: DataFrame, keyword: DataFrame, queries: DataFrame, base_alpha: float, id_col: str = "chunk_id") -> DataFrame:
    """Dense hits with keyword scores (0 where there is none) fused; hits of keywords alone are left out.
    ``keyword``: query_id, id, normalized. ``queries``: query_id, query. Adds dense_score, bm25_score,
    fused_score, rank; the order of equal fused scores is that of dense scores, then ids."""
    scores = keyword.select("query_id", F.col("id").alias(id_col), F.col("normalized").alias("bm25_score"))
    alpha = queries.select("query_id", dynamic_alpha(F.col("query"), base_alpha).alias("alpha"))
    joined = dense.drop("rank").withColumnRenamed("score", "dense_score").join(scores, ["query_id", id_col], "left").join(alpha, "query_id")
    joined = joined.withColumn("bm25_score", F.coalesce("bm25_score", F.lit(0.0)))
    fused = joined.withColumn("fused_score", fuse(F.col("alpha"), F.col("dense_score"), F.col("bm25_score")))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("fused_score", 9)), F.desc(F.round("dense_score", 9)), id_col)
    return fused.withColumn("rank", F.row_number().over(order))


def with_rows(hits: DataFrame, rows: DataFrame, queries: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """``hits`` with the rows of their ids. The hits of up to ``QUERY_BLOCK`` queries are sent to the rows, so that none moves
    which is no hit; those of more are joined by id. ``queries``: query_id; a query may have several hits, of bounded number."""
    few = queries.select("query_id").limit(QUERY_BLOCK + 1).count() <= QUERY_BLOCK
    return (F.broadcast(hits) if few else hits).join(rows, id_col)


def overlap_score(query: Column, text: Column) -> Column:
    """Share of the query's distinct words that a text has: the offline reranker."""
    asked = F.array_distinct(tokens(query))
    return F.when(F.size(asked) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(asked, tokens(text))) / F.greatest(F.lit(1), F.size(asked)))


def rerank(hits: DataFrame, top: int | None, score: Column | None = None, id_col: str = "chunk_id") -> DataFrame:
    """Hits (query_id, query, text, rank, ...) ordered by a new score, cut to ``top`` if that is positive.
    ``score`` may be any column function of query and text, a vectorised one too. A query with a null score, where
    scoring failed, keeps its hits as they were: their scores, their order, all of them."""
    scored = hits.withColumn("_new", overlap_score(F.col("query"), F.col("text")) if score is None else score)
    scored = scored.withColumn("_failed", F.max(F.col("_new").isNull()).over(Window.partitionBy("query_id")))
    order = Window.partitionBy("query_id").orderBy(F.when(~F.col("_failed"), F.round("_new", 9)).desc_nulls_last(), "rank", id_col)
    out = scored.withColumn("new_rank", F.row_number().over(order))
    out = out.where(F.col("_failed") | (F.col("new_rank") <= top)) if top and top > 0 else out
    new = F.when(F.col("_failed"), F.col("score")).otherwise(F.col("_new")) if "score" in hits.columns else F.col("_new")
    return out.withColumn("score", new).drop("rank", "_new", "_failed").withColumnRenamed("new_rank", "rank")


def query_variants(queries: DataFrame, n: int) -> DataFrame:
    """query_id, variant_no, variant: the query itself, then the first ``n`` of ``variants`` (an array column)."""
    every = F.concat(F.array("query"), F.slice(F.coalesce("variants", F.array().cast("array<string>")), 1, n))
    return queries.select("query_id", F.posexplode(every).alias("variant_no", "variant"))
