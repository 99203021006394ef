"""Vector index: flat scan, or inverted lists around k-means centroids stored as partitions."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scores import dot
from .retrieval import QUERY_BLOCK, Best, asked_vectors, best_of, dense_search, matrix, merged_variants

#: Share of new vectors above which centroids are fitted anew, and rows of a list that one task writes.
GROWTH, LIST_ROWS = 0.2, 200_000
#: Vectors for each list that centroids are fitted on at most, drawn evenly; all vectors are assigned.
FIT_ROWS = 256
#: Centroids up to which a vector is held against all; beyond it, against those of the ``NEAR`` nearest groups of them.
FLAT_LISTS, NEAR = 4096, 8


def index_kind(name: str) -> str:
    """flat, ivf or ivf_pq; ivf_flat means ivf. Others: ValueError."""
    kind = {"ivf_flat": "ivf"}.get(str(name).lower(), str(name).lower())
    if kind not in ("flat", "ivf", "ivf_pq"):
        raise ValueError(f"index type must be flat, ivf or ivf_pq, not {name!r}")
    return kind


def trainable(n: int, nlist: int) -> bool:
    return n >= 2 * nlist


def needs_retraining(trained: bool, present: int, added: int) -> bool:
    """More than a fifth of what is there comes new."""
    return trained and present > 0 and added / present > GROWTH


@dataclass
class VectorIndex:
    """vectors (id_col, embedding, cluster_id) and, if trained, centroids (cluster_id, centroid)."""

    vectors: DataFrame
    centroids: DataFrame | None
    nlist: int
    id_col: str = "chunk_id"

    @property
    def trained(self) -> bool:
        return self.centroids is not None

    @classmethod
    def build(cls, vectors: DataFrame, kind: str = "ivf", nlist: int = 1024, id_col: str = "chunk_id", seed: int = 0, n: int | None = None) -> VectorIndex:
        """Index of unit vectors. With fewer than 2 * nlist of them, or another kind than ivf, it is flat. ``n``: how many they
        are, if that is known."""
        kind = index_kind(kind)
        if kind == "ivf_pq":
            warnings.warn("ivf_pq is served by a flat index", stacklevel=2)
        rows = vectors.select(id_col, F.col("embedding"))
        if kind != "ivf" or not trainable(rows.count() if n is None else n, nlist):
            return cls(rows.withColumn("cluster_id", F.lit(0)), None, nlist, id_col)
        return cls._trained(rows, nlist, id_col, seed)

    @classmethod
    def _trained(cls, rows: DataFrame, nlist: int, id_col: str, seed: int) -> VectorIndex:
        n = rows.count()
        some = rows if n <= FIT_ROWS * nlist else rows.sample(fraction=min(1.0, FIT_ROWS * nlist / n), seed=seed)
        points = some.withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))
        model = KMeans(k=nlist, seed=seed, distanceMeasure="cosine", featuresCol="features", predictionCol="cluster_id").fit(points)
        spark = rows.sparkSession
        centers = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
        centroids = spark.createDataFrame(centers, "cluster_id int, centroid array<double>")
        return cls(_assign(rows, centroids, id_col), centroids, nlist, id_col)

    def assign(self, vectors: DataFrame) -> DataFrame:
        """New vectors with the list that each belongs to (0 in a flat index)."""
        new = vectors.select(self.id_col, "embedding")
        return new.withColumn("cluster_id", F.lit(0)) if self.centroids is None else _assign(new, self.centroids, self.id_col)

    def add(self, vectors: DataFrame) -> VectorIndex:
        """The index with more vectors, trained anew if they are many."""
        new = vectors.select(self.id_col, "embedding")
        if self.centroids is not None and needs_retraining(True, self.vectors.count(), new.count()):
            return self.retrained(new)
        return VectorIndex(self.vectors.unionByName(self.assign(new)), self.centroids, self.nlist, self.id_col)

    def retrained(self, vectors: DataFrame) -> VectorIndex:
        """The index with more vectors and new centroids; if training fails, the old ones serve on."""
        new = vectors.select(self.id_col, "embedding")
        try:
            return self._trained(self.vectors.select(self.id_col, "embedding").unionByName(new), self.nlist, self.id_col, 0)
        except (PySparkException, Py4JJavaError) as e:
            warnings.warn(f"training failed, the old centroids serve on: {str(e)[:200]}", stacklevel=2)
            return VectorIndex(self.vectors.unionByName(self.assign(new)), self.centroids, self.nlist, self.id_col)

    def search(self, queries: DataFrame, k: int, nprobe: int = 16) -> DataFrame:
        """The k best per variant, merged per query; ``queries``: query_id, variant_no, embedding. A trained
        index reads the ``nprobe`` lists nearest each variant only (partitions, when loaded from disk). A query set of up to
        ``QUERY_BLOCK`` rows is sent to the lists, which are multiplied where they are; a larger one is joined to them."""
        if self.centroids is None:
            return dense_search(self.vectors, queries, k, self.id_col)
        some = asked_vectors(queries).limit(QUERY_BLOCK + 1).toArrow()  # bounded, as its size decides
        scored = self._sent(queries, some, k, nprobe) if 0 < some.num_rows <= QUERY_BLOCK else self._joined(queries, nprobe)
        return merged_variants(scored, k, self.id_col)

    def _sent(self, queries: DataFrame, asked: pa.Table, k: int, nprobe: int) -> DataFrame:
        spark = self.vectors.sparkSession
        numbers, centers = centroid_matrix(self.centroids)
        dim = centers.shape[1]
        q = matrix(asked.column(2).combine_chunks(), dim)
        near = np.lexsort((np.broadcast_to(numbers, (len(q), len(numbers))), -(q @ centers.T)), axis=1)[:, :nprobe]
        probed = numbers[near]
        # The queries of each list.
        order = np.argsort(probed, axis=None, kind="stable")
        lists, first = np.unique(probed.ravel()[order], return_index=True)
        rows = np.split(order // probed.shape[1], first[1:])
        sent = spark.sparkContext.broadcast((q, dict(zip(lists.tolist(), rows, strict=True))))

        def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            every, asking = sent.value
            best = Best(len(every), k)
            for batch in stream:
                where = batch.column(2).to_numpy()
                for name in np.unique(where).tolist():
                    if name in asking:
                        here = pa.array(np.flatnonzero(where == name))
                        ids, who = batch.column(0).take(here), asking[name]
                        row, at, score = best_of(ids, matrix(batch.column(1).take(here), dim), every[who], k)
                        best.add(who[row], ids, at, score)
            yield from best.batches()

        vectors = self.vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") == dim))
        if len(lists) < len(numbers):  # lists that are partitions are pruned
            vectors = vectors.where(F.col("cluster_id").isin(lists.tolist()))
        kind = vectors.schema[self.id_col].dataType.simpleString()
        found = vectors.select(self.id_col, "embedding", F.col("cluster_id").cast("int")).mapInArrow(run, f"q long, id {kind}, score double")
        keys = spark.createDataFrame(asked.select([0, 1]).append_column("q", pa.array(np.arange(len(q)))))
        return found.join(F.broadcast(keys), "q").select("query_id", "variant_no", F.col("id").alias(self.id_col), "score")

    def _joined(self, queries: DataFrame, nprobe: int) -> DataFrame:
        near = Window.partitionBy("query_id", "variant_no").orderBy(F.desc("_near"), "cluster_id")
        probes = queries.crossJoin(F.broadcast(self.centroids)).withColumn("_near", dot(F.col("embedding"), F.col("centroid")))
        probes = probes.withColumn("_r", F.row_number().over(near)).where(F.col("_r") <= nprobe).select("query_id", "variant_no", F.col("embedding").alias("_query"), "cluster_id")
        return self.vectors.join(probes, "cluster_id").select("query_id", "variant_no", self.id_col, dot(F.col("embedding"), F.col("_query")).alias("score"))

    def save(self, path: str) -> None:
        write_vectors(self.vectors, self.trained, f"{path}/vectors", self.id_col)
        empty = self.vectors.sparkSession.createDataFrame([], "cluster_id int, centroid array<double>")
        (empty if self.centroids is None else self.centroids).write.mode("overwrite").parquet(f"{path}/centroids")

    @classmethod
    def load(cls, spark: SparkSession, path: str, nlist: int = 1024, id_col: str = "chunk_id") -> VectorIndex:
        centroids = spark.read.parquet(f"{path}/centroids")
        trained = not centroids.isEmpty()
        return cls(spark.read.parquet(f"{path}/vectors"), centroids if trained else None, nlist, id_col)


def write_vectors(vectors: DataFrame, trained: bool, path: str, id_col: str = "chunk_id") -> None:
    """Flat vectors as they are dealt; those of lists as one partition a list, which several tasks share if it is
    large."""
    if not trained:
        return vectors.write.mode("overwrite").parquet(path)
    counts = vectors.groupBy("cluster_id").agg(F.count("*").alias("_n")).select("cluster_id", F.ceil(F.col("_n") / LIST_ROWS).cast("int").alias("_s"))
    salted = vectors.join(counts, "cluster_id").withColumn("_s", F.pmod(F.xxhash64(id_col), F.col("_s")))
    return salted.repartition("cluster_id", "_s").drop("_s").write.mode("overwrite").partitionBy("cluster_id").parquet(path)


def centroid_matrix(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the lists, ascending, and their centroids as rows."""
    found = centroids.orderBy("cluster_id").select("cluster_id", "centroid").toArrow()
    return found.column(0).to_numpy().astype(np.int64), matrix(found.column(1).combine_chunks(), len(found.column(1)[0]))


class Coarse:
    """Which centroid has the largest inner product with each vector; of equal ones the first. Beyond ``FLAT_LISTS``
    centroids these are grouped around some of themselves, and a vector is held against the groups nearest to it."""

    def __init__(self, centers: np.ndarray, flat: int = FLAT_LISTS, near: int = NEAR):
        self.centers, self.heads = centers, None
        if len(centers) > flat:
            heads = centers[np.linspace(0, len(centers) - 1, int(len(centers) ** 0.5)).astype(int)]
            for _ in range(8):
                group = np.argmax(centers @ heads.T, axis=1)
                sums = np.zeros_like(heads)
                np.add.at(sums, group, centers)
                norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
                heads = np.where(norm > 0, sums / np.maximum(norm, 1e-12), heads)
            group = np.argmax(centers @ heads.T, axis=1)
            self.heads, self.near = heads, min(near, len(heads))
            self.members = [np.flatnonzero(group == g) for g in range(len(heads))]

    def nearest(self, x: np.ndarray) -> np.ndarray:
        if self.heads is None:
            return np.argmax(x @ self.centers.T, axis=1)
        groups = np.argpartition(-(x @ self.heads.T), self.near - 1, axis=1)[:, : self.near]
        best, at = np.full(len(x), -np.inf), np.zeros(len(x), np.int64)
        for g, members in enumerate(self.members):
            rows = np.flatnonzero((groups == g).any(axis=1))
            if not len(rows) or not len(members):
                continue
            scores = x[rows] @ self.centers[members].T
            top = np.argmax(scores, axis=1)
            value, which = scores[np.arange(len(rows)), top], members[top]
            better = (value > best[rows]) | ((value == best[rows]) & (which < at[rows]))
            best[rows[better]], at[rows[better]] = value[better], which[better]
        return at


def _assign(rows: DataFrame, centroids: DataFrame, id_col: str) -> DataFrame:
    """Each vector with its list; a vector that is null, or of another length, has the first one."""
    numbers, centers = centroid_matrix(centroids)
    sent = rows.sparkSession.sparkContext.broadcast(Coarse(centers))

    @F.arrow_udf("int")
    def assigned(vectors: pa.Array) -> pa.Array:
        fit = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(vectors), centers_dim), False).to_numpy(zero_copy_only=False))
        out = np.full(len(vectors), numbers[0])
        if len(fit):
            out[fit] = numbers[sent.value.nearest(matrix(vectors.take(pa.array(fit)), centers_dim))]
        return pa.array(out, pa.int32())

    centers_dim = centers.shape[1]
    return rows.select(id_col, "embedding", assigned("embedding").alias("cluster_id"))
