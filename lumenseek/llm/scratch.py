"""Tables written between the steps of an operator, in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one long up to which a set of ids is broadcast (about 32 MB in each executor); larger sets are shuffled.
BROADCAST_IDS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset (a local session), one of this machine's own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lumenseek-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """Texts are long: an Arrow batch of 10,000 of them, the default, is held several times over, on both sides
    of the pipe. From here on batches of this session end at 1,000 rows or 8 MB."""
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    if not 0 < int(rows) <= 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Writes frames as Parquet under one folder of the shared directory, so that no later step recomputes
    them and a lost executor costs no more than its own tasks. ``drop`` frees a table that has served."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/lumenseek-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        bound_batches(spark)
        atexit.register(self._close)

    def keep(self, frame: DataFrame) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex}"
        frame.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(frame.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            _delete(self.spark, self.paths.pop(id(frame)))

    def _close(self) -> None:
        try:
            _delete(self.spark, self.root)
        except Exception:  # the session may have ended before the interpreter does
            pass


def only_ids(frame: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows of ``frame`` whose ``column`` is in ``ids`` (one column of that name, distinct). The set is
    broadcast only if it is counted as small; else both sides are shuffled."""
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return frame.join(F.broadcast(ids) if small else ids, column, "left_semi")


def without_ids(frame: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows of ``frame`` whose ``column`` is not in ``ids``; null ids stay. As :func:`only_ids` else."""
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return frame.join(F.broadcast(ids) if small else ids, column, "left_anti").select(*frame.columns)


def connected(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Component of each node in ``edges`` (a, b: long): node, component (its smallest node).

    Alternating large and small stars; each round is one aggregation and one join over the edges, and the
    rounds grow with the logarithm of the longest chain. Nodes with many neighbours are pre-aggregated, and
    the join's hot side can be split, as its other side has one row a node.
    """
    now = scratch.keep(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.where("m < a").select("a", F.col("m").alias("b"))
        ).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(
            F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
        )).alias("e")).select("e.*").where("a <> b").distinct()
        after = scratch.keep(small)
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        scratch.drop(now)
        now = after
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )

