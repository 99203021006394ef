"""A session with the settings that the engine's plans expect."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: What the plans rely on. A cluster's own settings of memory, cores and shuffle partitions are left alone.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.files.maxPartitionBytes": str(64 << 20),
}


def session(name: str = "lumenseek", shared_dir: str | None = None, **more: str) -> SparkSession:
    """The active session, or a new one, with ``SETTINGS`` and ``more`` (dots as double underscores). ``shared_dir`` is the
    folder for intermediate tables, which all executors must see; one that is set already stays."""
    builder = SparkSession.builder.appName(name)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in more.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    if shared_dir and not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", shared_dir)
    return spark
