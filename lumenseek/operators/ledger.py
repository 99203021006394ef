"""The ledger of ingested files: what is new, what is done, what has gone stale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_files(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files whose file_hash the ledger lacks."""
    return files.join(ledger.select("file_hash").distinct(), "file_hash", "left_anti")


def mark_seen(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """All files with a boolean ``seen``."""
    known = ledger.select("file_hash").distinct().withColumn("_known", F.lit(True))
    return files.join(known, "file_hash", "left").withColumn("seen", F.coalesce("_known", F.lit(False))).drop("_known")


def stale_entries(ledger: DataFrame, files: DataFrame) -> DataFrame:
    """Ledger rows whose hash no current file has."""
    return ledger.join(files.select("file_hash").distinct(), "file_hash", "left_anti")


def without_stale(table: DataFrame, stale: DataFrame) -> DataFrame:
    """Rows of a table with file_hash (ledger, chunks, vectors) that do not belong to stale entries."""
    return table.join(stale.select("file_hash").distinct(), "file_hash", "left_anti")


def reconcile(ledger: DataFrame, files: DataFrame) -> DataFrame:
    """file_hash, status: new, processed or stale, for every hash on either side."""
    left, right = ledger.select("file_hash").distinct().withColumn("l", F.lit(1)), files.select("file_hash").distinct().withColumn("r", F.lit(1))
    both = left.join(right, "file_hash", "full")
    return both.select("file_hash", F.when(F.col("l").isNull(), "new").when(F.col("r").isNull(), "stale").otherwise("processed").alias("status"))
