"""Incremental ingestion as a stream: new rows only, each content once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def unseen_documents(stream: DataFrame, text_col: str = "text") -> DataFrame:
    """A stream's rows with file_hash, the first of each content. The hashes seen are the ledger: they are kept
    without a time limit, in the state store."""
    return stream.withColumn("file_hash", F.sha2(F.encode(F.col(text_col), "UTF-8"), 256)).dropDuplicates(["file_hash"])


def ingest_stream(spark: SparkSession, folder: str, schema: str, checkpoint: str, write: Callable[[DataFrame, int], None], files_per_batch: int = 64, glob: str | None = None) -> StreamingQuery:
    """Takes what has arrived as Parquet in ``folder`` since the last run, hands new rows to ``write`` batch by
    batch, and stops. ``write`` must be idempotent for a batch number."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    new = unseen_documents(reader.parquet(folder))
    return new.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def into(stream: DataFrame, take: Callable[[DataFrame, int], object], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Hands each batch of a stream and its number to ``take``, which must leave out a number that it has stored. ``once``: what
    has arrived, in batches, then it stops."""
    writer = stream.writeStream.foreachBatch(lambda rows, number: take(rows, number) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
