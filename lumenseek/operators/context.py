"""Context and prompt assembly from ranked hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import basename

#: The answer asked for when the excerpts say nothing. Fixed value.
NO_ANSWER = "No information found in documents"


def number_documents(hits: DataFrame) -> DataFrame:
    """Adds source_name and doc_no: documents numbered per query by first appearance in rank."""
    named = hits.withColumn("source_name", basename(F.col("source")))
    first = named.withColumn("_first", F.min("rank").over(Window.partitionBy("query_id", "source_name")))
    return first.withColumn("doc_no", F.dense_rank().over(Window.partitionBy("query_id").orderBy("_first"))).drop("_first")


def excerpt(doc_no: Column) -> Column:
    head = F.format_string("[Document %d — Source: %s | Chunk %d/%d | Type: %s]", doc_no, F.col("source_name"), F.col("chunk_index") + 1, F.col("total_chunks"), F.upper("file_type"))
    return F.concat(head, F.lit("\n"), F.col("text"))


def build_context(hits: DataFrame) -> DataFrame:
    """query_id, context (excerpts in rank order), legend (documents in number order) from hits (query_id, rank,
    source, chunk_index, total_chunks, file_type, text). A query's hits are few: its top k."""
    rows = number_documents(hits)
    blocks = F.array_sort(F.collect_list(F.struct("rank", excerpt(F.col("doc_no")).alias("block"))))
    names = F.array_sort(F.collect_set(F.struct("doc_no", "source_name")))
    grouped = rows.groupBy("query_id").agg(blocks.alias("b"), names.alias("n"))
    line = lambda x: F.format_string("- Document %d: %s", x["doc_no"], x["source_name"])
    return grouped.select("query_id", F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("context"), F.array_join(F.transform("n", line), "\n").alias("legend"))


def build_prompt(context: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, prompt: instructions around legend, excerpts and question."""
    # The instructions that answers depend on.
    rules = (
        "Review ALL excerpts for relevant information",
        "Synthesize information across multiple documents when appropriate",
        "Clearly cite sources using the form `Document X (FileName)`",
        "Quote specific passages verbatim when they materially support the answer",
        f'If no relevant information exists, respond exactly: "{NO_ANSWER}"',
    )
    parts = [
        F.lit("Analyze these excerpts to answer the question. Use ONLY the provided information."), F.concat(F.lit("DOCUMENT REFERENCE:\n"), F.col("legend")),
        F.concat(F.lit("EXCERPTS:\n"), F.col("context")), F.concat(F.lit("QUESTION: "), F.col("query")),
        F.lit("Instructions:\n" + "\n".join(f"- {r}" for r in rules)), F.lit("Response:"),
    ]
    return context.join(queries.select("query_id", "query"), "query_id").select("query_id", F.concat_ws("\n\n", *parts).alias("prompt"))
