"""From raw documents to token ids: quality, near-duplicates, secrets, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; between stages the
rows are written as Parquet and read again. Rows may hold nulls in any column, repeat, or be none at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenseek.llm.bpe import encode_documents
from lumenseek.llm.minhash import near_duplicates
from lumenseek.llm.mixing import mix_sources
from lumenseek.llm.quality import fit, with_scores
from lumenseek.llm.queries import QUALITY_CUT
from lumenseek.llm.scratch import Scratch, without_ids
from lumenseek.llm.secrets import redact


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose neighbours among the labelled ones vote for quality 1."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = max(docs.columns, key=len) + "_score"  # no column has this name
    return with_scores(docs, model, score_col=score).where(F.col(score) >= QUALITY_CUT).select(*docs.columns)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates (five-word shingles, similarity 0.8).
    Rows with one id and one text are one document; rows with one id and different texts are several."""
    scratch = Scratch(spark)
    if not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        gone = scratch.keep(near_duplicates(docs, shingle_words=5, percent=80).where(~F.col("kept")).select("doc_id").distinct())
        return without_ids(docs, gone, "doc_id")
    # Ids repeat: each document takes a number of its own, and ids only say which of a group stays.
    number, digest = max(docs.columns, key=len) + "_number", F.md5(F.encode("text", "UTF-8"))
    others = [f.name for f in docs.schema if f.name not in ("doc_id", "text") and "map<" not in f.dataType.simpleString()]  # maps have no order
    # Of rows with one id and one text the least stays, by an aggregation that is partial before the shuffle.
    row, least = F.struct(*docs.columns), F.struct(*others) if others else F.lit(0)
    once = docs.where("doc_id is not null").groupBy("doc_id", digest.alias("_digest")).agg(F.min_by(row, least).alias("_row")).select("_row.*")
    rows = docs.where("doc_id is null").unionByName(once)
    rows = scratch.keep(rows.withColumn(number, F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())))
    found = near_duplicates(rows, id_col=number, shingle_words=5, percent=80).where("component_id is not null").select(number, "component_id")
    found = scratch.keep(found.join(rows.select(number, "doc_id", digest.alias("digest")), number))
    first = found.groupBy("component_id").agg(F.min(F.struct("doc_id", "digest", number)).getField(number).alias("first"))
    gone = scratch.keep(found.join(first, "component_id").where(F.col(number) != F.col("first")).select(number))
    return without_ids(rows, gone, number).select(*docs.columns)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced in their texts."""
    kind = docs.schema["n_chars"].dataType
    return redact(docs).withColumn("n_chars", F.length("text").cast(kind)).select(*docs.columns)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for."""
    return mix_sources(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids: doc_id, n_tokens, ids (little-endian unsigned 32-bit integers)."""
    return encode_documents(docs).select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality_classifier", keep_good_quality),
    ("near_dedup", keep_one_of_near_duplicates),
    ("secret_scan", hide_secrets),
    ("source_mixing", mix_to_weights),
    ("bpe_encoding", encode),
]

#: The classifier and the exact near-duplicate groups have no SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
