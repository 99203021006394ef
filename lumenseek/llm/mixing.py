"""Mixing sources to target weights: repetition rates, whole copies, one seeded Bernoulli copy.

Sizes (words) are added up per source. Weights share out the total; a source's target stops at ``CAP`` times
its size and the excess is shared again by weight until none is above, which is one water level L: target =
min(cap, weight * L). Each round adds up, over the table of sources, the caps that L has reached and the
weights of the others. A document is emitted floor(rate) times plus once more with probability
rate - floor(rate), rate being its source's target / size, decided by one seeded hash of its id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

CAP = 3
SEED = 0
#: Bytes of the table of sources up to which it is broadcast to the documents; beyond it, both are shuffled.
BROADCAST_BYTES = 32_000_000
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _draw(id_text: Column) -> Column:
    """A number in [0, 1) from an id: 32 bits of md5("<seed>:<id>")."""
    digest = F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(id_text, F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0


def _weighed(per_source: DataFrame, scratch: Scratch, weights: Sequence[float]) -> DataFrame:
    """Sources (source, source_size) with w, the weights in turn in order of the source, and cap. Sources may be
    many (hosts, say): they are sorted in ranges, which count on from the ranges before."""
    dealt = per_source.repartitionByRange(F.asc_nulls_last("source")).sortWithinPartitions(F.asc_nulls_last("source"))
    placed = scratch.keep(dealt.withColumn("m", F.monotonically_increasing_id()))  # partition << 33 | row
    part = F.shiftright("m", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    k = F.col("before") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = placed.withColumn("part", part).join(before, "part")
    return ranked.select("source", "source_size", F.get(cycle, F.pmod(k, F.lit(len(weights))).cast("int")).alias("w"), (F.col("source_size") * float(CAP)).alias("cap"))


def _level(weighed: DataFrame) -> float:
    level, full = 0.0, -1
    while True:
        below = F.col("cap") >= F.col("w") * level
        total, capped, free, n = weighed.agg(
            F.sum("source_size"), F.sum(F.when(~below, F.col("cap")).otherwise(0.0)), F.sum(F.when(below, F.col("w")).otherwise(0.0)), F.count_if(~below)
        ).first()
        if not total or n == full or not free:
            return level
        level, full = (total - capped) / free, n


def source_rates(docs: DataFrame, scratch: Scratch, weights: Sequence[float], id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, source, size) of every row, and (source, source_size, target, rate) of every source."""
    sized = scratch.keep(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), words(F.col(text_col).cast("string")).alias("size")))
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weighed = scratch.keep(_weighed(per_source, scratch, weights))
    rated = weighed.withColumn("target", F.least("cap", F.col("w") * _level(weighed)))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return sized, rated.select("source", "source_size", "target", rate.alias("rate"))


def _with_copies(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """``rows`` (id, source, ...) with source_size, target and copies."""
    rates = rates.withColumnRenamed("source", "s")
    size = rates.agg(F.sum(F.coalesce(F.octet_length("s"), F.lit(0)) + 40)).first()[0] or 0
    out = rows.join(F.broadcast(rates) if size <= BROADCAST_BYTES else rates, F.col("source").eqNullSafe(F.col("s")))
    extra = _draw(F.col("id").cast("string")) < F.col("rate") - F.floor("rate")
    return out.withColumn("copies", F.floor("rate") + extra.cast("long"))


def plan_mixture(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """What the mix takes of every row: ``id_col``, source, size, source_size, target, copies.

    Sources stand in order of their code points, null last as a source of its own, and take ``weights`` in
    turn. Null text: size 0. Rows with one id are each decided alike. A null id is hashed as "". Sources
    without words have target 0 and no copies. An empty table gives an empty result.
    """
    sized, rates = source_rates(docs, Scratch(docs.sparkSession), weights, id_col, text_col, source_col)
    return _with_copies(sized, rates).select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "copies")


def mix_sources(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the rows of ``docs``, all columns, each as often as :func:`plan_mixture` says."""
    _, rates = source_rates(docs, Scratch(docs.sparkSession), weights, id_col, text_col, source_col)
    # The rows travel packed, so that no column of theirs can clash.
    packed = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    out = _with_copies(packed, rates).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


MIX_SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), per_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM per_source
), weighed AS (
  SELECT *, CAST((k - 1) % 3 + 1 AS DOUBLE) AS w, CAST(source_size * 3 AS DOUBLE) AS cap FROM ranked
), levels AS (
  SELECT *, (CAST((SELECT sum(source_size) FROM per_source) AS DOUBLE)
             - (sum(cap) OVER (ORDER BY cap / w, k ROWS UNBOUNDED PRECEDING) - cap))
            / sum(w) OVER (ORDER BY cap / w DESC, k DESC ROWS UNBOUNDED PRECEDING) AS level
  FROM weighed
), rated AS (
  SELECT source, source_size, least(cap, w * (SELECT max(level) FROM levels)) AS target FROM levels
), rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM rated
), drawn AS (
  SELECT d.doc_id, d.size, r.source_size, r.target,
    CAST(floor(r.rate) AS BIGINT) + CASE WHEN CAST(('0x' || substr(md5('0:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) / 4294967296.0
      < r.rate - floor(r.rate) THEN 1 ELSE 0 END AS copies
  FROM sized d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken FROM drawn
"""
