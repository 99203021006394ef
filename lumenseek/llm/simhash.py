"""SimHash fingerprints and their search by permuted block tables, with DataFrame functions only.

A text's terms are its lower-cased words; each occurrence votes with the word's length (at most ``LONGEST``)
as weight, for or against each of 128 bits, by two 64-bit hashes. A bit is set if more than half of the
weight votes for it. Votes are added up in 64 long sums of two 31-bit lanes each (a text has under 2^31
bytes, so no lane can overflow), right where the words are exploded: what is shuffled is one row of sums
for each text.

Search: the bits are cut into blocks; fingerprints that differ in at most r bits agree in all but r blocks,
so a table for each choice of ``blocks - r`` blocks, keyed by their bits, brings every such pair together.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import id_keys, with_ranges
from .scratch import Scratch

BITS = 128
LONGEST = 12
#: Rows in a range in which the next document is looked up, and bytes of text that a task takes.
RANGE_ROWS, TASK_BYTES = 512, 32 << 20
_LANES = (1 << 32) + 1


def _votes() -> list[Column]:
    """For each hash word and i in 0..31 the bits i and i + 32, in the low and high half of a long."""
    return [
        F.sum(F.shiftrightunsigned(f"h{part}", i).bitwiseAND(F.lit(_LANES)) * F.col("w")).alias(f"v{part}_{i}")
        for part in range(BITS // 64)
        for i in range(32)
    ]


def _majority(part: int) -> Column:
    """Hex of the 64 bits of one hash word, the highest bit first."""
    halves = []
    for shift in (32, 0):
        bits = F.lit(0).cast("long")
        for i in range(32):
            lane = F.shiftrightunsigned(f"v{part}_{i}", shift).bitwiseAND(F.lit((1 << 32) - 1))
            bits = bits + F.when(lane * 2 > F.col("weight"), F.lit(1 << i)).otherwise(F.lit(0))
        halves.append(F.lpad(F.lower(F.hex(bits)), 8, "0"))
    return F.concat(*halves)


def fingerprints(rows: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """``keys``, times (rows with that key), fingerprint (32 hex digits): one row for each distinct key.

    Keys must name a text (rows that agree in them must agree in the text). Null and empty texts, and texts
    of white space, have all bits 0. Equal texts have equal fingerprints.
    """
    split = F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[\x20\x09-\x0D]+")
    terms = rows.select(*keys, F.posexplode(split).alias("at", "term"))
    hashed = terms.select(
        *keys, "at", F.least(F.length("term"), F.lit(LONGEST)).cast("long").alias("w"),
        *[F.xxhash64("term", F.lit(p)).alias(f"h{p}") for p in range(BITS // 64)],
    )
    votes = hashed.groupBy(*keys).agg(F.sum("w").alias("weight"), F.count_if(F.col("at") == 0).alias("times"), *_votes())
    return votes.select(*keys, "times", F.concat(*[_majority(p) for p in range(BITS // 64)]).alias("fingerprint"))


def _words(fingerprint: Column) -> list[Column]:
    """Eight 16-bit numbers, as longs."""
    return [F.conv(F.substring(fingerprint, 1 + 4 * j, 4), 16, 10).cast("long") for j in range(BITS // 16)]


def distance(a: Column, b: Column) -> Column:
    """Hamming distance of two fingerprints."""
    out = F.lit(0)
    for x, y in zip(_words(a), _words(b), strict=True):
        out = out + F.bit_count(x.bitwiseXOR(y))
    return out


def likeness(a: Column, b: Column) -> Column:
    return F.lit(1.0) - distance(a, b) / F.lit(float(BITS))


def within_radius(prints: DataFrame, radius: int = 3, blocks: int = 8, fingerprint_col: str = "fingerprint") -> DataFrame:
    """All pairs of distinct fingerprints at most ``radius`` bits apart: a < b, distance.

    Each distinct fingerprint is one entry, so copies cost nothing; membership is the table of fingerprints
    itself. Blocks are of equal width; ``blocks`` > ``radius``. A pair that meets in several tables is
    emitted by the first only. Null fingerprints take no part.
    """
    if not 0 <= radius < blocks or BITS % (4 * blocks):
        raise ValueError("blocks must exceed radius and divide the fingerprint into whole hex digits")
    width = BITS // 4 // blocks
    cut = [F.substring("f", 1 + width * j, width) for j in range(blocks)]
    tables = list(combinations(range(blocks), blocks - radius))
    entries = prints.select(F.col(fingerprint_col).alias("f")).where("f is not null").distinct().select(
        "f", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.concat(*[cut[j] for j in c]).alias("key")) for t, c in enumerate(tables)])).alias("e")
    ).select("f", "e.t", "e.key")
    pair = entries.alias("x").join(entries.alias("y"), (F.col("x.t") == F.col("y.t")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.f") < F.col("y.f")))
    pair = pair.select(F.col("x.f").alias("a"), F.col("y.f").alias("b"), F.col("x.t").alias("t")).withColumn("distance", distance(F.col("a"), F.col("b"))).where(F.col("distance") <= radius)
    # The first table in which the two agree, from the blocks in which they do.
    same = [F.substring("a", 1 + width * j, width) == F.substring("b", 1 + width * j, width) for j in range(blocks)]
    first = F.lit(len(tables))
    for t in range(len(tables) - 1, -1, -1):
        agree = F.lit(True)
        for j in tables[t]:
            agree = agree & same[j]
        first = F.when(agree, F.lit(t)).otherwise(first)
    return pair.where(F.col("t") == first).select("a", "b", "distance")


def _name(text: Column) -> Column:
    """128 bits that stand for a text: among 10^10 of them none are expected to collide."""
    return F.unhex(F.md5(F.encode(text, "UTF-8")))


def with_next(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``range``, ``id``, ``text`` and ``next``: the text of the next row by id (after the last: the first).

    Rows are dealt into ranges of about ``RANGE_ROWS`` rows, cut at sampled quantiles; inside a range a window finds
    the next row, and the last row of a range takes the head of the next range that has rows. Null ids come first;
    equal ids are ordered by a hash of their texts. No task holds more than its ranges, or one number for each
    range. The rows stay dealt by ``range``, so what groups by it needs no further shuffle.
    """
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    ranged, key = with_ranges(rows, RANGE_ROWS, id_keys("id", "text"))
    ranged = Scratch(rows.sparkSession).keep(ranged)  # read twice: a row must not change its range in between
    inside = ranged.repartition(tasks, "range").withColumn("next", F.lead("text").over(Window.partitionBy("range").orderBy(*key)))
    # Heads are found before texts move: one row for each range and task is shuffled.
    ranges = ranged.groupBy("range").agg(F.min_by("text", F.struct(*key)).alias("head"))
    every = Window.orderBy("range")
    follow = ranges.select("range").withColumn("after", F.lead("range").over(every)).withColumn("after", F.coalesce("after", F.min("range").over(Window.partitionBy())))
    heads = follow.join(ranges.select(F.col("range").alias("after"), "head"), "after").select("range", "head")
    return inside.join(heads, "range").select("range", "id", "text", F.coalesce("next", "head").alias("next"))


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last floor(n_chars / 2) characters give way to
    the first as many (or all) of the next document's: ``id_col``, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next (share of equal bits with the edited text's and with the next
    document's fingerprint).

    Ids are whole numbers of any size. Null text: as empty. Null ids come first in the order; equal ids are
    ordered by a hash of their texts; repeated rows give repeated results. A single document is its own next. An empty table gives an empty result.
    """
    pairs = with_next(docs, id_col, text_col)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next"), F.lit(1), half))
    named = pairs.select("range", "id", "text", edited.alias("edited"), _name(F.col("next")).alias("after")).select(
        "range", "id", "after", "text", "edited", _name(F.col("text")).alias("own"), F.length("text").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
    )
    # A key names a row's text; the two texts of a row are two terms streams with one key each.
    keys = ["range", "id", "own", "after", "n_chars", "edited_sha256", "kind"]
    both = named.select(
        *keys[:-1], F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))).alias("e")
    ).select(*keys[:-1], "e.kind", "e.text")
    prints = fingerprints(both, keys)
    per_row = Scratch(docs.sparkSession).keep(prints.groupBy(*keys[:-1]).agg(
        F.max("times").alias("times"),
        F.max(F.when(F.col("kind") == 0, F.col("fingerprint"))).alias("fingerprint"),
        F.max(F.when(F.col("kind") == 1, F.col("fingerprint"))).alias("edited_fingerprint"),
    ))
    # The next document's fingerprint, by its text: one row for each distinct text on that side.
    by_text = per_row.groupBy(F.col("own").alias("after")).agg(F.min("fingerprint").alias("next_fingerprint"))
    out = per_row.join(by_text, "after").select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"), "times",
    )
    return out.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("times", "time")
