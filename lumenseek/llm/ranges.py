"""Rows dealt into ranges of an order, whatever the keys: cuts are sampled quantiles, nothing is subtracted.

The order is that of the given keys, the last of them a hash of the row's content, then of the row's place in its
file, so that neither an outlying key nor one key, nor one row that repeats, can fill a range.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranges at most, and sampled keys for each: what the driver sorts stays under 20 MB.
MOST_RANGES, SAMPLES = 65_536, 8
def _below(cuts: list[tuple[int, ...]], names: list[str]) -> Column:
    """How many of the sorted ``cuts`` are not above the row's key, by binary search."""
    fields = "struct<" + ", ".join(f"{k}: bigint" for k in names) + ">"
    text = json.dumps([dict(zip(names, c, strict=True)) for c in cuts])
    table, key = F.from_json(F.lit(text), f"array<{fields}>"), F.struct(*names)
    steps = F.array(*[F.lit(1 << s) for s in range(len(cuts).bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, w: F.when(F.get(table, at + w - 1) <= key, at + w).otherwise(at))


def id_keys(id_col: str, text_col: str) -> list[Column]:
    """Keys of the order by a long id (nulls first), then by a hash of the text."""
    return [F.col(id_col).isNotNull().cast("long"), F.coalesce(F.col(id_col), F.lit(0).cast("long")), F.xxhash64(text_col)]


def with_ranges(rows: DataFrame, width: int, parts: list[Column]) -> tuple[DataFrame, list[str]]:
    """``rows`` with columns for ``parts`` (longs without nulls) and the row's place, whose names are returned, and
    ``range``: ranges of about ``width`` rows follow each other as these keys do. Rows equal in all parts keep
    some order among them."""
    n = rows.count()
    names = [f"k{i}" for i in range(len(parts) + 1)]
    ranges = max(1, min(MOST_RANGES, -(-n // width)))
    keyed = rows.select("*", *[c.alias(k) for k, c in zip(names, [*parts, F.monotonically_increasing_id()], strict=True)])
    if ranges == 1:
        return keyed.withColumn("range", F.lit(0)), names
    # Which keys are drawn decides how even the ranges are, not what comes out.
    drawn = keyed.select(*names).where(F.rand(31) < min(1.0, SAMPLES * ranges / n)).toArrow()
    found = np.stack([c.to_numpy() for c in drawn.columns], axis=1) if drawn.num_rows else np.zeros((0, len(names)), np.int64)
    found = found[np.lexsort(found.T[::-1])]
    at = np.unique(np.linspace(0, len(found), ranges + 1).astype(int)[1:-1])
    cuts = [tuple(map(int, c)) for c in found[at[at < len(found)]]]
    return keyed.withColumn("range", _below(cuts, names) if cuts else F.lit(0)), names
