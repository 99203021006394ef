"""Vector arithmetic and score fusion as columns. All sums are in double precision."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from .text import WS


def dot(a: Column, b: Column) -> Column:
    """Inner product."""
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """Components over norm + 1e-12; a zero vector stays zero."""
    return F.transform(v, lambda x: x.cast("double") / (l2_norm(v) + 1e-12))


def _unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def dynamic_alpha(query: Column, base: Column | float) -> Column:
    """Weight of the dense score: less for short queries, more for long ones, linear between 3 and 12 words;
    of a blank query the base itself."""
    base = base if isinstance(base, Column) else F.lit(float(base))
    n = F.size(F.filter(F.split(F.coalesce(query, F.lit("")), WS), lambda t: t != ""))
    low, high = F.greatest(F.lit(0.1), F.least(F.lit(1.0), base - 0.25)), _unit(base + 0.15)
    return F.when(n == 0, _unit(base)).when(n <= 3, low).when(n >= 12, high).otherwise(low + (high - low) * ((n - 3) / F.lit(9.0)))


def dense_rescale(score: Column) -> Column:
    """Scores from 0.5 on, stretched to 0..1."""
    return _unit((score - 0.5) * 2.0)


def minmax(score: Column, *per: str) -> Column:
    """Score between its group's least (0) and most (1); all equal: 1."""
    window = Window.partitionBy(*per)
    least, most = F.min(score).over(window), F.max(score).over(window)
    return F.when(most == least, F.lit(1.0)).otherwise((score - least) / F.when(most == least, F.lit(1.0)).otherwise(most - least))


def fuse(alpha: Column, dense: Column, keyword: Column) -> Column:
    return alpha * dense_rescale(dense) + (1.0 - alpha) * keyword
