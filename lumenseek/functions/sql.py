"""The column functions as SQL functions of a session: ``install(spark)``, then ``SELECT dynamic_alpha(query, 0.7) ...``.

They are expressions (``CREATE TEMPORARY FUNCTION ... RETURN``), so that plans see through them: no function is called
for a row, filters are pushed down and code is generated as if the expression had been written out.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .text import SHORT_TEXT, WS

_WS = WS.replace("\\", "\\\\")


def _unit(x: str) -> str:
    return f"greatest(0D, least(1D, {x}))"


def _words(x: str) -> str:
    return f"size(filter(split(coalesce({x}, ''), '{_WS}'), t -> t <> ''))"


#: Name -> parameters, type, body.
FUNCTIONS = {
    "clean_text": ("t STRING", "STRING", f"trim(regexp_replace(t, '{_WS}', ' '))"),
    "tokenize": ("t STRING", "ARRAY<STRING>", f"filter(split(lower(t), '{_WS}'), x -> x <> '')"),
    "text_usable": (
        "t STRING", "BOOLEAN",
        f"""aggregate(array(regexp_replace(coalesce(t, ''), '^{_WS}|{_WS}$', '')), false, (a, s) -> CASE
          WHEN length(s) <= {SHORT_TEXT} THEN false
          WHEN {_words('s')} >= 50 AND size(filter(split(s, '{_WS}'), x -> length(x) = 1)) > 0.6D * {_words('s')} THEN false
          WHEN size(filter(array_distinct(split(regexp_replace(s, '[^\\\\p{{L}}]', ''), '')), c -> c <> '')) <= 4 AND length(s) > 100 THEN false
          ELSE true END)""",
    ),
    "base_name": ("p STRING", "STRING", r"element_at(split(p, '[/\\\\]'), -1)"),
    "file_extension": ("p STRING", "STRING", r"lower(regexp_extract(element_at(split(p, '[/\\\\]'), -1), '^.*[^.](\\.[^.]*)$', 1))"),
    "file_type": ("p STRING", "STRING", "CASE WHEN length(file_extension(p)) <= 1 THEN 'unknown' ELSE substring(file_extension(p), 2, 1000) END"),
    "text_preview": ("t STRING", "STRING", "CASE WHEN length(t) > 200 THEN concat(substring(t, 1, 200), '...') ELSE t END"),
    "parse_expansions": (
        "answer STRING, n INT", "ARRAY<STRING>",
        r"slice(filter(transform(split(answer, '\n'), x -> regexp_replace(trim(x), '^[0-9.\\-•* ]+', '')), x -> length(x) > 5), 1, n)",
    ),
    "vector_dot": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    "vector_norm": ("v ARRAY<DOUBLE>", "DOUBLE", "sqrt(aggregate(v, 0D, (s, x) -> s + x * x))"),
    "vector_normalize": ("v ARRAY<DOUBLE>", "ARRAY<DOUBLE>", "transform(v, x -> x / (vector_norm(v) + 1e-12D))"),
    "dynamic_alpha": (
        "query STRING, base DOUBLE", "DOUBLE",
        f"""CASE WHEN {_words('query')} = 0 THEN {_unit('base')}
          WHEN {_words('query')} <= 3 THEN greatest(0.1D, least(1D, base - 0.25D))
          WHEN {_words('query')} >= 12 THEN {_unit('base + 0.15D')}
          ELSE greatest(0.1D, least(1D, base - 0.25D)) + ({_unit('base + 0.15D')} - greatest(0.1D, least(1D, base - 0.25D))) * (({_words('query')} - 3) / 9D) END""",
    ),
    "dense_rescale": ("score DOUBLE", "DOUBLE", _unit("(score - 0.5D) * 2D")),
    "min_max": ("score DOUBLE, least DOUBLE, most DOUBLE", "DOUBLE", "CASE WHEN most = least THEN 1D ELSE (score - least) / nullif(most - least, 0D) END"),
    "fuse_scores": ("alpha DOUBLE, dense DOUBLE, keyword DOUBLE", "DOUBLE", "alpha * dense_rescale(dense) + (1D - alpha) * keyword"),
    "safe_dpi": (
        "width DOUBLE, height DOUBLE, max_pixels DOUBLE, max_side DOUBLE, base_dpi INT", "INT",
        """CASE WHEN width = 0 OR height = 0 THEN 96 ELSE greatest(72, CAST(base_dpi * aggregate(
          array(width * (base_dpi / 72D), height * (base_dpi / 72D)),
          CASE WHEN width * (base_dpi / 72D) * (height * (base_dpi / 72D)) > max_pixels THEN sqrt(max_pixels / (width * (base_dpi / 72D) * (height * (base_dpi / 72D)))) ELSE 1D END,
          (s, side) -> CASE WHEN side * s > max_side THEN s * (max_side / (side * s)) ELSE s END) AS INT)) END""",
    ),
}


def install(spark: SparkSession) -> list[str]:
    """Creates, or replaces, all of them in the session; their names."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
