"""Which files to leave out, and why; counts of reasons."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import skip_category

#: Extensions that can be read. Fixed values.
SUPPORTED = (".pdf", ".html", ".htm", ".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp")


def skip_reason(
    name: Column, ext: Column, size: Column, seen: Column, skip_names: Iterable[str] = (), allowed: Iterable[str] | None = None,
    max_mb: float = 200.0, pages: Column | None = None, max_pages: int = 200, has_form: Column | None = None, skip_forms: bool = True, openable: Column | None = None, why: Column | None = None,
) -> Column:
    """The first reason that holds, or null: name on the skip list, extension, already processed, unknown size,
    too large, then what only PDFs have. Cheap tests come first; ``seen`` is a boolean from the ledger."""
    extensions = list(SUPPORTED if allowed is None else allowed)
    # The reasons' wording, which summaries group by.
    refused = "file type not in filter: " if allowed is not None else "unsupported file type: "
    mb = size / F.lit(1048576.0)
    reason = (
        F.when(name.isin(list(skip_names)), "file in hard-coded skip list.")
        .when(~ext.isin(extensions), F.concat(F.lit(refused), ext))
        .when(seen, "already processed")
        .when(size.isNull(), "cannot stat file")
        .when(mb > max_mb, F.format_string("large file (%.1f MB)", mb))
    )
    pdf = ext == ".pdf"
    if openable is not None:
        reason = reason.when(pdf & ~openable, "cannot open PDF" if why is None else F.concat(F.lit("cannot open PDF: "), F.coalesce(why, F.lit(""))))
    if pages is not None:
        reason = reason.when(pdf & (pages > max_pages), F.format_string("PDF with %d pages", pages))
    if has_form is not None and skip_forms:
        reason = reason.when(pdf & has_form, "form-heavy PDF (has interactive fields)")
    return reason


def skip_breakdown(files: DataFrame, reason_col: str = "reason") -> DataFrame:
    """reason, n: files of each group of reasons, in order of the reason."""
    return files.where(F.col(reason_col).isNotNull()).groupBy(skip_category(F.col(reason_col)).alias("reason")).agg(F.count("*").alias("n")).orderBy("reason")


def run_counters(files: DataFrame, reason_col: str = "reason", failed: Column | None = None) -> DataFrame:
    """One row: candidates, processed, already_processed, skipped, failed. A file counts once."""
    reason, failed = F.col(reason_col), F.lit(False) if failed is None else failed
    return files.agg(
        F.count("*").alias("candidates"), F.count_if(reason.isNull() & ~failed).alias("processed"), F.count_if(reason == "already processed").alias("already_processed"),
        F.count_if(reason.isNotNull() & (reason != "already processed")).alias("skipped"), F.count_if(reason.isNull() & failed).alias("failed"),
    )
