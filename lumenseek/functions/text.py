"""Text functions as columns. White space is what Unicode and ASCII call so (``WS``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\x1c-\x1f\x85\p{Z}]+"
#: Texts of at most this length are never usable.
SHORT_TEXT = 20


def clean_text(text: Column) -> Column:
    """Every run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, WS, " "))


def tokens(text: Column) -> Column:
    """Lower-cased words between white space; punctuation stays."""
    return F.filter(F.split(F.lower(text), WS), lambda t: t != "")


def text_usable(text: Column) -> Column:
    """Whether extracted text is worth keeping: over 20 characters; not mostly single characters (of 50 words
    and more, over 60 %); not over 100 characters of at most four different letters."""
    stripped = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{WS}|{WS}$", "")
    words = F.filter(F.split(stripped, WS), lambda t: t != "")
    single = F.size(F.filter(words, lambda t: F.length(t) == 1))
    letters = F.size(F.filter(F.array_distinct(F.split(F.regexp_replace(stripped, r"[^\p{L}]", ""), "")), lambda c: c != ""))
    return (
        F.when(F.length(stripped) <= SHORT_TEXT, False)
        .when((F.size(words) >= 50) & (single > 0.6 * F.size(words)), False)
        .when((letters <= 4) & (F.length(stripped) > 100), False)
        .otherwise(True)
    )


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot, or "". A leading dot of a name begins no extension."""
    return F.lower(F.regexp_extract(basename(path), r"^.*[^.](\.[^.]*)$", 1))


def file_type(path: Column) -> Column:
    """Extension without its dot, or "unknown"."""
    bare = F.substring(extension(path), 2, 1_000)
    return F.when(bare == "", "unknown").otherwise(bare)


def preview(text: Column, size: int = 200) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def parse_expansions(response: Column, n: int) -> Column:
    """Query variants from a model's answer: a line each, without bullets and numbers in front, over five
    characters long, the first ``n``."""
    lines = F.transform(F.split(response, "\n"), lambda x: F.regexp_replace(F.trim(x), r"^[0-9.\-•* ]+", ""))
    return F.slice(F.filter(lines, lambda x: F.length(x) > 5), 1, n)


def skip_category(reason: Column) -> Column:
    """A skip reason's group: its text before a colon, without a full stop at the end."""
    base = F.regexp_replace(F.trim(F.substring_index(reason, ":", 1)), r"\.+$", "")
    return F.when(base == "unsupported file type", "incompatible file type").when(base == "file type not in filter", "filtered file type").otherwise(base)


def parse_extensions(value: str | None, supported: set[str]) -> set[str] | None:
    """Extensions of a comma-separated list, with dots; None if it is blank. Unknown ones: ValueError."""
    wanted = {"." + part.strip().lower().lstrip(".") for part in (value or "").split(",") if part.strip()}
    if unknown := sorted(wanted - supported):
        raise ValueError(f"Unsupported file types: {', '.join(x[1:] for x in unknown)}")
    return wanted or None


def normalize_url(url: str) -> str:
    return url.rstrip("/")
