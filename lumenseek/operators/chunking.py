"""Chunking: fixed windows natively, recursive splitting by an Arrow function."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of the recursive splitter, coarse to fine. Fixed values.
SEPARATORS = ("\n\n", "\n", ". ", "? ", "! ", "; ", ", ", " ", "")
SIZE, OVERLAP = 1600, 200


def fixed_chunks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Windows of ``size`` characters, each ``size - overlap`` after the one before (at least 1): ``id_col``, the
    columns ``keep``, chunk_index, text, total_chunks. Null or blank texts have none."""
    step = max(1, size - overlap)
    text = F.trim(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(id_col, *keep, text.alias("t")).where("t <> ''").withColumn("total_chunks", F.floor((F.length("t") - 1) / step).cast("int") + 1)
    rows = rows.withColumn("chunk_index", F.explode(F.sequence(F.lit(0), F.col("total_chunks") - 1)))
    return rows.select(id_col, *keep, "chunk_index", F.substring(F.col("t"), F.col("chunk_index") * step + 1, F.lit(size)).alias("text"), "total_chunks")


def split_recursively(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters where separators allow, overlapping by at most ``overlap``. A
    separator stays at the head of the piece behind it."""
    at = next(i for i, s in enumerate(separators) if s == "" or s in text) if separators[-1] == "" else next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    chosen, finer = separators[at], separators[at + 1 :]
    if chosen:
        first, *rest = text.split(chosen)
        parts = [p for p in (first, *(chosen + r for r in rest)) if p]
    else:
        parts = list(text)
    out: list[str] = []
    small: list[str] = []
    for part in parts:
        if len(part) < size:
            small.append(part)
            continue
        out += _packed(small, size, overlap)
        small = []
        out += split_recursively(part, size, overlap, finer) if finer else [part]
    return out + _packed(small, size, overlap)


def _packed(parts: list[str], size: int, overlap: int) -> list[str]:
    """Neighbouring parts joined up to ``size``; the next chunk begins with the last parts, up to ``overlap``."""
    out: list[str] = []
    first = total = 0
    for i, part in enumerate(parts):
        if total + len(part) > size and i > first:
            out.append("".join(parts[first:i]).strip())
            while total > overlap or (total + len(part) > size and total > 0):
                total -= len(parts[first])
                first += 1
        total += len(part)
    out.append("".join(parts[first:]).strip())
    return [c for c in out if c]


def recursive_chunks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """As :func:`fixed_chunks`, split at sentence and word borders."""

    @F.arrow_udf("array<string>")
    def split(texts: pa.Array) -> pa.Array:
        return pa.array([split_recursively(t, size, overlap) if t else [] for t in texts.to_pylist()], pa.list_(pa.string()))

    text = F.trim(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(id_col, *keep, split(text).alias("c"))
    return rows.select(id_col, *keep, F.size("c").alias("total_chunks"), F.posexplode("c").alias("chunk_index", "text")).select(id_col, *keep, "chunk_index", "text", "total_chunks")


def register_chunker(spark: SparkSession, name: str = "split_chunks") -> None:
    """Table functions for SQL. For whole tables, in batches: ``SELECT * FROM split_chunks_table(TABLE(SELECT key, text, size,
    overlap FROM ...))``, whose rows have the key (a string) of the text that they are of. For single texts, row by row, as
    Spark joins no batches laterally: ``SELECT ... FROM docs, LATERAL split_chunks(text, size, overlap)``."""

    class Chunker:
        def eval(self, text: str | None, size: int, overlap: int) -> Iterator[tuple[int, str]]:
            yield from enumerate(split_recursively(text.strip(), size, overlap) if text and text.strip() else [])

    class TableChunker:
        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
            texts, sizes, overlaps = (batch.column(c).to_pylist() for c in ("text", "size", "overlap"))
            found = [split_recursively(t.strip(), s, o) if t and t.strip() else [] for t, s, o in zip(texts, sizes, overlaps, strict=True)]
            rows = pa.array([i for i, c in enumerate(found) for _ in c], pa.int64())
            yield pa.table({
                "key": batch.column("key").cast(pa.string()).take(rows),
                "chunk_index": pa.array([i for c in found for i in range(len(c))], pa.int32()), "text": pa.array([x for c in found for x in c], pa.string()),
            })

    spark.udtf.register(name, F.udtf(Chunker, returnType="chunk_index int, text string"))
    spark.udtf.register(f"{name}_table", F.arrow_udtf(TableChunker, returnType="key string, chunk_index int, text string"))
