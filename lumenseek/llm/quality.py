"""Quality scores by nearest-neighbour voting in a latent-semantic space.

Terms are the character trigrams (of UTF-8 bytes) of a text and its pairs of neighbouring words, each hashed to
cells, and its runs of four words up to renaming (which of the four are equal), which words of any spelling
share. Their document frequencies are counted over all documents. A bounded sample of labelled rows
(``LABELLED``) is weighted (log count times inverse document frequency, unit length) and decomposed: the
leading ``DIMENSIONS`` right singular vectors span the latent space. The labelled vectors are broadcast (under
2 MB); every document's cosines with all of them are computed exactly, block by block, and the labels of its
``NEIGHBOURS`` nearest vote with their similarity as weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import bound_batches
from .words import held, mix, pieces, text_buffers, tidy, word_hashes

#: Cells of trigrams, cells of word pairs, and codes of four words up to renaming (2 * 3 * 4).
TRIGRAMS, PAIRS, SHAPES = 2048, 2048, 24
TERMS = TRIGRAMS + PAIRS + SHAPES
#: Documents whose counts are held at once.
ROWS = 256
LABELLED = 3000
DIMENSIONS, NEIGHBOURS = 64, 15


def _shapes(words: np.ndarray) -> np.ndarray:
    """For each run of four words a code of which are equal: each word's place is that of the first equal one."""
    n = max(0, len(words) - 3)
    code, scale = np.zeros(n, dtype=np.int64), 1
    for j in range(1, 4):
        first = np.full(n, j)
        for i in range(j - 1, -1, -1):
            first[words[i : i + n] == words[j : j + n]] = i
        code += scale * first
        scale *= j + 1
    return code


def term_counts(texts: pa.Array) -> Iterator[np.ndarray]:
    """Counts of all terms, one row for each text, a piece of documents at a time."""
    raw, offsets = text_buffers(texts)
    for a, b in ((x, min(x + ROWS, b)) for a, b in pieces(offsets) for x in range(a, b, ROWS)):
        data, ends = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        cells = np.zeros(len(data), dtype=np.int64)
        if len(data) > 2:
            wide = data.astype(np.uint32)
            key = wide[:-2] * np.uint32(0x9E3779B1) + wide[1:-1] * np.uint32(0x85EBCA77) + wide[2:] * np.uint32(0xC2B2AE3D)
            key ^= key >> np.uint32(15)
            key *= np.uint32(0x2C1B3C6D)
            cells[:-2] = key >> np.uint32(32 - (TRIGRAMS.bit_length() - 1))
        words, at = word_hashes(data, ends)
        pairs = (mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]) >> np.uint64(64 - (PAIRS.bit_length() - 1))).astype(np.int64)
        shapes = _shapes(words)
        out = np.zeros((b - a, TERMS), dtype=np.float32)
        parts = ((cells, ends, 3, 0, TRIGRAMS), (pairs, at, 2, TRIGRAMS, PAIRS), (shapes, at, 4, TRIGRAMS + PAIRS, SHAPES))
        for i in range(b - a):
            for values, places, width, first, size in parts:
                begin, end = places[i], places[i + 1] - width + 1
                if end > begin:
                    out[i, first : first + size] = np.bincount(values[begin:end], minlength=size)
        yield out


@tidy
def _document_counts(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each term, and documents, of one partition."""
    found, n = np.zeros(TERMS, dtype=np.int64), 0
    held("quality")
    for batch in stream:
        for counts in term_counts(batch.column(0)):
            found += (counts > 0).sum(axis=0)
            n += len(counts)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, TERMS)), pa.array(np.concatenate([[n], found]))], ["term", "n"])


@dataclass
class Latent:
    """Everything a score needs; nothing in it grows with the corpus."""

    weights: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int

    @property
    def prior(self) -> float:
        return float(self.labels.mean()) if len(self.labels) else 0.5

    def place(self, counts: np.ndarray) -> np.ndarray:
        """Unit vectors in the latent space; a text without known terms: zero."""
        return _unit(_unit(np.log1p(counts) * self.weights) @ self.axes)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest; the prior where nothing is similar."""
        out = np.full(len(counts), self.prior)
        if not len(self.labels):
            return out
        k = min(self.neighbours, len(self.labels))
        for a in range(0, len(counts), 512):
            cosine = self.place(counts[a : a + 512]) @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0.0).astype(np.float64)
            total = weight.sum(axis=1)
            voted = (weight * self.labels[near]).sum(axis=1)
            out[a : a + 512] = np.where(total > 1e-9, voted / np.maximum(total, 1e-9), self.prior)
        return np.clip(out, 0.0, 1.0)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _leading_axes(x: np.ndarray, rounds: int = 6) -> np.ndarray:
    """Leading right singular vectors, as columns, by subspace iteration from a seeded start."""
    axes = np.random.default_rng(3).standard_normal((x.shape[1], DIMENSIONS + 16))
    for _ in range(rounds):
        axes, _ = np.linalg.qr(x.T @ (x @ axes))
    _, _, turn = np.linalg.svd(x @ axes, full_matrices=False)
    return np.ascontiguousarray((axes @ turn.T)[:, :DIMENSIONS]) if len(x) >= DIMENSIONS else axes[:, :DIMENSIONS]


def _spread(id_text: Column) -> Column:
    return F.xxhash64(F.coalesce(id_text, F.lit("")), F.lit(29))


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, neighbours: int = NEIGHBOURS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Latent:
    """Learns from ``labels`` (``id_col``, ``label_col``: 0 or 1), at most ``labelled`` rows of them, chosen by a
    hash of the id; rows with null id or label are left out, several labels of one id are averaged and
    rounded. Term statistics cover all of ``docs``. Without labelled documents every score is 0.5.
    """
    bound_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = texts.mapInArrow(_document_counts, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    by_term = {r.term: r.n for r in total}
    found = np.array([by_term.get(t, 0) for t in range(TERMS)], dtype=np.float64)
    weights = np.log((1 + by_term.get(-1, 0)) / (1 + found)) + 0.1

    known = labels.select(F.col(id_col).cast("string").alias("id"), F.col(label_col).cast("double").alias("label")).where("id is not null and label is not null")
    known = known.groupBy("id").agg(F.round(F.avg("label")).cast("int").alias("label"))
    known = known.orderBy(_spread(F.col("id")), "id").limit(labelled)
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # A bounded set of ids. Texts are counted where they are; what is ordered and comes back has a bounded size.
    chosen = rows.join(F.broadcast(known), "id").select("label", _spread(F.col("id")).alias("spread"), "id", F.md5(F.encode("text", "UTF-8")).alias("digest"), "text")

    @tidy
    def counted(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            at = 0
            for counts in term_counts(batch.column(4)):
                n = len(counts)
                found = [np.flatnonzero(r) for r in counts]
                terms = [f.astype("<u2").tobytes() for f in found]
                times = [np.minimum(r[f], 65_535).astype("<u2").tobytes() for r, f in zip(counts, found, strict=True)]
                columns = [batch.column(i).slice(at, n) for i in range(4)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(terms, pa.binary()), pa.array(times, pa.binary())], ["label", "spread", "id", "digest", "terms", "times"])
                at += n

    every = chosen.mapInArrow(counted, "label int, spread long, id string, digest string, terms binary, times binary")
    got = every.orderBy("spread", "id", "digest").limit(labelled).select("label", "terms", "times").toArrow()
    values = np.zeros((got.num_rows, TERMS), dtype=np.float32)
    for i, (terms, times) in enumerate(zip(got.column(1).to_pylist(), got.column(2).to_pylist(), strict=True)):
        values[i, np.frombuffer(terms, dtype="<u2")] = np.frombuffer(times, dtype="<u2")
    given = np.array(got.column(0).to_pylist(), dtype=np.float64)
    axes = _leading_axes(_unit(np.log1p(values) * weights.astype(np.float32)).astype(np.float64))
    model = Latent(weights.astype(np.float32), axes.astype(np.float32), np.zeros((0, DIMENSIONS), np.float32), given, neighbours)
    model.vectors = model.place(values)
    return model


def score_documents(docs: DataFrame, model: Latent, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and score (0 to 1) of every row; labels, ids and other columns are not inputs.

    Null text: as empty. Texts without terms (empty, or one word of under three bytes) take the labelled rows' mean.
    Equal texts have equal scores, so a text that was learned from is among its own neighbours. Repeated rows
    give repeated results.
    """
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            scores = [sent.value.score(c) for c in term_counts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([*scores, np.zeros(0)]))], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def with_scores(docs: DataFrame, model: Latent, text_col: str = "text", score_col: str = "_score") -> DataFrame:
    """All columns of ``docs`` and ``score_col``, by an Arrow function on the text alone."""
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    @tidy
    def score(stream: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held("quality")
        for texts in stream:
            yield pa.array(np.concatenate([*(sent.value.score(c) for c in term_counts(texts)), np.zeros(0)]))

    return docs.withColumn(score_col, score(F.col(text_col).cast("string")))
