"""What models and renderers plug into, with offline defaults that always answer alike.

A provider is an object with the methods named here; it is sent to the workers as it is. Real embedders,
rerankers, OCR engines and language models are written against the same protocols.
"""

from __future__ import annotations

import copy
import hashlib
import json
import re
import time
import urllib.error
import urllib.request
import warnings
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators.context import NO_ANSWER


class Embedder(Protocol):
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class Reranker(Protocol):
    def score(self, query: list[str], text: list[str]) -> list[float]: ...


class TextExtractor(Protocol):
    """PDF and image text. ``pages`` gives, for each page: its text layer, the text of its embedded images, and the
    text of the rendered page; the latter two as strings, or as functions, called only for a page whose text
    layer doesn't serve. An extractor may also have ``inspect(content)``: pages, and whether a PDF has a form; and
    ``page_range(content, first, count)``: as ``pages``, of some pages alone, so that tasks can share a long PDF."""

    def pages(self, content: bytes) -> Iterable[tuple[str, str | Callable[[], str], str | Callable[[], str]]]: ...

    def image(self, content: bytes) -> str: ...


class LanguageModel(Protocol):
    def generate(self, prompt: str) -> str: ...

    def is_available(self) -> bool: ...


class HashingEmbedder:
    """Signed hashed words, unit length: texts that share words are near each other. A word's cell and sign come from
    its MD5, once for each distinct word of a batch."""

    def __init__(self, dim: int = 256):
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        words = [(t or "").lower().split() for t in texts]
        distinct: dict[str, int] = {}
        at = np.array([distinct.setdefault(w, len(distinct)) for ws in words for w in ws], dtype=np.int64)
        digests = [hashlib.md5(w.encode("utf-8", "surrogatepass")).digest() for w in distinct]
        cell = np.array([int.from_bytes(d[:4], "big") % self.dim for d in digests], dtype=np.int64)
        sign = np.array([1.0 if d[4] & 128 else -1.0 for d in digests])
        out = np.zeros((len(texts), self.dim), dtype=np.float64)
        if len(at):
            np.add.at(out, (np.repeat(np.arange(len(texts)), [len(w) for w in words]), cell[at]), sign[at])
        norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return (out / (norm + 1e-12)).astype(np.float32)


class NoExtractor:
    """Stands in where no PDF or OCR engine is installed: every page and image is empty."""

    def pages(self, content: bytes) -> list[tuple[str, str, str]]:
        return []

    def image(self, content: bytes) -> str:
        return ""


class ExtractiveModel:
    """Answers with the sentence of the excerpts that shares most words with the question."""

    def generate(self, prompt: str) -> str:
        question = set(prompt.rpartition("QUESTION: ")[2].partition("\n")[0].lower().split())
        excerpts = prompt.partition("EXCERPTS:\n")[2].rpartition("QUESTION: ")[0]
        best = max(re.split(r"(?<=[.!?])\s+|\n", excerpts), key=lambda s: len(question & set(s.lower().split())), default="")
        return best.strip() if question & set(best.lower().split()) else NO_ANSWER

    def is_available(self) -> bool:
        return True


class HttpModel:
    """A language-model server: POST /api/generate, tags at /api/tags. Failing calls are repeated with waiting
    times from 1 to 5 seconds; what still fails is answered by a warning text."""

    def __init__(self, url: str, model: str, timeout: float = 180.0, options: dict | None = None, attempts: int = 3):
        self.url, self.model, self.timeout, self.options, self.attempts = url.rstrip("/"), model, timeout, options or {}, attempts
        self._available: bool | None = None
        self._given, self.purposes = dict(self.options), {}

    def configure(self, settings) -> None:
        """Takes the request's time limit and the sampling options, and those for expansion, from the settings; options that
        the model was made with stay."""
        self.timeout = float(settings.request_timeout)
        self.options = {"temperature": settings.temperature, "top_p": settings.top_p, "num_predict": settings.max_tokens, **self._given}
        wider = {"temperature": settings.expansion_temperature, "top_p": settings.expansion_top_p, "num_predict": settings.expansion_max_tokens}
        self.purposes = {"expansion": (float(settings.expansion_timeout), {**wider, **self._given})}

    def for_purpose(self, purpose: str) -> HttpModel:
        """The same model with the time limit and options of a purpose."""
        out = copy.copy(self)
        out.timeout, out.options = self.purposes.get(purpose, (self.timeout, self.options))
        return out

    def _call(self, path: str, body: dict | None = None) -> dict:
        data = None if body is None else json.dumps(body).encode()
        request = urllib.request.Request(self.url + path, data, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return json.load(answer)

    def generate(self, prompt: str) -> str:
        why = ""
        for attempt in range(self.attempts):
            try:
                return str(self._call("/api/generate", {"model": self.model, "prompt": prompt, "stream": False, "options": self.options}).get("response", "")).strip()
            except urllib.error.HTTPError as e:
                why = f"status {e.code}"
                if e.code != 429 and e.code < 500:
                    break
            except (OSError, ValueError) as e:
                why = str(e)
            if attempt + 1 < self.attempts:
                time.sleep(min(5.0, 2.0**attempt))
        return f"Warning: the language model did not answer ({why})"

    def is_available(self) -> bool:
        """Whether the server lists the model; asked once."""
        if self._available is None:
            try:
                names = [str(m.get("name", "")) for m in self._call("/api/tags").get("models", [])]
                self._available = any(n == self.model or n.split(":")[0] == self.model for n in names)
            except (OSError, ValueError):
                self._available = False
        return self._available


def embed(rows: DataFrame, text_col: str, embedder: Embedder, out_col: str = "embedding", batch: int = 256, divisor: int = 4) -> DataFrame:
    """Adds unit vectors of a text column, encoded in batches; a batch that does not fit memory is taken in
    parts smaller by ``divisor``, down to single texts."""

    def encoded(texts: list[str], size: int) -> Iterator[np.ndarray]:
        for a in range(0, len(texts), size):
            part = texts[a : a + size]
            try:
                x = np.asarray(embedder.encode(part), dtype=np.float64)
                yield x / (np.sqrt((x * x).sum(axis=1, keepdims=True)) + 1e-12)
            except MemoryError:
                if size == 1:
                    raise
                yield from encoded(part, max(1, size // max(2, divisor)))

    @F.arrow_udf("array<float>")
    def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            x = [np.asarray(v, dtype=np.float32) for v in encoded([t or "" for t in texts.to_pylist()], batch)]
            width = x[0].shape[1] if x else 0
            offsets = pa.array(np.arange(len(texts) + 1) * width, pa.int32())
            yield pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([v.ravel() for v in x]) if x else [], pa.float32()))

    return rows.withColumn(out_col, vectors(F.col(text_col)))


def rerank_column(reranker: Reranker) -> Column:
    """Score of (query, text) columns by a model, in batches, for :func:`operators.retrieval.rerank`. A batch that the
    model fails on has null scores."""

    @F.arrow_udf("double")
    def scores(query: pa.Array, text: pa.Array) -> pa.Array:
        try:
            return pa.array([float(s) for s in reranker.score(query.to_pylist(), text.to_pylist())], pa.float64())
        except Exception as e:  # reranking is an improvement, not a condition: hits stay as they are
            warnings.warn(f"reranking failed: {e}", stacklevel=2)
            return pa.nulls(len(query), pa.float64())

    return scores(F.col("query"), F.col("text"))


def for_purpose(model: LanguageModel, purpose: str) -> LanguageModel:
    """The model with its options for a purpose, where it has such."""
    special = getattr(model, "for_purpose", None)
    return model if special is None else special(purpose)


def generate_column(model: LanguageModel, prompt: Column, calls: int = 1) -> Column:
    """A model's answer to each prompt, where the rows are. A model that raises answers with a warning. Of a batch's equal
    prompts one is asked, and up to ``calls`` at once (a model's own limit: servers queue what they can't take)."""

    def answer(prompt: str) -> str:
        try:
            return str(model.generate(prompt))
        except Exception as e:
            return f"Warning: the language model failed ({e})"

    @F.arrow_udf("string")
    def answers(prompts: pa.Array) -> pa.Array:
        asked = list(dict.fromkeys(p for p in prompts.to_pylist() if p is not None))
        with ThreadPoolExecutor(max_workers=max(1, calls)) as pool:
            said = dict(zip(asked, pool.map(answer, asked), strict=True))
        return pa.array([said.get(p) for p in prompts.to_pylist()], pa.string())

    return answers(prompt)
