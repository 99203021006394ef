"""Fill-in-the-middle rows: prefix, middle and suffix cut at code points, found by rank and select over bit vectors.

A bit vector has a one where a byte begins a code point. It is packed, with a directory of how many ones stand
before each block. A text's length is the ones between its two ends (rank); a cut after k code points is the byte of
the k-th one from its start (select). So no text is decoded, and a batch's texts share one vector.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import bound_batches
from .words import pieces, text_buffers, tidy

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Words of 64 bits in a block of the directory, and bytes that are looked at together while bits are packed.
BLOCK, SLICE = 8, 1 << 20


class Boundaries:
    """Packed bits, a one for each byte that begins a code point: an eighth of the bytes, and a directory of as much
    again over ``BLOCK``."""

    def __init__(self, raw: np.ndarray):
        packed = [np.packbits((raw[a : a + SLICE] & 0xC0) != 0x80, bitorder="little") for a in range(0, len(raw), SLICE)]
        size = sum(map(len, packed))
        packed.append(np.zeros(-size % (8 * BLOCK) or 8 * BLOCK, np.uint8))  # a block of zeros at the end, at least in part
        self.size, self.words = len(raw), np.concatenate(packed).view("<u8").astype(np.uint64)
        each = np.bitwise_count(self.words).reshape(-1, BLOCK)
        self.inside = np.cumsum(each, axis=1, dtype=np.uint16) - each  # ones in a block before each of its words
        self.before = np.concatenate([[0], np.cumsum(each.sum(axis=1, dtype=np.int64))])  # ones before each block

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each byte position."""
        at = np.asarray(at, np.int64)
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word // BLOCK] + self.inside[word // BLOCK, word % BLOCK] + np.bitwise_count(self.words[word] & low)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Byte position of the one with ``k`` ones before it; the size, where there are no more."""
        k = np.asarray(k, np.int64)
        beyond = k >= self.before[-1]
        k = np.where(beyond, 0, k)
        block = np.searchsorted(self.before, k, side="right") - 1
        block = np.minimum(block, len(self.inside) - 1)
        left = k - self.before[block]
        word = (self.inside[block] <= left[:, None]).sum(axis=1) - 1
        left = left - self.inside[block, word]
        bits = self.words[block * BLOCK + word]
        at = np.zeros(len(k), np.int64)
        for half in (32, 16, 8, 4, 2, 1):  # the half of what is left of the word that has the one
            low = np.bitwise_count((bits >> at.astype(np.uint64)) & np.uint64((1 << half) - 1)).astype(np.int64)
            right = left >= low
            left, at = left - np.where(right, low, 0), at + np.where(right, half, 0)
        return np.where(beyond, self.size, (block * BLOCK + word) * 64 + at)


def draws(seed: int, name: str) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits from a row's id: the first digits of sha256("<seed>:<id>")."""
    digest = hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()
    return tuple(int(digest[8 * i : 8 * i + 8], 16) for i in range(4))  # type: ignore[return-value]


def fill_in_middle(docs: DataFrame, seed: int = 1, fim_percent: int = 90, spm_percent: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text in the order in which a model learns to fill gaps: ``id_col``, n (code points), form, prefix_chars,
    middle_chars (null if plain), output.

    Two draws from the id, modulo n + 1, say where prefix and middle end. form is psm (``<P>`` prefix ``<S>`` suffix
    ``<M>`` middle), spm (``<S>`` suffix ``<P>`` prefix ``<M>`` middle, ``spm_percent`` of those cut) or plain (the text
    itself): empty texts, texts that hold one of the three marks, and all but ``fim_percent`` of the others. Since a mark
    begins with a sign that it has only there, and cut texts hold no mark, each mark stands once in the output, and
    :func:`restore` is exact. Null text: as empty. Rows with one id are cut by the same draws; a null id draws as "".
    Repeated rows give repeated results, an empty table an empty one. Extra columns are not read; no row moves.
    """
    if not 0 <= fim_percent <= 100 or not 0 <= spm_percent <= 100:
        raise ValueError("percentages are between 0 and 100")
    bound_batches(docs.sparkSession)
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def cut(names: list, raw: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        bits = Boundaries(raw)
        start = bits.rank(offsets)
        n, data = np.diff(start), raw.tobytes()
        drawn = np.array([draws(seed, name or "") for name in names], np.int64).reshape(-1, 4)
        ends = np.sort(drawn[:, :2] % (n + 1)[:, None], axis=1)
        at = bits.select((start[:-1, None] + ends).ravel()).reshape(-1, 2)
        plain, spm = (n == 0) | (drawn[:, 2] % 100 >= fim_percent), drawn[:, 3] % 100 < spm_percent
        out, forms = [], []
        for i, (a, b, c, d) in enumerate(zip(offsets[:-1].tolist(), *at.T.tolist(), offsets[1:].tolist(), strict=True)):
            if plain[i] or any(data.find(m, a, d) >= 0 for m in marks):
                out.append(data[a:d])
                forms.append("plain")
                continue
            p, s, m = marks
            forms.append("spm" if spm[i] else "psm")
            out.append(s + data[c:d] + p + data[a:b] + m + data[b:c] if spm[i] else p + data[a:b] + s + data[c:d] + m + data[b:c])
        whole = np.array([f == "plain" for f in forms], bool)
        sizes = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
        texts = pa.StringArray.from_buffers(len(out), pa.py_buffer(sizes.tobytes()), pa.py_buffer(b"".join(out)))
        chars = [pa.array(x, mask=whole) for x in (ends[:, 0], ends[:, 1] - ends[:, 0])]
        return pa.RecordBatch.from_arrays([pa.array(n), pa.array(forms, pa.string()), *chars, texts], ["n", "form", "prefix_chars", "middle_chars", "output"])

    @tidy
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            raw, offsets = text_buffers(batch.column(2))
            names = batch.column(1).to_pylist()
            for a, b in pieces(offsets):
                made = cut(names[a:b], raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *made.columns], ["id", *made.schema.names])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(id_col).cast("string").alias("name"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("id", id_col)


def restore(output: Column, form: Column) -> Column:
    """The text that :func:`fill_in_middle` cut, from its output and form."""
    body = F.substring(output, len(PREFIX) + 1, 2**31 - 1)
    last = F.substring_index(output, MIDDLE, -1)
    first = F.substring_index(body, MIDDLE, 1)  # the two parts before the middle

    def joined(mark: str, prefix: int) -> Column:
        return F.concat(F.substring_index(first, mark, prefix), last, F.substring_index(first, mark, -prefix))

    return F.when(form == "plain", output).when(form == "psm", joined(SUFFIX, 1)).when(form == "spm", joined(PREFIX, -1))


FIM_SQL = """
WITH named AS (
  SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), drawn AS (
  SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS b,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS c, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS d
  FROM named
), cut AS (
  SELECT *, least(a, b) AS x, greatest(a, b) AS y,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain' WHEN d < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT *, substr(t, 1, x) AS p, substr(t, x + 1, y - x) AS m, substr(t, y + 1) AS s FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN x END AS prefix_chars, CASE WHEN form <> 'plain' THEN y - x END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
