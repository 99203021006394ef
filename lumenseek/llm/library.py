"""The tokenizers library on whole texts, each distinct piece of a batch encoded once.

Byte-level vocabularies split a text by a published pattern before any merge. Between certain pairs of ASCII characters
that pattern always cuts, whatever stands around them; texts are cut there, a batch's distinct pieces are encoded by the
library, and texts are put together from them. Where the file asks for anything else, whole texts go to the library.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import SparkSession

from .words import held, pieces

#: Bytes of texts whose pieces are looked up together, pieces of at most so many bytes that a worker remembers, how many of
#: them, and how many words the library takes in one string.
PORTION, SHORT, REMEMBER, JOINED = 16 << 20, 48, 1_500_000, 25
_LETTER, _DIGIT, _MARK, _SPACE, _BLANK = 1, 2, 3, 4, 5


def _classes() -> np.ndarray:
    """Kinds of ASCII characters; 0: all that no rule here speaks about."""
    out = np.zeros(256, np.uint8)
    for code in range(128):
        c = chr(code)
        out[code] = _LETTER if c.isalpha() else _DIGIT if c.isdigit() else _MARK if 33 <= code < 127 else _SPACE if c == " " else _BLANK if 9 <= code <= 13 else 0
    return out


def _pairs() -> np.ndarray:
    """Between which kinds the pattern always cuts: before white space that follows something else, and where letters,
    digits and marks meet."""
    out = np.zeros((6, 6), bool)
    solid = (_LETTER, _DIGIT, _MARK)
    for a in solid:
        out[a, [_SPACE, _BLANK]] = True
        for b in solid:
            out[a, b] = a != b
    return out.ravel()


_KIND, _CUTS = _classes(), _pairs()
_LEADS = np.isin(np.arange(256), (0xC3, 0xC4, 0xC5, 0xD0, 0xD1))


def safe_cuts(raw: np.ndarray) -> np.ndarray:
    """Whether the pattern cuts before each byte but the first, where that follows from its neighbours alone."""
    kind = _KIND[raw]
    # Two-byte letters: Latin with accents and Cyrillic, whose blocks hold nothing else but two signs.
    wide = _LEADS[raw[:-1]] & (raw[1:] >= 0x80) & ~((raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7)))
    kind[:-1][wide] = _LETTER
    kind[1:][wide] = _LETTER
    cut = _CUTS[kind[:-1] * 6 + kind[1:]]
    cut &= ~((raw[:-1] == ord("'")) & (kind[1:] == _LETTER))  # may be a contraction
    # After a single blank other than a space: it can't be joined to what follows.
    solid = (kind > 0) & (kind <= _MARK)
    cut[1:] |= (kind[1:-1] == _BLANK) & solid[:-2] & solid[2:]
    return cut


def _valid(words: pa.Array) -> bool:
    try:
        words.cast(pa.string())
    except pa.ArrowInvalid:
        return False
    return True


class LibraryEncoder:
    def __init__(self, source: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share out the cores
        from tokenizers import Tokenizer

        spec = json.loads(source)
        self.model = Tokenizer.from_str(source.decode())
        self.model.no_truncation()
        self.model.no_padding()
        splitter = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens") or []
        plain = splitter.get("type") == "ByteLevel" and not splitter.get("add_prefix_space") and splitter.get("use_regex", True)
        alone = not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip"))
        self.cuttable = bool(plain and alone and not spec.get("normalizer") and not spec["model"].get("ignore_merges") and spec["model"]["type"] == "BPE")
        self.special = [t["content"].encode() for t in added]
        self.known, self.ids = pa.array([], pa.binary()), pa.array([], pa.binary())

    def _library(self, texts: list[str]) -> pa.Array:
        encoded = self.model.encode_batch_fast(texts, add_special_tokens=False)
        return pa.array([np.array(e.ids, "<u4").tobytes() for e in encoded], pa.binary())

    def _words(self, words: pa.Array, mark: str) -> pa.Array:
        """Ids of words of one pre-token each, many of which go to the library as one string, ``mark`` between them."""
        texts = words.cast(pa.string()).to_pylist()
        groups = [mark.join(texts[a : a + JOINED]) for a in range(0, len(texts), JOINED)]
        ids, sizes, step = [], [], 2 if mark else 1
        for i, e in enumerate(self.model.encode_batch(groups, add_special_tokens=False)):
            word = np.array(e.word_ids)
            n = min(JOINED, len(texts) - i * JOINED)
            if word[-1] + 1 != step * (n - 1) + 1:  # its alphabet is of another age than ours
                return self._library(texts)
            own = word % step == 0
            ids.append(np.array(e.ids, "<u4")[own])
            sizes.append(np.bincount(word[own] // step))
        ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) * 4
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(np.concatenate(ids).tobytes())])

    def _learn(self, words: pa.Array) -> pa.Array:
        """Encodings of distinct pieces. Pieces of a space and letters, or letters alone, are one pre-token each."""
        at = pc.index_in(words, value_set=self.known)
        new = words.filter(pc.is_null(at))
        # Pieces of whole characters only are strings; texts that are no UTF-8 have others.
        text = new.cast(pa.string()) if _valid(new) else None
        if text is None:
            made = self._library([w.decode("utf-8", "replace") for w in new.to_pylist()])
        else:
            spaced = pc.and_(pc.starts_with(text, " "), pc.utf8_is_alpha(pc.utf8_slice_codeunits(text, 1)))
            bare = pc.utf8_is_alpha(text)
            kind = np.where(spaced.to_numpy(zero_copy_only=False), 0, np.where(bare.to_numpy(zero_copy_only=False), 1, 2))
            order, made = np.argsort(kind, kind="stable"), []
            for which, mark in ((0, ""), (1, ","), (2, None)):
                some = new.take(pa.array(np.flatnonzero(kind == which)))
                if len(some):
                    made.append(self._library(some.cast(pa.string()).to_pylist()) if mark is None else self._words(some, mark))
            back = np.empty(len(order), np.int64)
            back[order] = np.arange(len(order))
            made = pa.concat_arrays(made).take(pa.array(back)) if made else pa.array([], pa.binary())
        found = at.fill_null(0).to_numpy().astype(np.int64)
        found[pc.is_null(at).to_numpy(zero_copy_only=False)] = len(self.known) + np.arange(len(new))
        out = pa.concat_arrays([self.ids, made]).take(pa.array(found))
        short = pc.less_equal(pc.binary_length(new), SHORT)
        if len(self.known) + len(new) > REMEMBER:  # what this batch has is likelier to come again
            short = pc.less_equal(pc.binary_length(words), SHORT)
            self.known, self.ids = words.filter(short).slice(0, REMEMBER), out.filter(short).slice(0, REMEMBER)
        else:
            self.known, self.ids = pa.concat_arrays([self.known, new.filter(short)]), pa.concat_arrays([self.ids, made.filter(short)])
        return out

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, list[bytes]]]:
        """Runs [a, b) of the texts that lie end to end in ``raw``, and the ids of each, 32 bits each."""
        for a, b in pieces(offsets, PORTION):
            part, at = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            yield a, b, self._portion(part, at)

    def _portion(self, raw: np.ndarray, at: np.ndarray) -> list[bytes]:
        data = raw.tobytes()
        if not self.cuttable:
            return self._library([data[x:y].decode("utf-8", "replace") for x, y in zip(at[:-1], at[1:], strict=True)]).to_pylist()
        if not data:
            return [b""] * (len(at) - 1)
        cut = np.concatenate([[True], safe_cuts(raw)])
        for name in self.special:  # a text that names a special token is one piece
            spot = data.find(name)
            while spot >= 0:
                i = int(np.searchsorted(at, spot, side="right")) - 1
                cut[at[i] : at[i + 1]] = False
                spot = data.find(name, int(at[i + 1]))
        cut[at[:-1][at[:-1] < len(data)]] = True
        begins = np.concatenate([np.flatnonzero(cut), [len(data)]])
        found = pa.Array.from_buffers(pa.binary(), len(begins) - 1, [None, pa.py_buffer(begins.astype(np.int32).tobytes()), pa.py_buffer(data)]).dictionary_encode()
        coded = self._learn(found.dictionary).cast(pa.large_binary()).take(found.indices)
        spots = np.frombuffer(coded.buffers()[1], np.int64)[: len(coded) + 1]
        whole = coded.buffers()[2]
        ids = memoryview(whole) if whole is not None else memoryview(b"")
        ends = spots[np.searchsorted(begins, at)].tolist()
        return [bytes(ids[x:y]) for x, y in zip(ends[:-1], ends[1:], strict=True)]


class _Source:
    """A vocabulary file, sent to workers, which build their encoder once."""

    def __init__(self, text: bytes, small: bool):
        self.text, self.small = text, small

    def loaded(self) -> LibraryEncoder:
        cache, key = held("library"), hashlib.md5(self.text).hexdigest()
        if key not in cache:
            cache[key] = LibraryEncoder(self.text)
        return cache[key]


def library_encoder(spark: SparkSession, path: str) -> Broadcast:
    """``small``: all of its ids have 16 bits."""
    with open(path, "rb") as f:
        source = f.read()
    spec = json.loads(source)
    highest = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens") or [])], default=0)
    return spark.sparkContext.broadcast(_Source(source, highest < 1 << 16))
