"""Byte-level BPE by prefix sharing: distinct words in a trie, last-token states handed down depth first.

The encoding of a prefix is the encoding of a shorter prefix plus one last token, and that last token is
unique: of the tokens that end at the prefix, it is the one that the merges leave intact beside the last
token of the prefix before it. So a trie node needs one number, its last token, and a word's encoding is
read back along its path. Sorted words are the trie's depth-first order: what two neighbours share is
computed once, and only the current path is held.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import bound_batches
from .words import held, pieces, tidy

#: The published pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of distinct words whose encodings a worker remembers; beyond it, it forgets them all and goes on.
REMEMBER = 3_000_000


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the
    others from U+0100 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def _refuse(spec: dict) -> None:
    """ValueError for a file that asks for what this encoder doesn't do."""
    model, splitter, no = spec["model"], spec.get("pre_tokenizer") or {}, (None, False, "", 0)
    asked = [f"model {model.get('type')}"] * (model.get("type", "BPE") != "BPE")
    asked += [f"model.{k}" for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k) not in no]
    asked += ["normalizer"] * (spec.get("normalizer") is not None)
    asked += ["pre_tokenizer"] * (splitter.get("type") != "ByteLevel" or bool(splitter.get("add_prefix_space")) or not splitter.get("use_regex", True))
    asked += [f"added token {t['content']!r}" for t in spec["added_tokens"] if any(t.get(k) for k in ("single_word", "lstrip", "rstrip"))]
    if asked:
        raise ValueError(f"byte-level BPE only, without {', '.join(asked)}")


class ByteBpe:
    """Encoder and decoder of one vocabulary file in the tokenizers library's JSON format."""

    def __init__(self, source: bytes):
        spec = json.loads(source)
        _refuse(spec)
        letters = _byte_letters()
        vocabulary, self.special = spec["model"]["vocab"], {x["content"]: x["id"] for x in spec["added_tokens"]}
        spelled = {t: bytes(letters[c] for c in t) for t in vocabulary if t not in self.special}
        self.text: list[bytes] = [b""] * (1 + max([*vocabulary.values(), *self.special.values()]))
        for t, i in vocabulary.items():
            self.text[i] = spelled.get(t, b"")
        for t, i in self.special.items():
            self.text[i] = t.encode()
        n = len(self.text)
        self.rank, self.left, self.right = [-1] * n, [0] * n, [0] * n
        self.pair_rank: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            made, a, b = vocabulary[a + b], vocabulary[a], vocabulary[b]
            self.rank[made], self.left[made], self.right[made] = rank, a, b
            self.pair_rank[a << 20 | b] = rank
        self.word = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.known: dict[str, bytes] = {}
        self.known_bytes = 0
        self.fit_memo: dict[int, bool] = {}
        self._automaton({s: vocabulary[t] for t, s in spelled.items()})

    def _automaton(self, tokens: dict[bytes, int]) -> None:
        """Finds all tokens that end at a place: states are prefixes of tokens, ``ends`` lists the tokens, longest first."""
        step: dict[int, int] = {}
        states = [b""]
        for t in sorted(tokens):
            at = 0
            for b in t:
                key = at << 8 | b
                if key not in step:
                    step[key] = len(states)
                    states.append(states[at] + bytes([b]))
                at = step[key]
        number = {s: i for i, s in enumerate(states)}
        self.step, self.back = step, [0] * len(states)
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(states)
        for s in sorted(states, key=len):
            i = number[s]
            if len(s) > 1:
                at = self.back[number[s[:-1]]]
                while at and (at << 8 | s[-1]) not in step:
                    at = self.back[at]
                self.back[i] = step.get(at << 8 | s[-1], 0)
            own = ((tokens[s], len(s)),) if s in tokens else ()
            self.ends[i] = own + self.ends[self.back[i]]

    def _intact(self, a: int, b: int) -> bool:
        """Whether the merges leave tokens a and b, side by side, as they are: takes them apart again, the
        latest merge first, and looks for a merge across the border that would have come earlier. Of equal
        merges the leftmost comes first."""
        rank, before = self.rank, len(self.pair_rank)
        while True:
            if self.pair_rank.get(a << 20 | b, before) < before:
                return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[a] > rank[b]:
                before, a = rank[a], self.right[a]
            else:
                before, b = rank[b] + 1, self.left[b]

    def _traverse(self, words: list[bytes]) -> Iterator[bytes]:
        """Encodings of sorted distinct words."""
        step, back, ends, memo = self.step, self.back, self.ends, self.fit_memo
        last, size, state, before = [0], [0], [0], b""
        if len(memo) > 200_000:
            memo.clear()
        for word in words:
            n = min(len(word), len(before))
            shared = 0
            if word[:n] == before[:n]:
                shared = n
            else:
                while word[shared] == before[shared]:
                    shared += 1
            del last[shared + 1 :], size[shared + 1 :], state[shared + 1 :]
            at = state[shared]
            for depth in range(shared, len(word)):
                b = word[depth]
                while at and (at << 8 | b) not in step:
                    at = back[at]
                at = step.get(at << 8 | b, 0)
                for token, length in ends[at]:
                    begin = depth + 1 - length
                    if not begin:
                        break
                    key = last[begin] << 20 | token
                    good = memo.get(key)
                    if good is None:
                        good = memo[key] = self._intact(last[begin], token)
                    if good:
                        break
                last.append(token)
                size.append(length)
                state.append(at)
            depth, ids = len(word), []
            while depth:
                ids.append(last[depth])
                depth -= size[depth]
            before = word
            yield np.array(ids[::-1], dtype="<u4").tobytes()

    def learn(self, words: Iterable[str]) -> None:
        """Computes what is not remembered yet."""
        new = sorted((w.encode("utf-8", "surrogatepass"), w) for w in words if w not in self.known)
        for (raw, w), ids in zip(new, self._traverse([x[0] for x in new]), strict=True):
            self.known[w] = ids
            self.known_bytes += len(raw)

    def split(self, text: str) -> list[str]:
        if self.cut is None or not any(s in text for s in self.special):
            return self.word.findall(text)
        out: list[str] = []
        for i, part in enumerate(self.cut.split(text)):
            out += [part] if i % 2 else self.word.findall(part)
        return out

    def _encoded(self, texts: list[str]) -> Iterator[Iterator[bytes]]:
        """The ids of each text's words."""
        if self.known_bytes > REMEMBER:
            self.known, self.known_bytes = {}, 0
        for t, i in self.special.items():
            self.known[t] = np.array([i], dtype="<u4").tobytes()
        split = [self.split(t) for t in texts]
        self.learn({w for words in split for w in words})
        for words in split:
            yield map(self.known.__getitem__, words)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        yield from map(b"".join, self._encoded(texts))

    def count(self, texts: list[str]) -> Iterator[int]:
        """How many ids each text has."""
        for ids in self._encoded(texts):
            yield sum(map(len, ids)) // 4

    def decode(self, ids: bytes) -> str:
        """Text of ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.text.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


def _loaded(source: bytes) -> ByteBpe:
    cache, key = held("bpe"), hashlib.md5(source).hexdigest()
    if key not in cache:
        cache[key] = ByteBpe(source)
    return cache[key]


def portions(column: pa.Array, most: int = 1 << 20) -> Iterator[list[str]]:
    """Texts in lists of about ``most`` bytes (at least one text); null: empty. Only one list is unpacked at a time."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    for a, b in pieces(offsets, most):
        yield [t or "" for t in column.slice(a, b - a).to_pylist()]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """Token ids of every text: ``id_col``, ids (binary: little-endian unsigned 32-bit integers) and, if asked
    for, decoded (the text that these ids give back).

    ``path``: a byte-level BPE file of the tokenizers library, read by the driver and sent to the workers
    (about 1.5 MB). The names of special tokens in a text are encoded as those tokens. Null text: as empty,
    no ids. Ids may be null or repeat: one row each. Extra columns are not read. No row moves.
    """
    bound_batches(docs.sparkSession)
    with open(path or default_vocabulary(), "rb") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())

    @tidy
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _loaded(source.value)
        for batch in stream:
            at = 0
            for texts in portions(batch.column(1)):
                ids = list(model.encode(texts))
                columns = [batch.column(0).slice(at, len(texts)), pa.array(ids, pa.binary())]
                if decode:
                    columns.append(pa.array([model.decode(x) for x in ids], pa.string()))
                at += len(texts)
                yield pa.RecordBatch.from_arrays(columns, ["id", "ids", "decoded"][: len(columns)])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(run, f"id {kind}, ids binary" + ", decoded string" * decode)
    return out.withColumnRenamed("id", id_col)


def token_count(spark: SparkSession, text: Column, path: str | None = None) -> Column:
    """How many tokens a text has. Null: 0."""
    with open(path or default_vocabulary(), "rb") as f:
        source = spark.sparkContext.broadcast(f.read())

    @F.arrow_udf("long")
    @tidy
    def count(stream: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = _loaded(source.value)
        for texts in stream:
            yield pa.array([n for part in portions(texts) for n in model.count(part)], pa.int64())

    return count(text)


def decode_documents(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Text of each row's ids: ``id_col``, text. Null ids: null text."""
    with open(path or default_vocabulary(), "rb") as f:
        source = encoded.sparkSession.sparkContext.broadcast(f.read())

    @tidy
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _loaded(source.value)
        for batch in stream:
            texts = [None if x is None else model.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
