"""Token counts of a unigram tokenizer without its tokens: a Viterbi pass that carries score and count only.

An Aho-Corasick automaton over the vocabulary lists, for each end, the pieces that end there. The dynamic
programme keeps for each place of a word the best score and the number of pieces on that best path. Ties
are decided as the tokenizers library's unigram model does: of equal scores, the path whose last piece
begins first wins. A character that no piece spells alone is unknown: it costs the least score minus 10;
neighbouring unknown characters are one unknown stretch, which is spelled in byte pieces if the vocabulary
has all of them, and is one piece else.

Words begin at the mark U+2581 that replaces a space, and no piece crosses one, so equal words have equal
counts and each distinct word of a batch is computed once.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import portions
from .scratch import bound_batches
from .words import held, tidy

MARK = "▁"
#: What the tokenizers library takes off the least score for an unknown character.
UNKNOWN_PENALTY = 10.0
REMEMBER = 4_000_000


def load_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, in id order. Pieces that its own training gave no
    proper score (control and byte pieces, runs of marks) take the least of the others."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    proper = [not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i)) and p.get_score(i) > -1e8 for i in range(p.get_piece_size())]
    least = min(p.get_score(i) for i, good in enumerate(proper) if good)
    return [(p.id_to_piece(i), p.get_score(i) if good else least) for i, good in enumerate(proper)]


class UnigramCounter:
    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True):
        self.unknown_score = min(s for _, s in pieces) - UNKNOWN_PENALTY
        names = {p for p, _ in pieces}
        self.bytes = byte_fallback and all(f"<0x{b:02X}>" in names for b in range(256))
        self.find = ahocorasick.Automaton()
        for p, score in pieces:
            if p:
                self.find.add_word(p, (len(p), score))
        self.find.make_automaton()
        self.known: dict[str, tuple[int, float]] = {}
        self.known_chars = 0

    def count_word(self, word: str) -> tuple[int, float]:
        """Pieces on the best path, and its score."""
        n = len(word)
        best, count = [0.0] + [None] * n, [0] * (n + 1)
        stretch = [0] * (n + 1)  # UTF-8 bytes of the unknown stretch that ends here
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, found in self.find.iter(word):
            ends[end].append(found)
        for end in range(n):
            found = sorted(ends[end], reverse=True)  # longest first: the earliest begin wins ties
            top = None
            for length, score in found:
                total = best[end + 1 - length] + score
                if top is None or total > top:
                    top, begin = total, end + 1 - length
            if (not found or found[-1][0] > 1) and (top is None or best[end] + self.unknown_score > top):
                best[end + 1] = best[end] + self.unknown_score
                size = len(word[end].encode("utf-8", "surrogatepass"))
                if self.bytes:
                    count[end + 1] = count[end] + size
                else:
                    count[end + 1] = count[end] + (not stretch[end])
                stretch[end + 1] = stretch[end] + size
            else:
                best[end + 1], count[end + 1] = top, count[begin] + 1
        return count[n], best[n]

    def count(self, text: str) -> tuple[int, float, int]:
        """Tokens, score and words of a text; spaces become marks and one stands before the text."""
        if not text:
            return 0, 0.0, 0
        if not text.startswith(" "):
            text = " " + text
        words = Counter(text.replace(" ", " " + MARK).split(" ")[1:])
        tokens, total, n = 0, 0.0, 0
        known = self.known
        for w, times in words.items():
            got = known.get(w)
            if got is None:
                if self.known_chars > REMEMBER:
                    known.clear()
                    self.known_chars = 0
                got = known[w] = self.count_word(w)
                self.known_chars += len(w)
            tokens += times * got[0]
            total += times * got[1]
            n += times
        return tokens, total, n


def _loaded(pieces: list[tuple[str, float]]) -> UnigramCounter:
    cache, key = held("unigram"), hashlib.md5(repr(pieces).encode()).hexdigest()
    if key not in cache:
        cache[key] = UnigramCounter(pieces)
    return cache[key]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def count_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every text under a unigram vocabulary: ``id_col``, n_tokens, n_words, score (of the best
    segmentations, added up).

    ``path``: a sentencepiece model whose pieces and scores are taken as the unigram vocabulary; the driver
    reads it and sends it to the workers (under 2 MB). Null text: as empty, which has no token. Ids may be
    null or repeat: one row each. Extra columns are not read. No row moves.
    """
    bound_batches(docs.sparkSession)
    pieces = docs.sparkSession.sparkContext.broadcast(load_pieces(path or default_vocabulary()))

    @tidy
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _loaded(pieces.value)
        for batch in stream:
            at = 0
            for texts in portions(batch.column(1)):
                found = [model.count(t) for t in texts]
                tokens, scores, words = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(tokens, pa.int64()), pa.array(words, pa.int64()), pa.array(scores, pa.float64())],
                    ["id", "n_tokens", "n_words", "score"],
                )
                at += len(texts)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, n_words long, score double").withColumnRenamed("id", id_col)
