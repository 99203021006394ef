"""Removal of long repeats with a run-length index.

Wanted: every byte covered by a ``LENGTH``-byte string that also starts earlier in the corpus. The text of one
task can't be the corpus, so what may match is first brought together, exactly:

1. Whole copies: of equal texts all but the first go (or nothing, if shorter than ``LENGTH``).
2. Anchors: of the ``SEED``-byte seeds of a window of ``LENGTH`` bytes the one with the least hash, leftmost
   of equals, is its anchor. Equal windows have equal anchors, so windows can only match where the anchor's
   hash occurs twice. One row for each anchor (about 1 in 35 bytes) is shuffled, by that hash.
3. Fragments: the bytes spanned by the windows of an anchor that occurs twice. Equal fragments (by a 128-bit
   cryptographic digest; those of one batch before any shuffle) are aggregated to the first one; the distinct
   ones are dealt to shards of about ``SHARD`` bytes by the hash.
4. In a shard, a run-length index is built over its fragments in corpus order: the Burrows-Wheeler transform
   as runs, LF by runs, and samples at the ends of runs. Fragments are streamed backward through it, all at
   once, which gives each position its matching statistic: how many bytes it shares with its neighbours in
   suffix order, and where those stand. Where that is ``LENGTH`` or more, the neighbours are followed until
   one stands earlier; only the earliest is not marked.
   An anchor with more than ``CROWD`` distinct fragments is not put in one shard: its windows are
   aggregated one by one instead.
5. Marked windows become byte intervals for each document, and the texts are cut.

Equal anchor hashes only bring windows together; their bytes decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranges import id_keys, with_ranges
from .scratch import Scratch
from .words import _powers, mix, text_buffers, tidy

LENGTH, SEED = 100, 32
SHARD, CROWD, RANGE_ROWS = 2_000_000, 10_000, 2048
#: Bytes of a per-document table up to which it is broadcast to the texts; beyond it, texts are shuffled to it.
BROADCAST_BYTES = 48_000_000
#: Window starts taken at once.
_PIECE = 1 << 20
_TABLE = np.random.default_rng(77_003).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_INVERSE_BASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _inverse_powers(n: int, cache: list[np.ndarray] = [np.ones(1, dtype=np.uint64)]) -> np.ndarray:  # noqa: B006
    if len(cache[0]) < n:
        grown = np.full(n, _INVERSE_BASE, dtype=np.uint64)
        grown[0] = 1
        cache[0] = np.multiply.accumulate(grown)
    return cache[0]


def _sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbouring values."""
    have = 1
    while have * 2 <= width:
        v = np.minimum(v[: len(v) - have], v[have:])
        have *= 2
    rest = width - have
    return np.minimum(v[: len(v) - rest], v[rest:]) if rest else v


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts end to end: the anchor hash, first window start and last window start of every run of windows
    that have one anchor. Windows lie inside one text."""
    keys, firsts, lasts = [], [], []
    n = len(raw)
    for x in range(0, n - length + 1, _PIECE):
        y = min(x + _PIECE, n - length + 1)
        part = raw[x : y + length - 1]
        # Window starts in [x, y) that end inside their text.
        a, b = np.searchsorted(offsets, x, side="right") - 1, np.searchsorted(offsets, y, side="left")
        room = np.repeat(np.arange(a, b), np.diff(np.clip(offsets[a : b + 1], x, y)))
        good = np.arange(x, y) + length <= offsets[room + 1]
        if not good.any():
            continue
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_TABLE[part] * _powers(_PIECE + length)[: len(part)], out=sums[1:])
        hashes = mix((sums[seed:] - sums[:-seed]) * _inverse_powers(_PIECE + length)[: len(part) - seed + 1])
        place = np.arange(len(hashes), dtype=np.uint64)
        least = _sliding_least((hashes & np.uint64(0xFFFFFFFFFF000000)) | place, length - seed + 1)
        at = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        starts = np.flatnonzero(good)
        at = at[starts]
        new = np.ones(len(starts), dtype=bool)
        new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1) | (room[starts[1:]] != room[starts[:-1]])
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(starts)) - 1
        keys.append(hashes[at[begin]].view(np.int64))
        firsts.append(starts[begin] + x)
        lasts.append(starts[end] + x)
    none = np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate([*found, none]) for found in (keys, firsts, lasts))


def _suffix_order(text: np.ndarray, to_end: np.ndarray) -> np.ndarray:
    """Suffixes in order, by doubling from up to 7 symbols of 9 bits; what already stands alone, or has ended, is not
    sorted again. A suffix ends with its string; equal ones stand in the order of the strings."""
    n, depth = len(text), 7
    key = np.zeros(n, dtype=np.int64)
    for j in range(depth):
        symbol = np.zeros(n, dtype=np.int64)
        symbol[: max(0, n - j)] = text[j:]
        symbol[to_end < j] = 0
        key = key << 9 | symbol
    order = np.argsort(key)
    key = key[order]
    first = np.ones(n + 1, dtype=bool)  # whether a group of equals begins at a row
    first[1:n] = key[1:] != key[:-1]
    rank = np.empty(n, dtype=np.int64)  # the row where a suffix's group begins
    rank[order] = np.maximum.accumulate(np.where(first[:n], np.arange(n), 0))
    rows = np.flatnonzero(~(first[:-1] & first[1:]))
    while len(rows := rows[~(first[rows] & first[rows + 1]) & (to_end[order[rows]] >= depth)]):
        at = order[rows]
        key = rank[at] * (n + 1) + rank[at + depth]
        turn = np.argsort(key)
        at, key = at[turn], key[turn]
        order[rows] = at
        first[rows[1:]] |= key[1:] != key[:-1]
        rank[at] = np.maximum.accumulate(np.where(first[rows], rows, 0))
        depth *= 2
    rows = np.flatnonzero(~(first[:-1] & first[1:]))
    at = order[rows]
    order[rows] = at[np.argsort(rank[at] * (n + 1) + at)]
    return order


def _common(words: np.ndarray, to_end: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of the suffixes at a and at b, eight bytes at a time."""
    most = np.minimum(to_end[a], to_end[b])
    out = np.zeros(len(a), dtype=np.int64)
    alive = np.flatnonzero(most > 0)
    while len(alive):
        differ = words[a[alive] + out[alive]] ^ words[b[alive] + out[alive]]
        lowest = np.where(differ, differ & -differ, np.uint64(1) << np.uint64(63))
        out[alive] += np.where(differ, np.log2(lowest.astype(np.float64)).astype(np.int64) >> 3, 8)
        alive = alive[(differ == 0) & (out[alive] < most[alive])]
    return np.minimum(out, most)


class _Neighbours:
    """The neighbour above (or below) of any position in suffix order, and what the two share, from samples.

    If neighbouring rows are preceded by one symbol, the rows that LF leads to are neighbours too, one position back and
    sharing one byte more. So samples are needed only at positions that LF reaches from an end of a run, and at the
    strings' ends: for any other position the next sampled one behind it tells, moved back."""

    def __init__(self, at: np.ndarray, other: np.ndarray, shared: np.ndarray):
        self.at, self.other, self.shared = at.astype(np.int32), other.astype(np.int32), shared.astype(np.int32)

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.at, x)
        back = self.at[i] - x
        return self.other[i] - back, self.shared[i] + back


class RunLengthIndex:
    """Index of byte strings, in order: runs of the Burrows-Wheeler transform, LF by runs, and samples at both ends of
    each run. Everything that it keeps has one entry a run or a string."""

    def __init__(self, strings: list[bytes], length: int = LENGTH):
        self.length = length
        self.sizes = np.array([len(s) for s in strings], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes + 1)])
        joined = np.frombuffer(b"\0".join(strings) + b"\0" * 9, dtype=np.uint8)
        n = int(self.starts[-1])
        text = joined[:n].astype(np.int64) + 1
        text[self.starts[1:] - 1] = 0  # the end of a string, below every byte
        to_end = np.repeat(self.starts[1:] - 1, self.sizes + 1) - np.arange(n)
        order = _suffix_order(text, to_end)
        # The transform as runs. A string's first symbol is preceded by an end mark; LF from there is not used.
        transform = text[order - 1]
        head = np.zeros(n, dtype=bool)
        head[self.starts[:-1]] = True
        transform[head[order]] = 0
        run_starts = np.concatenate([[0], np.flatnonzero(transform[1:] != transform[:-1]) + 1])
        symbols, lengths = transform[run_starts], np.diff(np.append(run_starts, n))
        below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=257))[:-1]])
        by_symbol = np.argsort(symbols, kind="stable")
        sums = np.cumsum(lengths[by_symbol]) - lengths[by_symbol]
        first_of = np.searchsorted(symbols[by_symbol], np.arange(257))
        base = sums[np.minimum(first_of, len(sums) - 1)]
        shift = np.empty(len(run_starts), dtype=np.int64)  # from a row of the run to where LF leads
        shift[by_symbol] = below[symbols[by_symbol]] + sums - base[symbols[by_symbol]] - run_starts[by_symbol]
        self.run_starts, self.shift = np.append(run_starts, n).astype(np.int32), shift.astype(np.int32)
        # A directory with about one entry a run: the run at every 2^step-th row.
        self.step = max(0, (n // len(run_starts)).bit_length() - 1)
        self.directory = (np.searchsorted(run_starts, np.arange(0, n, 1 << self.step), side="right") - 1).astype(np.int32)
        words = np.zeros(n, dtype=np.uint64)
        for j in range(8):
            words |= joined[j : j + n].astype(np.uint64) << np.uint64(8 * j)
        inner = np.flatnonzero(symbols > 0)
        self.above, self.above_of = self._samples(order, words, to_end, inner, (run_starts + shift)[inner], -1)
        self.below, self.below_of = self._samples(order, words, to_end, inner, (run_starts + lengths - 1 + shift)[inner], 1)

    def _samples(self, order: np.ndarray, words: np.ndarray, to_end: np.ndarray, inner: np.ndarray, rows: np.ndarray, side: int) -> tuple[_Neighbours, np.ndarray]:
        """Neighbours above (side -1) or below (1) of ``rows``, which LF reaches from the runs ``inner``, and of the
        strings' ends, which are the first rows; and which sample belongs to each run."""
        ends = np.arange(len(self.sizes))
        rows = np.concatenate([rows, ends])
        beside = rows + side
        there = (beside >= 0) & (beside < len(order))
        at, other = order[rows], order[np.where(there, beside, rows)]
        shared = np.where(there, _common(words, to_end, at, other), 0)
        by_place = np.argsort(at)
        sample_of = np.zeros(len(self.run_starts) - 1, dtype=np.int32)
        place = np.empty(len(rows), dtype=np.int64)
        place[by_place] = np.arange(len(rows))
        sample_of[inner] = place[: len(inner)]
        return _Neighbours(at[by_place], other[by_place], shared[by_place]), sample_of

    @property
    def nbytes(self) -> int:
        """Bytes of all that the index keeps."""
        kept = [self.sizes, self.starts, self.run_starts, self.shift, self.directory, self.above_of, self.below_of]
        return sum(x.nbytes for x in [*kept, *vars(self.above).values(), *vars(self.below).values()])

    def _runs_of(self, rows: np.ndarray) -> np.ndarray:
        run = self.directory[rows >> self.step]
        go = np.flatnonzero(self.run_starts[run + 1] <= rows)
        while len(go):
            run[go] += 1
            go = go[self.run_starts[run[go] + 1] <= rows[go]]
        return run

    def matching(self) -> Iterator[tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]]:
        """Streams all strings backward through the index, side by side: at each step the positions reached, and
        their neighbours in suffix order, above and below, with the lengths of what is shared. The larger
        length is the matching statistic of a position against all others."""
        rows = np.arange(len(self.sizes))
        place, left = self.starts[1:] - 1, self.sizes.copy()
        sides = []
        for known in (self.above, self.below):
            sides.append(list(known.of(place)))
        alive = np.flatnonzero(left > 0)
        rows, place, left = rows[alive], place[alive], left[alive]
        sides = [[v[alive].astype(np.int64) for v in side] for side in sides]
        while len(rows):
            run = self._runs_of(rows)
            for side, known, sample_of, edge in ((sides[0], self.above, self.above_of, self.run_starts[run]), (sides[1], self.below, self.below_of, self.run_starts[run + 1] - 1)):
                fresh = np.flatnonzero(rows == edge)
                sample = sample_of[run[fresh]]
                side[0], side[1] = side[0] - 1, side[1] + 1
                side[0][fresh], side[1][fresh] = known.other[sample], known.shared[sample]
            rows, place, left = rows + self.shift[run], place - 1, left - 1
            yield place, sides[0], sides[1]
            if not left.all():
                on = left > 0
                rows, place, left = rows[on], place[on], left[on]
                sides = [[v[on] for v in side] for side in sides]

    def _is_earlier(self, at: np.ndarray, up: np.ndarray, down: np.ndarray) -> np.ndarray:
        """Of positions whose next neighbours that share ``length`` bytes (-1: none) are later ones: whether any other
        such position is earlier. Walks from neighbour to neighbour, both ways at once, until one is."""
        out = np.zeros(len(at), dtype=bool)
        who, ways = np.arange(len(at)), [up, down]
        while len(who):
            found = np.zeros(len(who), dtype=bool)
            for i, known in enumerate((self.above, self.below)):
                go = np.flatnonzero(ways[i] >= 0)
                other, shared = known.of(ways[i][go])
                ways[i][go] = np.where(shared >= self.length, other, -1)
                found |= (ways[i] >= 0) & (ways[i] < at)
            out[who[found]] = True
            on = ~found & ((ways[0] >= 0) | (ways[1] >= 0))
            who, at, ways = who[on], at[on], [w[on] for w in ways]
        return out

    def repeated(self) -> list[np.ndarray]:
        """For each string the starts of its windows that also start earlier in the indexed text."""
        marks = np.zeros(int(self.starts[-1]), dtype=bool)
        open_ones: list[tuple[np.ndarray, ...]] = []
        for place, (up, up_shared), (down, down_shared) in self.matching():
            long = np.flatnonzero(np.maximum(up_shared, down_shared) >= self.length)
            if not len(long):
                continue
            at = place[long]
            up, down = np.where(up_shared[long] >= self.length, up[long], -1), np.where(down_shared[long] >= self.length, down[long], -1)
            sure = ((up >= 0) & (up < at)) | ((down >= 0) & (down < at))
            marks[at[sure]] = True
            open_ones.append((at[~sure], up[~sure], down[~sure]))
        if open_ones:
            at, up, down = (np.concatenate(x) for x in zip(*open_ones, strict=True))
            marks[at[self._is_earlier(at, up, down)]] = True
        return [np.flatnonzero(marks[a : a + n]) for a, n in zip(self.starts[:-1], self.sizes, strict=True)]


def _runs(starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last of each run of neighbouring numbers."""
    if len(starts):
        cut = np.flatnonzero(np.diff(starts) > 1) + 1
        for part in np.split(starts, cut):
            yield int(part[0]), int(part[-1])


#: Kinds of anchor rows: seen once in its batch; seen more often, so known to occur twice; a witness, which
#: only tells other batches that its hash occurs.
_ONCE, _TWICE, _WITNESS = 0, 1, 2


@tidy
def _anchor_rows(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each anchor; of a hash that a batch has more than once, one witness as well."""
    for batch in stream:
        raw, offsets = text_buffers(batch.column(1))
        keys, firsts, lasts = anchors(raw, offsets)
        doc = np.searchsorted(offsets, firsts, side="right") - 1
        packed = (firsts - offsets[doc]) << 7 | (lasts - firsts)
        docs = (batch.column(0).to_numpy(zero_copy_only=False)[doc] if len(doc) else np.zeros(0)).astype(np.int64)
        each, where, times = np.unique(keys, return_inverse=True, return_counts=True)
        kind = np.where(times[where] > 1, _TWICE, _ONCE)
        witness = each[times > 1]
        none = np.zeros(len(witness), dtype=np.int64)
        columns = [np.concatenate(c) for c in ((keys, witness), (docs, none), (packed, none), (kind, none + _WITNESS))]
        for a in range(0, max(1, len(columns[0])), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 200_000]) for c in columns], ["key", "doc", "packed", "kind"])


@tidy
def _repeated_keys(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, sorted by key, whose key occurs more than once. Rows known to are passed on, witnesses are not."""
    held: pa.RecordBatch | None = None
    last_emitted = False
    for batch in stream:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([b for b in (held, batch) if b is not None]).combine_chunks()
        keys, kind = table.column(0).to_numpy(), table.column(3).to_numpy()
        same = keys[1:] == keys[:-1]
        twice = np.zeros(len(keys), dtype=bool)
        twice[1:] |= same
        twice[:-1] |= same
        twice |= kind == _TWICE
        emit = twice & (kind != _WITNESS)
        if held is not None and last_emitted:
            emit[0] = False
        held = table.slice(len(keys) - 1).to_batches()[0]
        last_emitted = bool(emit[-1])
        for b in table.filter(pa.array(emit)).to_batches():
            yield pa.RecordBatch.from_arrays(b.columns[:3], ["key", "doc", "packed"])


@tidy
def _fragments(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments with a 128-bit digest of their bytes. Of those equal in a batch only the earliest keeps its
    bytes; the others are ``gone``, as it stands before them."""
    for batch in stream:
        docs = batch.column(0).to_pylist()
        least: dict[bytes, tuple[int, int]] = {}
        rows: list[tuple] = []
        for doc, text, found in zip(docs, batch.column(1), batch.column(2), strict=True):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
            keys, packed = (found.values.field(i).to_numpy() for i in (0, 1))
            for key, first, more in zip(keys.tolist(), (packed >> 7).tolist(), (packed & 127).tolist(), strict=True):
                part = raw[first : first + more + LENGTH]
                digest = blake2b(part, digest_size=16).digest()
                place = (doc, first)
                rows.append((key, digest, *place, len(part), part if place <= least.get(digest, place) else None))
                if place < least.get(digest, (1 << 62, 0)):
                    least[digest] = place
        for a in range(0, max(1, len(rows)), 20_000):
            out = [(*r[:5], r[5] if least[r[1]] == r[2:4] else None) for r in rows[a : a + 20_000]]
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "digest", "doc", "first", "n", "bytes"])


@tidy
def _shard_intervals(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (shard, doc, first, bytes) sorted by shard, doc and first: byte intervals to remove."""

    def done(rows: list[tuple]) -> pa.RecordBatch:
        found = []
        if len(rows) > 1:
            index = RunLengthIndex([r[2] for r in rows])
            for (doc, first, _), starts in zip(rows, index.repeated(), strict=True):
                found += [(doc, first + a, first + b + LENGTH) for a, b in _runs(starts)]
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], ["doc", "begin", "end"])

    shard, rows = None, []
    for batch in stream:
        for s, doc, first, raw in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if s != shard:
                if rows:
                    yield done(rows)
                shard, rows = s, []
            rows.append((doc, first, raw))
    if rows:
        yield done(rows)


@tidy
def _cut(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc", "n_bytes", "n_removed", "spans", "kept"]
    for batch in stream:
        out: tuple[list, ...] = ([], [], [], [], [])
        for doc, text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            spans: list[dict] = []
            for x in sorted(found or [], key=lambda x: x["begin"]):
                if spans and x["begin"] <= spans[-1]["end"]:
                    spans[-1]["end"] = max(spans[-1]["end"], x["end"])
                else:
                    spans.append(dict(x))
            kept, at = [], 0
            for s in spans:
                kept.append(raw[at : s["begin"]])
                at = s["end"]
            kept.append(raw[at:])
            row = (doc, len(raw), sum(s["end"] - s["begin"] for s in spans), spans, b"".join(kept))
            for column, value in zip(out, row, strict=True):
                column.append(value)
        span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), span, pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)


def _numbered(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows`` (id, text) with seq: their place by id (nulls first) and a hash of the text. Ranges are numbered
    inside, then shifted by the rows of the ranges before."""
    ranged, key = with_ranges(rows, RANGE_ROWS, id_keys("id", "text"))
    ranged = scratch.keep(ranged)  # read twice: a row must not change its range in between
    sizes = ranged.groupBy("range").agg(F.count("*").alias("n"))
    before = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    inside = ranged.withColumn("k", F.row_number().over(Window.partitionBy("range").orderBy(*key)))
    return inside.join(before, "range").select((F.col("before") + F.col("k")).alias("seq"), "id", "text")


def _beside(rows: DataFrame, table: DataFrame, size: int, how: str) -> DataFrame:
    """Join of texts with a per-document table of ``size`` bytes, on seq."""
    return rows.join(F.broadcast(table) if size <= BROADCAST_BYTES else table, "seq", how)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cuts from every text, as UTF-8 bytes, what is covered by a 100-byte string that also starts earlier:
    ``id_col``, n_bytes, n_removed, spans (array of begin, end: maximal removed runs), kept (binary).

    Earlier: in a document with a smaller id, or earlier in the same document; strings are judged on the
    input. Ids are whole numbers of any size. Null text: as empty. Null ids come first; rows with one id are
    documents in the order of a hash of their texts, so of repeated rows all but one are removed. Extra columns are not read. An empty table gives an
    empty result.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    named = rows.groupBy("id").agg(F.count("*").alias("n")).agg(F.max("n"), F.max(F.col("id").isNull())).first()
    plain = (named[0] or 0) <= 1 and not named[1]
    rows = rows.withColumn("seq", F.col("id")) if plain else scratch.keep(_numbered(rows, scratch))

    # 1. Whole copies.
    light = rows.select("seq", F.md5(F.encode("text", "UTF-8")).alias("m"), F.octet_length("text").alias("n")).where(F.col("n") >= LENGTH)
    light = scratch.keep(light)
    groups = light.groupBy("m").agg(F.min("seq").alias("first"), F.count("*").alias("c")).where("c > 1").select("m", "first")
    copies = scratch.keep(light.join(groups, "m").where("seq <> first").select("seq", "n"))
    n_copies = copies.count()
    fresh = _beside(rows.where(F.octet_length("text") >= LENGTH), copies.select("seq"), 40 * n_copies, "left_anti")

    # 2. Anchors that occur twice, per document.
    anchored = fresh.select("seq", "text").mapInArrow(_anchor_rows, "key long, doc long, packed long, kind long")
    dealt = anchored.repartition(F.when(F.col("kind") == _TWICE, F.xxhash64("doc", "packed")).otherwise(F.col("key")))
    twice = dealt.sortWithinPartitions("key").mapInArrow(_repeated_keys, "key long, doc long, packed long")
    found = scratch.keep(twice.groupBy(F.col("doc").alias("seq")).agg(F.collect_list(F.struct("key", "packed")).alias("found")))
    n_found = found.agg(F.sum(F.size("found"))).first()[0] or 0

    # 3. Fragments: distinct ones with their first place, and the places of the others.
    schema = "key long, digest binary, doc long, first long, n long, bytes binary"
    fragments = scratch.keep(_beside(fresh.select("seq", "text"), found, 60 * n_found, "inner").select("seq", "text", "found").mapInArrow(_fragments, schema))
    kept, gone = fragments.where("bytes is not null"), fragments.where("bytes is null")
    distinct = scratch.keep(kept.groupBy("key", "digest").agg(F.min(F.struct("doc", "first")).alias("at"), F.count("*").alias("c"), F.first("bytes").alias("bytes")))
    earlier = distinct.where("c > 1").select("digest", F.col("at.doc").alias("d"), F.col("at.first").alias("f"))
    others = kept.select("digest", "doc", "first", "n").join(earlier, "digest").where("doc <> d or first <> f")
    others = others.select("doc", "first", "n").unionByName(gone.select("doc", "first", "n")).select("doc", F.col("first").alias("begin"), (F.col("first") + F.col("n")).alias("end"))

    # 4. Shards, and anchors with too many fragments for one.
    keys = distinct.groupBy("key").agg(F.count("*").alias("k"), F.sum(F.length("bytes")).alias("b")).where("k > 1")
    keys = scratch.keep(keys)
    total = keys.where(F.col("k") <= CROWD).agg(F.sum("b")).first()[0] or 0
    shards = max(1, -(-total // SHARD))
    members = distinct.join(keys.select("key", "k"), "key").select("key", "k", F.col("at.doc").alias("doc"), F.col("at.first").alias("first"), "bytes")
    dealt = members.where(F.col("k") <= CROWD).select(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), "doc", "first", "bytes")
    indexed = dealt.repartition(int(shards), "shard").sortWithinPartitions("shard", "doc", "first").mapInArrow(_shard_intervals, "doc long, begin long, end long")
    crowded = members.where(F.col("k") > CROWD).withColumn("i", F.explode(F.sequence(F.lit(0), F.length("bytes") - LENGTH)))
    crowded = crowded.select("doc", (F.col("first") + F.col("i")).alias("begin"), F.expr(f"substring(bytes, i + 1, {LENGTH})").alias("w"))
    firsts = crowded.groupBy("w").agg(F.min(F.struct("doc", "begin")).alias("at"), F.count("*").alias("c")).where("c > 1").select("w", "at")
    single = crowded.join(firsts, "w").where(F.struct("doc", "begin") != F.col("at")).select("doc", "begin", (F.col("begin") + LENGTH).alias("end"))

    # 5. Intervals per document.
    intervals = scratch.keep(
        others.unionByName(indexed).unionByName(single).unionByName(copies.select(F.col("seq").alias("doc"), F.lit(0).cast("long").alias("begin"), F.col("n").cast("long").alias("end")))
        .groupBy(F.col("doc").alias("seq")).agg(F.collect_list(F.struct("begin", "end")).alias("found"))
    )
    n_intervals = intervals.agg(F.sum(F.size("found"))).first()[0] or 0
    scratch.drop(fragments, distinct, keys, found)
    both = _beside(rows, intervals, 60 * n_intervals, "left")
    if plain:
        cut = both.select("seq", "text", "found").mapInArrow(_cut, "doc long, n_bytes long, n_removed long, spans array<struct<begin: bigint, end: bigint>>, kept binary")
        return cut.withColumnRenamed("doc", id_col)
    cut = both.select("seq", "text", "found").mapInArrow(_cut, "seq long, n_bytes long, n_removed long, spans array<struct<begin: bigint, end: bigint>>, kept binary")
    return rows.select("seq", F.col("id").alias(id_col)).join(cut, "seq").drop("seq")
