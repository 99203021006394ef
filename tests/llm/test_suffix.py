import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from lumenseek.llm import suffix
from lumenseek.llm.suffix import RunLengthIndex, anchors, remove_repeats

SF = "/root/testdata/sf0.001"


def brute(texts, length=100):
    """Removed byte flags of each text, in order."""
    seen, out = set(), []
    for raw in texts:
        gone = np.zeros(len(raw), dtype=bool)
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                gone[i : i + length] = True
            seen.add(w)
        out.append(gone)
    return out


def repetitive(n, seed):
    r = random.Random(seed)
    parts = ["".join(r.choice("abé漢 ") for _ in range(r.randrange(1, 260))) for _ in range(12)]
    return ["".join(r.choice(parts) for _ in range(r.randrange(0, 9))) + r.choice(["", "x" * r.randrange(300)]) for _ in range(n)]


def check(spark, rows):
    """rows: (id, text); compares with brute force, by id and text."""
    frame = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, key string, first int")
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_removed, bytes(r.kept)) for r in remove_repeats(frame).collect()), key=lambda r: r[:4] + (r[4],))
    ordered = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, (x[1] or "").encode()))
    raws = [(t or "").encode() for _, t in ordered]
    want = []
    for (i, _), raw, gone in zip(ordered, raws, brute(raws), strict=True):
        want.append((i is not None, i or 0, len(raw), int(gone.sum()), np.frombuffer(raw, np.uint8)[~gone].tobytes()))
    assert got == sorted(want, key=lambda r: r[:4] + (r[4],))
    return got


@pytest.mark.parametrize("length", [5, 7, 20, 100])
def test_index_marks_later_windows(length):
    r = random.Random(length)
    for _ in range(30):
        strings = ["".join(r.choice("ab\0") for _ in range(r.randrange(0, 3 * length))).encode() for _ in range(r.randrange(1, 12))]
        strings += [s for s in strings[:2]]
        seen, want = set(), []
        for s in strings:
            marks = []
            for i in range(len(s) - length + 1):
                marks += [i] * (s[i : i + length] in seen)
                seen.add(s[i : i + length])
            want.append(marks)
        assert [x.tolist() for x in RunLengthIndex(strings, length).repeated()] == want


def test_anchors_cover_each_window_once(monkeypatch):
    monkeypatch.setattr(suffix, "_PIECE", 512)
    texts = [t.encode() for t in repetitive(60, 5)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    keys, firsts, lasts = anchors(np.frombuffer(b"".join(texts), np.uint8), offsets)
    windows, by_text = {}, {}
    for k, a, b in zip(keys, firsts, lasts, strict=True):
        for s in range(a, b + 1):
            assert s not in windows
            windows[s] = k
            assert by_text.setdefault(b"".join(texts)[s : s + 100], k) == k
    assert set(windows) == {int(o) + i for o, t in zip(offsets, texts, strict=False) for i in range(len(t) - 99)}


def test_random_repetitive_texts(spark):
    check(spark, list(enumerate(repetitive(120, 1))))


def test_crowded_anchor(spark, monkeypatch):
    monkeypatch.setattr(suffix, "CROWD", 3)
    check(spark, list(enumerate(repetitive(40, 2))))


def test_documents(spark):
    table = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = check(spark, [(d["doc_id"], d["text"]) for d in table])
    assert sum(r[3] > 0 for r in got) > 10


def test_edges(spark):
    long = "".join(random.Random(4).choice("abc d") for _ in range(300_000))
    rows = [(1, None), (2, ""), (3, "a" * 99), (4, "a" * 99), (5, "z" * 250), (6, long), (7, long[1000:5000] + "Q" + long[1000:1099])]
    check(spark, rows)
    check(spark, [*rows, (None, "n" * 120), (None, "n" * 120), (6, long), (6, "other " * 40), (8, None)])
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_index_shrinks_with_repetition():
    r = random.Random(8)
    fresh = [bytes(r.choice(b"abcdefgh") for _ in range(150)) for _ in range(300)]
    base = fresh[:10]
    copies = [base[i % 10][i // 10 :] for i in range(300)]
    plain, repetitive_ = RunLengthIndex(fresh), RunLengthIndex(copies)
    assert len(repetitive_.run_starts) < 0.2 * len(plain.run_starts)
    assert repetitive_.nbytes < 0.3 * plain.nbytes


def test_matching_statistics():
    strings = [b"abracadabra", b"cadabrabra", b"", b"abra", b"x"]
    index = RunLengthIndex(strings, 3)
    suffixes = {int(s) + i: t[i:] for s, t in zip(index.starts, strings, strict=False) for i in range(len(t))}
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    for place, up, down in index.matching():
        for i, p in enumerate(place.tolist()):
            best = max(common(suffixes[p], t) for q, t in suffixes.items() if q != p)
            assert max(up[1][i], down[1][i]) == best
            for other, shared in (up, down):
                assert not shared[i] or common(suffixes[p], suffixes[int(other[i])]) == shared[i]


WIDE = [None, -(1 << 63), (1 << 63) - 1, 0, 5, -3, 1 << 62]


def test_ids_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(suffix, "RANGE_ROWS", 4)
    texts = repetitive(40, 6)
    check(spark, [(WIDE[i % 7] if i < 7 else i * 0x1234567890ABCD % (1 << 63) - (1 << 62), t) for i, t in enumerate(texts)])
    check(spark, [(None if i % 3 else 7, "one text " * 30) for i in range(60)])
