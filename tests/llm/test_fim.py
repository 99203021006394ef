import hashlib
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenseek.llm import fim, queries

SF = "/root/testdata/sf0.01"


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("aé漢😀<>PSM \u0000"), max_size=1200))
def test_rank_and_select(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    bits, starts = fim.Boundaries(raw), [i for i, b in enumerate(raw.tolist()) if b & 0xC0 != 0x80]
    assert bits.rank(np.arange(len(raw) + 1)).tolist() == np.searchsorted(starts, np.arange(len(raw) + 1)).tolist()
    assert bits.select(np.arange(len(starts) + 2)).tolist() == [*starts, len(raw), len(raw)]


def test_directory_over_many_slices(monkeypatch):
    text = "".join(random.Random(2).choice("aé漢😀") for _ in range(20_000)).encode()
    whole = fim.Boundaries(np.frombuffer(text, np.uint8))
    monkeypatch.setattr(fim, "SLICE", 64)
    parts = fim.Boundaries(np.frombuffer(text, np.uint8))
    assert (parts.words == whole.words).all() and (parts.before == whole.before).all()
    assert whole.rank(np.array([len(text)])) == [20_000]


def brute(doc_id, text, seed=1, fim_percent=90, spm_percent=20):
    """The rule over Python strings."""
    text, n = text or "", len(text or "")
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= fim_percent:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_percent:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def check(rows, table, **options):
    got = table.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", fim.restore(F.col("output"), F.col("form")).alias("back")).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[-1], r[-2])
    want = [(i, *brute(i, t, **options), t or "") for i, t, *_ in rows]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_every_case(spark):
    r = random.Random(4)
    pieces = ["a", "é", "漢", "😀", "<", ">", "<P", "S>", "M", "<S", "\n", " "]
    rows = [(i, "".join(r.choice(pieces) for _ in range(r.randrange(30))), None) for i in range(600)]
    rows += [(None, "no id", "x"), (None, None, None), (7, "", "x"), (9, "has <M> mark", "x"), (5, "twice", "y"), (5, "twice", "y"), (-3, "long " + "é😀 " * 400_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string").repartition(3)
    check(rows, fim.fill_in_middle(docs))
    check(rows, fim.fill_in_middle(docs, seed=8, fim_percent=100, spm_percent=100), seed=8, fim_percent=100, spm_percent=100)
    check(rows, fim.fill_in_middle(docs, fim_percent=0), fim_percent=0)
    assert fim.fill_in_middle(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        fim.fill_in_middle(docs, fim_percent=101)


def test_ids_of_another_type(spark):
    docs = spark.createDataFrame([("k1", "some text"), ("k2", None)], "doc_id string, text string")
    check([("k1", "some text"), ("k2", None)], fim.fill_in_middle(docs))


def test_query(spark):
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for d in docs:
        n, form, p, m, out = brute(d["doc_id"], d["text"])
        want.append((d["doc_id"], n, form, p, m, sha(out), sha(d["text"] or "")))
    got = queries.op11_fill_in_middle(spark, SF)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
