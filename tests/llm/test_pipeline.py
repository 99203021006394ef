import re
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lumenseek.llm.scratch import Scratch
from lumenseek.llm.secrets import REPLACEMENT

SF = "/root/testdata/sf0.01"


def groups(ids, texts, k, percent=80):
    """Components by comparing all pairs that share a shingle, with sets of tuples."""
    sets, holders, up = {}, defaultdict(list), {i: i for i in ids}
    for i, t in zip(ids, texts, strict=True):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
        sets[i] = {tuple(words[j : j + k]) for j in range(max(1, len(words) - k + 1))} if words else set()

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in ids:
        shared = Counter(j for s in sets[i] for j in holders[s])
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                up[b] = a
        for s in sets[i]:
            holders[s].append(i)
    return {i: root(i) for i in ids}


@pytest.fixture(scope="module")
def stages(spark):
    scratch, docs, out = Scratch(spark), spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, f in corpus_pipeline.STAGES:
        docs = scratch.keep(f(spark, docs, SF))
        out.append((name, docs.toPandas()))
    return out


def test_columns(stages):
    want = pq.read_schema(f"{SF}/documents.parquet").names
    assert all(list(frame.columns) == want for _, frame in stages[:-1])
    assert list(stages[-1][1].columns) == ["doc_id", "n_tokens", "ids"]


def test_quality_keeps_clean_rejects_labelled(stages):
    labels = pq.read_table(f"{SF}/labels.parquet").to_pandas()
    kept = set(stages[0][1].doc_id)
    good, bad = labels[labels.quality == 1].doc_id, labels[labels.quality == 0].doc_id
    assert good.isin(kept).mean() > 0.99 and bad.isin(kept).mean() < 0.25  # 58 rows of quality 0 to learn from here


def test_near_duplicates_against_all_pairs(stages):
    before, after = stages[0][1], stages[1][1]
    want = groups(before.doc_id.tolist(), before.text.tolist(), 5)
    assert set(after.doc_id) == set(want.values()) and len(set(want.values())) < len(want)


def test_secrets_mixing_and_ids(stages):
    before, hidden, mixed, coded = (stages[i][1] for i in (1, 2, 3, 4))
    texts = dict(zip(before.doc_id, before.text, strict=True))
    for i, t, n in zip(hidden.doc_id, hidden.text, hidden.n_chars, strict=True):
        assert t == re.sub(r'token = "[0-9a-f]{40}"', f'token = "{REPLACEMENT}"', texts[i], flags=re.I) or REPLACEMENT in t
        assert n == len(t)
    assert len(hidden) == len(before) and set(mixed.doc_id) <= set(hidden.doc_id)
    assert mixed.groupby("doc_id").size().max() <= 3
    import public_tokenizers

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    clean = dict(zip(hidden.doc_id, hidden.text, strict=True))
    assert sorted(coded.doc_id) == sorted(mixed.doc_id)
    for i, n, ids in coded.drop_duplicates("doc_id").head(150).itertuples(index=False):
        want = library.encode(clean[i], add_special_tokens=False).ids
        assert n == len(want) and ids == b"".join(x.to_bytes(4, "little") for x in want)


def test_stages_on_odd_rows(spark):
    long = " ".join(f"w{i % 5003}" for i in range(200_000))
    rows = [(None, None, None, None, None), (1, "a b c d e f", None, "s", 11), (1, "a b c d e f", None, "s", 11), (2, "a b c d e f", "en", None, 11), (3, "", "en", "s", 0), (None, "x " * 30, "en", "s", None), (1 << 62, long, "en", "s", len(long)), (-5, long + " end", "en", "t", 4)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    plain = spark.createDataFrame(rows, schema)
    clashing = plain.selectExpr("*", "1 AS id", "2 AS row", "'x' AS copies", "3 AS range", "map(1, 2) AS number", "4.0D AS score", "5 AS rate", "6 AS kept")
    for docs in (plain, clashing, plain.limit(0)):
        whole = docs.count()
        for name, f in corpus_pipeline.STAGES:
            out = f(spark, docs, SF)
            found = out.collect()
            if name != "bpe_encoding":
                assert out.columns == docs.columns, name
            if name in ("secret_scan", "bpe_encoding"):  # a row for each row
                assert len(found) == whole
            if name == "source_mixing":  # sources: s, t, null; only words are taken
                assert all(r.text and r.text.strip() for r in found) or not whole or len(found) <= 3 * whole
            if name == "quality_classifier":
                assert len(found) <= whole
    for docs in (plain, clashing):
        kept = corpus_pipeline.keep_one_of_near_duplicates(spark, docs, SF).collect()
        assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [-5, 1, 3] and len(kept) == 5
        assert [r.text for r in kept if r.doc_id == -5] == [long + " end"]


def test_rows_of_one_id_with_different_texts(spark):
    words = [f"w{i}" for i in range(60)]
    text, near, other = " ".join(words), " ".join([*words[:-1], "end"]), " ".join(f"v{i}" for i in range(60))
    for copy in (text, near):
        rows = [(6, text), (9, copy), (9, other), (9, other), (12, other), (None, text), (7, None), (7, None), (7, "")]
        docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
        kept = corpus_pipeline.keep_one_of_near_duplicates(spark, docs, SF)
        assert kept.columns == docs.columns
        assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, text), (6, text), (7, ""), (7, ""), (9, other)]
