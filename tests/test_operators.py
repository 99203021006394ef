import math
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lumenseek.operators import chunking, context, ledger, retrieval, skipping
from lumenseek.operators.bm25 import Bm25Index, bm25_search, build_bm25
from lumenseek.operators.retrieval import merged_variants
from lumenseek.operators.vector_index import VectorIndex, index_kind, needs_retraining, trainable
from lumenseek.operators.visualize import even_sample, reduce_points, tsne, visualize

SF = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


# Chunks


@pytest.mark.parametrize(("text", "size", "overlap"), [("A" * 120, 50, 10), ("0123456789" * 10, 20, 5), ("x", 10, 20), ("  padded  ", 4, 1)])
def test_fixed_chunks(spark, text, size, overlap):
    rows = chunking.fixed_chunks(spark.createDataFrame([(1, text)], "doc_id long, text string"), size, overlap).orderBy("chunk_index").collect()
    step, body = max(1, size - overlap), text.strip()
    want = [body[i : i + size] for i in range(0, len(body), step)]
    assert [r.text for r in rows] == want and {r.total_chunks for r in rows} == {len(want)}


def test_blank_texts_have_no_chunks(spark):
    docs = spark.createDataFrame([(1, ""), (2, "   "), (3, None)], "doc_id long, text string")
    assert chunking.fixed_chunks(docs).count() == 0 and chunking.recursive_chunks(docs).count() == 0


def test_recursive_chunks_keep_all_characters(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: " ".join(r.text.split()) for r in docs.collect()}
    rows = chunking.recursive_chunks(docs.select("doc_id", F.regexp_replace(F.trim("text"), r"\s+", " ").alias("text"))).collect()
    by_doc = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.chunk_index)):
        by_doc.setdefault(r.doc_id, []).append(r.text)
        assert 0 < len(r.text) <= 1600 and r.text in texts[r.doc_id]
    for i, parts in by_doc.items():
        assert not Counter(texts[i].replace(" ", "")) - Counter("".join(parts).replace(" ", ""))


def test_recursive_splitting_prefers_coarse_separators():
    text = "one two. three four. five six"
    assert chunking.split_recursively(text, 12, 0) == ["one two", ". three four", ". five six"]
    assert chunking.split_recursively("abcdefghij", 4, 1) == ["abcd", "defg", "ghij"]
    assert chunking.split_recursively("a\n\nb c", 100, 0) == ["a\n\nb c"]


def test_chunker_in_sql(spark):
    chunking.register_chunker(spark)
    got = spark.sql("SELECT chunk_index, c.text FROM VALUES ('one two. three four') AS d(t), LATERAL split_chunks(d.t, 12, 0) c ORDER BY 1").collect()
    assert [r.text for r in got] == ["one two", ". three four"]


# BM25


def python_bm25(docs, query, k):
    words = {i: t.lower().split() for i, t in docs.items()}
    n, avgdl = len(words), sum(map(len, words.values())) / len(words)
    df = Counter(w for ws in words.values() for w in set(ws))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in idf.items()}
    score = Counter()
    for i, ws in words.items():
        tf = Counter(ws)
        score[i] = sum(idf[q] * tf[q] * 2.5 / (tf[q] + 1.5 * (0.25 + 0.75 * len(ws) / avgdl)) for q in query.lower().split() if tf[q])
    return sorted(((i, s) for i, s in score.items() if s > 0), key=lambda x: (-round(x[1], 9), x[0]))[:k]


def test_bm25_against_plain_python(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    asked = [(0, "the of the la"), (1, "and Thereat"), (2, "  "), (3, texts[5][:60]), (4, "zzzz")]
    index = build_bm25(docs)
    index.save(str(tmp_path / "bm25"))
    for ix in (index, Bm25Index.load(spark, str(tmp_path / "bm25"))):
        got = bm25_search(ix, spark.createDataFrame(asked, "query_id long, query string"), 10).orderBy("query_id", "rank").collect()
        for q, text in asked:
            want = python_bm25(texts, text, 10)
            mine = [(r.id, r.score) for r in got if r.query_id == q]
            assert [i for i, _ in mine] == [i for i, _ in want]
            assert [s for _, s in mine] == pytest.approx([s for _, s in want])
    assert Bm25Index.load(spark, str(tmp_path / "none")) is None


# Retrieval


def test_variants_merge_by_largest_score(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.6, 0.8])], "chunk_id long, embedding array<double>")
    asked = spark.createDataFrame([(7, 0, [1.0, 0.0]), (7, 1, [0.0, 1.0])], "query_id long, variant_no int, embedding array<double>")
    got = retrieval.dense_search(vectors, asked, 2).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in got] == [(1, 1.0), (2, 1.0), (3, pytest.approx(0.8))]
    assert "WindowGroupLimit" in plan(retrieval.dense_search(vectors, asked, 2))


def test_hybrid_keeps_dense_hits_only(spark):
    dense = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.8, 2)], "query_id long, chunk_id long, score double, rank int")
    words = spark.createDataFrame([(1, 11, 1.0), (1, 99, 0.5)], "query_id long, id long, normalized double")
    asked = spark.createDataFrame([(1, "short query")], "query_id long, query string")
    got = retrieval.hybrid(dense, words, asked, 0.7).orderBy("rank").collect()
    assert [(r.chunk_id, r.bm25_score) for r in got] == [(11, 1.0), (10, 0.0)]
    assert got[0].fused_score == pytest.approx(0.45 * 0.6 + 0.55)


def test_rerank_cuts_only_if_asked(spark):
    hits = spark.createDataFrame([(1, i, i, "alpha beta", t) for i, t in enumerate(["x", "alpha", "beta alpha y", "beta"], 1)], "query_id long, chunk_id long, rank int, query string, text string")
    assert [r.chunk_id for r in retrieval.rerank(hits, 2).orderBy("rank").collect()] == [3, 2]
    assert retrieval.rerank(hits, 0).count() == 4 and retrieval.rerank(hits, None).count() == 4


def test_query_variants(spark):
    asked = spark.createDataFrame([(1, "q", ["a", "b", "c"]), (2, "r", None)], "query_id long, query string, variants array<string>")
    assert sorted(map(tuple, retrieval.query_variants(asked, 2).collect())) == [(1, 0, "q"), (1, 1, "a"), (1, 2, "b"), (2, 0, "r")]


# Context


def test_context_numbers_documents_by_first_appearance(spark):
    rows = [(1, 1, "/x/b.pdf", 0, 3, "pdf", "T1"), (1, 2, "/y/a.pdf", 4, 5, "pdf", "T2"), (1, 3, "/x/b.pdf", 1, 3, "pdf", "T3")]
    hits = spark.createDataFrame(rows, "query_id long, rank int, source string, chunk_index int, total_chunks int, file_type string, text string")
    got = context.build_context(hits).first()
    assert got.legend == "- Document 1: b.pdf\n- Document 2: a.pdf"
    assert got.context.split("\n\n") == [
        "[Document 1 — Source: b.pdf | Chunk 1/3 | Type: PDF]\nT1", "[Document 2 — Source: a.pdf | Chunk 5/5 | Type: PDF]\nT2", "[Document 1 — Source: b.pdf | Chunk 2/3 | Type: PDF]\nT3",
    ]
    prompt = context.build_prompt(context.build_context(hits), spark.createDataFrame([(1, "why?")], "query_id long, query string")).first().prompt
    assert "QUESTION: why?" in prompt and context.NO_ANSWER in prompt and prompt.endswith("Response:")


# Skipping and ledger


def test_skip_rules_in_order(spark):
    rows = [("skipme.txt", ".txt", 1, True), ("a.txt", ".txt", 1, True), ("b.pdf", ".pdf", 1, True), ("c.pdf", ".pdf", None, False), ("d.pdf", ".pdf", 201 * 1048576, False), ("e.pdf", ".pdf", 200 * 1048576, False)]
    files = spark.createDataFrame(rows, "name string, ext string, size long, seen boolean")
    reason = skipping.skip_reason(F.col("name"), F.col("ext"), F.col("size"), F.col("seen"), ["skipme.txt"])
    assert [r.x for r in files.select(reason.alias("x")).collect()] == ["file in hard-coded skip list.", "unsupported file type: .txt", "already processed", "cannot stat file", "large file (201.0 MB)", None]
    only = skipping.skip_reason(F.col("name"), F.col("ext"), F.col("size"), F.col("seen"), allowed=[".png"])
    assert files.select(only.alias("x")).collect()[2].x == "file type not in filter: .pdf"


def test_ledger(spark):
    known = spark.createDataFrame([("h1", "a"), ("h2", "b"), ("h2", "b2")], "file_hash string, filename string")
    files = spark.createDataFrame([("h2", "b"), ("h3", "c")], "file_hash string, path string")
    assert [r.file_hash for r in ledger.new_files(files, known).collect()] == ["h3"]
    stale = ledger.stale_entries(known, files)
    assert [r.filename for r in stale.collect()] == ["a"]
    assert sorted(r.filename for r in ledger.without_stale(known, stale).collect()) == ["b", "b2"]
    assert {r.file_hash: r.status for r in ledger.reconcile(known, files).collect()} == {"h1": "stale", "h2": "processed", "h3": "new"}
    assert {r.file_hash: r.seen for r in ledger.mark_seen(files, known).collect()} == {"h2": True, "h3": False}


# Vector index


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding")


def test_index_kinds():
    assert [index_kind(x) for x in ("IVF", "ivf_flat", "IVF_PQ", "flat")] == ["ivf", "ivf", "ivf_pq", "flat"]
    with pytest.raises(ValueError, match="not-real"):
        index_kind("not-real")
    assert trainable(16, 8) and not trainable(15, 8)
    assert needs_retraining(True, 100, 21) and not needs_retraining(True, 100, 20) and not needs_retraining(False, 100, 50) and not needs_retraining(True, 0, 5)


def test_probing_all_lists_equals_flat(spark, vectors, tmp_path):
    asked = vectors.where("chunk_id < 6").select(F.col("chunk_id").alias("query_id"), F.lit(0).alias("variant_no"), "embedding")
    flat = VectorIndex.build(vectors, "flat").search(asked, 10)
    built = VectorIndex.build(vectors, "ivf", nlist=8)
    assert built.trained and VectorIndex.build(vectors, "ivf", nlist=1024).trained is False
    built.save(str(tmp_path / "ix"))
    index = VectorIndex.load(spark, str(tmp_path / "ix"), 8)
    key = lambda f: sorted((r.query_id, r.chunk_id, round(r.score, 9)) for r in f.collect())
    assert key(index.search(asked, 10, nprobe=8)) == key(flat)
    few = index.search(asked, 10, nprobe=2)
    assert "PartitionFilters: [cluster_id" in plan(few)  # few queries: the lists are known when the plan is made
    assert "dynamicpruning" in plan(merged_variants(index._joined(asked, 2), 10, "chunk_id"))  # many queries
    assert {r.query_id for r in few.where("score > 0.999").collect()} == set(range(6))


def test_growth(spark, vectors):
    index = VectorIndex.build(vectors.where("chunk_id < 300"), "ivf", nlist=8)
    few = index.add(vectors.where("chunk_id between 300 and 350"))
    assert few.vectors.count() == 351 and few.centroids is index.centroids
    many = index.add(vectors.where("chunk_id >= 300"))
    assert many.vectors.count() == 500 and many.centroids is not index.centroids
    with pytest.warns(UserWarning, match="flat"):
        assert not VectorIndex.build(vectors, "ivf_pq").trained


# Plots


@pytest.mark.parametrize(("n", "m"), [(10, 20), (10, 10), (500, 7), (500, 499), (333, 100), (5, 1)])
def test_even_sample(spark, n, m):
    got = sorted(r.position for r in even_sample(spark.range(n).select((F.col("id") * 3).alias("chunk_id")), m).collect())
    want = list(range(n)) if n <= m else sorted({int(x) for x in np.linspace(0, n - 1, m)})
    assert got == want or (m == 1 and got in ([0], [n - 1]))


@pytest.mark.parametrize("method", ["umap", "tsne", "pca"])
def test_layouts_keep_groups_together(method):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.05, (30, 16)) for c in np.eye(16)[:3]])
    at = reduce_points(x, method, 2)
    assert at.shape == (90, 2) and np.isfinite(at).all()
    assert (reduce_points(x, method, 2) == at).all()
    centres = at.reshape(3, 30, 2).mean(axis=1)
    inside = max(np.linalg.norm(at.reshape(3, 30, 2)[i] - centres[i], axis=1).mean() for i in range(3))
    assert inside < min(np.linalg.norm(centres[i] - centres[j]) for i in range(3) for j in range(i))
    assert reduce_points(x[:2], method, 3).shape == (2, 3)


def test_tsne_runs_all_rounds():
    x = np.random.default_rng(2).normal(0, 1, (40, 8))
    assert (reduce_points(x, "tsne", 2) == tsne(x, 2, rounds=1000)).all()


def test_visualize(spark, vectors):
    chunks = pq.read_table(f"{SF}/documents.parquet").to_pandas()
    frame = spark.createDataFrame(chunks[["doc_id", "source", "text"]]).withColumnRenamed("doc_id", "chunk_id")
    hits = spark.createDataFrame([(0, 1.3), (7, -0.5)], "chunk_id long, score double")
    rows = visualize(vectors.where("chunk_id < 200"), frame, hits, [1.0] * 64, "pca", 2, 500).collect()
    assert len(rows) == 201 and sum(r.is_query for r in rows) == 1
    by_id = {r.id: r for r in rows}
    assert by_id[0].score == 1.0 and by_id[7].score == 0.0 and all(r.z is None for r in rows)
    with pytest.raises(ValueError):
        reduce_points([[1.0]], "other")


@pytest.mark.parametrize("key", ["xxhash64(id)", "if(id = 3, -9223372036854775808, if(id = 4, 9223372036854775807, id))", "md5(string(id))", "if(id = 7, 1L << 62, id)"])
def test_even_sample_of_ids_of_any_kind(spark, key, monkeypatch):
    from lumenseek.operators import visualize as module

    monkeypatch.setattr(module, "RANGE_ROWS", 100)
    rows = spark.range(3000).selectExpr(f"{key} AS chunk_id")
    ids = sorted(r.chunk_id for r in rows.collect())
    got = even_sample(rows, 500).collect()
    assert len(got) == 500 and all(ids[r.position] == r.chunk_id for r in got)
    assert {0, 2999} <= {r.position for r in got}


def test_blocks_of_queries_find_the_same(spark, vectors, monkeypatch):
    from lumenseek.operators import retrieval

    asked = vectors.where("chunk_id % 9 = 0").selectExpr("chunk_id AS query_id", "0 AS variant_no", "embedding")
    named = vectors.selectExpr("concat('c', chunk_id) AS chunk_id", "embedding").union(spark.createDataFrame([("n", None), ("s", [1.0]), ("z", [float("nan")] * 64)], "chunk_id string, embedding array<float>"))
    rows = lambda: sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 9)) for r in retrieval.dense_search(named, asked, 5).collect())
    sent = rows()
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    monkeypatch.setattr(retrieval, "VECTOR_BLOCK", 100)
    assert rows() == sent and len(sent) == 5 * asked.count()
    assert retrieval.dense_search(named, asked.limit(0), 5).columns == ["query_id", "chunk_id", "score", "rank"]
    assert retrieval.dense_search(named, asked.limit(0), 5).count() == 0


def test_broken_keyword_index_is_none(spark, tmp_path):
    build_bm25(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).save(str(tmp_path / "ix"))
    spark.range(1).write.mode("overwrite").parquet(str(tmp_path / "ix" / "terms" / "terms"))
    assert Bm25Index.load(spark, str(tmp_path / "ix")) is None
    for f in (tmp_path / "ix" / "terms" / "corpus").glob("*.parquet"):
        f.write_bytes(b"nothing")
    with pytest.warns(UserWarning, match="dense search only"):
        assert Bm25Index.load(spark, str(tmp_path / "ix")) is None


def test_flat_and_listed_vectors_are_written_by_many_tasks(spark, vectors, tmp_path):
    VectorIndex.build(vectors.repartition(5), "flat").save(str(tmp_path / "flat"))
    assert len(list((tmp_path / "flat" / "vectors").glob("*.parquet"))) == 5


def test_keyword_scores_of_one_task_equal_joined_ones(spark, monkeypatch, tmp_path):
    from lumenseek.operators import bm25

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").repartition(3)
    asked = spark.read.parquet(f"{SF}/benchmark.parquet").selectExpr("item_id AS query_id", "text AS query").union(spark.createDataFrame([(-1, " "), (-2, "nobodyhasthis"), (-3, "the the of")], "query_id long, query string"))
    built = build_bm25(docs)
    built.save(str(tmp_path / "ix"))
    stored = Bm25Index.load(spark, str(tmp_path / "ix"))
    rows = lambda ix: sorted((r.query_id, r["rank"], r.id, round(r.score, 8)) for r in bm25_search(ix, asked, 9).collect())
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")  # documents go on from batch to batch
    sent = rows(built)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert rows(stored) == sent and {q for q, *_ in sent}.isdisjoint({-1, -2}) and len(sent) > 300
    monkeypatch.setattr(bm25, "WEIGHTS", 10)
    assert rows(built) == sent == rows(stored)
    assert spark._jsparkSession.sharedState().cacheManager().isEmpty()  # nothing is left behind
