"""How searches run: rows before a shuffle, lists as matrices, assignment, what is left in memory."""

import importlib
import sys
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenseek.functions import text as tx
from lumenseek.operators import bm25, retrieval, vector_index
from lumenseek.operators.bm25 import bm25_scores, bm25_search, build_bm25
from lumenseek.operators.vector_index import Coarse, VectorIndex
from lumenseek.plans import catalogue
from lumenseek.providers import HashingEmbedder, embed

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding")


def test_best_over_batches_is_best_of_all():
    r = np.random.default_rng(1)
    for k in (1, 3, 7):
        best, every = retrieval.Best(5, k), []
        best.room = 40
        for a in range(0, 300, 30):
            scores = np.round(r.normal(size=(5, 30)), 1)  # many ties
            q, at = np.divmod(np.arange(150), 30)
            best.add(q, pa.array([f"id{(a + i) * 7 % 300:03}" for i in range(30)]), at, scores.ravel())
            every += [(int(i), -s, f"id{(a + j) * 7 % 300:03}") for i, j, s in zip(q, at, scores.ravel(), strict=True)]
            assert best.rows <= best.room + 150
        want = [x for i in range(5) for x in sorted(e for e in every if e[0] == i)[:k]]
        got = [(q, -s, i) for b in best.batches() for q, i, s in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        assert got == want
    assert list(retrieval.Best(2, 3).batches()) == []


def test_rows_before_the_shuffle_are_bounded(spark, vectors):
    q = np.array([r.embedding for r in vectors.limit(40).collect()], dtype=np.float64)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        for parts in (1, 3):
            dealt = vectors.repartition(parts)
            assert retrieval._scan_all(dealt, q, 5, "chunk_id", "embedding").count() == parts * 40 * 5
            listed = VectorIndex.build(vectors, "ivf", nlist=4)
            asked = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(q)], "query_id long, variant_no int, embedding array<double>")
            index = VectorIndex(listed.vectors.repartition(parts), listed.centroids, 4)
            assert index._sent(asked, retrieval.asked_vectors(asked).toArrow(), 5, 4).count() == parts * 40 * 5
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_sent_and_joined_queries_find_the_same(spark, vectors, monkeypatch):
    odd = vectors.unionByName(spark.createDataFrame([(10**6, None), (10**6 + 1, [1.0, 2.0])], "chunk_id long, embedding array<float>"))
    index = VectorIndex.build(vectors, "ivf", nlist=8)
    index = VectorIndex(index.assign(odd), index.centroids, 8)
    asked = vectors.where("chunk_id < 60").select((F.col("chunk_id") % 20).alias("query_id"), F.floor(F.col("chunk_id") / 20).cast("int").alias("variant_no"), "embedding")
    rows = lambda n: sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 9)) for r in index.search(asked, 6, n).collect())
    sent = {n: rows(n) for n in (1, 3, 8)}
    flat = sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 9)) for r in retrieval.dense_search(odd, asked, 6).collect())
    assert sent[8] == flat and sent[1] != flat
    index.vectors = index.vectors.where(F.size("embedding") == 64)
    monkeypatch.setattr(vector_index, "QUERY_BLOCK", 10)
    assert {n: rows(n) for n in (1, 3, 8)} == sent
    assert index.search(asked.limit(0), 6).count() == 0


def test_lists_on_disk_are_pruned(spark, vectors, tmp_path):
    VectorIndex.build(vectors, "ivf", nlist=8).save(str(tmp_path / "ix"))
    index = VectorIndex.load(spark, str(tmp_path / "ix"), 8)
    asked = vectors.where("chunk_id = 3").select(F.lit(0).cast("long").alias("query_id"), F.lit(0).alias("variant_no"), "embedding")
    hits = index.search(asked, 5, 2)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert hits.count() == 5 and "PartitionFilters: [cluster_id" in plan


def test_assignment():
    r = np.random.default_rng(2)
    unit = lambda x: x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    centers, x = unit(r.normal(size=(300, 16))), unit(r.normal(size=(5000, 16)))
    centers[200] = centers[7]  # of equal ones the first
    want = np.argmax(x @ centers.T, axis=1)
    assert (Coarse(centers).nearest(x) == want).all() and 200 not in want
    every = Coarse(centers, flat=100, near=10**6)
    assert every.heads is not None and (every.nearest(x) == want).all()
    some = Coarse(centers, flat=100, near=6).nearest(x)
    assert (some == want).mean() > 0.8 and ((x * centers[some]).sum(1) <= (x * centers[want]).sum(1) + 1e-12).all()


def test_centroids_are_fitted_on_a_bounded_sample(spark, vectors, monkeypatch):
    monkeypatch.setattr(vector_index, "FIT_ROWS", 30)
    index = VectorIndex.build(vectors, "ivf", nlist=4)
    assert index.centroids.count() == 4 and index.vectors.count() == vectors.count()
    best = {r.chunk_id: r.cluster_id for r in index.vectors.collect()}
    numbers, centers = vector_index.centroid_matrix(index.centroids)
    rows = vectors.collect()
    want = np.argmax(np.array([r.embedding for r in rows], np.float64) @ centers.T, axis=1)
    assert [best[r.chunk_id] for r in rows] == numbers[want].tolist()


def test_time_of_assignment_to_many_lists():
    r = np.random.default_rng(3)
    coarse, x = Coarse(r.normal(size=(1024, 64))), r.normal(size=(20_000, 64))
    began = time.perf_counter()
    coarse.nearest(x)
    assert time.perf_counter() - began < 10  # 20 million products


def test_embedded_vectors_of_many_batches(spark):
    rows = spark.createDataFrame([(i, None if i == 3 else f"word{i} and {i % 3}") for i in range(50)], "i int, t string")
    got = {r.i: r.embedding for r in embed(rows, "t", HashingEmbedder(16), batch=7).collect()}
    want = HashingEmbedder(16).encode(["" if i == 3 else f"word{i} and {i % 3}" for i in range(50)])
    assert all(np.allclose(got[i], want[i], atol=1e-6) for i in range(50))
    assert embed(rows.limit(0), "t", HashingEmbedder(16)).count() == 0


def test_keyword_queries_leave_nothing_cached_and_read_texts_once_for_weights(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    terms = build_bm25(docs).terms
    terms.count()
    for name in ("q15b_bm25_stats", "q16_bm25_topk", "q18_hybrid_fusion"):
        catalogue.queries()[name](spark, "/root/testdata/sf0.001").count()
    assert spark._jsparkSession.sharedState().cacheManager().isEmpty()
    terms.write.format("noop").mode("overwrite").save()
    frame = build_bm25(docs).terms
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]
    assert plan.count("Generate explode") == 1 and "ReusedExchange" in plan
    asked = spark.createDataFrame([(0, "the of")], "query_id long, query string")
    assert bm25_search(build_bm25(docs), asked, 5).count() == 5


def test_entry_goes_on_without_the_training_operators(monkeypatch):
    import __spark_entry__

    real = importlib.import_module

    def missing(name, *more):
        if name.startswith(("lumenseek.llm", "corpus_pipeline")):
            raise ImportError(name)
        return real(name, *more)

    monkeypatch.setattr(importlib, "import_module", missing)
    assert set(__spark_entry__.queries()) == set(catalogue.queries()) and set(__spark_entry__.oracle_sql()) == set(catalogue.oracle_sql())
    assert "pipeline" not in __spark_entry__.queries() and sys.modules  # nothing else is asked of it


# SQL functions and table functions


def test_sql_functions_equal_columns(spark):
    from lumenseek.functions import geometry, scores, sql
    from lumenseek.functions import text as tx

    assert set(sql.install(spark)) == set(sql.FUNCTIONS) and sql.install(spark)
    texts = [None, "", "  ", "one", "a b c", "What is\tthe \x1fpoint of it all, really and truly now please tell", "x " * 60, "ab" * 90, "1. first line\n- second line\n* x\n2) third one here", "a/b\\c.tar.GZ", ".hidden", "dir.d/name", "long " * 80]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    pairs = {
        "clean_text(t)": tx.clean_text(F.col("t")), "tokenize(t)": tx.tokens(F.col("t")), "text_usable(t)": tx.text_usable(F.col("t")), "base_name(t)": tx.basename(F.col("t")),
        "file_extension(t)": tx.extension(F.col("t")), "file_type(t)": tx.file_type(F.col("t")), "text_preview(t)": tx.preview(F.col("t")), "parse_expansions(t, 2)": tx.parse_expansions(F.col("t"), 2),
        "dynamic_alpha(t, 0.7D)": scores.dynamic_alpha(F.col("t"), 0.7), "dynamic_alpha(t, 0.05D)": scores.dynamic_alpha(F.col("t"), 0.05),
    }
    for text, column in pairs.items():
        got = rows.select("i", F.expr(text).alias("a"), column.alias("b")).orderBy("i").collect()
        assert [r.a for r in got] == [r.b for r in got], text
    numbers = spark.createDataFrame([(0.2, 0.0, 3.0), (0.8, 1.0, 1.0), (0.55, 0.4, 0.9), (0.0, 792.0, 612.0), (612.0, 792.0, 5.0), (30000.0, 20.0, 1.0)], "x double, y double, z double")
    pairs = {
        "dense_rescale(x)": scores.dense_rescale(F.col("x")), "fuse_scores(z, x, y)": scores.fuse(F.col("z"), F.col("x"), F.col("y")), "vector_norm(array(x, y, z))": scores.l2_norm(F.array("x", "y", "z")),
        "vector_normalize(array(x, y, z))": scores.l2_normalize(F.array("x", "y", "z")), "vector_dot(array(x, y), array(y, z))": scores.dot(F.array("x", "y"), F.array("y", "z")),
        "safe_dpi(x, y, 400000, 2000, 150)": geometry.safe_dpi(F.col("x"), F.col("y"), 400_000, 2000), "safe_dpi(x, z, 90000, 300, 96)": geometry.safe_dpi(F.col("x"), F.col("z"), 90_000, 300, 96),
        "min_max(x, min(x) OVER (), max(x) OVER ())": scores.minmax(F.col("x")),
    }
    for text, column in pairs.items():
        got = numbers.select(F.expr(text).alias("a"), column.alias("b")).collect()
        assert [r.a for r in got] == pytest.approx([r.b for r in got], rel=1e-12) if not isinstance(got[0].a, list) else [r.a for r in got] == [r.b for r in got], text
    assert spark.sql("SELECT min_max(3D, 3D, 3D) AS x").first().x == 1.0
    plan = rows.where("tokenize(t)[0] = 'one'")._jdf.queryExecution().executedPlan().toString()
    assert "tokenize(" not in plan and "filter(split(lower" in plan  # the plan sees through it


def test_table_functions_in_batches(spark):
    from lumenseek.operators import chunking

    chunking.register_chunker(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40").select("doc_id", "text").unionByName(spark.createDataFrame([(98, None), (99, "  ")], "doc_id long, text string"))
    docs.createOrReplaceTempView("chunked_docs")
    want = sorted((r.doc_id, r.chunk_index, r.text) for r in chunking.recursive_chunks(docs, 300, 40).collect())
    lateral = spark.sql("SELECT doc_id, c.chunk_index, c.text FROM chunked_docs d, LATERAL split_chunks(d.text, 300, 40) c")
    table = spark.sql("SELECT CAST(key AS BIGINT) AS doc_id, chunk_index, text FROM split_chunks_table(TABLE(SELECT CAST(doc_id AS STRING) AS key, text, 300 AS size, 40 AS overlap FROM chunked_docs))")
    for frame in (lateral, table):
        assert sorted(map(tuple, frame.collect())) == want
    assert "ArrowEvalPythonUDTF" in table._jdf.queryExecution().executedPlan().toString()


# Model calls


def test_model_calls_overlap_and_equal_prompts_are_asked_once(spark, tmp_path):
    from lumenseek.providers import generate_column

    log = str(tmp_path / "calls")

    class Slow:
        def generate(self, prompt):
            with open(log, "a") as f:
                f.write(f"{time.time()} b {prompt}\n")
            time.sleep(0.3)
            with open(log, "a") as f:
                f.write(f"{time.time()} e {prompt}\n")
            if prompt == "p3":
                raise ValueError("no")
            return prompt.upper()

    rows = spark.createDataFrame([(i, f"p{i % 6}" if i != 7 else None) for i in range(24)], "i int, p string").coalesce(1)
    got = {r.i: r.a for r in rows.select("i", generate_column(Slow(), F.col("p"), 3).alias("a")).collect()}
    assert got[1] == "P1" and got[7] is None and got[3].startswith("Warning:")
    events = [line.split() for line in open(log)]
    assert sorted(p for _, kind, p in events if kind == "b") == [f"p{i}" for i in range(6)]
    now = most = 0
    for _, kind, _ in sorted(events):
        now += 1 if kind == "b" else -1
        most = max(most, now)
    assert 1 < most <= 3


def test_expansion_has_its_own_options():
    from lumenseek.config import Settings
    from lumenseek.providers import ExtractiveModel, HttpModel, for_purpose

    model = HttpModel("http://127.0.0.1:9/", "m", options={"seed": 4})
    model.configure(Settings(temperature=0.2, expansion_max_tokens=99))
    model.configure(Settings(temperature=0.3))
    assert model.options == {"temperature": 0.3, "top_p": 0.9, "num_predict": 500, "seed": 4} and model.timeout == 180
    other = for_purpose(model, "expansion")
    assert other.options == {"temperature": 0.7, "top_p": 0.9, "num_predict": 150, "seed": 4} and other.timeout == 30
    assert for_purpose(model, "else").options == model.options
    plain = ExtractiveModel()
    assert for_purpose(plain, "expansion") is plain
    with pytest.raises(ValueError):
        Settings(expansion_temperature=3.0)


# Pages


def test_a_long_pdf_is_shared_out(spark, tmp_path):
    from lumenseek.config import Settings
    from lumenseek.plans.engine import Engine
    from lumenseek.sources.ocr import OcrExtractor, Recognizer

    root, log = tmp_path / "pdfs", tmp_path / "log"
    root.mkdir()
    log.mkdir()
    (root / "long.pdf").write_bytes(b"2000")
    (root / "short.pdf").write_bytes(b"3")

    class Page:
        width, height = 612, 792

        def __init__(self, no):
            self.no = no

        def text(self):
            return ""

        def images(self):
            return []

        def has_form(self):
            return False

        def render(self, dpi, clip):
            import uuid

            from pyspark import TaskContext

            (log / f"{TaskContext.get().partitionId()}-{uuid.uuid4().hex}").touch()
            if self.no == 777:
                raise ValueError("this page fails")
            return self.no

    class Reader:
        def read(self, image):
            return [f"page{image}"]

    extractor = OcrExtractor(Recognizer(Reader(), tile_px=2000), lambda content: (Page(i) for i in range(int(content))), lambda c: None)
    engine = Engine(spark, str(tmp_path / "s"), Settings(max_pdf_pages=5000, enable_semantic_chunking=False, chunk_size=100_000, chunk_overlap=0), extractor=extractor)
    report = engine.ingest(str(root))
    assert report.errors.count() == 0
    texts = {r.source.rpartition("/")[2]: r.text.split() for r in engine.store.chunks().collect()}
    assert texts["long.pdf"] == [f"page{i}" for i in range(2000) if i != 777] and texts["short.pdf"] == ["page0", "page1", "page2"]
    assert len(list(log.iterdir())) == 2003 and len({p.name.split("-")[0] for p in log.iterdir()}) >= 4


# Keyword scores where the texts are


def test_words_are_those_of_the_column_function(spark):
    texts = ["", " ", "a  b", " The cat sat\x1fon\x85it ", "İstanbul ΟΔΟΣ ẞ", "x​y᠎z", "\r\n\t\x0b\x0c"]
    texts += ["".join(chr(c) + ("y" if c % 3 else "") for c in range(a, min(a + 997, 0x110000)) if not 0xD800 <= c < 0xE000) for a in range(1, 0x110000, 997)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", F.lower("t").alias("low"), tx.tokens(F.col("t")).alias("w")).orderBy("i").collect()
    row, words = bm25._words(pa.array([r.low for r in rows]))
    assert list(zip(row.tolist(), words.to_pylist(), strict=True)) == [(r.i, w) for r in rows for w in r.w]


def test_all_keyword_scores_equal_joined_ones(spark, monkeypatch, tmp_path):
    docs = spark.createDataFrame([("a", "the cat the"), ("b", " Half and half "), ("c", None), ("d", "half the dog"), ("e", ""), ("f", "THE end")], "doc_id string, text string").repartition(2)
    asked = spark.createDataFrame([(1, "the the end"), (2, "nobodyhasthis"), (3, "  "), (4, "dog the"), (5, "the")], "query_id long, query string")
    built = build_bm25(docs)
    assert {r.term: r.idf for r in built.terms.collect()}["the"] == 0  # in half of the documents: counts, without weight
    built.save(str(tmp_path / "ix"))
    stored = bm25.Bm25Index.load(spark, str(tmp_path / "ix"))
    rows = lambda ix: sorted((r.query_id, r.id, round(r.score, 9)) for r in bm25_scores(ix, asked).collect())
    sent = rows(built)
    assert [r[:2] for r in sent] == [(q, i) for q in (1, 4, 5) for i in "adf"] and rows(stored) == sent
    for name in ("TEXTS", "SCORES"):
        monkeypatch.setattr(bm25, name, 3)
    assert rows(built) == sent == rows(stored)
    monkeypatch.setattr(bm25, "WEIGHTS", 1)
    assert rows(built) == sent == rows(stored)
    assert build_bm25(docs.limit(0)).corpus.first().n == 0 and bm25_scores(build_bm25(docs.limit(0)), asked).count() == 0


def test_all_keyword_scores_move_no_pair_of_query_and_document(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = catalogue.q34_bm25_all_scores(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert [x.split("#")[0] for x in plan.split("Exchange hashpartitioning(")[1:]] == ["query_id"]
    index = build_bm25(docs)
    weights = index.terms.crossJoin(F.broadcast(index.corpus.select("avgdl")))
    weights.collect()
    assert weights._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0].count("Scan parquet") == 1


def test_texts_that_are_no_hits_are_not_moved(spark, monkeypatch):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for texts of any size
    try:
        sent = catalogue.q21_rerank_topk(spark, SF)
        moved = lambda df: [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "SortMergeJoin [chunk_id" in x and "LeftSemi" not in x and "LeftOuter" not in x]
        assert not moved(sent)
        want = sorted(map(tuple, sent.collect()))
        monkeypatch.setattr(retrieval, "QUERY_BLOCK", 1)
        joined = catalogue.q21_rerank_topk(spark, SF)
        assert moved(joined) and sorted(map(tuple, joined.collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
