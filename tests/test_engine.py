import pytest
from pyspark.sql import functions as F

from lumenseek.config import Settings, load_settings, looks_like_path
from lumenseek.plans.engine import Engine, NothingIngested, StaleEntries
from lumenseek.providers import ExtractiveModel, HashingEmbedder, HttpModel, embed, rerank_column
from lumenseek.sources import files, store
from lumenseek.streaming.ingest import ingest_stream


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "docs"
    (root / "deep" / "node_modules").mkdir(parents=True)
    (root / "a.html").write_text("<html><title>Solar power</title><script>var x</script><body>Panels turn sunlight into power &amp; heat.<!-- no --></body></html>")
    (root / "deep" / "b.HTM").write_text("<p>Wind turbines need steady wind. They stand on hills and coasts.</p>")
    (root / "deep" / "copy.html").write_text((root / "a.html").read_text())
    (root / "deep" / "node_modules" / "c.html").write_text("<p>never read</p>")
    (root / "note.txt").write_text("plain")
    return root


def make(spark, tmp_path, **settings):
    return Engine(spark, str(tmp_path / "state"), Settings(**settings))


def test_html_to_text():
    assert files.html_to_text("<style>x{}</style>a<noscript>b</noscript>&eacute;<p>c</p>") == "a\né\nc"


def test_html_entities_without_semicolon():
    page = "<h1>a&amp;&amp</h1><p>&am &notit; &eacute; &#65; &#66 &amp;lt; &</p>"
    assert files.html_to_text(page) == "a&&\n&am ¬it; é A B &lt; &"
    assert files.html_to_text(page, ended=True) == "a&&amp\n&am &notit; é A &#66 &lt; &"


def test_listing_prunes_and_ignores_case(spark, folder):
    rows = files.list_files(spark, str(folder), [".HTML", ".htm"])
    assert sorted(r.name for r in rows.collect()) == ["a.html", "b.HTM", "copy.html"]
    assert sorted(r.name for r in files.list_files(spark, str(folder), recurse=False).collect()) == ["a.html", "note.txt"]


def test_roots_that_are_refused(tmp_path):
    for bad in ("/", str(tmp_path / "none"), str(files.Path.home()), str(files.Path.home().parent)):
        with pytest.raises(ValueError):
            files.check_root(bad)
    assert files.check_root(str(tmp_path)) == str(tmp_path.resolve())


def test_ingest_search_answer(spark, folder, tmp_path):
    engine = make(spark, tmp_path)
    assert engine.health()["loaded"] is False
    with pytest.raises(FileNotFoundError):
        engine.search(engine.queries(["x"]))
    report = engine.ingest(str(folder))
    assert report.n_chunks == 2
    counters = report.counters.first()
    assert (counters.candidates, counters.processed, counters.skipped, counters.failed) == (4, 3, 1, 0)
    assert [tuple(r) for r in report.skipped.collect()] == [("incompatible file type", 1)]
    assert engine.health() == {"loaded": True, "chunks": 2, "sources": 2, "index": "flat"}
    engine.validate()
    hits = engine.search(engine.queries(["steady wind turbines", "  ", "sunlight power panels"])).orderBy("query_id", "rank").collect()
    first = {h.query_id: h for h in hits if h["rank"] == 1}
    assert first[0].source.endswith("b.HTM") and "Panels" in first[2].text and 1 not in first
    answers = engine.answer(["where do wind turbines stand"])
    assert "wind" in answers[0]["answer"].lower() and answers[0]["sources"]
    assert engine.dense_search(engine.queries(["wind"]), 1).count() == 1
    points = engine.visualize("wind", "pca", 3).collect()
    assert len(points) == 3 and points[0].is_query


def test_reingesting_adds_only_what_is_new(spark, folder, tmp_path):
    engine = make(spark, tmp_path)
    engine.ingest(str(folder))
    before = {r.chunk_id for r in engine.store.chunks().collect()}
    assert engine.ingest(str(folder)).n_chunks == 0
    assert {r.chunk_id for r in engine.store.chunks().collect()} == before
    (folder / "new.html").write_text("<p>Tidal plants use the moon.</p>")
    (folder / "deep" / "b.HTM").unlink()
    with pytest.raises(StaleEntries):
        engine.ingest(str(folder), on_stale="fail")
    engine.ingest(str(folder), on_stale="clean")
    texts = [r.text for r in engine.store.chunks().collect()]
    assert any("Tidal" in t for t in texts) and not any("turbines" in t for t in texts)
    at = engine.store.manifest()
    row = store.consistency(engine.store.chunks(), engine.store.read_each(at.vectors)).first()
    assert (row.chunks_without_vector, row.vectors_without_chunk) == (0, 0)
    assert engine.ingest(str(folder), fresh=True).n_chunks == 2


def test_nothing_to_ingest(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "x.txt").write_text("text")
    with pytest.raises(NothingIngested):
        make(spark, tmp_path).ingest(str(tmp_path / "empty"))
    with pytest.raises(ValueError, match="docx"):
        make(spark, tmp_path).ingest(str(tmp_path / "empty"), filetypes="docx")


def test_table_ingestion_and_growth_to_ivf(spark, tmp_path):
    engine = make(spark, tmp_path, index_type="ivf", nlist=8, chunk_size=800, chunk_overlap=50, enable_reranking=False)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    engine.ingest_table(docs.where("doc_id = 1"), F.col("source"), F.col("text"))
    assert engine.health()["index"] == "flat"
    n = engine.ingest_table(docs, F.col("source"), F.col("text"))
    assert n > 100 and engine.health()["index"] == "ivf"
    assert engine.ingest_table(docs, F.col("source"), F.col("text")) == 0
    text = docs.where("doc_id = 9").first().text[:200]
    hits = engine.search(engine.queries([text])).orderBy("rank").collect()
    assert text[:40] in hits[0].text


def test_failing_extractor_is_reported(spark, tmp_path):
    class Broken:
        def pages(self, content):
            raise RuntimeError("no")

        def image(self, content):
            return "An image that says something useful"

    root = tmp_path / "mixed"
    root.mkdir()
    (root / "a.pdf").write_bytes(b"%PDF")
    (root / "b.png").write_bytes(b"x")
    engine = Engine(spark, str(tmp_path / "s"), Settings(), extractor=Broken())
    report = engine.ingest(str(root))
    assert report.n_chunks == 1 and [r.error for r in report.errors.collect()] == ["RuntimeError"]
    assert report.counters.first().failed == 1
    assert [r.error for r in spark.read.parquet(str(tmp_path / "s" / "errors")).collect()] == ["RuntimeError"]


def test_public_names():
    import lumenseek

    assert all(getattr(lumenseek, name) for name in lumenseek.__all__)
    with pytest.raises(AttributeError):
        _ = lumenseek.nothing


def test_page_rule():
    class Engine_:
        def pages(self, content):
            return [("A text layer that is long enough to use.", "", "no"), ("x", "from images", "no"), ("x", " ", "rendered")]

    assert files._extract(Engine_(), "pdf", b"") == "A text layer that is long enough to use.\nfrom images\nrendered"


def test_expansion_falls_back(spark, tmp_path):
    class Model:
        def is_available(self):
            return True

        def generate(self, prompt):
            return "1. wind power stations\n2. machines for wind\nno" if "QUESTION" not in prompt else "ok"

    engine = make(spark, tmp_path)
    engine.model = Model()
    got = engine.expand(engine.queries(["wind turbines"])).orderBy("variant_no").collect()
    assert [r.variant for r in got] == ["wind turbines", "wind power stations", "machines for wind"]
    engine.model = HttpModel("http://127.0.0.1:9/", "m", timeout=0.2, attempts=1)
    assert [r.variant for r in engine.expand(engine.queries(["wind"])).collect()] == ["wind"]
    assert engine.model.generate("x").startswith("Warning:")


def test_providers(spark):
    rows = spark.createDataFrame([(1, "wind power"), (2, ""), (3, None)], "i int, text string")
    got = {r.i: r.embedding for r in embed(rows, "text", HashingEmbedder(16), batch=2).collect()}
    assert sum(x * x for x in got[1]) == pytest.approx(1, abs=1e-5) and set(got[2]) == {0.0} == set(got[3])

    class Length:
        def score(self, query, text):
            return [len(t) for t in text]

    from lumenseek.operators.retrieval import rerank

    hits = spark.createDataFrame([(1, 1, 1, "q", "a"), (1, 2, 2, "q", "abc")], "query_id long, chunk_id long, rank int, query string, text string")
    assert rerank(hits, 1, rerank_column(Length())).first().chunk_id == 2
    assert ExtractiveModel().generate("EXCERPTS:\nSolar works. Wind blows.\n\nQUESTION: wind\nResponse:") == "Wind blows."


def test_settings(tmp_path):
    (tmp_path / "sample.toml").write_text('[index]\nINDEX_TYPE = "IVF_FLAT"\n[x]\nSEMANTIC_CHUNK_MAX_SIZE = 900\nSKIP_FILES = ["a"]\nOTHER = 1\n')
    s = load_settings(tmp_path / "s.toml", tmp_path / "sample.toml")
    assert (s.index_type, s.chunk_size, s.skip_files, s.extra) == ("ivf", 900, ("a",), {"other": 1})
    assert (tmp_path / "s.toml").read_text() == (tmp_path / "sample.toml").read_text()
    assert load_settings(tmp_path / "none.toml") == Settings()
    for bad in ({"nlist": 0}, {"hybrid_alpha": 1.5}, {"index_type": "x"}):
        with pytest.raises(ValueError):
            Settings(**bad)
    assert Settings().top_k(0) == Settings().top_k(None) == 7 and Settings().top_k(3) == 3
    assert [looks_like_path(x) for x in ("org/model", "/m", "C:\\m", "./m", "m.onnx")] == [False, True, True, True, True]


def test_ledger_text_and_chunk_columns(spark, tmp_path):
    (tmp_path / "l.txt").write_text("h1|a.pdf\nbroken\nh2|b|c\n")
    assert sorted(map(tuple, store.read_ledger_text(spark, str(tmp_path / "l.txt")).collect())) == [("h1", "a.pdf"), ("h2", "b|c")]
    spark.range(1).write.parquet(str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="chunk_index"):
        store.read_chunks(spark, str(tmp_path / "bad"))


def test_stream_takes_each_content_once(spark, tmp_path):
    schema, folder = "doc_id long, text string", str(tmp_path / "in")
    write = lambda b, n: b.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")
    for part in ([(1, "a"), (2, "b"), (3, "a")], [(4, "b"), (5, "c")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        ingest_stream(spark, folder, schema, str(tmp_path / "state"), write).awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b", "c"]


def test_a_run_that_ends_early_changes_nothing(spark, folder, tmp_path, monkeypatch):
    engine = make(spark, tmp_path)
    engine.ingest(str(folder))
    before = engine.store.manifest()
    (folder / "new.html").write_text("<p>Tidal plants use the moon.</p>")

    def killed(*args):
        raise RuntimeError("killed")

    monkeypatch.setattr(store.Store, "_appears", killed)
    with pytest.raises(RuntimeError, match="killed"):
        engine.ingest(str(folder))
    monkeypatch.undo()
    assert engine.store.manifest() == before and engine.health()["chunks"] == 2
    assert engine.ingest(str(folder)).n_chunks == 1 and engine.health()["chunks"] == 3
    with pytest.raises(store.ConcurrentRun):
        engine.store.commit(before)


def test_runs_append(spark, folder, tmp_path):
    engine = make(spark, tmp_path)
    engine.ingest(str(folder))
    first = engine.store.manifest()
    (folder / "new.html").write_text("<p>Tidal plants use the moon and the turbines turn.</p>")
    engine.ingest(str(folder))
    second = engine.store.manifest()
    for table in ("chunks", "ledger", "vectors", "postings"):
        assert getattr(second, table)[:-1] == getattr(first, table) and len(getattr(second, table)) == 2
    # Terms and sums of both runs are those of an index of everything.
    from lumenseek.operators.bm25 import build_bm25

    whole, kept = build_bm25(engine.store.chunks(), "chunk_id"), engine._words(second)
    rows = lambda ix: sorted((r.term, r.df, round(r.idf, 9)) for r in ix.terms.collect())
    assert rows(kept) == rows(whole) and kept.corpus.select("n", "len", "avgdl").first() == whole.corpus.select("n", "len", "avgdl").first()
    assert kept.postings.count() == whole.postings_of().count()


def test_many_parts_become_one(spark, folder, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "PARTS", 1)
    engine = make(spark, tmp_path)
    engine.ingest(str(folder))
    (folder / "new.html").write_text("<p>Tidal plants use the moon.</p>")
    engine.ingest(str(folder))
    at = engine.store.manifest()
    assert [len(x) for x in (at.chunks, at.ledger, at.vectors, at.postings)] == [1, 1, 1, 1]
    hits = engine.search(engine.queries(["tidal moon"])).orderBy("rank").collect()
    assert "Tidal" in hits[0].text


def test_missing_ledger_discards_the_state_and_a_broken_one_is_refused(spark, folder, tmp_path):
    engine = make(spark, tmp_path)
    engine.ingest(str(folder))
    at = engine.store.manifest()
    engine.store.commit(type(at)(**{**vars(at), "vectors": []}))
    broken = make(spark, tmp_path)
    with pytest.raises(ValueError, match="no vectors"):
        broken.search(broken.queries(["x"]))
    engine.store.delete(at.ledger[0])
    assert engine.ingest(str(folder)).n_chunks == 2 and engine.health()["chunks"] == 2
    at = engine.store.manifest()
    extra = engine.store.write(spark.createDataFrame([("ghost", [0.0] * 256, 0)], "chunk_id string, embedding array<float>, cluster_id int"), "vectors")
    engine.store.commit(type(at)(**{**vars(at), "vectors": [*at.vectors, extra]}))
    with pytest.raises(ValueError, match="vectors without chunk"):
        make(spark, tmp_path).search(engine.queries(["x"]))


def test_refused_files_are_not_opened(spark, folder):
    from lumenseek.operators import skipping

    rows = files.list_files(spark, str(folder))
    early = skipping.skip_reason(F.col("name"), F.col("ext"), F.col("size"), F.lit(False), (), None, float("inf"))
    plan = rows.where(early.isNotNull()).select("path", early.alias("reason"))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]
    assert "content" not in files.with_file_columns(rows.where(early.isNull())).columns


def test_paths_with_a_scheme(spark, folder, tmp_path):
    assert files.check_root(f"file://{folder}", spark) == str(folder)
    names = {r.name for r in files.list_files(spark, f"file://{folder}").collect()}
    assert names == {"a.html", "b.HTM", "copy.html", "note.txt"}
    with pytest.raises(ValueError, match="no session"):
        files.check_root("hdfs://name/docs")


def test_pdf_rules_and_recognition_on_demand(spark, tmp_path):
    from lumenseek.sources.ocr import OcrExtractor, Recognizer

    root = tmp_path / "pdfs"
    root.mkdir()
    for name, content in (("ok.pdf", b"12"), ("long.pdf", b"1" * 9), ("form.pdf", b"form"), ("bad.pdf", b"broken")):
        (root / name).write_bytes(content)
    log = str(tmp_path / "log")

    class Page:
        width, height = 612, 792

        def __init__(self, layer):
            self.layer = layer

        def text(self):
            return self.layer

        def has_form(self):
            return "form" in self.layer

        def images(self):
            return []

        def render(self, dpi, clip):
            with open(log, "a") as f:
                f.write("x")
            if "fails" in self.layer:
                raise ValueError("page")
            return object()

    class Reader:
        def read(self, image):
            return ["a line that was recognised"]

    def open_pdf(content):
        if content == b"broken":
            raise ValueError("no header")
        layers = {b"form": ["form"], b"1" * 9: ["x"] * 9}.get(content, ["A text layer that is long enough to be used.", "short", "fails"])
        return [Page(t) for t in layers]

    extractor = OcrExtractor(Recognizer(Reader(), tile_px=2000), open_pdf, lambda c: None)
    engine = Engine(spark, str(tmp_path / "s"), Settings(max_pdf_pages=5), extractor=extractor)
    report = engine.ingest(str(root))
    assert {r.reason: r.n for r in report.skipped.collect()} == {"PDF with 9 pages": 1, "cannot open PDF": 1, "form-heavy PDF (has interactive fields)": 1}
    text = engine.store.chunks().first().text
    assert "used" in text and text.endswith("recognised") and open(log).read() == "xx"  # the page that fails is left out
    lenient = Engine(spark, str(tmp_path / "s2"), Settings(max_pdf_pages=9, skip_form_pdfs=False), extractor=extractor)
    assert {r.reason for r in lenient.ingest(str(root)).skipped.collect()} == {"cannot open PDF"}


def test_errors_say_why_and_are_of_the_last_run(spark, tmp_path):
    class Pages:
        """A PDF reader's extractor: counts what is rendered."""

        def __init__(self, log):
            self.log = log

        def pages(self, content):
            def rendered():
                with open(self.log, "a") as f:
                    f.write("x")
                return "Text that was read from a rendered page."

            yield "A text layer that is long enough to be used as it is.", lambda: 1 / 0, lambda: 1 / 0
            yield "short", lambda: " ", rendered
            yield "short", lambda: [][0], rendered  # IndexError is no ValueError: the file fails

        def image(self, content):
            return ""

        def inspect(self, content):
            if content == b"broken":
                raise ValueError("no header")
            return len(content), content.startswith(b"form")

    root, log = tmp_path / "p", str(tmp_path / "log")
    root.mkdir()
    (root / "a.pdf").write_bytes(b"12")
    (root / "b.html").write_text("<p>A page with some words on it.</p>")
    engine = Engine(spark, str(tmp_path / "s"), Settings(), extractor=Pages(log))
    row = engine.ingest(str(root)).errors.first()
    assert row.error == "IndexError" and "out of range" in row.message and "Traceback" in row.traceback and open(log).read() == "x"
    (root / "a.pdf").unlink()
    assert engine.ingest(str(root)).errors.count() == 0 == spark.read.parquet(str(tmp_path / "s" / "errors")).count()


def test_reranker_and_what_happens_when_it_fails(spark, folder, tmp_path):
    class Shortest:
        def score(self, query, text):
            return [-float(len(t)) for t in text]

    class Failing:
        def score(self, query, text):
            raise RuntimeError("no model")

    engine = make(spark, tmp_path, default_top_k=1, enable_query_expansion=False)
    engine.ingest(str(folder))
    asked = engine.queries(["steady wind on coasts"])
    plain = engine.search(asked).collect()
    assert len(plain) == 1 and "turbines" in plain[0].text
    engine.reranker = Shortest()
    hits = engine.search(asked).collect()
    assert len(hits) == 1 and "Panels" in hits[0].text and hits[0].score == -len(hits[0].text)
    engine.reranker = Failing()
    kept = engine.search(asked).orderBy("rank").collect()
    assert [h["rank"] for h in kept] == [1, 2] and "turbines" in kept[0].text and kept[0].score == kept[0].fused_score
    found = [r.hit for r in engine.search_json(asked).collect()]
    assert len(found) == 2 and all("null" not in h for h in found)


def test_settings_reach_model_and_embedder(spark, folder, tmp_path):
    s = Settings(temperature=0.3, top_p=0.5, max_tokens=77, request_timeout=9)
    model = HttpModel("http://127.0.0.1:9", "m", options={"seed": 1})
    Engine(spark, str(tmp_path / "x"), s, model=model)
    assert model.timeout == 9.0 and model.options == {"temperature": 0.3, "top_p": 0.5, "num_predict": 77, "seed": 1}

    class Small:
        dim = 4

        def encode(self, texts):
            if len(texts) > 2:
                raise MemoryError
            return [[float(len(texts)), 0.0, 0.0, 0.0]] * len(texts)

    rows = spark.createDataFrame([(i, "t") for i in range(9)], "i int, t string").coalesce(1)
    assert embed(rows, "t", Small(), batch=9, divisor=5).count() == 9

    class Raising:
        def is_available(self):
            return True

        def generate(self, prompt):
            raise ConnectionError("gone")

    engine = make(spark, tmp_path)
    engine.model = Raising()
    engine.ingest(str(folder))
    assert [r.variant for r in engine.expand(engine.queries(["wind"])).collect()] == ["wind"]
    assert engine.answer(["wind"])[0]["answer"].startswith("Warning:")


def test_plot_of_more_chunks_than_points(spark, tmp_path):
    engine = make(spark, tmp_path, chunk_size=400, chunk_overlap=0, enable_hybrid_search=False)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    n = engine.ingest_table(docs, F.col("source"), F.col("text"))
    rows = engine.visualize("a question", "pca", 2, max_points=50).collect()
    assert n > 100 and len(rows) == 50 and rows[0].is_query
    places = sorted(r.id for r in rows[1:])
    assert places[0] == 0 and places[-1] == n - 1 and max(b - a for a, b in zip(places, places[1:], strict=False)) <= n / 48 + 1
    assert all(r.chunk_idx >= 0 and r.source and r.key for r in rows[1:])
    with pytest.raises(ValueError):
        engine.visualize("q", "pca", 2, max_points=0)


def test_commands(spark, folder, tmp_path, capsys, monkeypatch):
    import io

    from lumenseek import cli

    state = ["--state", str(tmp_path / "cli")]
    assert cli.main([*state, "health"], spark) == 0 and '"loaded": false' in capsys.readouterr().out
    assert cli.main([*state, "ask", "x"], spark) == 1 and "FileNotFoundError" in capsys.readouterr().err
    assert cli.main([*state, "ingest", str(folder), "--no-recurse", "--verbose"], spark) == 0
    out = capsys.readouterr().out
    assert "processed: 1" in out and "new chunks: 1" in out and "incompatible file type: 1" in out
    assert cli.main([*state, "ingest", str(folder), "--fresh", "--filetypes", "htm"], spark) == 0
    capsys.readouterr()
    monkeypatch.setattr("sys.stdin", io.StringIO("where do wind turbines stand\n\n"))
    assert cli.main([*state, "ask", "--json"], spark) == 0
    assert "b.HTM" in capsys.readouterr().out
    assert cli.main([*state, "ingest", str(tmp_path / "none")], spark) == 1


def test_missing_sample_warns(tmp_path):
    with pytest.warns(UserWarning, match="defaults hold"):
        assert load_settings(tmp_path / "a.toml", tmp_path / "b.toml") == Settings()


def test_ledger_of_another_encoding(spark, tmp_path):
    (tmp_path / "l.txt").write_bytes("h1|früh.pdf\r\nh2|b\n".encode("cp1252"))
    assert sorted(map(tuple, store.read_ledger_text(spark, str(tmp_path / "l.txt")).collect())) == [("h1", "früh.pdf"), ("h2", "b")]


def test_session_settings(spark):
    from lumenseek.plans.session import SETTINGS, session

    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    try:
        got = session(spark__sql__shuffle__partitions=spark.conf.get("spark.sql.shuffle.partitions"))
        assert got.sparkContext is spark.sparkContext and all(got.conf.get(k) == v for k, v in SETTINGS.items())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
