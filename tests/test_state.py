"""What is stored over many runs: fingerprints, tombstones, vacuum, streams, concurrent commits."""

import os
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lumenseek.config import Settings
from lumenseek.operators.bm25 import build_bm25
from lumenseek.plans.engine import Engine
from lumenseek.sources import files, store, walk

SF = "/root/testdata/sf0.01"


def make(spark, tmp_path, name="state", **settings):
    return Engine(spark, str(tmp_path / name), Settings(**settings))


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "docs"
    for i in range(12):
        (root / f"d{i % 3}" / "deep").mkdir(parents=True, exist_ok=True)
        (root / f"d{i % 3}" / "deep" / f"p{i}.html").write_text(f"<p>Page {i} speaks of subject{i} and of wind.</p>")
    (root / "d0" / "node_modules" / "x").mkdir(parents=True)
    (root / "d0" / "node_modules" / "x" / "hidden.html").write_text("<p>never read</p>")
    return root


def size(path):
    return sum(p.stat().st_size for p in Path(path).rglob("*") if p.is_file() and not p.name.startswith("."))


def sameness(engine, spark):
    """The keyword index equals one of the living chunks; chunks, vectors and postings name each other."""
    at = engine.store.manifest()
    chunks, index, words = engine.store.chunks(), engine._index(at), engine._words(at)
    row = store.consistency(chunks, index.vectors).first()
    assert (row.chunks_without_vector, row.vectors_without_chunk) == (0, 0) and row.n_chunks == at.n_chunks
    whole = build_bm25(chunks, "chunk_id")
    rows = lambda ix: sorted((r.term, r.df, round(r.idf, 9)) for r in ix.terms.collect())
    assert rows(words) == rows(whole)
    sums = lambda ix: [round(x or 0, 9) for x in ix.corpus.select("n", "len", "avgdl", "mean_idf").first()]
    assert sums(words) == sums(whole)
    posts = lambda p: sorted(map(tuple, p.select("term", "id", "tf", "dl").collect()))
    assert posts(words.postings) == posts(whole.postings_of())


# Listing


def test_excluded_folders_are_not_entered(folder):
    visited, store_ = [], walk.store_of(str(folder))[0]

    def children(at):
        visited.append(os.path.basename(at))
        return walk._children(store_, at)

    found = list(walk.walk(str(folder), files.EXCLUDED_DIRS, children))
    assert len(found) == 12 and len(visited) == 7 and not {"node_modules", "x"} & set(visited)
    visited.clear()
    for spread in (1, 3, 4, 100):
        parts = walk.share_out(str(folder), files.EXCLUDED_DIRS, children, spread)
        every = [f for p, deep in parts for f in walk.walk(p, files.EXCLUDED_DIRS, children, deep)]
        assert sorted(every) == sorted(found) and "node_modules" not in visited
    assert len(parts) == 7 and not any(deep for _, deep in parts)


def test_listing_equals_spark_s_own(spark, folder):
    (folder / ".hidden.html").write_text("listed here, hidden from Spark's reader")
    os.symlink(folder, folder / "d1" / "loop")  # is not followed
    os.symlink(folder / "gone", folder / "d1" / "broken.html")
    columns = ["path", "name", "ext", "size", "modified"]
    own = {r.name: tuple(r) for r in files.find_files(spark, str(folder)).select(columns).collect()}
    assert own.pop(".hidden.html") and own.pop("broken.html")[3] is None
    os.unlink(folder / "d1" / "broken.html")
    os.unlink(folder / "d1" / "loop")
    assert own == {r.name: tuple(r) for r in files.list_files(spark, str(folder)).select(columns).collect()}
    assert files.find_files(spark, str(folder), recurse=False).count() == 1
    assert spark.read.format("lumenseek_walk").option("spread", 2).load(f"file://{folder}").count() == 14


def test_paths_and_stores(tmp_path):
    (tmp_path / "a b").write_bytes(b"x" * 10)
    for path in (f"{tmp_path}/a b", f"file:{tmp_path}/a b", f"file://{tmp_path}/a b"):
        assert walk.read_file(path) == b"x" * 10 and len(walk.file_sha256(path)) == 64
        assert walk.store_of(path)[2] == "file:"
    assert walk.opens("/x") and not walk.opens("viewfs://store/in")


# Fingerprints


def test_unchanged_files_are_not_opened(spark, folder, tmp_path):
    engine = make(spark, tmp_path)
    assert engine.ingest(str(folder)).n_chunks == 12
    before = engine.store.manifest()
    # Other bytes under the same path, size and time: only who opens the file could tell.
    for path in folder.rglob("*.html"):
        at, text = path.stat(), path.read_text()
        path.write_text(text[::-1])
        os.utime(path, ns=(at.st_atime_ns, at.st_mtime_ns))
    report = engine.ingest(str(folder))
    assert report.n_chunks == 0 and report.counters.first().already_processed == 12
    assert engine.store.manifest() == before  # nothing was written
    # A file that did change is opened, alone.
    (folder / "d1" / "deep" / "p1.html").write_text("<p>Another text about tides.</p>")
    assert engine.ingest(str(folder)).n_chunks == 1 and engine.store.prints().count() == 13
    engine.compact()
    assert engine.store.prints().count() == 12
    sameness(engine, spark)


def test_a_file_that_cannot_be_read_is_counted(spark, folder, tmp_path, monkeypatch):
    engine = make(spark, tmp_path)
    listing = files.find_files(spark, str(folder))
    gone = listing.limit(1).withColumn("path", F.lit(f"file:{folder}/gone.html")).withColumn("name", F.lit("gone.html"))
    monkeypatch.setattr(files, "find_files", lambda *a, **k: listing.unionByName(gone))
    report = engine.ingest(str(folder))
    row = report.counters.first()
    assert (row.candidates, row.processed, row.failed) == (13, 12, 1) and report.n_chunks == 12
    assert [(r.path.endswith("gone.html"), r.error) for r in report.errors.collect()] == [(True, "FileNotFoundError")]


def test_stores_that_tasks_cannot_open_are_left_to_spark(spark, folder, tmp_path, monkeypatch):
    monkeypatch.setattr(walk, "opens", lambda path: False)
    engine = make(spark, tmp_path)
    assert engine.ingest(str(folder)).n_chunks == 12 and engine.ingest(str(folder)).n_chunks == 0
    sameness(engine, spark)


# Deletion


def test_deletion_writes_little_and_equals_a_fresh_build(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").dropDuplicates(["text"]).select("doc_id", "source", "text")
    engine = make(spark, tmp_path)
    engine.ingest_table(docs, F.col("doc_id"), F.col("text"))
    root, before = tmp_path / "state", engine.store.manifest()
    whole = size(root)
    victim = docs.where("doc_id = 7").select(F.sha2(F.encode("text", "UTF-8"), 256).alias("file_hash"))
    n = engine.forget(victim)
    assert n > 0 and size(root) - whole < 0.01 * whole
    after = engine.store.manifest()
    assert (after.chunks, after.vectors, after.postings) == (before.chunks, before.vectors, before.postings) and after.n_dead == n
    assert engine.forget(victim) == 0 and engine.store.manifest() == after
    fresh = make(spark, tmp_path, "fresh")
    fresh.ingest_table(docs.where("doc_id <> 7"), F.col("doc_id"), F.col("text"))
    asked = spark.createDataFrame([(i, r.text[:120]) for i, r in enumerate(docs.where("doc_id in (3, 7, 11)").orderBy("doc_id").collect())], "query_id long, query string")
    hits = lambda e: sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 9), round(r.bm25_score, 9)) for r in e.search(asked).collect())
    assert hits(engine) == hits(fresh)
    sameness(engine, spark)
    # What was deleted comes back, and stays when the tables are written anew.
    assert engine.ingest_table(docs, F.col("doc_id"), F.col("text")) == n
    sameness(engine, spark)
    engine.compact()
    at = engine.store.manifest()
    assert (at.tombs, at.n_dead, len(at.chunks), len(at.terms)) == ([], 0, 1, 1)
    sameness(engine, spark)


def test_stale_files_are_cleaned_and_many_dead_are_compacted(spark, folder, tmp_path):
    engine = make(spark, tmp_path)
    engine.ingest(str(folder))
    for i in (0, 1):
        os.unlink(folder / f"d{i}" / "deep" / f"p{i}.html")
    (folder / "new.html").write_text("<p>Tidal plants use the moon.</p>")
    assert engine.ingest(str(folder), on_stale="clean").n_chunks == 1
    at = engine.store.manifest()
    assert len(at.tombs) == 1 and (at.n_chunks, at.n_dead) == (11, 2)
    sameness(engine, spark)
    os.unlink(folder / "new.html")
    for i in (3, 4, 5):
        os.unlink(folder / f"d{i % 3}" / "deep" / f"p{i}.html")
    engine.ingest(str(folder), on_stale="clean")
    at = engine.store.manifest()
    assert (at.tombs, at.n_chunks, at.n_dead) == ([], 7, 0)
    sameness(engine, spark)


def test_deletion_from_inverted_lists(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").dropDuplicates(["text"])
    engine = make(spark, tmp_path, index_type="ivf", nlist=4, nprobe=4, enable_reranking=False)
    engine.ingest_table(docs, F.col("source"), F.col("text"))
    assert engine.health()["index"] == "ivf"
    text = docs.where("doc_id = 3").first().text
    found = lambda: {r.file_hash for r in engine.search(engine.queries([text[:150]])).collect()}
    victim = docs.where("doc_id = 3").select(F.sha2(F.encode("text", "UTF-8"), 256).alias("file_hash"))
    name = victim.first().file_hash
    assert name in found()
    engine.forget(victim)
    assert name not in found()
    sameness(engine, spark)


# Vacuum and commits


def test_vacuum_leaves_what_readers_and_runs_need(spark, folder, tmp_path):
    engine = make(spark, tmp_path)
    engine.ingest(str(folder))
    first = engine.store.manifest()
    (folder / "new.html").write_text("<p>Tidal plants use the moon.</p>")
    engine.ingest(str(folder))
    second = engine.store.manifest()
    engine.compact()  # replaces all parts
    left = engine.store.write(spark.range(3), "chunks")  # as a run leaves it that ended early
    reader = engine.store.chunks(second)
    assert engine.store.vacuum() == []  # all of it is young
    gone = engine.store.vacuum(retain=2, older_than_s=0)
    assert left in gone and f"manifests/manifest-{first.number}.json" in gone
    assert not engine.store.exists(left) and reader.count() == 13  # the former manifest's reader goes on
    assert engine.store.chunks(engine.store.manifest(second.number)).count() == 13
    gone = engine.store.vacuum(retain=1, older_than_s=0)
    assert set(second.chunks) <= set(gone) and engine.health()["chunks"] == 13
    sameness(engine, spark)
    named = engine.store.manifest().folders()
    assert {f"{t}/{p.name}" for t in store.TABLES for p in (tmp_path / "state" / t).glob("[!.]*")} == named
    assert engine.store.vacuum(retain=1, older_than_s=0) == []


def test_one_of_two_commits_wins(spark, tmp_path):
    at = store.Store(spark, str(tmp_path / "s"))
    first = at.commit(store.Manifest())
    at.commit(store.Manifest(**{**vars(first), "n_chunks": 5}))
    with pytest.raises(store.ConcurrentRun):
        at.commit(first)
    assert at.manifest().n_chunks == 5 and at.numbers() == [1, 2]
    assert not list((tmp_path / "s" / "manifests").glob(".[0-9a-f]*[0-9a-f]"))


# Streams


class Killed(RuntimeError):
    pass


def test_stream_is_killed_between_write_and_commit(spark, tmp_path, monkeypatch):
    schema, arrived, state = "doc_id long, text string", tmp_path / "in", str(tmp_path / "check")
    texts = [f"Text number {i} speaks of subject{i % 7} at some length." for i in range(9)]
    for k in range(3):
        spark.createDataFrame([(i, texts[i]) for i in range(3 * k, 3 * k + 3)] + [(99, texts[0])], schema).coalesce(1).write.mode("append").parquet(str(arrived))
    engine = make(spark, tmp_path)

    def run():
        frame = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(arrived))
        query = engine.ingest_stream(frame, state, F.col("doc_id"), F.col("text"))
        query.awaitTermination()

    real, calls = store.Store.commit, []

    def commit(self, at):
        calls.append(at.batches)
        if len(calls) == 2:  # parts are written, the manifest is not
            raise Killed("before the commit")
        out = real(self, at)
        if len(calls) == 4:  # the manifest is there, the stream's own log is not
            raise Killed("after the commit")
        return out

    monkeypatch.setattr(store.Store, "commit", commit)
    for why in ("before the commit", "after the commit"):
        with pytest.raises(Exception, match=why):
            run()
    run()
    found = [r.text for r in engine.store.chunks().collect()]
    assert sorted(found) == sorted(texts)  # each once
    assert [c["stream"] for c in calls] == [0, 1, 1, 2]  # the repeated batch 2 wrote nothing
    assert engine.store.manifest().batches == {"stream": 2}
    sameness(engine, spark)
    run()
    assert len(calls) == 4


def test_files_that_arrive(spark, folder, tmp_path):
    engine, state = make(spark, tmp_path), str(tmp_path / "check")
    engine.watch(str(folder), state).awaitTermination()
    assert engine.health()["chunks"] == 12
    (folder / "late.html").write_text("<p>Tidal plants use the moon.</p>")
    shutil.copy(folder / "late.html", folder / "copy.html")
    engine.watch(str(folder), state).awaitTermination()
    assert engine.health()["chunks"] == 13 and engine.store.manifest().batches == {"files": 1}
    assert engine.ingest(str(folder)).counters.first().already_processed == 14
    sameness(engine, spark)


def test_commands_on_the_state(spark, folder, tmp_path, capsys, monkeypatch):
    import io

    from lumenseek import cli

    state = ["--state", str(tmp_path / "cli")]
    assert cli.main([*state, "ingest", str(folder), "--verbose"], spark) == 0
    steps = [line.split(":")[0].strip() for line in capsys.readouterr().err.splitlines() if line.startswith("  ")]
    assert steps == ["listing", "looked", "judged", "taken", "stored"]
    monkeypatch.setattr("sys.stdin", io.StringIO("which page speaks of subject3\n\nQuit\nnever asked\n"))
    assert cli.main([*state, "ask", "--json"], spark) == 0
    assert len(capsys.readouterr().out.splitlines()) == 1
    (folder / "late.html").write_text("<p>Tidal plants use the moon.</p>")
    assert cli.main([*state, "watch", str(folder), "--checkpoint", str(tmp_path / "check")], spark) == 0
    assert '"chunks": 13' in capsys.readouterr().out
    assert cli.main([*state, "compact"], spark) == 0 and cli.main([*state, "vacuum", "--retain", "1", "--hours", "0"], spark) == 0
    assert "deleted: " in capsys.readouterr().out
    assert cli.main([*state, "health"], spark) == 0 and '"chunks": 13' in capsys.readouterr().out
