"""The engine: ingest a folder or a table, then search, answer and plot over what is stored.

A search is one plan for any number of queries: variants, dense scores, keyword scores, fusion, reranking;
texts join last, for the hits alone. Ingestion adds to what is stored: rules that need names alone come before
any byte is read, files that have not changed are not opened, new ones are opened by the tasks that hash them and
take their texts, and only new texts are chunked, embedded and counted. Deletion adds tombstones.
"""

from __future__ import annotations

import os
import warnings
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Settings, looks_like_path
from ..functions.text import basename, file_type, parse_expansions, parse_extensions
from ..operators import chunking, context, ledger, retrieval, skipping
from ..operators.bm25 import Bm25Index, bm25_search, build_bm25, moved_counts, shape_mean
from ..operators.vector_index import VectorIndex, needs_retraining, trainable, write_vectors
from ..operators.visualize import visualize
from ..providers import Embedder, ExtractiveModel, HashingEmbedder, LanguageModel, Reranker, TextExtractor, embed, for_purpose, generate_column, rerank_column
from ..sources import files, store, walk
from ..streaming import ingest

NEEDED = "query_id long, query string"
#: Share of dead chunks from which all tables are written anew.
DEAD = 0.2


class NothingIngested(RuntimeError):
    """No file gave a chunk."""


class StaleEntries(RuntimeError):
    """The ledger has files that are gone."""


@dataclass
class IngestReport:
    """Tables about a run: counters (one row), skipped (reason, n), errors (path, error)."""

    counters: DataFrame
    skipped: DataFrame
    errors: DataFrame
    n_chunks: int


@dataclass
class Engine:
    spark: SparkSession
    root: str
    settings: Settings = field(default_factory=Settings)
    embedder: Embedder = field(default_factory=HashingEmbedder)
    extractor: TextExtractor | None = None
    model: LanguageModel = field(default_factory=ExtractiveModel)
    reranker: Reranker | None = None
    progress: Callable[[str, int], object] | None = None  # told each step of an ingestion, and its rows

    def __post_init__(self):
        self.store = store.Store(self.spark, self.root)
        self._checked = 0
        for provider in (self.model, self.extractor):
            if hasattr(provider, "configure"):  # limits and options from the settings
                provider.configure(self.settings)

    # Ingestion

    def ingest(self, folder: str, recurse: bool = True, filetypes: str | None = None, fresh: bool = False, on_stale: str = "append") -> IngestReport:
        """Reads new files of a folder. ``on_stale`` (fail, fresh, clean, append): what to do about ledger rows
        whose files are gone. A state whose ledger is missing is discarded."""
        files.check_root(folder, self.spark)
        before = self.store.manifest()
        if fresh or (before and not all(self.store.exists(p) for p in before.ledger)):
            self.store.reset()
        self.store.delete("errors")
        return self._ingest(folder, files.find_files(self.spark, folder, recurse), filetypes, on_stale)

    def _ingest(self, folder: str, listing: DataFrame, filetypes: str | None = None, on_stale: str = "append", batch: tuple[str, int] | None = None) -> IngestReport:
        """Takes in what a listing (path, name, ext, size, modified) has of ``folder``."""
        s, st, wanted = self.settings, self.store, parse_extensions(filetypes, set(self.settings.extensions))
        allowed, work = sorted(wanted) if wanted else None, self.store.new_part("work")

        def kept(frame: DataFrame, name: str) -> DataFrame:
            frame.write.parquet(f"{self.root}/{work}/{name}")
            out = self.spark.read.parquet(f"{self.root}/{work}/{name}")
            if self.progress is not None:
                self.progress(name, out.count())  # from the files' footers
            return out

        # Rules by name and extension come first: what they refuse is never opened.
        early = skipping.skip_reason(F.col("name"), F.col("ext"), F.col("size"), F.lit(False), s.skip_files, allowed, float("inf"))
        listing = kept(listing.withColumn("early", early), "listing")
        at = st.manifest()
        # A file of known path, size and time is not opened again, nor is one that has no size.
        inspects = hasattr(self.extractor, "inspect")
        prints = st.prints(at).dropDuplicates(["path", "size", "modified"])
        met = listing.where("early is null").drop("early").join(prints, ["path", "size", "modified"], "left")
        unknown = F.col("file_hash").isNull() | (F.lit(inspects) & (F.col("ext") == ".pdf") & ~F.col("looked"))
        looked = kept(self._look(folder, met.where(unknown & F.col("size").isNotNull()).select("path", "ext", "size", "name", "modified")), "looked")
        rest = met.where(~unknown | F.col("size").isNull()).withColumn("unread", F.lit(None).cast("string"))
        listed = rest.unionByName(looked).withColumn("file_type", file_type(F.col("path")))
        known = st.ledger(at)
        drop = None
        if on_stale != "append":
            stale = kept(ledger.stale_entries(known, listed.where("file_hash is not null")), "stale")
            if not stale.isEmpty():
                if on_stale == "fail":
                    raise StaleEntries(f"{stale.count()} ledger entries without a file")
                if on_stale == "fresh":
                    st.reset()
                    at, known = None, st.ledger()
                else:
                    drop = stale
        seen = {c: F.col(c) for c in ("openable", "pages", "has_form", "why")} if inspects else {}
        reason = skipping.skip_reason(
            F.col("name"), F.col("ext"), F.col("size"), F.col("seen"), s.skip_files, allowed, s.max_file_mb, max_pages=s.max_pdf_pages, skip_forms=s.skip_form_pdfs, **seen)
        judged = kept(ledger.mark_seen(listed, known).withColumn("reason", reason).select("path", "ext", "size", "file_hash", "file_type", "pages", "reason", "unread"), "judged")
        new = judged.where("reason is null and file_hash is not null").groupBy("file_hash").agg(F.min_by(F.struct("path", "ext", "size", "file_type", "pages"), "path").alias("f")).select("f.path", "f.ext", "f.size", "file_hash", "f.file_type", "f.pages")
        taken = kept(self._extract(folder, new).select("path", "file_hash", "file_type", "text", "error", "message", "traceback"), "taken")
        texts = taken.where("error is null").select(F.col("path").alias("source"), "file_hash", "file_type", "text")
        n = self._write(texts, drop, looked.where("file_hash is not null"), batch)
        failed = taken.where("error is not null").select("path", "error", "message", "traceback")
        nothing = F.lit(None).cast("string")
        unread = judged.where("reason is null and unread is not null").select("path", F.col("unread").alias("error"), nothing.alias("message"), nothing.alias("traceback"))
        failed.unionByName(unread).withColumn("at", F.current_timestamp()).write.mode("overwrite").parquet(f"{self.root}/errors")
        # All copies of a failed file count as failed.
        hashes = taken.where("error is not null").select("file_hash", F.col("error").alias("failure"))
        outcome = judged.join(hashes, "file_hash", "left").select("path", "reason", F.coalesce("failure", F.when(F.col("reason").isNull(), F.col("unread"))).alias("failure")).unionByName(
            listing.where("early is not null").select("path", F.col("early").alias("reason"), F.lit(None).cast("string").alias("failure")))
        # Reports are a row, and a row for each kind of reason: they outlive the tables that they count.
        local = lambda frame: self.spark.createDataFrame(frame.toArrow())
        report = IngestReport(
            local(skipping.run_counters(outcome, failed=F.col("failure").isNotNull())),
            local(skipping.skip_breakdown(outcome.select(F.coalesce("reason", "failure").alias("reason")))), self.spark.read.parquet(f"{self.root}/errors"), n,
        )
        st.delete(work)
        if not n and batch is None and not ((after := st.manifest()) and after.ledger):
            raise NothingIngested(folder)
        return report

    def _look(self, folder: str, wanted: DataFrame) -> DataFrame:
        """Files (path, ext, size, ...) with their hashes and what rules ask of PDFs."""
        if walk.opens(folder):
            return files.look_at(wanted, self.extractor)
        read = files.list_files(self.spark, folder).select("path", "content").join(wanted, "path")
        found = files.with_file_columns(read, self.extractor).drop("file_type")
        lacking = {"openable": "boolean", "pages": "int", "has_form": "boolean", "why": "string"}
        for name, kind in lacking.items():
            found = found if name in found.columns else found.withColumn(name, F.lit(None).cast(kind))
        return found.withColumn("looked", F.lit(hasattr(self.extractor, "inspect"))).withColumn("unread", F.lit(None).cast("string"))

    def _extract(self, folder: str, wanted: DataFrame) -> DataFrame:
        """Files (path, ext, size, ...) with their texts."""
        if walk.opens(folder):
            return files.extract_paths(wanted, self.extractor)
        return files.extract_text(files.list_files(self.spark, folder).select("path", "content").join(wanted, "path"), self.extractor)

    def ingest_table(self, docs: DataFrame, source: Column, text: Column, batch: tuple[str, int] | None = None) -> int:
        """Chunks of a table's new texts; returns how many. ``batch``: name of a stream and number of its batch; one that is
        stored already is left out."""
        at = self.store.manifest()
        if batch and at and at.batches.get(batch[0], -1) >= batch[1]:
            return 0
        rows = docs.select(source.cast("string").alias("source"), F.sha2(F.encode(text, "UTF-8"), 256).alias("file_hash"), F.lit("unknown").alias("file_type"), text.alias("text"))
        new = ledger.new_files(rows.where("text is not null"), self.store.ledger(at)).groupBy("file_hash").agg(F.min("source").alias("source"), F.first("file_type").alias("file_type"), F.first("text").alias("text"))
        return self._write(new, None, None, batch)

    def ingest_stream(self, stream: DataFrame, checkpoint: str, source: Column, text: Column, name: str = "stream", once: bool = True) -> StreamingQuery:
        """Takes a streaming frame's new texts batch by batch. A batch and its number are stored in one commit, so a batch
        that is repeated after a failure adds nothing; texts that the ledger knows are left out, without a state store.
        ``once``: what has arrived, then it stops; else it runs on."""
        return ingest.into(stream, lambda rows, number: self.ingest_table(rows, source, text, (name, number)), checkpoint, once)

    def watch(self, folder: str, checkpoint: str, recurse: bool = True, filetypes: str | None = None, name: str = "files", once: bool = True) -> StreamingQuery:
        """Takes the files that arrive in a folder, as :meth:`ingest` does, batch by batch. Files are listed by the stream and
        opened once for their hash and once for their text. What is gone from the folder stays in the state."""
        files.check_root(folder, self.spark)

        def take(rows: DataFrame, number: int) -> None:
            at = self.store.manifest()
            if at is None or at.batches.get(name, -1) < number:
                self._ingest(folder, rows, filetypes, batch=(name, number))

        return ingest.into(files.arriving(self.spark, folder, recurse), take, checkpoint, once)

    def forget(self, hashes: DataFrame) -> int:
        """Deletes the files with these hashes (file_hash) from the state; how many chunks that are. Nothing is rewritten:
        tombstones name what is dead, and its words are taken off the counts of terms."""
        old = self.store.manifest()
        if old is None:
            return 0
        drop = self.store.ledger(old).join(hashes.select("file_hash").distinct(), "file_hash", "left_semi")
        state = self._without(old, drop)
        if state is not old:
            self.store.commit(self._compacted(state))
        return state.n_dead - old.n_dead

    def compact(self) -> None:
        """Writes all tables anew as one part each, without what is dead."""
        if at := self.store.manifest():
            self.store.commit(self._compacted(at, always=True))

    def _write(self, texts: DataFrame, drop: DataFrame | None, looked: DataFrame | None = None, batch: tuple[str, int] | None = None) -> int:
        """Adds texts (source, file_hash, file_type, text) to the state, and what is known of files; returns how many chunks
        the texts have. All of it is one commit."""
        s, st, old = self.settings, self.store, self.store.manifest() or store.Manifest()
        epoch = F.lit(old.number + 1).cast("long").alias("epoch")
        cut = chunking.recursive_chunks if s.enable_semantic_chunking else chunking.fixed_chunks
        pieces = cut(texts, s.chunk_size, s.chunk_overlap, "file_hash", keep=["source", "file_type"])
        # 128 bits name a chunk, whatever the size of the corpus.
        key = F.substring(F.sha2(F.concat_ws(":", "file_hash", "chunk_index"), 256), 1, 32)
        new = pieces.select(key.alias("chunk_id"), "source", "chunk_index", "text", "file_hash", F.current_timestamp().alias("created_at"), "file_type", "total_chunks", epoch)
        state = old if drop is None else self._without(old, drop)
        part = st.write(new, "chunks")
        chunks = store.read_chunks(self.spark, f"{st.root}/{part}")
        n = chunks.count()
        added = st.write(texts.select("file_hash", basename(F.col("source")).alias("filename"), epoch), "ledger")
        if not st.read([added], store.LEDGER).isEmpty():
            state = replace(state, ledger=[*state.ledger, added])
        if looked is not None and not looked.isEmpty():
            names = [f.split()[0] for f in store.PRINTS.split(", ")]
            state = replace(state, prints=[*state.prints, st.write(looked.select(*names), "prints")])
        if batch:
            state = replace(state, batches={**state.batches, batch[0]: batch[1]})
        if state is old or not (n or batch or old.number):
            return 0  # nothing that a reader could miss
        if n:
            state = replace(state, chunks=[*state.chunks, part])
            vectors = st.write(embed(chunks.select("chunk_id", "text"), "text", self.embedder, batch=s.batch_size, divisor=s.batch_size_retry_divisor).select("chunk_id", "embedding"), "work")
            state = self._with_vectors(state, self.spark.read.parquet(f"{st.root}/{vectors}"), n, epoch)
            st.delete(vectors)
            if s.enable_hybrid_search:
                state = self._with_words(state, chunks, epoch)
            state = replace(state, n_chunks=state.n_chunks + n)
        st.commit(self._compacted(state))
        if self.progress is not None:
            self.progress("stored", n)
        return n

    def _with_vectors(self, state: store.Manifest, new: DataFrame, n: int, epoch: Column) -> store.Manifest:
        """The vector table with ``n`` more rows: assigned to its lists, or all anew where centroids are fitted."""
        s, st, present = self.settings, self.store, self._index(state)
        if present is not None:
            train = needs_retraining(True, state.n_chunks, n) if present.trained else s.index_type == "ivf" and trainable(state.n_chunks + n, s.nlist)
            if not train:
                part = st.new_part("vectors")
                write_vectors(present.assign(new).withColumn("epoch", epoch), present.trained, f"{st.root}/{part}")
                return replace(state, vectors=[*state.vectors, part])
            index = present.retrained(new) if present.trained else VectorIndex.build(present.vectors.select("chunk_id", "embedding").unionByName(new), s.index_type, s.nlist, n=state.n_chunks + n)
        else:
            index = VectorIndex.build(new, s.index_type, s.nlist, n=n)
        part = st.new_part("vectors")
        write_vectors(index.vectors.withColumn("epoch", epoch), index.trained, f"{st.root}/{part}")
        return replace(state, vectors=[part], centroids=st.write(index.centroids, "centroids") if index.trained else None)

    def _with_words(self, state: store.Manifest, chunks: DataFrame, epoch: Column | None, sign: int = 1) -> store.Manifest:
        """Postings of more chunks beside the old ones, and their counts of terms; with sign -1 and no epoch, counts taken
        off. Of the old counts only those of the same terms are read."""
        st, new = self.store, build_bm25(chunks, "chunk_id")
        if epoch is not None:
            part = st.new_part("postings")
            new.save_postings(f"{st.root}/{part}", epoch)
            state = replace(state, postings=[*state.postings, part])
        counts = st.write(new.counts().select("term", (F.col("df") * sign).alias("df")), "terms")
        delta, old = st.read([counts]), st.read(state.terms) if state.terms else None
        shape = st.write(moved_counts(st.read([state.shape]) if state.shape else None, old, delta), "shapes")
        n, length = (have + sign * more for have, more in zip((state.words.get("n", 0), state.words.get("len", 0)), new.sums(), strict=True))
        return replace(state, terms=[*state.terms, counts], shape=shape, words={"n": n, "len": length, "mean": shape_mean(st.read([shape]), n)})

    def _without(self, state: store.Manifest, drop: DataFrame) -> store.Manifest:
        """The state without the rows of some files: tombstones, and fewer counts of terms."""
        st, hashes = self.store, drop.select("file_hash").distinct()
        gone = st.chunks(state).join(hashes, "file_hash", "left_semi").select("file_hash", "chunk_id", "text")
        dead = self.spark.read.parquet(f"{st.root}/{(work := st.write(gone, 'work'))}")
        last = F.lit(state.number).cast("long").alias("epoch")
        tombs = hashes.select("file_hash", F.lit(None).cast("string").alias("chunk_id"), last).unionByName(dead.select("file_hash", "chunk_id", last))
        part, n = st.write(tombs, "tombs"), dead.count()
        if n and state.terms:
            state = self._with_words(state, dead, None, -1)
        elif st.read([part], store.TOMBS).isEmpty():
            return state
        st.delete(work)
        return replace(state, tombs=[*state.tombs, part], n_chunks=state.n_chunks - n, n_dead=state.n_dead + n)

    def _compacted(self, state: store.Manifest, always: bool = False) -> store.Manifest:
        """Tables of many parts as one. All are written anew, without what is dead, where that is more than ``DEAD`` of them,
        or named by many parts."""
        st, last = self.store, F.lit(state.number + 1).cast("long").alias("epoch")
        whole = always or len(state.tombs) > store.PARTS or state.n_dead > DEAD * (state.n_chunks + state.n_dead)
        due = lambda table: getattr(state, table) and (whole or len(getattr(state, table)) > store.PARTS)
        out = state
        if due("chunks"):
            out = replace(out, chunks=[st.write(st.chunks(state).withColumn("epoch", last), "chunks")])
        if due("ledger"):
            out = replace(out, ledger=[st.write(st.ledger(state).withColumn("epoch", last), "ledger")])
        if due("postings"):
            rows = st.living(st.read(state.postings), state, "chunk_id", "id").withColumn("epoch", last)
            out = replace(out, postings=[st.write(rows.repartitionByRange("term").sortWithinPartitions("term"), "postings")])
        if due("terms"):
            out = replace(out, terms=[st.write(st.read(state.terms).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0"), "terms")])
        if due("prints"):  # of each path the latest
            out = replace(out, prints=[st.write(st.prints(state).groupBy("path").agg(F.max_by(F.struct("*"), F.struct("modified", "looked")).alias("p")).select("p.*"), "prints")])
        if due("vectors"):
            index, part = self._index(state), st.new_part("vectors")
            write_vectors(index.vectors.withColumn("epoch", last), index.trained, f"{st.root}/{part}")
            out = replace(out, vectors=[part])
        return replace(out, tombs=[], n_dead=0) if whole else out

    def _index(self, state: store.Manifest) -> VectorIndex | None:
        if not state.vectors:
            return None
        vectors = self.store.living(self.store.read_each(state.vectors), state, "chunk_id")
        if "cluster_id" not in vectors.columns:
            vectors = vectors.withColumn("cluster_id", F.lit(0))
        return VectorIndex(vectors, self.store.read([state.centroids]) if state.centroids else None, self.settings.nlist)

    def _words(self, state: store.Manifest) -> Bm25Index | None:
        """The keyword index; None, and a warning, if it can't be read: search is dense only then."""
        if not state.postings or not state.terms:
            return None
        try:
            postings, counts = self.store.read(state.postings), self.store.read(state.terms)
        except (PySparkException, Py4JJavaError) as e:
            warnings.warn(f"keyword index can't be read; dense search only: {str(e)[:200]}", stacklevel=2)
            return None
        return Bm25Index.counted(self.store.living(postings, state, "chunk_id", "id"), counts, state.words["n"], state.words["len"], state.words["mean"])

    # Retrieval

    def _state(self) -> tuple[store.Manifest, DataFrame, VectorIndex]:
        """What is stored. A state is checked when it is first used: every chunk has a vector, and the other way round."""
        at = self.store.manifest()
        if at is None or not at.chunks:
            raise FileNotFoundError(f"nothing is ingested at {self.root}")
        chunks, index = self.store.chunks(at), self._index(at)
        if index is None:
            raise ValueError(f"no vectors at {self.root}: ingest again")
        if self._checked != at.number:
            row = store.consistency(chunks, index.vectors).first()
            if row.chunks_without_vector or row.vectors_without_chunk:
                raise ValueError(f"{row.chunks_without_vector} chunks without vector, {row.vectors_without_chunk} vectors without chunk: ingest again")
            self._checked = at.number
        return at, chunks, index

    def validate(self) -> None:
        """Settings against what is stored: local model paths exist, indexes are there."""
        if looks_like_path(self.settings.embed_model) and not os.path.exists(os.path.expanduser(self.settings.embed_model)):
            raise FileNotFoundError(self.settings.embed_model)
        at, _, _ = self._state()
        if self.settings.enable_hybrid_search and self._words(at) is None:
            raise FileNotFoundError(f"no keyword index at {self.root}")

    def queries(self, texts: Iterable[str]) -> DataFrame:
        """query_id, query of the texts that are not blank."""
        return self.spark.createDataFrame([(i, t) for i, t in enumerate(texts) if t.strip()], NEEDED)

    def expand(self, queries: DataFrame) -> DataFrame:
        """query_id, variant_no, variant: what a user asks, and variants of it from the model, which is asked where the
        queries are. An unavailable or failing model, or no usable answer, leaves the query alone."""
        s = self.settings
        if not s.enable_query_expansion or isinstance(self.model, ExtractiveModel) or not self._available():
            return retrieval.query_variants(queries.withColumn("variants", F.lit(None).cast("array<string>")), 0)
        prompt = F.concat(F.lit(f"Write {s.query_expansion_count} different ways to ask, one a line:\n"), "query")
        rows = queries.withColumn("answer", generate_column(for_purpose(self.model, "expansion"), prompt, s.model_calls))
        rows = rows.withColumn("variants", F.when(F.col("answer").startswith("Warning:"), F.array().cast("array<string>")).otherwise(parse_expansions(F.col("answer"), s.query_expansion_count)))
        # Written, as a model may answer differently when it is asked again; a vacuum deletes it.
        return self.store.read([self.store.write(retrieval.query_variants(rows, s.query_expansion_count), "work")], "query_id long, variant_no int, variant string")

    def _available(self) -> bool:
        try:
            return self.model.is_available()
        except Exception as e:
            warnings.warn(f"the language model failed: {e}", stacklevel=2)
            return False

    def dense_search(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        """Dense hits alone: query_id, rank, chunk_id, score and the chunk."""
        _, chunks, index = self._state()
        single = queries.where(F.length(F.trim("query")) > 0).select("query_id", F.lit(0).alias("variant_no"), F.col("query").alias("variant"))
        hits = index.search(embed(single, "variant", self.embedder), self.settings.top_k(k), self.settings.nprobe)
        return retrieval.with_rows(hits, chunks, single)

    def search(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        """The full plan. Without reranking all merged hits stay."""
        s, (at, chunks, index) = self.settings, self._state()
        asked = queries.where(F.length(F.trim("query")) > 0)
        width = s.rerank_top_k if s.enable_reranking else s.top_k(k)
        vectors = embed(self.expand(asked), "variant", self.embedder)
        hits = index.search(vectors, width, s.nprobe).withColumn("faiss_score", F.col("score"))
        words = self._words(at) if s.enable_hybrid_search else None
        if words is not None:
            fused = retrieval.hybrid(hits.drop("faiss_score"), bm25_search(words, asked, width), asked, s.hybrid_alpha)
            hits = fused.select("query_id", "chunk_id", F.col("fused_score").alias("score"), F.col("dense_score").alias("faiss_score"), "bm25_score", "fused_score", "rank")
        full = retrieval.with_rows(hits, chunks, asked).join(asked.select("query_id", "query"), "query_id")
        if not s.enable_reranking:
            return full
        return retrieval.rerank(full, s.top_k(k), None if self.reranker is None else rerank_column(self.reranker))

    def answers(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        """query_id, query, answer and sources (array of source, chunk_index, total_chunks, score, in rank order) of any
        number of queries (query_id, query); the model is asked where the prompts are."""
        hits = self.search(queries, k)
        prompts = context.build_prompt(context.build_context(hits), queries)
        source = F.struct("rank", "source", "chunk_index", "total_chunks", "score")
        named = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(source)).alias("sources"))
        said = prompts.select("query_id", generate_column(self.model, F.col("prompt"), self.settings.model_calls).alias("answer"))
        out = queries.select("query_id", "query").join(said, "query_id", "left").join(named, "query_id", "left")
        return out.withColumn("answer", F.coalesce("answer", F.lit(context.NO_ANSWER)))

    def answer(self, texts: Iterable[str], k: int | None = None) -> list[dict]:
        """Answer and sources of each question, in order."""
        said = self.answers(self.queries(texts), k).orderBy("query_id").collect()
        line = lambda r: f"{r.source} (chunk {r.chunk_index + 1}/{r.total_chunks}, score {r.score:.3f})"
        return [{"query": r.query, "answer": r.answer, "sources": [line(x) for x in r.sources or []]} for r in said]

    def search_json(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        """query_id, rank, hit: each hit as a JSON object, without what it doesn't have."""
        hits = self.search(queries, k)
        return hits.select("query_id", "rank", F.to_json(F.struct(*[c for c in hits.columns if c != "query_id"])).alias("hit"))

    def health(self) -> dict:
        """Whether anything is loaded, how much, and by which index."""
        if not (at := self.store.manifest()) or not at.chunks:
            return {"loaded": False, "chunks": 0, "sources": 0, "index": None}
        _, chunks, index = self._state()
        n, sources = chunks.agg(F.count("*"), F.countDistinct("source")).first()
        return {"loaded": True, "chunks": n, "sources": sources, "index": "ivf" if index.trained else "flat"}

    def visualize(self, query: str, method: str = "umap", dims: int = 2, max_points: int = 1000, k: int | None = None) -> DataFrame:
        _, chunks, index = self._state()
        hits = self.dense_search(self.queries([query]), k).select("chunk_id", "score")
        vector = [float(x) for x in self.embedder.encode([query])[0]]
        return visualize(index.vectors, chunks, hits, vector, method, dims, max_points)
