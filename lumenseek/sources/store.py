"""The stored state: chunks, vectors, keyword index and ledger, as folders of rows named by a manifest.

A run adds folders (parts) to the tables and then a manifest with the next number, which lists all parts; the
manifest with the largest number is the state. So a run writes what is new, readers never see tables of
different runs, and a run that ends early leaves only folders that no manifest names. Tables of many small
parts are written anew as one (``PARTS``). Rows carry keys; nothing depends on positions.

Rows also carry the number of the manifest that they came with (``epoch``). What is deleted is named by tombstones
(file_hash, chunk_id, epoch): a row is dead if a tombstone of its key has its epoch or a later one, so content that comes
back after it was deleted lives. Tables leave dead rows out when they are read, and lose them when they are written anew.
"""

from __future__ import annotations

import json
import os
import re
import time
import uuid
from dataclasses import dataclass, field
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNKS = T.StructType([
    T.StructField("chunk_id", T.StringType()), T.StructField("source", T.StringType()), T.StructField("chunk_index", T.IntegerType()),
    T.StructField("text", T.StringType()), T.StructField("file_hash", T.StringType()), T.StructField("created_at", T.TimestampType()),
    T.StructField("file_type", T.StringType()), T.StructField("total_chunks", T.IntegerType()),
])
LEDGER = "file_hash string, filename string"
TOMBS = "file_hash string, chunk_id string, epoch long"
#: What is known of a file without opening it again: a file of the same path, size and time is taken to be the same.
PRINTS = "path string, size long, modified timestamp, file_hash string, openable boolean, pages int, has_form boolean, why string, looked boolean"
#: Parts of a table, beyond which the next run writes it as one.
PARTS = 32
_NUMBER = re.compile(r"manifest-(\d+)\.json")


TABLES = ("chunks", "ledger", "vectors", "postings", "centroids", "terms", "shapes", "tombs", "prints")
#: Manifests that stay readable, and how old a folder must be that none of them names, before a vacuum deletes it.
RETAINED, AGE_S = 2, 86_400.0


class ConcurrentRun(RuntimeError):
    """Another run has committed since this one began."""


@dataclass
class Manifest:
    """Folders of each table, under the store's root, and what is known of them: how many chunks live and how many are dead,
    the sums of the keyword index (n, len, mean), and the last batch of each stream."""

    number: int = 0
    chunks: list[str] = field(default_factory=list)
    ledger: list[str] = field(default_factory=list)
    vectors: list[str] = field(default_factory=list)
    postings: list[str] = field(default_factory=list)
    terms: list[str] = field(default_factory=list)
    tombs: list[str] = field(default_factory=list)
    prints: list[str] = field(default_factory=list)
    centroids: str | None = None
    shape: str | None = None
    words: dict = field(default_factory=dict)
    n_chunks: int = 0
    n_dead: int = 0
    batches: dict[str, int] = field(default_factory=dict)

    def folders(self) -> set[str]:
        lists = (self.chunks, self.ledger, self.vectors, self.postings, self.terms, self.tombs, self.prints)
        return {p for parts in lists for p in parts} | {p for p in (self.centroids, self.shape) if p}


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        return self._fs().exists(self._path(f"{self.root}/{name}"))

    def numbers(self) -> list[int]:
        """Numbers of the manifests that are there."""
        fs, folder = self._fs(), self._path(f"{self.root}/manifests")
        names = [_NUMBER.fullmatch(f.getPath().getName()) for f in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(m[1]) for m in names if m)

    def manifest(self, number: int | None = None) -> Manifest | None:
        """The state, or None before the first run; with a number, an earlier one that is retained."""
        if number is None:
            numbers = self.numbers()
            if not numbers:
                return None
            number = numbers[-1]
        text = "".join(r.value for r in self.spark.read.text(f"{self.root}/manifests/manifest-{number}.json").collect())
        return Manifest(**json.loads(text))

    def new_part(self, table: str) -> str:
        """Name of a folder for new rows."""
        return f"{table}/{uuid.uuid4().hex}"

    def write(self, frame: DataFrame, table: str, **options) -> str:
        """Writes rows as a part of a table; its name."""
        name = self.new_part(table)
        frame.write.parquet(f"{self.root}/{name}", **options)
        return name

    def commit(self, state: Manifest) -> Manifest:
        """Makes ``state`` current, as the successor of the manifest that it was made from. The file is written aside and
        appears under its number whole: by a hard link on a local disk, else by a rename; neither replaces a file. (Stores
        of objects that copy when they rename need one writer at a time.)"""
        state = Manifest(**{**vars(state), "number": state.number + 1})
        fs, target = self._fs(), self._path(f"{self.root}/manifests/manifest-{state.number}.json")
        aside = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}")
        out = fs.create(aside, True)
        out.write(bytearray((json.dumps(vars(state)) + "\n").encode()))
        out.close()
        try:
            taken = not self._appears(fs, aside, target)
        finally:
            fs.delete(aside, False)
        if taken:
            raise ConcurrentRun(f"manifest {state.number} is there already")
        return state

    def _appears(self, fs, aside, target) -> bool:
        if fs.makeQualified(target).toUri().getScheme() != "file":
            return not fs.exists(target) and fs.rename(aside, target)
        local = [fs.makeQualified(p).toUri().getPath() for p in (aside, target)]
        try:
            os.link(*local)  # the driver's own disk; fails if the name is taken
        except FileExistsError:
            return False
        return True

    def vacuum(self, retain: int = RETAINED, older_than_s: float = AGE_S) -> list[str]:
        """Deletes the manifests before the last ``retain``, and folders that no other manifest names: parts that a later one
        replaced, and what runs left that ended early. What is younger than ``older_than_s`` stays, as a run may be writing
        it or a reader may have begun with it. Names of what is gone. Folders are listed by the driver: there are as many as
        runs since the last vacuum."""
        fs, numbers = self._fs(), self.numbers()
        before = (time.time() - older_than_s) * 1000
        aged = lambda f: f.getModificationTime() <= before
        # A manifest goes only if it is old itself: all that stay keep what they name.
        old = [n for n in (numbers[:-retain] if retain else numbers[:-1]) if aged(fs.getFileStatus(self._path(f"{self.root}/manifests/manifest-{n}.json")))]
        named = set().union(*[self.manifest(n).folders() for n in numbers if n not in old])
        gone = [f"manifests/manifest-{n}.json" for n in old]
        for table in (*TABLES, "work", "manifests"):
            folder = self._path(f"{self.root}/{table}")
            for f in fs.listStatus(folder) if fs.exists(folder) else []:
                name = f"{table}/{f.getPath().getName()}"
                left = f.getPath().getName().startswith(".") if table == "manifests" else name not in named
                if left and aged(f):
                    gone.append(name)
        for name in gone:  # manifests first: none of them ever names what is gone
            self.delete(name)
        return gone

    def reset(self) -> None:
        """Deletes the state, the manifests first."""
        for name in ("manifests", *TABLES):
            self.delete(name)

    def delete(self, name: str) -> None:
        self._fs().delete(self._path(f"{self.root}/{name}"), True)

    def read(self, parts: list[str], schema: T.StructType | str | None = None) -> DataFrame:
        """Rows of a table's parts."""
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(*[f"{self.root}/{p}" for p in parts])

    def read_each(self, parts: list[str]) -> DataFrame:
        """As :meth:`read`, for parts that are partitioned folders."""
        return reduce(partial(DataFrame.unionByName, allowMissingColumns=True), [self.spark.read.parquet(f"{self.root}/{p}") for p in parts])

    def living(self, rows: DataFrame, at: Manifest | None, key: str, name: str | None = None) -> DataFrame:
        """Rows (with epoch, where they have one) without those that are dead, and without epoch. ``key``, file_hash or
        chunk_id, is in their column ``name``."""
        if at is None or not at.tombs:
            return rows.drop("epoch")
        dead = self.read(at.tombs, TOMBS).where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_dead")).agg(F.max("epoch").alias("_until"))
        rows = rows if "epoch" in rows.columns else rows.withColumn("epoch", F.lit(0).cast("long"))
        return rows.join(dead, (F.col(name or key) == F.col("_dead")) & (F.coalesce("epoch", F.lit(0)) <= F.col("_until")), "left_anti").drop("epoch")

    def chunks(self, at: Manifest | None = None) -> DataFrame:
        """Chunk table; empty before the first run. A missing column: ValueError."""
        at = at or self.manifest()
        if not at or not at.chunks:
            return self.spark.createDataFrame([], CHUNKS)
        return self.living(read_chunks(self.spark, *[f"{self.root}/{p}" for p in at.chunks], epoch=bool(at.tombs)), at, "file_hash")

    def ledger(self, at: Manifest | None = None) -> DataFrame:
        at = at or self.manifest()
        return self.living(self.read(at.ledger, LEDGER + ", epoch long"), at, "file_hash") if at and at.ledger else self.spark.createDataFrame([], LEDGER)

    def prints(self, at: Manifest | None = None) -> DataFrame:
        """What is known of files, a row for each path, size and time."""
        at = at or self.manifest()
        return self.read(at.prints, PRINTS) if at and at.prints else self.spark.createDataFrame([], PRINTS)


def read_chunks(spark: SparkSession, *paths: str, epoch: bool = False) -> DataFrame:
    found = spark.read.parquet(*paths)
    if missing := [n for n in CHUNKS.names if n not in found.columns]:
        raise ValueError(f"chunk table lacks {', '.join(missing)}: ingest again")
    return found.select(*CHUNKS.names, *(["epoch"] if epoch and "epoch" in found.columns else []))


def read_ledger_text(spark: SparkSession, path: str) -> DataFrame:
    """A ledger kept as text, a line ``hash|name`` each; other lines are ignored. Text that is no UTF-8 is taken for
    the usual Western code page."""
    lines = spark.read.text(path)
    if not lines.where(~F.is_valid_utf8("value")).isEmpty():

        @F.arrow_udf("string")
        def western(contents: pa.Array) -> pa.Array:
            return pa.array([c.decode("cp1252", "ignore") for c in contents.to_pylist()], pa.string())

        raw = spark.read.format("binaryFile").load(path).select(western("content").alias("t"))
        lines = raw.select(F.explode(F.split("t", r"\r?\n")).alias("value"))
    cut = F.split("value", r"\|", 2)
    return lines.where(F.col("value").contains("|")).select(F.trim(cut[0]).alias("file_hash"), cut[1].alias("filename"))


def valid_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.where("chunk_index >= 0 and total_chunks >= 1")


def consistency(chunks: DataFrame, vectors: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """One row: n_chunks, n_vectors, n_sources, chunks_without_vector, vectors_without_chunk."""
    left, right = chunks.select(F.col(id_col).alias("k"), F.lit(1).alias("l"), "source"), vectors.select(F.col(id_col).alias("k"), F.lit(1).alias("r"))
    both = left.join(right, "k", "full")
    return both.agg(
        F.count("l").alias("n_chunks"), F.count("r").alias("n_vectors"), F.countDistinct("source").alias("n_sources"),
        F.count_if(F.col("r").isNull()).alias("chunks_without_vector"), F.count_if(F.col("l").isNull()).alias("vectors_without_chunk"),
    )
