"""Folders walked by tasks: a data source whose partitions are directories, and files opened where they are needed.

Excluded directories are never entered. The driver lists the first levels only, until there are enough directories to
share out; a task walks those that it is given. Listing opens no file.
"""

from __future__ import annotations

import hashlib
import json
import os
import stat
from collections.abc import Callable, Iterable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Directories that the driver lists at most before it shares out the rest, and bytes of files that a task reads.
SPREAD, TASK_BYTES = 256, 64 << 20
#: Bytes of a file that are held while it is hashed, and rows of a batch.
READ_BYTES, ROWS = 4 << 20, 10_000
FOUND = "path string, size long, modified timestamp"


def store_of(path: str) -> tuple[pafs.FileSystem, str, str]:
    """What opens ``path``, the path in that store, and what goes before such paths in Spark's form."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path, "file:"
    if path.startswith("file:"):
        bare = path.removeprefix("file:")
        return pafs.LocalFileSystem(), bare[2:] if bare.startswith("//") else bare, "file:"
    store, inside = pafs.FileSystem.from_uri(path)
    return store, inside, path[: path.index(inside.rstrip("/"))]


def opens(path: str) -> bool:
    """Whether tasks can open files at ``path`` themselves; other stores are left to Spark's own readers."""
    try:
        store_of(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError, ValueError):
        return False
    return True


def _time(ns: int | None) -> datetime | None:
    """To the millisecond, as Spark's own listing has it."""
    return None if ns is None else datetime.fromtimestamp(ns // 1_000_000 / 1000, UTC)


def _children(store: pafs.FileSystem, folder: str) -> tuple[list[str], list[tuple]]:
    """Sub-folders, and files as (path, size, modified), of one directory. Links to folders are not followed; a file that
    can't be looked at has no size. A directory that can't be read has no entries."""
    if not isinstance(store, pafs.LocalFileSystem):
        infos = store.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
        return [i.path for i in infos if i.type == pafs.FileType.Directory], [(i.path, i.size, _time(i.mtime_ns)) for i in infos if i.type == pafs.FileType.File]
    folders, found = [], []
    try:
        entries = sorted(os.scandir(folder), key=lambda e: e.name)
    except OSError:
        return [], []
    for entry in entries:
        if entry.is_dir(follow_symlinks=False):
            folders.append(entry.path)
        elif not entry.is_dir():
            try:
                at = entry.stat()
                if stat.S_ISREG(at.st_mode):
                    found.append((entry.path, at.st_size, _time(at.st_mtime_ns)))
            except OSError:
                found.append((entry.path, None, None))
    return folders, found


def walk(folder: str, excluded: Iterable[str], children: Callable[[str], tuple[list[str], list[tuple]]], deep: bool = True) -> Iterator[tuple]:
    """Files below ``folder``, depth first. ``children`` lists a directory; it is asked for none whose name is excluded."""
    refused, left = set(excluded), [folder]
    while left:
        folders, found = children(left.pop())
        yield from found
        if deep:
            left += [f for f in reversed(folders) if f.rstrip("/").rpartition("/")[2] not in refused]


def share_out(root: str, excluded: Iterable[str], children: Callable[[str], tuple[list[str], list[tuple]]], spread: int) -> list[tuple[str, bool]]:
    """Directories that together are everything below ``root``: (folder, whether with all below it)."""
    refused, shallow, level = set(excluded), [], [root]
    while level and len(shallow) + len(level) < spread:
        below = [f for folder in level for f in children(folder)[0] if f.rstrip("/").rpartition("/")[2] not in refused]
        shallow += level
        level = below
    return [(f, False) for f in shallow] + [(f, True) for f in level]


class _Part(InputPartition):
    def __init__(self, folder: str, deep: bool):
        self.folder, self.deep = folder, deep


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root, self.recurse = options["path"], options.get("recurse", "true").lower() == "true"
        self.excluded, self.spread = json.loads(options.get("excluded", "[]")), int(options.get("spread", str(SPREAD)))

    def partitions(self):
        store, inside, _ = store_of(self.root)
        if not self.recurse:
            return [_Part(inside, False)]
        return [_Part(*p) for p in share_out(inside, self.excluded, lambda f: _children(store, f), self.spread)]

    def read(self, partition):
        store, _, before = store_of(self.root)
        schema = pa.schema([("path", pa.string()), ("size", pa.int64()), ("modified", pa.timestamp("us", "UTC"))])
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], schema.field(i).type) for i in range(3)], schema=schema)

        for path, size, modified in walk(partition.folder, self.excluded, lambda f: _children(store, f), partition.deep):
            rows.append((before + path, size, modified))
            if len(rows) >= ROWS:
                yield batch()
                rows = []
        if rows:
            yield batch()


class FolderWalk(DataSource):
    """``spark.read.format("lumenseek_walk").option("excluded", '["dir", ...]').load(folder)``: path, size, modified. Options:
    recurse, excluded (JSON list of directory names), spread (directories that the driver lists at most)."""

    @classmethod
    def name(cls):
        return "lumenseek_walk"

    def schema(self):
        return FOUND

    def reader(self, schema):
        return _Reader(self.options)


def walked(spark: SparkSession, root: str, recurse: bool = True, excluded: Iterable[str] = (), spread: int = SPREAD) -> DataFrame:
    """path, size, modified of the files below ``root``."""
    spark.dataSource.register(FolderWalk)
    return spark.read.format("lumenseek_walk").option("recurse", str(recurse).lower()).option("excluded", json.dumps(list(excluded))).option("spread", spread).load(root)


def dealt(files: DataFrame) -> DataFrame:
    """Files (with size) dealt over as many tasks as their bytes ask for."""
    n, size = files.agg(F.count("*"), F.sum("size")).first()
    least = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(max(1, min(n, max(least, -(-(size or 0) // TASK_BYTES)))))


def read_file(path: str) -> bytes:
    store, inside, _ = store_of(path)
    with store.open_input_stream(inside) as source:
        return source.read()


def file_sha256(path: str) -> str:
    """Hex SHA-256 of a file, which is never held as a whole."""
    store, inside, _ = store_of(path)
    out = hashlib.sha256()
    with store.open_input_stream(inside) as source:
        while part := source.read(READ_BYTES):
            out.update(part)
    return out.hexdigest()
