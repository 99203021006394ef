"""Files as rows: listing, routing by extension, and text extraction."""

from __future__ import annotations

import re
import traceback
from collections.abc import Callable, Iterable, Iterator
from html.entities import html5
from html.parser import HTMLParser
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import basename, clean_text, extension, file_type
from ..providers import NoExtractor, TextExtractor
from . import walk

#: Directories whose files are never read. Fixed values.
EXCLUDED_DIRS = (".venv", "venv", ".git", ".hg", ".svn", "node_modules", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".tox", "dist", "build", ".eggs")
#: Elements whose text is not content.
DROPPED_ELEMENTS = frozenset({"script", "style", "noscript"})
#: An ampersand, with the character reference that it begins if that has its semicolon.
REFERENCE = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[a-zA-Z][a-zA-Z0-9]*;)?")


def check_root(folder: str, spark: SparkSession | None = None) -> str:
    """A folder that may be indexed: it exists, and is neither the root, nor the home folder, nor above it. A path with
    a scheme is looked up in its own store."""
    scheme = folder.partition("://")[0] if "://" in folder else ""
    if scheme and scheme != "file":
        if spark is None:
            raise ValueError(f"no session to look up {folder}")
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(at) or not fs.getFileStatus(at).isDirectory():
            raise ValueError(f"not a folder: {folder}")
        whole, home = fs.makeQualified(at), fs.makeQualified(fs.getHomeDirectory())
        while home is not None and home.toString() != whole.toString():  # the home folder, then those above it
            home = home.getParent()
        if at.getParent() is None or home is not None:
            raise ValueError(f"refusing to index {folder}")
        return folder
    path, home = Path(folder.removeprefix("file://")).resolve(), Path.home().resolve()
    if not path.is_dir():
        raise ValueError(f"not a folder: {folder}")
    if path == Path(path.anchor) or path == home or path in home.parents:
        raise ValueError(f"refusing to index {path}")
    return str(path)


def find_files(spark: SparkSession, root: str, recurse: bool = True, excluded: Iterable[str] = EXCLUDED_DIRS) -> DataFrame:
    """path, name, ext, size, modified of the files under ``root``, without entering excluded directories."""
    if not walk.opens(root):
        return list_files(spark, root, recurse=recurse, excluded=excluded).drop("content")
    found = walk.walked(spark, root if "://" in root else str(Path(root).resolve()), recurse, excluded)
    return found.select("path", basename(F.col("path")).alias("name"), extension(F.col("path")).alias("ext"), "size", "modified")


def arriving(spark: SparkSession, root: str, recurse: bool = True, excluded: Iterable[str] = EXCLUDED_DIRS, files_per_batch: int = 1000) -> DataFrame:
    """As :func:`find_files`, as a stream of the files that arrive."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", recurse)
    return _described(reader.load(root), root, excluded).drop("content")


def list_files(spark: SparkSession, root: str, extensions: Iterable[str] | None = None, recurse: bool = True, excluded: Iterable[str] = EXCLUDED_DIRS) -> DataFrame:
    """path, name, ext, size, modified, content of the files under ``root``. Unless content is used, Spark reads
    metadata only."""
    root = root if "://" in root else str(Path(root).resolve())
    reader = spark.read.format("binaryFile")
    if recurse:
        reader = reader.option("recursiveFileLookup", True)
    rows = _described(reader.load(root), root, excluded)
    return rows if extensions is None else rows.where(F.col("ext").isin([e.lower() for e in extensions]))


def _described(read: DataFrame, root: str, excluded: Iterable[str]) -> DataFrame:
    rows = read.select("path", basename(F.col("path")).alias("name"), extension(F.col("path")).alias("ext"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
    # Folders between the root and the file: what follows the root's own path.
    whole = root.partition("://")[2].partition("/")[2] if "://" in root else root
    depth = len([p for p in Path(whole).parts if p != "/"])
    inside = F.split(F.regexp_replace(F.col("path"), "^[a-z0-9+.-]+:(//[^/]*)?/*", ""), "/")
    return rows.where(~F.arrays_overlap(F.slice(inside, depth + 1, 1_000), F.array(*[F.lit(d) for d in excluded])))


#: Pages of a PDF that one task takes; a longer one is shared out, if the extractor can open a range of pages.
PAGES = 32
#: What extraction adds to a file, and what looking at one does.
TAKEN = "text string, error string, message string, traceback string"
LOOKED = "file_hash string, openable boolean, pages int, has_form boolean, why string, looked boolean, unread string"


def _taken(engine: TextExtractor, kind: str, content: Callable[[], bytes]) -> tuple:
    try:
        return _extract(engine, kind, content()), None, None, None
    except Exception as e:  # one bad file must not end the run: its row says why
        return None, type(e).__name__, str(e), traceback.format_exc()


def _by_path(files: DataFrame, added: str, run: Callable[[str, str, int], tuple], first: str | None = None) -> DataFrame:
    """``files`` (path, ext, size, ...) with what ``run`` makes of each path, kind of route and number in the column ``first``,
    in the task that opens it."""
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema]

    def rows(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for i in range(batch.num_rows):  # a file's text may be long: each goes on by itself
                one = batch.slice(i, 1)
                made = run(*(one.column(j)[0].as_py() for j in range(3)))
                yield pa.RecordBatch.from_arrays([*one.columns[3:], *(pa.array([x], t) for x, t in zip(made, types, strict=True))], names)

    empty = files.sparkSession.createDataFrame([], added)
    names = [*files.columns, *empty.columns]
    types = [{"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32()}[f.dataType.simpleString()] for f in empty.schema]
    sent = walk.dealt(files).select(F.col("path").alias("_p"), route(F.col("ext")).alias("_k"), (F.col(first) if first else F.lit(0)).alias("_n"), *files.columns)
    return sent.mapInArrow(rows, ", ".join(kinds) + ", " + added)


def extract_paths(files: DataFrame, extractor: TextExtractor | None = None) -> DataFrame:
    """As :func:`extract_text`, for files (path, ext, size, ...) that tasks open by their paths: no other file is read, and
    no content leaves its task."""
    engine = extractor or NoExtractor()
    many = F.coalesce(F.col("pages") > PAGES, F.lit(False)) if "pages" in files.columns and hasattr(engine, "page_range") else F.lit(False)
    done = _by_path(files.where(~many), TAKEN, lambda path, kind, first: _taken(engine, kind, lambda: walk.read_file(path)))
    if "pages" in files.columns and hasattr(engine, "page_range"):
        done = done.unionByName(_in_ranges(files.where(many), engine))
    return done.withColumn("text", clean_text(F.col("text")))


def _in_ranges(files: DataFrame, engine: TextExtractor) -> DataFrame:
    """Long PDFs, ``PAGES`` pages a row and task, put together in order of the pages. A page that fails is left out; a range
    that can't be opened fails its file, as a whole file would."""
    ranges = files.withColumn("_first", F.explode(F.sequence(F.lit(0), F.col("pages") - 1, F.lit(PAGES))))

    def some(path: str, kind: str, first: int) -> tuple:
        try:
            return _joined(engine.page_range(walk.read_file(path), first, PAGES)), None, None, None
        except Exception as e:  # as in _taken
            return None, type(e).__name__, str(e), traceback.format_exc()

    read = _by_path(ranges, TAKEN, some, "_first")
    failed = F.min_by(F.struct("error", "message", "traceback"), F.when(F.col("error").isNotNull(), F.col("_first")))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("_first", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"])
    whole = read.groupBy(*files.columns).agg(failed.alias("_e"), F.array_join(texts, "\n").alias("text"))
    error = F.when(F.col("_e.error").isNotNull(), F.col("_e"))
    return whole.select(*files.columns, F.when(error.isNull(), F.col("text")).alias("text"), error["error"].alias("error"), error["message"].alias("message"), error["traceback"].alias("traceback"))


def look_at(files: DataFrame, extractor: TextExtractor | None = None) -> DataFrame:
    """``files`` (path, ext, size, ...) with their SHA-256 and, if the extractor can ``inspect``, what rules ask of PDFs. Files
    are read in pieces; ``unread`` names the error of one that can't be."""
    look = getattr(extractor, "inspect", None)

    def run(path: str, kind: str, first: int) -> tuple:
        try:
            found = walk.file_sha256(path)
            if kind != "pdf" or look is None:
                return found, None, None, None, None, look is not None, None
            content = walk.read_file(path)
        except OSError as e:
            return None, None, None, None, None, False, type(e).__name__
        try:
            return found, True, *look(content), None, True, None
        except (OSError, RuntimeError, ValueError) as e:
            return found, False, None, None, str(e), True, None

    return _by_path(files, LOOKED, run)


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.dropped = 0

    def handle_starttag(self, tag, attrs):
        self.dropped += tag in DROPPED_ELEMENTS

    def handle_endtag(self, tag):
        if tag in DROPPED_ELEMENTS and self.dropped:
            self.dropped -= 1

    def handle_data(self, data):
        if not self.dropped:
            self.parts.append(data)


def _ended(reference: re.Match) -> str:
    """A character reference as it is, if it ends in a semicolon and has a meaning; else its ampersand as text."""
    name = reference[1]
    return reference[0] if name and (name[0] == "#" or name in html5) else "&amp;" + (name or "")


def html_to_text(html: str, ended: bool = False) -> str:
    """Text nodes, one a line, without scripts, styles and comments; entities decoded. Browsers take some without their
    semicolon too (``&amp`` in a text that was cut off); with ``ended`` those stay as they are."""
    parser = _Text()
    parser.feed(REFERENCE.sub(_ended, html) if ended else html)
    parser.close()
    return "\n".join(parser.parts)


def html_text(html: Column, ended: bool = False) -> Column:
    """:func:`html_to_text` of a column, in batches. Null stays null."""

    @F.arrow_udf("string")
    def convert(pages: pa.Array) -> pa.Array:
        return pa.array([None if h is None else html_to_text(h, ended) for h in pages.to_pylist()], pa.string())

    return convert(html)


def route(ext: Column) -> Column:
    """pdf, html or image: by which way a file's text is got."""
    return F.when(ext == ".pdf", "pdf").when(ext.isin(".html", ".htm"), "html").otherwise("image")


def extract_text(files: DataFrame, extractor: TextExtractor | None = None) -> DataFrame:
    """Adds text (cleaned) and error (null, or why extraction failed) to rows with content and ext.

    A PDF page's text layer counts if it is usable, else the text of its images, else recognition of the
    rendered page; a page that fails is left out. ``message`` and ``traceback`` say more about an error.
    """
    engine = extractor or NoExtractor()

    @F.arrow_udf(TAKEN)
    def extract(kinds: pa.Array, contents: pa.Array) -> pa.Array:
        rows = [_taken(engine, kind, lambda c=content: c or b"") for kind, content in zip(kinds.to_pylist(), contents.to_pylist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], ["text", "error", "message", "traceback"])

    done = files.withColumn("_x", extract(route(F.col("ext")), F.col("content")))
    return done.withColumn("text", clean_text(F.col("_x.text"))).select("*", "_x.error", "_x.message", "_x.traceback").drop("_x", "content")


def usable(text: str) -> bool:
    """The rule of :func:`functions.text.text_usable`, for one page at a time."""
    text = text.strip()
    words, letters = text.split(), {c for c in text if c.isalpha()}
    garbled = len(words) >= 50 and sum(len(w) == 1 for w in words) > 0.6 * len(words)
    return len(text) > 20 and not garbled and not (len(letters) <= 4 and len(text) > 100)


def _extract(engine: TextExtractor, kind: str, content: bytes) -> str:
    if kind == "html":
        return html_to_text(content.decode("utf-8", "ignore"))
    if kind == "image":
        return engine.image(content)
    return _joined(engine.pages(content))


def _joined(pages: Iterable) -> str:
    out = []
    for native, *others in pages:
        try:
            out.append(_page_text(native, others))
        except (MemoryError, OSError, RuntimeError, ValueError):  # the page is left out
            continue
    return "\n".join(out)


def _page_text(native: str, others: list) -> str:
    """A usable text layer, else what the images hold, else the rendered page; the latter two are strings, or
    functions that are called only if it comes to that."""
    if usable(native):
        return native
    embedded, rendered = others
    found = embedded() if callable(embedded) else embedded
    return found if found.strip() else rendered() if callable(rendered) else rendered


def with_file_columns(files: DataFrame, extractor: TextExtractor | None = None) -> DataFrame:
    """``files`` without content, and with file_hash (SHA-256), file_type, and, if the extractor can ``inspect``, what
    rules ask of PDFs: openable, pages, has_form (null for other files, or if it can't)."""
    named = files.withColumn("file_hash", F.sha2("content", 256)).withColumn("file_type", file_type(F.col("path")))
    look = getattr(extractor, "inspect", None)
    if look is None:
        return named.drop("content")

    @F.arrow_udf("openable boolean, pages int, has_form boolean, why string")
    def inspected(kinds: pa.Array, contents: pa.Array) -> pa.Array:
        rows = []
        for kind, content in zip(kinds.to_pylist(), contents, strict=True):
            try:
                rows.append((True, *look(content.as_py() or b""), None) if kind == "pdf" else (None, None, None, None))
            except (OSError, RuntimeError, ValueError) as e:
                rows.append((False, None, None, str(e)))
        types = (pa.bool_(), pa.int32(), pa.bool_(), pa.string())
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["openable", "pages", "has_form", "why"])

    return named.withColumn("_x", inspected(route(F.col("ext")), F.col("content"))).select("*", "_x.openable", "_x.pages", "_x.has_form", "_x.why").drop("_x", "content")
