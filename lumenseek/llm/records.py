"""Length-delimited binary records: token ids in files with checksums, and a separate index of where records begin.

A record's frame is the length of its data (unsigned, 64 bits), a masked checksum of the length, the data, and a masked
checksum of the data (CRC-32C, turned by 15 bits, plus a constant), all little-endian: the framing of the TFRecord
format. The data is a row's id (signed, 64 bits), a byte of flags (1: the id is not null, 2: ids have 16 bits each) and the
ids. Beside each file ``X.rec`` stands ``X.idx``: the place of every frame and the file's size, as unsigned numbers of 64
bits. The table ``files`` (Parquet) names the files that belong to the set, in order, with records, tokens, and how many
tokens stand before each. It is written last, so files of attempts that were lost are named nowhere and never read.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import default_vocabulary
from .library import PORTION, LibraryEncoder, library_encoder
from .ranges import MOST_RANGES, id_keys, with_ranges
from .scratch import bound_batches
from .words import pieces, text_buffers, tidy

#: The checksum's polynomial (reflected) and the constant that masks it.
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8
#: Bytes of text that a range of rows has on average, and bytes from which a file is closed.
RANGE_BYTES, FILE_BYTES = 32 << 20, 128 << 20
#: Bytes that are read, or handed on, at once (or one record).
READ_BYTES = 4 << 20
_HEAD = struct.Struct("<qB")
_LANE = 64


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ np.where(table & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    return table


def _tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """What each byte of a lane adds to its checksum (by place in the lane), and what moving a checksum over 1, 2, 4, ... lanes
    makes of each of its four bytes."""
    one = _byte_table()
    lane = np.empty((_LANE, 256), np.uint32)
    lane[-1] = one
    for j in range(_LANE - 2, -1, -1):  # one zero byte further
        lane[j] = one[lane[j + 1] & np.uint32(0xFF)] ^ (lane[j + 1] >> np.uint32(8))
    move = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * i) for i in range(4)])
    for _ in range(_LANE):
        move = one[move & np.uint32(0xFF)] ^ (move >> np.uint32(8))
    moves = [move]
    for _ in range(40):
        moves.append(_moved(moves[-1], moves[-1]))
    return lane, moves


def _moved(crc: np.ndarray, move: np.ndarray) -> np.ndarray:
    out = move[0][crc & np.uint32(0xFF)]
    for i in (1, 2, 3):
        out = out ^ move[i][(crc >> np.uint32(8 * i)) & np.uint32(0xFF)]
    return out


_LANES, _MOVES = _tables()


def masked_checksums(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Masked CRC-32C of each of the records that lie end to end in ``raw``; each has at least four bytes.

    Zeros before a record don't change its remainder, so records are filled up to whole lanes at their heads; all lanes
    of all records are looked up together, and neighbours are joined pairwise until each record has one number.
    """
    sizes = np.diff(offsets)
    if not len(sizes):
        return np.zeros(0, np.uint32)
    if sizes.min() < 4:
        raise ValueError("records of fewer than four bytes")
    lanes = -(-sizes // _LANE)
    ends = np.cumsum(lanes) * _LANE
    filled = np.zeros(int(ends[-1]), np.uint8)
    shift = np.repeat(ends - offsets[1:], sizes)
    filled[np.arange(offsets[0], offsets[-1]) + shift] = raw[offsets[0] : offsets[-1]]
    heads = (ends - sizes)[:, None] + np.arange(4)
    filled[heads] ^= 0xFF  # the register starts with ones
    table = filled.reshape(-1, _LANE)
    crc = _LANES[0][table[:, 0]]
    for j in range(1, _LANE):
        crc ^= _LANES[j][table[:, j]]
    level = 0
    while lanes.max() > 1:
        odd = lanes % 2
        place = np.cumsum(lanes + odd)
        even = np.zeros(int(place[-1]), np.uint32)
        even[np.arange(len(crc)) + np.repeat(np.cumsum(odd), lanes)] = crc
        crc = _moved(even[::2], _MOVES[level]) ^ even[1::2]
        lanes, level = (lanes + odd) // 2, level + 1
    crc = crc ^ np.uint32(0xFFFFFFFF)
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK)


def _framed(data: list[bytes]) -> tuple[bytes, np.ndarray]:
    """Frames end to end, and their sizes."""
    sizes = np.array([len(d) for d in data], np.int64)
    raw, offsets = np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum(sizes)])
    tails = masked_checksums(raw, offsets).astype("<u4")
    lengths = sizes.astype("<u8")
    heads = masked_checksums(lengths.view(np.uint8), np.arange(len(data) + 1) * 8).astype("<u4")
    parts: list[bytes] = []
    for n, h, d, t in zip(lengths, heads, data, tails, strict=True):
        parts += (n.tobytes(), h.tobytes(), d, t.tobytes())
    return b"".join(parts), sizes + 16


def unframe(data: bytes) -> tuple[list[bytes], int]:
    """The whole records at the head of ``data``, checked, and how many bytes they fill. A wrong checksum: ValueError."""
    found, spots, at = [], [], 0
    while at + 12 <= len(data):
        size = int.from_bytes(data[at : at + 8], "little")
        if at + size + 16 > len(data):
            break
        found.append(data[at + 12 : at + 12 + size])
        spots.append(at)
        at += size + 16
    if found:
        lengths = b"".join(data[a : a + 8] for a in spots)
        heads = [int.from_bytes(data[a + 8 : a + 12], "little") for a in spots]
        tails = [int.from_bytes(data[a + 12 + len(d) : a + 16 + len(d)], "little") for a, d in zip(spots, found, strict=True)]
        raw, offsets = np.frombuffer(b"".join(found), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in found])])
        good = masked_checksums(np.frombuffer(lengths, np.uint8), np.arange(len(found) + 1) * 8).tolist() == heads
        if not good or masked_checksums(raw, offsets).tolist() != tails:
            raise ValueError("a record's checksum is wrong")
    return found, at


def next_size(data: bytes) -> int:
    """Bytes of the frame at the head of ``data`` (12 bytes at least), whose length is checked."""
    head = int(masked_checksums(np.frombuffer(data[:8], np.uint8), np.array([0, 8]))[0])
    if head != int.from_bytes(data[8:12], "little"):
        raise ValueError("a record's length is wrong")
    return int.from_bytes(data[:8], "little") + 16


def _pack(row_id: int | None, ids: bytes, narrow: bool) -> bytes:
    body = np.frombuffer(ids, "<u4").astype("<u2").tobytes() if narrow else ids
    return _HEAD.pack(row_id or 0, (row_id is not None) | bool(narrow) << 1) + body


def _tokens(data: bytes) -> int:
    return (len(data) - _HEAD.size) // (2 if data[_HEAD.size - 1] & 2 else 4)


def _unpack(data: bytes) -> tuple[int | None, bytes]:
    row_id, flags = _HEAD.unpack_from(data)
    body = data[_HEAD.size :]
    return (row_id if flags & 1 else None), np.frombuffer(body, "<u2").astype("<u4").tobytes() if flags & 2 else body


def store_of(folder: str) -> tuple[pafs.FileSystem, str]:
    """What opens files under ``folder``, and the folder's path in it. Spark itself has no writer of plain bytes."""
    if "://" not in folder and not folder.startswith("file:"):
        return pafs.LocalFileSystem(), folder
    return pafs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))


class _Writer:
    """Files of one range at a time; ``done`` describes those that are closed."""

    def __init__(self, folder: str, file_bytes: int):
        self.fs, self.folder = store_of(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.file_bytes, self.range, self.seq, self.out = file_bytes, -1, 0, None
        self.done: list[tuple] = []

    def add(self, at: int, data: list[bytes]) -> None:
        a, sizes = 0, np.cumsum([len(d) + 16 for d in data])
        while a < len(data):
            if self.out is None or at != self.range:
                self._open(at)
            room = self.file_bytes - self.places[-1] + (int(sizes[a - 1]) if a else 0)
            b = max(a + 1, int(np.searchsorted(sizes, room, side="right")))
            frames, each = _framed(data[a:b])
            self.out.write(frames)
            self.places += (self.places[-1] + np.cumsum(each)).tolist()
            self.tokens += sum(map(_tokens, data[a:b]))
            if self.places[-1] >= self.file_bytes or b < len(data):
                self.close()
            a = b

    def _open(self, at: int) -> None:
        self.close()
        self.seq = self.seq + 1 if at == self.range else 0
        self.range, self.places, self.tokens = at, [0], 0
        self.name = f"part-{at:05d}-{self.seq:05d}-{uuid.uuid4().hex}"  # an attempt's own
        self.out = self.fs.open_output_stream(f"{self.folder}/{self.name}.rec")

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        with self.fs.open_output_stream(f"{self.folder}/{self.name}.idx") as out:
            out.write(np.array(self.places, "<u8").tobytes())
        self.done.append((self.range, self.seq, self.name, len(self.places) - 1, self.tokens, self.places[-1]))
        self.out = None


def write_records(docs: DataFrame, folder: str, path: str | None = None, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the token ids of all texts as record files under ``folder``, in ascending order of ``id_col``, and returns the
    table ``files``: range, seq, file, n_records, n_tokens, n_bytes, start (tokens before the file).

    ``path``: a vocabulary file of the tokenizers library, which encodes the texts; ``end_id`` is appended to each text's
    ids. Null and empty texts have that id alone. Null ids come first; equal ids are ordered by a hash of their texts,
    repeated rows are repeated records. An empty table gives no files. Extra columns are not read. ``docs`` should be a
    table, or a frame that gives the same rows again when it is read again. Texts are encoded where they are; ids are dealt
    into ranges of the order, which are written by a task each, and never held as a whole.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    encoder = library_encoder(spark, path or default_vocabulary())
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n, size = rows.agg(F.count("*"), F.sum(F.octet_length("text") + 64)).first()
    width = max(1, n * RANGE_BYTES // (size or 1))
    ranged, keys = with_ranges(rows, width, id_keys("id", "text"))
    data = _encoded(ranged.select("range", *keys, "id", "text"), encoder, end_id)
    dealt = data.repartitionById(max(1, min(MOST_RANGES, -(-n // width))), "range").sortWithinPartitions("range", *keys).select("range", "data")

    @tidy
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Writer(folder, file_bytes)
        for batch in stream:
            where = batch.column(0).to_numpy()
            for a, b in _runs(where):
                out.add(int(where[a]), batch.column(1).slice(a, b - a).to_pylist())
        out.close()
        names = ["range", "seq", "file", "n_records", "n_tokens", "n_bytes"]
        columns = list(zip(*out.done, strict=True)) or [[]] * 6
        types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)

    written = dealt.mapInArrow(run, "range int, seq int, file string, n_records long, n_tokens long, n_bytes long")
    written.write.parquet(f"{folder}/written")
    written = spark.read.schema(written.schema).parquet(f"{folder}/written")
    # Ranges are bounded in number (ranges.MOST_RANGES), so their sums fit one task; files are summed within their range.
    sums = written.groupBy("range").agg(F.sum("n_tokens").alias("t"))
    before = sums.select("range", (F.sum("t").over(Window.orderBy("range")) - F.col("t")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("range").orderBy("seq")) - F.col("n_tokens")
    placed = written.withColumn("inside", inside).join(before, "range").withColumn("start", F.col("before") + F.col("inside"))
    placed.select(*written.columns, "start").repartitionByRange("range", "seq").sortWithinPartitions("range", "seq").write.parquet(f"{folder}/files")
    return files_of(spark, folder)


FILES = "range int, seq int, file string, n_records long, n_tokens long, n_bytes long, start long"


def files_of(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(FILES).parquet(f"{folder}/files")


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    cuts = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
    return [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


def _encoded(rows: DataFrame, encoder: Broadcast, end_id: int | None) -> DataFrame:
    """``rows`` with the data of their records in place of their last two columns, id and text."""
    tail = b"" if end_id is None else struct.pack("<I", end_id)
    keys = rows.columns[:-2]

    def coded(model: LibraryEncoder, batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).combine_chunks()
        raw, offsets = text_buffers(table.column("text"))
        names = table.column("id").to_pylist()
        for a, b, ids in model.encode(raw, offsets):
            sizes = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
            for c, d in pieces(sizes, READ_BYTES):
                data = pa.array([_pack(i, x + tail, encoder.value.small) for i, x in zip(names[a + c : a + d], ids[c:d], strict=True)], pa.binary())
                part = table.slice(a + c, d - c).combine_chunks()
                yield pa.RecordBatch.from_arrays([*(pa.concat_arrays(part.column(k).chunks) for k in keys), data], [*keys, "data"])

    @tidy
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder.value.loaded()
        batches, size = [], 0
        for batch in stream:  # the more texts, the more often a piece is looked up once for several
            batches.append(batch)
            size += batch.nbytes
            if size >= PORTION:
                yield from coded(model, batches)
                batches, size = [], 0
        if batches:
            yield from coded(model, batches)

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keys)
    return rows.mapInArrow(run, f"{kinds}, data binary")


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)


def _tasks(files: DataFrame) -> int:
    n, size = files.agg(F.count("*"), F.sum("n_bytes")).first()
    return max(1, min(n, max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // FILE_BYTES))))


def read_records(spark: SparkSession, folder: str, id_name: str = "doc_id") -> DataFrame:
    """The records of a set, checked: ``id_name``, start (tokens before the record in the whole set), ids (binary, 32 bits
    each). Files are streamed, a few MB at a time."""
    files = files_of(spark, folder)
    names, types = ["id", "start", "ids"], [pa.int64(), pa.int64(), pa.binary()]

    @tidy
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store_of(folder)
        for batch in stream:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_stream(f"{root}/{name}.rec") as source:
                    rest, want = b"", READ_BYTES
                    while more := source.read(want):
                        found, used = unframe(rest := rest + more)
                        rest, rows = rest[used:], []
                        for data in found:
                            row_id, ids = _unpack(data)
                            rows.append((row_id, start, ids))
                            start += len(ids) // 4
                        want = max(READ_BYTES, next_size(rest) - len(rest)) if len(rest) >= 12 else READ_BYTES
                        if rows:
                            yield _batch(rows, names, types)
                    if rest:
                        raise ValueError(f"{name}.rec ends within a record")

    dealt = files.select("file", "start").repartition(_tasks(files))
    return dealt.mapInArrow(run, "id long, start long, ids binary").withColumnRenamed("id", id_name)


def read_shuffled(spark: SparkSession, folder: str, seed: int, id_name: str = "doc_id") -> DataFrame:
    """All records in a pseudo-random order that depends on ``seed`` alone: ``id_name``, ids. Only the offset indexes are
    sorted; each task then reads its records by place."""
    files = files_of(spark, folder)

    @tidy
    def places(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store_of(folder)
        for batch in stream:
            for at, seq, name in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                with fs.open_input_stream(f"{root}/{name}.idx") as source:
                    spots = np.frombuffer(source.read(), "<u8").astype(np.int64)
                n = len(spots) - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array([name] * n), pa.array(np.arange(n)), pa.array(spots[:-1]), pa.array(np.diff(spots))],
                    ["range", "seq", "file", "no", "at", "size"],
                )

    @tidy
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store_of(folder)
        rows, held = [], 0
        for batch in stream:
            for name, at, size in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                with fs.open_input_file(f"{root}/{name}.rec") as source:
                    found, _ = unframe(source.read_at(size, at))
                rows.append(_unpack(found[0]))
                held += size
                if held >= READ_BYTES:
                    yield _batch(rows, ["id", "ids"], [pa.int64(), pa.binary()])
                    rows, held = [], 0
        yield _batch(rows, ["id", "ids"], [pa.int64(), pa.binary()])

    tasks = _tasks(files)
    index = files.select("range", "seq", "file").repartition(tasks).mapInArrow(places, "range int, seq int, file string, no long, at long, size long")
    index = index.withColumn("draw", F.xxhash64(F.lit(seed), "range", "seq", "no"))
    dealt = index.repartitionByRange(tasks, "draw").sortWithinPartitions("draw", "range", "seq", "no")
    return dealt.select("file", "at", "size").mapInArrow(run, "id long, ids binary").withColumnRenamed("id", id_name)


def sweep(spark: SparkSession, folder: str) -> int:
    """Deletes record files that the set doesn't name, as attempts leave them that were lost; how many. Not while it is
    being written."""
    files = files_of(spark, folder)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.{rec,idx}").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"))
    stray = found.join(files.select("file"), F.regexp_replace("name", r"\.(rec|idx)$", "") == F.col("file"), "left_anti")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store_of(folder)
        for batch in stream:
            for name in batch.column(0).to_pylist():
                fs.delete_file(f"{root}/{name}")
            yield batch

    return stray.mapInArrow(run, "name string").count()
