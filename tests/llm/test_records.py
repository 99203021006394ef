import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from lumenseek.llm import library, queries, records
from lumenseek.llm.words import text_buffers

from test_tokens import HARD, random_texts

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    out = Tokenizer.from_file(PATH)
    out.no_truncation()
    out.no_padding()
    return out


def crc32c(data):
    c = 0xFFFFFFFF
    for b in data:
        c ^= b
        for _ in range(8):
            c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def masked(data):
    c = crc32c(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def test_checksums():
    assert crc32c(b"123456789") == 0xE3069283  # the published check value
    r = random.Random(3)
    data = [r.randbytes(n) for n in [4, 5, 8, 63, 64, 65, 127, 128, 129, 1000, 4097, *[r.randrange(4, 400) for _ in range(80)]]]
    got = records.masked_checksums(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]))
    assert got.tolist() == [masked(d) for d in data]


def test_frames_and_damage():
    data = [b"12345", b"x" * 300, b"abcd"]
    whole, sizes = records._framed(data)
    assert whole == b"".join(struct.pack("<QI", len(d), masked(struct.pack("<Q", len(d)))) + d + struct.pack("<I", masked(d)) for d in data)
    assert sizes.tolist() == [len(d) + 16 for d in data]
    assert records.unframe(whole + whole[:9]) == (data, len(whole)) and records.next_size(whole) == 21
    for at in (0, 9, 14, 18, 40, len(whole) - 1):  # length, its checksum, data, data's checksum
        with pytest.raises(ValueError):
            broken = bytearray(whole)
            broken[at] ^= 4
            found, used = records.unframe(bytes(broken))
            if used < len(whole):  # a length beyond the data: the reader asks for it
                records.next_size(bytes(broken[used:]))


def encoded(texts, source=None):
    model = library.LibraryEncoder(source or open(PATH, "rb").read())
    out = []
    for _ in range(2):  # the second time from memory
        out.append([x for _, _, c in model.encode(*text_buffers(pa.array(texts, pa.string()))) for x in c])
    assert out[0] == out[1]
    return [np.frombuffer(x, "<u4").tolist() for x in out[0]]


def test_encoder_equals_library(tokenizer):
    r = random.Random(9)
    pool = ["a", "s", "'", "'s", "'ll", " ", "  ", "\n", "\t", "\n\n", "!", "1", ",", "é", " ", "\x1c", "\x1f", "\x85", "<|endoftext|>", "t", "Z", "_", "\x00", "ʼ", "漢", "\r\n", "ß", "÷", "×", "ж", "ŉ", "́", "ſ"]
    odd = ["".join(r.choice(pool) for _ in range(r.randrange(40))) for _ in range(30_000)]
    texts = [*pq.read_table(f"{SF}/documents.parquet", columns=["text"])["text"].to_pylist(), *HARD, *random_texts(3000), *odd, None, "x" * 200_000]
    for text, got, want in zip(texts, encoded(texts), tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False), strict=True):
        assert got == want.ids, repr(text[:200])


def test_encoder_forgets_and_stays_right(tokenizer, monkeypatch):
    monkeypatch.setattr(library, "REMEMBER", 500)
    monkeypatch.setattr(library, "PORTION", 5000)
    texts = pq.read_table(f"{SF}/documents.parquet", columns=["text"])["text"].to_pylist()[:120]
    assert encoded(texts) == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_other_files_of_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    other, texts = Tokenizer.from_file(path), ["Some Words, and more.", "", "<|endoftext|> x"]
    other.no_truncation()
    other.no_padding()
    source = open(path, "rb").read()
    assert not library.LibraryEncoder(source).cuttable
    assert encoded(texts, source) == [e.ids for e in other.encode_batch(texts, add_special_tokens=False)]


def brute(rows, tokenizer, end=2):
    """(id, start, ids) in order of the id, null first."""
    out, start = [], 0
    for row_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, *([] if end is None else [end])]
        out.append((row_id, start, ids))
        start += len(ids)
    return out


def ids_of(data):
    return np.frombuffer(data, "<u4").tolist()


def test_files_and_back(spark, tmp_path, tokenizer, monkeypatch):
    monkeypatch.setattr(records, "RANGE_BYTES", 40_000)
    monkeypatch.setattr(records, "READ_BYTES", 10_000)
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()[:300]
    rows = [(d["doc_id"] * 10**12, d["text"]) for d in docs] + [(None, "no id"), (-(2**62), None), (2**63 - 1, ""), (5, "long " * 60_000)]
    table = spark.createDataFrame([(i, t, b"x") for i, t in rows], "doc_id long, text string, data binary").repartition(5)
    table.write.parquet(str(tmp_path / "in"))
    folder = f"file://{tmp_path}/set"
    files = records.write_records(spark.read.parquet(str(tmp_path / "in")), folder, file_bytes=30_000).collect()
    want = brute(rows, tokenizer)
    got = sorted(records.read_records(spark, folder).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start, ids_of(r.ids)) for r in got] == want
    # Files follow each other as the ids do; the index says where records begin; every file closes near its size.
    files.sort(key=lambda f: (f.range, f.seq))
    assert len({f.range for f in files}) > 5 and any(f.seq for f in files)
    at = 0
    for f in files:
        data, spots = (tmp_path / "set" / f"{f.file}.rec").read_bytes(), np.fromfile(tmp_path / "set" / f"{f.file}.idx", "<u8")
        assert len(data) == f.n_bytes == spots[-1] and len(spots) == f.n_records + 1
        assert f.n_bytes <= 30_000 or f.n_records == 1
        for a, b in zip(spots[:-1].tolist(), spots[1:].tolist(), strict=True):
            (one,), used = records.unframe(data[a:b])
            row_id, ids = records._unpack(one)
            assert used == b - a and (row_id, at, ids_of(ids)) == want.pop(0)
            at += len(ids) // 4
        assert f.start == at - f.n_tokens
    assert not want
    # Shuffled reads: the same records, in an order of the seed alone.
    orders = [[(r.doc_id, bytes(r.ids)) for r in records.read_shuffled(spark, folder, seed).collect()] for seed in (1, 1, 2)]
    assert orders[0] == orders[1] != orders[2] and sorted(map(str, orders[0])) == sorted(map(str, orders[2])) == sorted(str((r.doc_id, bytes(r.ids))) for r in got)


def test_damaged_and_stray_files(spark, tmp_path):
    rows = [(i, f"text {i} " * 20) for i in range(40)]
    folder = str(tmp_path / "set")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    file = records.write_records(spark.read.parquet(str(tmp_path / "in")), folder).first()
    for end in ("rec", "idx"):  # as a lost attempt leaves them
        (tmp_path / "set" / f"part-00000-00000-abc.{end}").write_bytes(b"half a rec")
    assert records.read_records(spark, folder).count() == 40
    assert records.sweep(spark, folder) == 2 and records.read_records(spark, folder).count() == 40
    path = tmp_path / "set" / f"{file.file}.rec"
    whole = path.read_bytes()
    for broken in (whole[:100] + b"?" + whole[101:], whole[:-3]):
        path.write_bytes(broken)
        with pytest.raises(Exception, match="checksum|within a record"):
            records.read_records(spark, folder).collect()


def test_repeats_wide_ids_and_no_rows(spark, tmp_path, tokenizer):
    docs = spark.createDataFrame([(1, "same"), (1, "same"), (1, "other"), (2, "")], "doc_id int, text string")
    records.write_records(docs, str(tmp_path / "a"), end_id=None)
    got = sorted(records.read_records(spark, str(tmp_path / "a")).collect(), key=lambda r: (r.start, r.doc_id))
    assert sorted((r.doc_id, ids_of(r.ids)) for r in got) == sorted((i, x) for i, _, x in brute([(1, "same"), (1, "same"), (1, "other"), (2, "")], tokenizer, None))
    assert got[-1].doc_id == 2 and got[-1].start == sum(len(r.ids) // 4 for r in got)
    assert records._unpack(records._pack(None, struct.pack("<2I", 70_000, 5), False)) == (None, struct.pack("<2I", 70_000, 5))
    assert records._unpack(records._pack(-4, struct.pack("<2I", 65_535, 5), True)) == (-4, struct.pack("<2I", 65_535, 5))
    none = records.write_records(docs.limit(0), str(tmp_path / "b"))
    assert none.count() == 0 and records.read_records(spark, str(tmp_path / "b")).count() == 0 and records.read_shuffled(spark, str(tmp_path / "b"), 1).count() == 0


def test_query(spark, tokenizer):
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    want = [(i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, start, ids in brute([(d["doc_id"], d["text"]) for d in docs], tokenizer)]
    got = queries.op12_binary_records(spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect())) == want
