import hashlib
import json
import random

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

from lumenseek.llm.bpe import ByteBpe, decode_documents, encode_documents
from lumenseek.llm.unigram import MARK, UnigramCounter, count_tokens, load_pieces

SF = "/root/testdata/sf0.01"
HARD = [
    "", " ", "   \n\n  a", "I'll we've 'S 'd''t", "x" * 3000, "aaaaaaaab" * 40, "<|endoftext|>", "a<|endoftext|><|endoftext|> b<|endoftext",
    "é̂ ñandú 漢字かな 😀👩‍👩‍👧   x \x1c\x1d\x85y", "1234567 ٣٤٥ ⅷ x²", "\t\ttabs\r\nlines ", "﻿​\u0000\u0007", "the\x0bthe\x0cthe",
    "<0x0A> <s> <unk> ▁▁ ▁a", "\\### Assistant: </turn> ok",
]


def random_texts(n, seed=3):
    r = random.Random(seed)
    pool = [" ", "\n", "  ", "'", "s", "th", "ing", "é", "ß", "漢", "😀", "1", "##", " ", "́", "ll", "re", "A", "Ĝ", "\x1f", "　", "ǅ", "़"]
    for _ in range(n):
        yield "".join(r.choice(pool) if r.random() < 0.8 else chr(r.choice([r.randrange(32, 0x3000), r.randrange(0x10000, 0x1F700)])) for _ in range(r.randrange(60)))


@pytest.fixture(scope="module")
def texts():
    return pq.read_table(f"{SF}/documents.parquet", columns=["text"])["text"].to_pylist()


def test_bpe_equals_library(texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), ByteBpe(open(path, "rb").read())
    library.no_truncation()
    every = [*texts, *HARD, *random_texts(3000)]
    for text, ids, want in zip(every, own.encode(every), library.encode_batch(every, add_special_tokens=False), strict=True):
        got = [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)]
        assert got == want.ids, text[:200]
        assert own.decode(ids) == library.decode(want.ids, skip_special_tokens=False)


def test_every_code_point_is_split_as_in_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), ByteBpe(open(path, "rb").read())
    texts = ["".join(f"a{chr(c)}1{chr(c)}{chr(c)} " for c in range(k, k + 256) if not 0xD800 <= c < 0xE000) for k in range(0, 0x1_1000 + 0xF000, 256)]
    for text, ids, want in zip(texts, own.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert len(ids) == 4 * len(want.ids), hex(ord(text[1]))


def test_bpe_documents(spark):
    rows = [(1, "the cat", "x"), (1, "the cat", "y"), (None, None, None), (3, "", "z"), (4, "<|endoftext|>é", "ids")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = encode_documents(docs, decode=True).collect()
    assert sorted((r.doc_id or 0, r.decoded) for r in out) == [(0, ""), (1, "the cat"), (1, "the cat"), (3, ""), (4, "<|endoftext|>é")]
    back = decode_documents(encode_documents(docs)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((r.doc_id or 0, r.decoded) for r in out)
    assert encode_documents(docs.limit(0)).count() == 0


def library_unigram(pieces):
    t = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Split(Regex(f"(?={MARK})"), "isolated")
    t.decoder = decoders.ByteFallback()
    return t


def test_counts_equal_library(texts):
    pieces = load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    library, own = library_unigram(pieces), UnigramCounter(pieces)
    for text in [*texts[:300], *HARD, *random_texts(2000)]:
        marked = ((text if text.startswith(" ") else " " + text) if text else "").replace(" ", MARK)
        if MARK in text:  # a mark in the text itself begins no word here
            continue
        want = sum(len(library.model.tokenize(MARK + w)) for w in marked.split(MARK)[1:])
        assert own.count(text)[0] == want, text[:100]


def test_count_ties_and_unknown():
    pieces = [("<unk>", 0.0), ("a", -2.0), ("aa", -4.0), ("aaa", -6.0), ("b", -1.0), ("▁", -1.0)]
    own, library = UnigramCounter(pieces), models.Unigram(pieces, unk_id=0, byte_fallback=False)
    for w in ["▁aaaaa", "▁baab", "▁xxaxx", "▁é", "aéxb", "▁"]:
        assert own.count_word(w)[0] == len(library.tokenize(w)), w


def test_count_documents(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None), (2, ""), (2, "")], "doc_id long, text string").selectExpr("*", "1 as n_tokens")
    out = sorted((r.doc_id or 0, r.n_words) for r in count_tokens(docs).collect())
    assert out == [(0, 0), (1, 2), (2, 0), (2, 0)]
    assert count_tokens(docs.limit(0)).count() == 0


def test_digest_of_ids_is_little_endian(spark):
    row = encode_documents(spark.createDataFrame([(1, "hello world")], "doc_id long, text string")).first()
    assert row.ids == b"".join(i.to_bytes(4, "little") for i in (31373, 995))
    assert len(hashlib.sha256(row.ids).hexdigest()) == 64


def test_long_words_and_texts_through_spark(spark):
    rng = random.Random(11)
    letters = "".join(rng.choice("abcdefghijklmnop") for _ in range(120_000))
    texts = [letters, "x" * 200_000, "é漢" * 50_000, "-" * 100_000, letters[:50_000] + " word" * 100_000, " " * 100_000, "\n" * 50_000 + "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS ids", "3 AS n_tokens", "4 AS decoded", "5 AS score")
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in encode_documents(docs, decode=True).collect()}
    for i, t in enumerate(texts):
        want = library.encode(t, add_special_tokens=False).ids
        assert bytes(got[i].ids) == b"".join(x.to_bytes(4, "little") for x in want) and got[i].decoded == t
    counted = {r.doc_id: r.n_tokens for r in count_tokens(docs).collect()}
    assert counted.keys() == got.keys() and min(counted.values()) > 100


@pytest.mark.parametrize(("change", "what"), [({"normalizer": {"type": "NFC"}}, "normalizer"), ({"pre_tokenizer": {"type": "Whitespace"}}, "pre_tokenizer"), ({"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, "pre_tokenizer")])
def test_files_that_ask_for_more_are_refused(change, what):
    spec = json.loads(open(public_tokenizers.path("byte_bpe_50k.json"), "rb").read()) | change
    with pytest.raises(ValueError, match=what):
        ByteBpe(json.dumps(spec).encode())
