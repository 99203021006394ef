import hashlib
import random
import zlib
from collections import defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lumenseek.llm import merkle, queries

SF = "/root/testdata/sf0.01"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(hashes, fan):
    """The root, and for each place its (left, right) siblings from below."""
    proofs, place = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for i, at in enumerate(place):
            a = at // fan * fan
            proofs[i].append(("".join(hashes[a:at]), "".join(hashes[at + 1 : a + fan])))
        place = [at // fan for at in place]
        hashes = [sha("".join(hashes[a : a + fan])) for a in range(0, len(hashes), fan)]
    return hashes[0], proofs


def brute(rows, change=lambda r: r, fan=16):
    """Rows (doc_id, source, lang, n_chars, text) -> doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0] is not None, r[0] or 0, leaf(r), leaf(change(r))))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(groups[s])], fan) for s in names}
    root, above = climb([trees[s][0] for s in names], fan)
    out = []
    for s, top in zip(names, above, strict=True):
        for (some, i, own, probe), proof in zip(sorted(groups[s]), trees[s][1], strict=True):
            node, flat = probe, ""
            for left, right in [*proof, *top]:
                node, flat = sha(left + node + right), flat + left + right
            out.append((i if some else None, own, trees[s][0], root, sha(flat), node, node == root))
    return out


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))


def proven(docs, **options):
    return order(merkle.verify(merkle.manifest(docs, **options)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, s long"


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 17}, {"a": 16, None: 1, "": 3}, {"a": 300, "é": 257, "z": 16, "Z": 1, None: 40}, {f"s{i}": 1 + i % 3 for i in range(40)}])
def test_trees_of_many_shapes(spark, monkeypatch, sizes):
    monkeypatch.setattr(merkle, "RANGE_ROWS", 50)
    r, rows = random.Random(1), []
    for s, n in sizes.items():
        for _ in range(n):
            text = r.choice([None, "", "Some Text", "ABC é 漢 😀", "5:x", "-"])
            rows.append((r.randrange(-(10**12), 10**12), s, r.choice(["en", None, "-"]), None if text is None else len(text), text))
    docs = spark.createDataFrame([(*x, "clash", 1) for x in rows], SCHEMA).repartition(3)
    change = lambda x: (*x[:4], x[4] and x[4].replace("S", "s"))
    want = order(brute(rows, change))
    assert proven(docs, tampered={"text": F.replace("text", F.lit("S"), F.lit("s"))}) == want
    assert len({w[3] for w in want}) == 1 and {w[6] for w in want} <= {True, False}
    assert all(w[6] for w in proven(docs))


def test_repeats_nulls_and_no_rows(spark, monkeypatch):
    monkeypatch.setattr(merkle, "RANGE_ROWS", 8)
    rows = [(None, None, None, None, None), (None, "a", "x", 1, "t"), *[(5, "a", "x", 4, "same")] * 40, *[(5, "a", "x", 4, "othr")] * 3, (2**63 - 1, "a", "x", 0, ""), (-(2**63), "b", "", 0, "long " * 300_000)]
    docs = spark.createDataFrame([(*x, None, None) for x in rows], SCHEMA)
    first = proven(docs.repartition(4))
    assert first == proven(docs.repartition(3).orderBy(F.rand(3)))  # the root depends on content alone
    assert first == order(brute(rows))
    assert proven(docs.limit(0)) == []


def test_a_change_anywhere_changes_the_root(spark):
    rows = [(i, "ab"[i % 2], "x", i, f"text {i}") for i in range(50)]
    root = lambda some: proven(spark.createDataFrame([(*x, "", 0) for x in some], SCHEMA))[0][3]
    base = root(rows)
    changed = [rows[1:], [*rows[:7], (*rows[7][:4], "text 7 "), *rows[8:]], [(0, "b", *rows[0][2:]), *rows[1:]], [(0, "a", None, 0, "text 0"), *rows[1:]]]
    assert base == root(rows[::-1]) and len({base, *map(root, changed)}) == 5


def test_query(spark):
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "source", "lang", "n_chars", "text"]).to_pylist()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    change = lambda r: r if zlib.crc32(str(r[0]).encode()) % 5 or r[4] is None else (*r[:4], r[4].translate(lower))
    got = queries.op13_merkle_manifest(spark, SF)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert order(got.collect()) == order(brute([tuple(d.values()) for d in docs], change))
