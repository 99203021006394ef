import hashlib
import math
from collections import defaultdict

import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tokenizers
from pyspark.sql import functions as F

from lumenseek.llm.chat import digest_windows, escape, format_windows, read_turns, render_turn, unescape
from lumenseek.llm.mixing import mix_sources, plan_mixture
from lumenseek.llm.queries import op1_chat_windows
from lumenseek.llm.simhash import distance, edited_likeness, fingerprints, within_radius

SF = "/root/testdata/sf0.01"
HARD = ["", "\\", "\\\\#", "###", "####### a: b", "</turn>", "<\\/turn>", "</turn></turn>\n### User: x", "\\### Assistant: </turn> ok", "#", "##"]


def sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# Chat windows


@pytest.mark.parametrize("text", HARD)
def test_escape_is_reversible_and_safe(text):
    assert unescape(escape(text)) == text
    assert "###" not in escape(text) and "</turn>" not in escape(text)


def test_turns_read_back():
    turns = [(role, text) for role in ["user", "assistant", "system", "", "tool: x\n", "User", "~a\\"] for text in HARD]
    formatted = "".join(render_turn(*t)[0] for t in turns)
    assert [(r, t) for r, t, _, _ in read_turns(formatted)] == turns


def test_chat_query_against_plain_python(spark):
    rows = pq.read_table(f"{SF}/conversations.parquet").to_pylist()
    rows += [{"conv_id": -7, "turn": i, "role": r, "text": HARD[8]} for i, r in enumerate(["user", "assistant"])]
    talks = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["conv_id"], r["turn"])):
        talks[r["conv_id"]].append((r["role"], r["text"] or ""))
    got = {r.conv_id: r for r in op1_chat_windows(spark, SF).collect()}
    assert got.keys() == talks.keys()
    for c, turns in talks.items():
        loss = [t for r, t in turns if r == "assistant"]
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), sha(f"{r}\n{t}\n" for r, t in turns))
        assert (got[c].loss_chars, got[c].loss_sha256) == (sum(map(len, loss)), sha(loss))


def test_windows_keep_budget_system_and_history(spark):
    talk = [(0, "system", "be brief")] + [(i, "user" if i % 2 else "assistant", f"turn {i} " + "w " * (i % 40)) for i in range(1, 3000)]
    rows = [(9, i, r, t, "x") for i, r, t in talk] + [(9, 3000, "assistant", "w " * 900, "x"), (9, 3001, "user", "end", "x"), (None, None, None, None, "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, tokens string")
    windows = format_windows(turns, budget=120, history=40).collect()
    large = [w for w in windows if w.n_tokens > 120]
    assert len(large) == 1 and large[0].n_turns == 1
    mine = sorted((w for w in windows if w.conv_id == 9), key=lambda w: (w.segment, w.number))
    assert len({w.segment for w in mine}) > 5
    seen = []
    for i, w in enumerate(mine):
        inside = [(r, t) for r, t, _, _ in read_turns(w.formatted)]
        if i:
            assert inside[0] == ("system", "be brief")
            repeated = inside[1 : w.n_repeated]
            assert not repeated or seen[-len(repeated) :] == repeated
        seen += inside[w.n_repeated :]
        assert len(w.loss) == sum(r == "assistant" for r, _ in inside[w.n_repeated :])
    assert seen == [(r, t) for _, _, r, t, _ in rows[:-1]]
    assert sum(w.n_repeated > 1 for w in mine) > len(mine) / 2
    digests = {r.conv_id: r for r in digest_windows(format_windows(turns, budget=120, history=40)).collect()}
    assert digests[9].turns_sha256 == sha(f"{r}\n{t}\n" for r, t in seen)
    assert digests[None].n_turns == 1 and digests[None].turns_sha256 == sha(["\n\n"])
    assert format_windows(turns.limit(0)).count() == 0 and digest_windows(format_windows(turns.limit(0))).count() == 0


def test_windows_keep_their_budget_with_a_large_system_turn(spark):
    count = F.regexp_count("text", F.lit(r"\S+")) - 4  # a text's words are its tokens, marks included
    talk = [("system", "s " * 404)] + [("user" if i % 2 else "assistant", f"t{i} " + "w " * (203 if i < 6 else 50)) for i in range(1, 20)]
    turns = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(talk)], "conv_id long, turn long, role string, text string")
    windows = sorted(format_windows(turns, budget=512, history=64, tokens=count).collect(), key=lambda w: (w.segment, w.number))
    assert all(w.n_tokens <= 512 for w in windows)
    new, with_system = [], []
    for i, w in enumerate(windows):
        inside = [(r, t) for r, t, _, _ in read_turns(w.formatted)]
        first = inside[w.n_repeated]
        # The system turn is left out only where it and the first new turn exceed the budget.
        with_system.append(inside[0][0] == "system")
        assert i == 0 or with_system[-1] == (404 + len(first[1].split()) <= 512)
        new += inside[w.n_repeated :]
    assert new == talk and not all(with_system) and sum(with_system) > 1
    alone = format_windows(turns.where("turn in (0, 1)"), budget=100, history=64, tokens=count).collect()
    assert sorted((w.n_turns, w.n_repeated, w.n_tokens) for w in alone) == [(1, 0, 404), (1, 1, 608)]


def test_tokens_are_those_of_the_encoder(spark):
    texts = ["", "Hello world", "x" * 70_000, "a b " * 20_000, None, "née 漢字 <|endoftext|> 12345"]
    turns = spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    model = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {w.conv_id: w.n_tokens for w in format_windows(turns).collect()}
    assert got == {i: len(model.encode(t or "", add_special_tokens=False).ids) + 4 for i, t in enumerate(texts)}


def test_turns_of_one_number_and_hot_conversations(spark, monkeypatch):
    from lumenseek.llm import chat

    monkeypatch.setattr(chat, "RANGE_ROWS", 8)
    rows = [(None if i % 3 else 5, None if i % 2 else 1, "user", f"text {i % 50}") for i in range(400)] + [(i, -(1 << 63) + i, "assistant", "a " * 600) for i in range(9)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS range", "2 AS k0", "3 AS start", "4 AS tokens")
    got = {r.conv_id: r for r in digest_windows(format_windows(turns, budget=64, history=16)).collect()}
    count = defaultdict(int)
    for r in rows:
        count[r[0]] += 1
    assert {c: r.n_turns for c, r in got.items()} == dict(count)
    assert got == {r.conv_id: r for r in digest_windows(format_windows(turns.repartition(5), budget=64, history=16)).collect()}


# Mixing


def water_level(sizes):
    """Targets by repeated resharing."""
    total, names = sum(sizes.values()), sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    full = {}
    while True:
        rest = total - sum(full.values())
        open_ = [s for s in names if s not in full]
        share = {s: rest * weight[s] / max(1, sum(weight[t] for t in open_)) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return full | share
        full |= {s: 3 * sizes[s] for s in over}


def test_mixture_targets_and_copies(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    sizes = defaultdict(int)
    for d in docs:
        sizes[d["source"]] += len(d["text"].split())
    want = water_level(sizes)
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    plan = plan_mixture(frame).collect()
    taken, variance = defaultdict(int), defaultdict(float)
    for r in plan:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        rate = want[r.source] / sizes[r.source]
        assert r.copies - math.floor(rate + 1e-9) in (0, 1) and r.copies <= 3
        taken[r.source] += r.size * r.copies
        variance[r.source] += r.size**2 * (rate % 1) * (1 - rate % 1)
    # Each document draws for itself, so totals scatter about the targets as sums of such draws do.
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 4 * math.sqrt(variance[s]) + 1e-6
    assert abs(sum(taken.values()) - sum(want.values())) <= 4 * math.sqrt(sum(variance.values()))
    again = {r.doc_id: r.copies for r in plan_mixture(frame.repartition(7)).collect()}
    assert again == {r.doc_id: r.copies for r in plan}
    mixed = mix_sources(frame)
    assert mixed.columns == frame.columns and mixed.count() == sum(again.values())


def test_mixture_comes_near_targets_of_large_sources(spark):
    docs = spark.range(60_000).selectExpr("id AS doc_id", "repeat('word ', cast(1 + id % 37 as int)) AS text", "concat('s', id % 4) AS source")
    rows = plan_mixture(docs).selectExpr("source", "target", "size * copies AS taken").groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert len(rows) == 4 and all(r["sum(taken)"] == pytest.approx(r["max(target)"], rel=0.03) for r in rows)


def test_mixture_edges(spark):
    rows = [(1, "a b c", None, 1.0), (1, "a b c", None, 2.0), (2, None, "s", 1.0), (3, "", "s", 1.0), (None, "a", "t", 0.0), (5, "b " * 1000, "u", 0.0), (6, "c", "v", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, rate double").selectExpr("*", "1 as copies", "2 as seed", "3 as row", "4 as s", "5 as id")
    plan = plan_mixture(docs).collect()
    assert len(plan) == len(rows)
    want = water_level({None: 6, "s": 0, "t": 1, "u": 1000, "v": 1})
    assert all(r.target == pytest.approx(want[r.source]) for r in plan)
    assert mix_sources(docs).columns == docs.columns
    assert plan_mixture(docs.limit(0)).count() == 0 and mix_sources(docs.limit(0)).count() == 0
    empty = plan_mixture(docs.where("doc_id = 3")).collect()
    assert [(r.target, r.copies) for r in empty] == [(0.0, 0)]


# SimHash


def test_edited_texts_and_next(spark):
    docs = sorted(pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist(), key=lambda d: d["doc_id"])
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in edited_likeness(frame.where("doc_id % 3 < 2")).collect()}
    docs = [d for d in docs if d["doc_id"] % 3 < 2]
    assert got.keys() == {d["doc_id"] for d in docs}
    by_text = {}
    bits = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 128
    for d, after in zip(docs, docs[1:] + docs[:1], strict=True):
        r, n = got[d["doc_id"]], len(d["text"])
        edited = d["text"][: n - n // 2] + after["text"][: n // 2]
        assert (r.n_chars, r.edited_sha256) == (n, sha([edited]))
        assert by_text.setdefault(d["text"], r.fingerprint) == r.fingerprint
        assert r.near_edited == bits(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == bits(r.fingerprint, got[after["doc_id"]].fingerprint)
    long = [got[d["doc_id"]] for d in docs if len(d["text"]) > 400]
    assert sum(r.near_edited > r.near_next for r in long) > 0.98 * len(long)


def test_simhash_edges(spark):
    rows = [(None, None, 1), (5, "", 1), (5, "", 1), (5, "b a", 1), (9, "x" * 50_000 + " y", 1), (2, "a b", 1), (7, "  ", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, own int")
    out = edited_likeness(docs).collect()
    assert sorted((r.doc_id or 0) for r in out) == sorted((r[0] or 0) for r in rows)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    assert {r.fingerprint for r in out if r.n_chars == 0} == {"0" * 32}
    assert edited_likeness(docs.limit(0)).count() == 0
    one = edited_likeness(docs.where("doc_id = 9")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert edited_likeness(docs.where("doc_id is null")).count() == 1


def test_block_tables_find_all_pairs(spark):
    base = [int(hashlib.md5(bytes([i])).hexdigest(), 16) for i in range(60)]
    prints = {b ^ flip for b in base for flip in (0, 1, 5 << 40, (7 << 100) | 1, (1 << 127) | (1 << 64) | 1, 31 << 62)}
    rows = [(f"{p:032x}",) for p in prints] + [(f"{base[0]:032x}",), (None,)]
    frame = spark.createDataFrame(rows, "fingerprint string")
    got = {(r.a, r.b, r.distance) for r in within_radius(frame, 3).collect()}
    names = sorted(f"{p:032x}" for p in prints)
    want = {(a, b, d) for i, a in enumerate(names) for b in names[i + 1 :] if (d := (int(a, 16) ^ int(b, 16)).bit_count()) <= 3}
    assert got == want and len(want) > 100
    assert within_radius(frame, 3).count() == len(want)


def test_fingerprint_is_a_weighted_majority(spark):
    one = fingerprints(spark.createDataFrame([(1, "word")], "k int, text string"), ["k"]).first().fingerprint
    many = fingerprints(spark.createDataFrame([(1, "Word word a word")], "k int, text string"), ["k"]).first().fingerprint
    assert one == many
    assert spark.range(1).select(distance(*[__import__("pyspark").sql.functions.lit(x) for x in ("f" * 32, "0" * 32)]).alias("d")).first().d == 128


def test_next_for_ids_of_any_size(spark, monkeypatch):
    from lumenseek.llm import simhash

    monkeypatch.setattr(simhash, "RANGE_ROWS", 5)
    ids = [-(1 << 63), (1 << 63) - 1, 1 << 62, *(i * 0x9E3779B97F4A7C15 % (1 << 63) - (1 << 61) for i in range(60))]
    docs = sorted({i: f"text {n} of {i} " * 4 for n, i in enumerate(ids)}.items())
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in edited_likeness(frame).collect()}
    for (i, t), (_, after) in zip(docs, docs[1:] + docs[:1], strict=True):
        assert got[i].edited_sha256 == sha([t[: len(t) - len(t) // 2] + after[: len(t) // 2]])
    same = spark.createDataFrame([(None if i % 2 else 4, "same words here") for i in range(70)] + [(1 << 62, "far away")], "doc_id long, text string")
    assert edited_likeness(same).count() == 71


def test_one_outlying_id_does_not_fill_a_range(spark):
    from lumenseek.llm.ranges import id_keys, with_ranges

    rows = spark.range(20_000).selectExpr("if(id = 7, 1L << 62, id) AS id", "'t' AS text")
    for frame in (rows, rows.selectExpr("if(id % 3 = 0, null, 5L) AS id", "text")):
        counts = [r["count"] for r in with_ranges(frame, 500, id_keys("id", "text"))[0].groupBy("range").count().collect()]
        assert sum(counts) == 20_000 and len(counts) > 30 and max(counts) < 2500


def test_repeated_rows_of_an_input_that_changes_its_order(spark, monkeypatch):
    from lumenseek.llm import simhash, suffix
    from lumenseek.llm.scratch import Scratch

    def shuffled(frames):
        import random

        for frame in frames:
            yield frame.sample(frac=1, random_state=random.SystemRandom().randrange(2**31))

    rows = [(5, "the same text")] * 60 + [(i, f"text {i}") for i in (1, 2, 7, 8)] + [(5, "another text"), (None, "a"), (None, "a"), (None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).mapInPandas(shuffled, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(simhash, "RANGE_ROWS", 7)
    monkeypatch.setattr(suffix, "RANGE_ROWS", 7)
    for _ in range(2):
        got = [(r.id, r.text, r.next) for r in simhash.with_next(docs, "doc_id", "text").collect()]
        assert sorted(map(str, [g[:2] for g in got])) == sorted(map(str, rows))
        assert sum(t == n == "the same text" for _, t, n in got) == 59 and sum(t == n == "a" for _, t, n in got) == 2
        assert sorted(n for _, _, n in got) == sorted(t for _, t in rows)  # each is the next of one
        numbered = suffix._numbered(docs.select(F.col("doc_id").alias("id"), "text"), Scratch(spark)).collect()
        assert sorted(r.seq for r in numbered) == list(range(1, len(rows) + 1))


def test_texts_are_named_by_128_bits(spark):
    from lumenseek.llm.simhash import _name

    row = spark.createDataFrame([("x",)], "t string").select(_name(F.col("t")).alias("n")).first()
    assert bytes(row.n) == hashlib.md5(b"x").digest()
