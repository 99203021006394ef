import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lumenseek.llm.ann import CANDIDATES, LEAF, POWER, SAMPLE, Forest, nearest


def brute(ids, x, queries, k=20):
    out = {}
    for i in queries:
        s = (x[i] * x).sum(axis=1)
        order = sorted((j for j in range(len(x)) if ids[j] != ids[i]), key=lambda j: (-s[j], ids[j]))[:k]
        out[ids[i]] = [(ids[j], s[j]) for j in order]
    return out


def collected(frame):
    out = {}
    for r in frame.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    table = pq.read_table(f"/root/testdata/{sf}/embeddings.parquet").to_pydict()
    ids, x = table["vec_id"], np.array(table["embedding"], dtype=np.float64)
    got = collected(nearest(spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet"), F.col("vec_id") % 20 == 0))
    want = brute(ids, x, [i for i, v in enumerate(ids) if v % 20 == 0])
    assert got.keys() == want.keys()
    hits = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    scores = dict(zip(ids, x, strict=True))
    for q, rows in got.items():
        assert len(rows) == 20 and rows == sorted(rows, key=lambda r: (-r[1], r[0]))
        assert all(s == pytest.approx(float(scores[q] @ scores[j]), abs=1e-12) for j, s in rows)


def probed(x, forest, queries, n_leaves):
    """Recall of the 20 nearest, share of all vectors in the leaves taken, and vectors multiplied by vectors."""
    cells, recall, share, work = forest.leaves(x), [], [], []
    for q, taken in zip(queries, forest.taken(x[queries], n_leaves), strict=True):
        assert len(taken) == len(set(taken)) == min(n_leaves, forest.trees << forest.depth)
        inside = np.zeros((forest.trees, 1 << forest.depth), dtype=bool)
        inside[tuple(zip(*taken, strict=True))] = True
        hit = inside[np.arange(forest.trees), cells]
        scores = x @ x[q]
        scores[q] = -np.inf
        recall.append(hit.any(axis=1)[np.argsort(-scores)[:20]].mean())
        share.append(hit.any(axis=1).mean())
        work.append(hit.sum() / len(x))
    return np.mean(recall), np.mean(share), np.mean(work)


@pytest.mark.parametrize("n", [500, 2000, 20_000, 80_000])
def test_recall_and_share_grow_apart(n):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((n, 64)) * rng.uniform(0.8, 1.2, (n, 1))
    forest = Forest(x[:SAMPLE], float(np.linalg.norm(x, axis=1).max()), n)
    assert LEAF / 2 <= n / (1 << forest.depth) <= LEAF
    take = int(np.ceil(CANDIDATES * n**POWER / (n / (1 << forest.depth))))
    recall, share, _ = probed(x, forest, range(0, n, n // 25), take)
    assert recall >= 0.9 and share < (0.85 if n <= 500 else 0.75 if n <= 2000 else 0.6)
    sizes = np.array([np.bincount(c, minlength=1 << forest.depth) for c in forest.leaves(x).T])
    assert sizes.max() < 4 * LEAF


def test_clusters_need_few_leaves():
    rng = np.random.default_rng(6)
    x = np.repeat(rng.standard_normal((200, 64)), 100, axis=0) + 0.2 * rng.standard_normal((20_000, 64))
    forest = Forest(x, float(np.linalg.norm(x, axis=1).max()), len(x))
    recall, share, _ = probed(x, forest, range(0, 20_000, 499), 24)
    assert recall >= 0.9 and share < 0.08


def test_paths_below_the_sample():
    rng = np.random.default_rng(7)
    x = rng.standard_normal((4000, 8))
    forest = Forest(x[:100], 9.0, 4000, leaf=4)
    assert forest.depth == 10 and [c.shape[1] for c in forest.cuts] == [1, 2, 4, 8, *[1] * 6]
    assert len(list(forest.taken(x[:3], 5000))[0]) == 4 << 10


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.5]), (4, None), (20, [0.0, 0.0]), (40, [nan, 1.0]), (60, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0]), (None, [1.0, 0.0]), (80, [2.0, -1.0]), (80, [2.0, -1.0]), (100, [-1.0, 0.0]), (7, [])]
    frame = spark.createDataFrame([(*r, 0.0, 1) for r in rows], "vec_id long, embedding array<double>, score double, rank int")
    got = collected(nearest(frame, F.col("vec_id") % 20 == 0, k=4))
    assert got == {
        0: [(80, 2.0), (1, 1.0), (2, 1.0), (3, 0.5)], 80: [(0, 2.0), (1, 2.0), (2, 2.0), (3, 0.5)], 100: [(3, -0.5), (0, -1.0), (1, -1.0), (2, -1.0)],
    }
    assert nearest(frame.limit(0), F.lit(True)).count() == 0
    assert nearest(frame.where("vec_id = 0"), F.lit(True)).count() == 0
    ids = list(range(400))
    x = np.array([[1.0, 2.0] if i % 3 == 0 else [np.sin(i), np.cos(i)] for i in ids])
    hot = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got, want = collected(nearest(hot, F.col("vec_id") % 20 == 0)), brute(ids, x, range(0, 400, 20))
    assert {q: [j for j, _ in v] for q, v in got.items()} == {q: [j for j, _ in v] for q, v in want.items()}
