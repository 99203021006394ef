"""MinHash near-duplicates: circulant signatures, banding, exact verification.

A shingle is placed in a circle of 2^20 cells by a first permutation (the leading bits of its mixed hash);
a second, fixed permutation of the circle, shifted by k places, gives coordinate k of a signature as the
least value that the set meets. As neighbouring shifts are neighbouring entries, one slice of the table
yields all coordinates of a shingle.

Steps: (1) signatures in one pass over the texts; documents with equal shingle sets are one class from
here on. (2) Bands of equal coordinates propose candidates: each bucket is reduced to links with two of
its members, so no bucket is expanded into its pairs. (3) Those links are confirmed on the full sets.
(4) What the buckets join but the confirmed links don't is compared exhaustively in blocks: the documents
outside a cluster's largest confirmed component against all others of the cluster, with an inverted index
for each block. In (3) and (4) pairs whose sizes alone refute them are left out. Nothing is capped: a pair that shares a band is always either confirmed, refuted, or
already joined by confirmed links. A pair at similarity 0.8 shares no band with probability 5e-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, connected, only_ids
from .words import mix, overlap, pieces, shingles, text_buffers, tidy, word_hashes

BANDS, ROWS = 48, 6
_BITS = 20
#: Shingles in a block of documents that are compared exhaustively with another block.
BLOCK = 1_000_000


def _circle(cache: list[np.ndarray] = []) -> np.ndarray:  # noqa: B006
    if not cache:
        table = np.random.default_rng(4_071).permutation(1 << _BITS).astype(np.uint32)
        cache.append(np.lib.stride_tricks.sliding_window_view(np.concatenate([table, table]), BANDS * ROWS))
    return cache[0]


def signature(shingle_set: np.ndarray) -> np.ndarray:
    """All coordinates of a non-empty set of shingle hashes."""
    circle, cells = _circle(), np.unique(mix(shingle_set) >> np.uint64(64 - _BITS)).astype(np.int64)
    least = None
    for c in range(0, len(cells), 256):
        part = circle[cells[c : c + 256]].min(axis=0)
        least = part if least is None else np.minimum(least, part)
    return least


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band."""
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in coordinates.reshape(BANDS, ROWS).T:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key.view(np.int64)


def _sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    raw, offsets = text_buffers(texts)
    for a, b in pieces(offsets):
        hashes, at = word_hashes(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        for i in range(b - a):
            yield shingles(hashes[at[i] : at[i + 1]], k)


def _signatures(k: int):
    @tidy
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, dtype=np.int64)
        for batch in stream:
            sizes, first, second, keys = [], [], [], []
            for s in _sets(batch.column(1), k):
                sizes.append(len(s))
                first.append(int(np.bitwise_xor.reduce(mix(s)).view(np.int64)) if len(s) else 0)
                second.append(int(np.add.reduce(mix(s ^ np.uint64(0xA5A5_5A5A_1234_4321))).view(np.int64)) if len(s) else 0)
                keys.append(band_keys(signature(s)) if len(s) else none)
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*keys, none])))],
                ["id", "n", "h1", "h2", "bands"],
            )

    return run


def _similar(o, a, b, percent: int):
    return 100 * o >= percent * (a + b - o)


def _confirm(k: int, percent: int):
    """Rows sorted by pivot, salt, and the pivot's own row first: links of the members that are similar."""

    @tidy
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, heads = None, []
        for batch in stream:
            links = []
            columns = [batch.column(c).to_pylist() for c in range(4)]
            for pivot, salt, kind, doc, s in zip(*columns, _sets(batch.column(4), k), strict=True):
                if (pivot, salt) != group:
                    group, heads = (pivot, salt), []
                if kind == 0:
                    heads.append(s)
                elif any(_similar(overlap(s, h), len(s), len(h), percent) for h in heads):
                    links.append((pivot, doc))
            yield _edges(links)

    return run


def _edges(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])


class _Forest:
    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while self.up.get(x, x) != x:
            self.up[x] = x = self.up.get(self.up[x], self.up[x])
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[x] = y
        return x != y


def _between(left: list[tuple], right: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links that join components, between documents (id, component, set) of two blocks (or of one, given twice)."""
    if not left or not right:
        return []
    owner = np.repeat(np.arange(len(right)), [len(x[2]) for x in right])
    values = np.concatenate([x[2] for x in right])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    sizes = np.array([len(x[2]) for x in right])
    comps = np.array([x[1] for x in right])
    forest, links = _Forest(), []
    for doc, comp, s in left:
        lo = np.searchsorted(values, s, side="left")
        counts = np.searchsorted(values, s, side="right") - lo
        total = int(counts.sum())
        if not total:
            continue
        at = np.repeat(lo - np.append(0, np.cumsum(counts)[:-1]), counts) + np.arange(total)
        shared = np.bincount(owner[at], minlength=len(right))
        for j in np.flatnonzero(_similar(shared, len(s), sizes, percent) & (comps != comp)):
            if forest.join(comp, int(comps[j])):
                links.append((doc, right[j][0]))
    return links


def _exhaust(k: int, percent: int):
    """Rows sorted by cluster and pair of blocks: the links between the two blocks."""

    @tidy
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, sides = None, ([], [])
        for batch in stream:
            columns = [batch.column(c).to_pylist() for c in range(6)]
            for cluster, x, y, block, doc, comp, s in zip(*columns, _sets(batch.column(6), k), strict=True):
                if (cluster, x, y) != task:
                    if task:
                        yield _edges(_between(sides[0], sides[1] if task[1] != task[2] else sides[0], percent))
                    task, sides = (cluster, x, y), ([], [])
                sides[0 if block == x else 1].append((doc, comp, s))
        if task:
            yield _edges(_between(sides[0], sides[1] if task[1] != task[2] else sides[0], percent))

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of ``docs``: its id (``id_col``), n_shingles, component_id, kept.

    Documents are linked when 100 * |A & B| >= percent * |A | B| for their sets of distinct word shingles; a
    component is what links reach, named by its smallest id; ``kept`` marks that document. Null text: as
    empty, and an empty set is linked with nothing. Rows with one id are one node of the graph, each with its
    own size. A null id: linked with nothing, component_id null, kept. Extra columns are not read. The ids
    must be whole numbers. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = scratch.keep(rows.mapInArrow(_signatures(shingle_words), "id long, n long, h1 long, h2 long, bands array<long>"))
    some = signed.where("id is not null and n > 0")
    classes = scratch.keep(some.groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"), F.min_by("bands", "id").alias("bands")))
    bands = classes.select("rep", F.explode("bands").alias("key"))
    pivots = bands.groupBy("key").agg(
        F.min("rep").alias("p"), F.min_by("rep", F.xxhash64("rep")).alias("q"), F.max("rep").alias("top"), F.count("*").alias("size")
    ).where("p < top").select("key", "p", "q", "size")
    near = scratch.keep(
        bands.join(pivots, "key").select("rep", F.explode(F.array_distinct(F.array("p", "q"))).alias("pivot"), "size")
        .where("rep <> pivot").groupBy("rep", "pivot").agg(F.max("size").alias("size"))
    )
    clusters = scratch.keep(connected(near.select(F.col("rep").alias("a"), F.col("pivot").alias("b")), scratch))
    texts = scratch.keep(only_ids(rows, clusters.select(F.col("node").alias("id")), "id").distinct())
    # What sizes alone refute is not compared: a similarity is at most the smaller size over the larger.
    sizes = classes.groupBy(F.col("rep").alias("node")).agg(F.min("n").alias("least"), F.max("n").alias("most"))
    sized = near.join(sizes.select(F.col("node").alias("rep"), "least", "most"), "rep").join(sizes.select(F.col("node").alias("pivot"), F.col("least").alias("least_p"), F.col("most").alias("most_p")), "pivot")
    sized = sized.where(F.least("most", "most_p") * 100 >= F.greatest("least", "least_p") * percent)

    # Documents around one pivot are dealt over several tasks, by its bucket's size, each with the pivot's text.
    salted = sized.withColumn("salt", F.pmod(F.xxhash64("rep"), F.ceil(F.col("size") / 256)).cast("int"))
    heads = salted.select("pivot", "salt").distinct().withColumn("kind", F.lit(0)).withColumn("id", F.col("pivot"))
    members = salted.select("pivot", "salt", F.lit(1).alias("kind"), F.col("rep").alias("id"))
    confirmed = scratch.keep(
        heads.unionByName(members).join(texts, "id").select("pivot", "salt", "kind", "id", "text")
        .repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "kind")
        .mapInArrow(_confirm(shingle_words, percent), "a long, b long")
    )
    parts = scratch.keep(connected(confirmed, scratch))

    # Per cluster: blocks of the largest confirmed component (negative numbers) and of the rest.
    nodes = scratch.keep(
        clusters.select("node", F.col("component").alias("cluster")).join(parts, "node", "left").join(sizes, "node")
        .select("cluster", "node", "least", "most", F.coalesce("component", "node").alias("comp"))
    )
    by_part = nodes.groupBy("cluster", "comp").agg(F.sum("most").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
    split = by_part.groupBy("cluster").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.count("*").alias("comps")).where("comps > 1").drop("comps")
    # Of the largest component only documents of a size that one of the others may match are compared.
    others = by_part.join(split, "cluster").groupBy("cluster", "main").agg(
        F.min(F.when(F.col("comp") != F.col("main"), F.col("least"))).alias("from"), F.max(F.when(F.col("comp") != F.col("main"), F.col("most"))).alias("to"))
    fit = nodes.join(others, "cluster").where((F.col("comp") != F.col("main")) | ((F.col("most") * 100 >= F.col("from") * percent) & (F.col("to") * 100 >= F.col("least") * percent)))
    fit = scratch.keep(fit.select("cluster", "node", "comp", "main", F.col("most").alias("n")))
    is_main = F.col("comp") == F.col("main")
    blocks = lambda mine: F.greatest(F.lit(1), F.ceil(F.coalesce(F.sum(F.when(mine, F.col("n"))), F.lit(0)) / BLOCK)).cast("int")
    split = fit.groupBy("cluster").agg(blocks(is_main).alias("mains"), blocks(~is_main).alias("rests"))
    placed = fit.join(split, "cluster").withColumn(
        "block",
        F.when(F.col("comp") == F.col("main"), -1 - F.pmod(F.xxhash64("node"), F.col("mains")).cast("int"))
        .otherwise(F.pmod(F.xxhash64("node"), F.col("rests")).cast("int")),
    )
    rest = F.sequence(F.lit(0), F.col("rests") - 1)
    pairs = F.when(F.col("block") < 0, F.transform(rest, lambda r: F.struct(F.col("block").alias("x"), r.alias("y")))).otherwise(
        F.concat(
            F.transform(F.sequence(-F.col("mains"), F.lit(-1)), lambda m: F.struct(m.alias("x"), F.col("block").alias("y"))),
            F.transform(rest, lambda r: F.struct(F.least(r, F.col("block")).alias("x"), F.greatest(r, F.col("block")).alias("y"))),
        )
    )
    more = scratch.keep(
        placed.withColumn("pair", F.explode(pairs)).join(texts.withColumnRenamed("id", "node"), "node")
        .select("cluster", "pair.x", "pair.y", "block", "node", "comp", "text")
        .repartition("cluster", "x", "y").sortWithinPartitions("cluster", "x", "y")
        .mapInArrow(_exhaust(shingle_words, percent), "a long, b long")
    )
    joined = scratch.keep(connected(confirmed.unionByName(more), scratch))
    scratch.drop(near, texts, nodes, fit, confirmed, more, parts, clusters)

    named = classes.select("h1", "h2", "n", "rep").join(joined.withColumnRenamed("node", "rep"), "rep", "left").select(
        "h1", "h2", "n", F.coalesce("component", "rep").alias("component"))
    # Rows with one id are one node: each takes the least component of its classes.
    out = signed.select("id", "h1", "h2", "n").join(named, ["h1", "h2", "n"], "left")
    out = out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
    return out.select(
        F.col("id").alias(id_col), "n_shingles", "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


#: near_duplicates of ``documents`` with two-word shingles, all pairs compared.
NEAR_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(s) AS s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM words)
), sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN sizes x ON x.doc_id = a.doc_id JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  WHERE 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, component) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT b.b, r.component FROM reach r JOIN edges b ON b.a = r.node WHERE r.component < b.b
), least AS (SELECT node, min(component) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN least ON node = d.doc_id
"""
