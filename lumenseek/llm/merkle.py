"""A Merkle manifest of a table: a tree over each group's rows, and one over the groups' roots, with a proof for each row.

The trees are built from below: each level is written as runs of up to ``fan`` neighbours, whose digest is a node of the
next level. Proofs are pushed from above: a run is joined to its parent, and each of its children takes the proof of the
parent with its own siblings before it. So every join has one row for a run on both sides, and what the last join moves is
one proof for ``fan`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import with_ranges
from .scratch import Scratch

FAN = 16
#: Rows in a range of the order of leaves, and bytes of the table of groups up to which it is broadcast to the leaves.
RANGE_ROWS, BROADCAST_BYTES = 10_000, 32_000_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of a string's bytes."""
    return F.sha2(text.cast("binary"), 256)


def leaf_digest(values: Sequence[Column]) -> Column:
    """Digest of a row: each value as ``-`` if null, else its UTF-8 bytes after their number and a colon."""
    texts = [v.cast("string") for v in values]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def _joined(hashes: Column) -> Column:
    return F.array_join(hashes, "")


def _numbered(groups: DataFrame, scratch: Scratch) -> DataFrame:
    """``groups`` (source, n) with s, their number in order of the source, null first. They may be many: they are sorted in
    ranges, which count on from the ranges before."""
    order = F.asc_nulls_first("source")
    placed = scratch.keep(groups.repartitionByRange(order).sortWithinPartitions(order).withColumn("at", F.monotonically_increasing_id()))  # partition << 33 | row
    part = F.shiftright("at", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("rows"))
    before = sizes.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("before"))
    numbered = placed.withColumn("part", part).join(before, "part")
    return scratch.keep(numbered.select("source", "n", (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("s")))


def _positions(leaves: DataFrame, numbers: DataFrame, scratch: Scratch) -> DataFrame:
    """Leaves (s, pos, m, id, leaf, probe): their place among the m leaves of their group. Groups may hold any share of the
    rows: rows are numbered in ranges of the whole order, which count on within each group."""
    size = numbers.agg(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 48)).first()[0] or 0
    named = numbers.select(F.col("source").alias("g"), F.col("n").alias("m"), "s")
    rows = leaves.join(F.broadcast(named) if size <= BROADCAST_BYTES else named, F.col("source").eqNullSafe(F.col("g"))).drop("source", "g")
    keys = [F.col("s"), F.col("id").isNotNull().cast("long"), F.coalesce("id", F.lit(0).cast("long")), F.conv(F.substring("leaf", 1, 15), 16, 10).cast("long")]
    ranged, order = with_ranges(rows, RANGE_ROWS, keys)
    ranged = scratch.keep(ranged)  # read twice: a row must not change its range in between
    counted = ranged.groupBy("range", "s").agg(F.count("*").alias("rows"))
    before = counted.select("range", "s", (F.sum("rows").over(Window.partitionBy("s").orderBy("range")) - F.col("rows")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("range", "s").orderBy(*order[:-1], "leaf", order[-1])) - 1
    return ranged.withColumn("inside", inside).join(before, ["range", "s"]).select("s", (F.col("before") + F.col("inside")).alias("pos"), "m", "id", "leaf", "probe")


@dataclass
class Tree:
    """``levels[l]``: runs (s, p, kids) of nodes of level l, kids in order, with ``hash`` and what else leaves have.
    ``tops`` (s, level, hash): each tree's topmost node."""

    levels: list[DataFrame]
    tops: DataFrame


def build_tree(nodes: DataFrame, most: int, scratch: Scratch, fan: int = FAN) -> Tree:
    """Trees over ``nodes`` (s, pos, m, hash, and what leaves carry), one for each s; m is how many nodes s has, ``most`` the
    largest m."""
    levels: list[DataFrame] = []
    tops = nodes.where("m = 1").select("s", F.lit(0).alias("level"), "hash")
    while most > 1:
        carried = [c for c in nodes.columns if c not in ("s", "pos", "m")]
        runs = nodes.where("m > 1").groupBy("s", "m", F.expr(f"pos div {fan}").alias("p")).agg(F.array_sort(F.collect_list(F.struct("pos", *carried))).alias("kids"))
        runs = scratch.keep(runs.select("s", "m", "p", F.transform("kids", lambda k: k.dropFields("pos")).alias("kids")))
        levels.append(runs.drop("m"))
        nodes = runs.select("s", F.col("p").alias("pos"), F.ceil(F.col("m") / fan).cast("long").alias("m"), digest(_joined(F.transform("kids", lambda k: k["hash"]))).alias("hash"))
        tops = tops.unionByName(nodes.where("m = 1").select("s", F.lit(len(levels)).alias("level"), "hash"))
        most = -(-most // fan)
    return Tree(levels, scratch.keep(tops))


def push_proofs(tree: Tree, tops: DataFrame, fan: int = FAN) -> DataFrame:
    """Leaves that have siblings or parents: s, pos, kid, proof and what ``tops`` carries. ``tops`` (s, level, proof, ...):
    each tree's topmost node and the proof from there on. A proof is an array of (left, right), from below: the hashes of the
    siblings on either side, end to end."""
    carried = [c for c in tops.columns if c not in ("s", "level", "proof")]
    at = None
    for level in range(len(tree.levels) - 1, -1, -1):
        heads = tops.where(F.col("level") == level + 1).select("s", F.lit(0).cast("long").alias("p"), "proof", *carried)
        at = heads if at is None else at.select("s", F.col("pos").alias("p"), "proof", *carried).unionByName(heads)
        met = tree.levels[level].join(at, ["s", "p"])
        kids = met.select("s", "p", "kids", "proof", *carried, F.posexplode(F.col("kids")).alias("i", "kid"))
        sides = F.struct(
            _joined(F.transform(F.slice("kids", F.lit(1), F.col("i")), lambda k: k["hash"])).alias("left"),
            _joined(F.transform(F.slice("kids", F.col("i") + 2, F.lit(fan)), lambda k: k["hash"])).alias("right"),
        )
        at = kids.select("s", (F.col("p") * fan + F.col("i")).alias("pos"), "kid", F.concat(F.array(sides), "proof").alias("proof"), *carried)
    return at


def manifest(
    docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: Sequence[str] = FIELDS, tampered: dict[str, Column] | None = None, scratch: Scratch | None = None
) -> DataFrame:
    """A row for each row of ``docs``: ``id_col``, leaf, probe, subroot (its group's), root (of all), proof.

    ``id_col`` is a whole number, ``fields`` go into the leaf. ``probe`` is the leaf that the row would have with the columns
    ``tampered`` in place of its own, to be held against the proof by :func:`verify`. Groups stand in order of their UTF-8
    bytes, null first; rows in order of the id, null first. Rows with one id are ordered by their digests, so repeated rows
    may change places and the root depends on content alone. A lone leaf is its group's root, a lone group's root is the
    root. An empty table gives no rows and has no root. Columns not in ``fields`` are not read.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    changed = tampered or {}
    leaf = leaf_digest([F.col(c) for c in fields])
    probe = leaf_digest([changed.get(c, F.col(c)) for c in fields]) if changed else leaf
    leaves = scratch.keep(docs.select(F.col(id_col).cast("long").alias("id"), F.col(group_col).cast("string").alias("source"), leaf.alias("leaf"), probe.alias("probe")))
    numbers = _numbered(leaves.groupBy("source").agg(F.count("*").alias("n")), scratch)
    groups, most = numbers.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    nodes = _positions(leaves, numbers, scratch).withColumnRenamed("leaf", "hash")
    nodes = scratch.keep(nodes)
    rows = build_tree(nodes, most, scratch)
    above = build_tree(rows.tops.select(F.lit(0).cast("long").alias("s"), F.col("s").alias("pos"), F.lit(groups).cast("long").alias("m"), "hash", F.col("level").alias("height")), groups, scratch)
    root = above.tops.first()
    empty = F.array().cast("array<struct<left: string, right: string>>")
    root_hash = F.lit(root.hash if root else None).cast("string")
    if above.levels:
        start = above.tops.select("s", "level", empty.alias("proof"))
        tops = push_proofs(above, start).select(F.col("pos").alias("s"), F.col("kid.height").alias("level"), F.col("kid.hash").alias("subroot"), "proof")
        tops = scratch.keep(tops)
    else:
        tops = rows.tops.select("s", "level", F.col("hash").alias("subroot"), empty.alias("proof"))
    lone = nodes.where("m = 1").join(tops, "s").select("id", "hash", "probe", "subroot", "proof")
    found = lone
    if rows.levels:
        found = push_proofs(rows, tops).select("kid.id", "kid.hash", "kid.probe", "subroot", "proof").unionByName(lone)
    return found.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), F.col("hash").alias("leaf"), "probe", "subroot", root_hash.alias("root"), "proof")


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda node, side: digest(F.concat(side["left"], node, side["right"])))


def verify(proven: DataFrame) -> DataFrame:
    """Rows of :func:`manifest` with proof_sha256 (digest of all siblings, from below, left to right), folded_root (from the
    probe) and verified (whether that is the root)."""
    flat = digest(_joined(F.transform("proof", lambda side: F.concat(side["left"], side["right"]))))
    out = proven.withColumn("proof_sha256", flat).withColumn("folded_root", fold(F.col("probe"), F.col("proof")))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _leaf_sql(text: str) -> str:
    values = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"coalesce(CAST(strlen({v}) AS VARCHAR) || ':' || {v}, '-')" for v in values) + ")"


MERKLE_SQL = f"""
WITH RECURSIVE changed AS (
  SELECT *, coalesce(xor(4294967295::BIGINT, list_reduce(
      list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
      lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                               lambda x, z: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END)))) % 5 = 0, false) AS fifth
  FROM documents
), probed AS (
  SELECT *, CASE WHEN fifth THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other FROM changed
), leaves AS (
  SELECT doc_id, source, {_leaf_sql("text")} AS leaf, {_leaf_sql("other")} AS probe FROM probed
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS m,
         dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s
  FROM leaves
), nodes(lvl, s, pos, m, hash) AS (
  SELECT 0, s, pos, m, leaf FROM placed
  UNION ALL
  SELECT lvl + 1, s, pos // 16, (m + 15) // 16, sha256(string_agg(hash, '' ORDER BY pos)) FROM nodes WHERE m > 1 GROUP BY lvl, s, pos // 16, m
), subroots AS (
  SELECT s, lvl AS height, hash FROM nodes WHERE m = 1
), tops(lvl, pos, m, hash) AS (
  SELECT 0, s, (SELECT count(*) FROM subroots), hash FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 16, (m + 15) // 16, sha256(string_agg(hash, '' ORDER BY pos)) FROM tops WHERE m > 1 GROUP BY lvl, pos // 16, m
), below AS (
  SELECT p.s, p.pos, n.lvl AS ord,
         coalesce(string_agg(n.hash, '' ORDER BY n.pos) FILTER (WHERE n.pos < p.pos >> (4 * n.lvl)), '') AS l,
         coalesce(string_agg(n.hash, '' ORDER BY n.pos) FILTER (WHERE n.pos > p.pos >> (4 * n.lvl)), '') AS r
  FROM placed p JOIN nodes n ON n.s = p.s AND n.m > 1 AND n.pos >> 4 = p.pos >> (4 * n.lvl + 4)
  GROUP BY p.s, p.pos, n.lvl
), above AS (
  SELECT b.s, 100 + t.lvl AS ord,
         coalesce(string_agg(t.hash, '' ORDER BY t.pos) FILTER (WHERE t.pos < b.s >> (4 * t.lvl)), '') AS l,
         coalesce(string_agg(t.hash, '' ORDER BY t.pos) FILTER (WHERE t.pos > b.s >> (4 * t.lvl)), '') AS r
  FROM subroots b JOIN tops t ON t.m > 1 AND t.pos >> 4 = b.s >> (4 * t.lvl + 4)
  GROUP BY b.s, t.lvl
), sides AS (
  SELECT s, pos, l, r, row_number() OVER (PARTITION BY s, pos ORDER BY ord) AS step
  FROM (SELECT * FROM below UNION ALL SELECT p.s, p.pos, a.ord, a.l, a.r FROM placed p JOIN above a ON a.s = p.s)
), folded(s, pos, step, node) AS (
  SELECT s, pos, 0, probe FROM placed
  UNION ALL
  SELECT f.s, f.pos, f.step + 1, sha256(x.l || f.node || x.r) FROM folded f JOIN sides x ON x.s = f.s AND x.pos = f.pos AND x.step = f.step + 1
), ends AS (
  SELECT s, pos, arg_max(node, step) AS node FROM folded GROUP BY s, pos
), proofs AS (
  SELECT s, pos, string_agg(l || r, '' ORDER BY step) AS proof FROM sides GROUP BY s, pos
)
SELECT p.doc_id, p.leaf, b.hash AS subroot, t.hash AS root, sha256(coalesce(f.proof, '')) AS proof_sha256, e.node AS folded_root, e.node = t.hash AS verified
FROM placed p JOIN subroots b ON b.s = p.s JOIN tops t ON t.m = 1 JOIN ends e ON e.s = p.s AND e.pos = p.pos LEFT JOIN proofs f ON f.s = p.s AND f.pos = p.pos
"""
