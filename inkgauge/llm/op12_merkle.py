"""Merkle manifest of a table: a hash tree a group, a tree over the groups' roots, proofs.

Nodes are rows (tree, idx).  On every level each node finds its siblings by
equijoins with computed indices: ``idx XOR 1`` in a binary tree, else the index
of each other slot of its run.  The node in slot zero then has all digests of
its run and emits the parent.  Proofs come down from the root the same way, a
join of children with parents a level.  Every digest is a lowercase hex sha256
of UTF-8 text, digests as their hex text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import base
from ..session import written

ARITY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of a sorted range, about.
RANGE_ROWS = 100_000
STEP = "struct<left:string,right:string>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


# -- places of the leaves ----------------------------------------------------------


def placed(rows: DataFrame, group: str, order: Sequence[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` with ``tree`` (number of its group, null first), ``idx`` in the group by ``order`` and ``n``, the group's rows.

    Rows are sorted in ranges of group and order, so a group of any size has many
    tasks; only the rows of a range and group are counted and summed up.  ``order``
    should end in a draw, which parts equal rows.
    """
    ranges = base.parts_for(rows.count(), range_rows)
    keys = [group, *order]
    rows = rows.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    rows = written(rows.withColumn("place", F.monotonically_increasing_id()), "ranges").withColumn("range", F.shiftright("place", 33))
    sizes = rows.groupBy("range", group).agg(F.count("*").alias("rows"), F.min("place").alias("first"))
    so_far = Window.partitionBy(group).orderBy("range")
    sizes = sizes.withColumn("before", F.sum("rows").over(so_far) - F.col("rows")).withColumn("n", F.sum("rows").over(Window.partitionBy(group)))
    begins = (F.col("before") == 0).cast("long")
    # a row for each range in one window: groups that begin in the ranges before
    starts = sizes.groupBy("range").agg(F.sum(begins).alias("begin"))
    starts = starts.select("range", (F.sum("begin").over(Window.orderBy("range")) - F.col("begin")).alias("trees"))
    nth = F.sum(begins).over(Window.partitionBy("range").orderBy(F.col(group).asc_nulls_first()))
    sizes = sizes.join(starts, "range").withColumn("number", F.when(F.col("before") == 0, F.col("trees") + nth - 1))
    sizes = sizes.withColumn("tree", F.max("number").over(Window.partitionBy(group)))
    sizes = written(sizes.select(F.col("range").alias("of"), F.col(group).alias("named"), "first", "before", "n", "tree"), "groups")
    found = rows.join(sizes, (rows.range == sizes.of) & rows[group].eqNullSafe(sizes.named))
    return found.withColumn("idx", F.col("before") + F.col("place") - F.col("first")).drop("place", "range", "of", "named", "first", "before")


# -- up ------------------------------------------------------------------------------


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """``tree, idx, n, digest`` of nodes with ``left`` and ``right``: the digests of their run before and after them."""
    slot = F.col("idx") % arity
    out = nodes.select("tree", "idx", "n", "digest")
    other = nodes.where("n > 1").select(F.col("tree").alias("of"), F.col("idx").alias("at"), F.col("digest").alias("sibling"))
    for j in range(1, arity):
        # XOR of a binary index, else the slot j further in the run; a slot the last run has not finds no row
        there = F.col("idx").bitwiseXOR(F.lit(1).cast("long")) if arity == 2 else F.col("idx") - slot + (slot + j) % arity
        side = other.select("of", "at", F.col("sibling").alias(f"d{j}"))
        out = out.join(side, (out.tree == side.of) & (there == side.at), "left").drop("of", "at")
    kin = [(F.coalesce(f"d{j}", F.lit("")), slot + j) for j in range(1, arity)]
    left = F.concat(*[F.when(to >= arity, d).otherwise(F.lit("")) for d, to in kin])
    right = F.concat(*[F.when(to < arity, d).otherwise(F.lit("")) for d, to in kin])
    return out.select("tree", "idx", "n", "digest", left.alias("left"), right.alias("right"))


def tree_levels(nodes: DataFrame, arity: int = ARITY) -> list[DataFrame]:
    """The levels of all trees of leaves ``tree, idx, n, digest``, each written.

    A level has ``left`` and ``right`` besides, and ``n``, the nodes its tree has
    there; the node of a tree with ``n = 1`` is the root.
    """
    levels, most = [], nodes.agg(F.max("n")).first()[0] or 0
    while True:
        levels.append(written(with_siblings(nodes, arity), "level"))
        if most <= 1:
            return levels
        slot_zero = levels[-1].where((F.col("n") > 1) & (F.col("idx") % arity == 0))
        nodes = slot_zero.select(
            "tree", F.floor(F.col("idx") / arity).alias("idx"), F.ceil(F.col("n") / arity).alias("n"), digest(F.col("digest"), F.col("right")).alias("digest")
        )
        most = -(-most // arity)


# -- down ----------------------------------------------------------------------------


def paths(levels: list[DataFrame], heads: DataFrame, arity: int = ARITY) -> DataFrame:
    """``tree, idx, subroot, path`` of all leaves: left and right siblings, the leaf's level first.

    ``heads`` has ``tree, subroot`` and the ``path`` that goes on from the tree's root.
    """
    down = None
    for level in reversed(levels):
        here = level.where("n = 1").select("tree", "idx").join(heads, "tree").select("tree", "idx", "subroot", "path")
        if down is not None:
            up = down.select(F.col("tree").alias("of"), F.col("idx").alias("up"), "subroot", "path")
            below = level.where("n > 1").select("tree", "idx", F.struct("left", "right").alias("step"), F.floor(F.col("idx") / arity).alias("parent"))
            below = below.join(up, (below.tree == up.of) & (below.parent == up.up))
            here = here.unionAll(below.select("tree", "idx", "subroot", F.concat(F.array("step"), "path").alias("path")))
        down = here
    return down


def proof(path: Column) -> Column:
    """The siblings along a path in one text, left to right and level by level."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and a path lead to."""
    return F.aggregate(path, leaf, lambda d, s: digest(s["left"], d, s["right"]))


def manifest(
    docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: Sequence[str] = FIELDS,
    arity: int = ARITY, claimed: dict[str, Column] | None = None,
) -> DataFrame:
    """``id, leaf, subroot, root, path, claimed_leaf`` of every row.

    Leaves hash ``fields``; a null is not an empty text.  The rows of a group, a
    null group too, stand by id (null first), rows of one id by their leaves, equal
    rows count each.  ``claimed`` names fields with other values, whose leaf is
    ``claimed_leaf``; ``folded`` of it and the path is the root where they are
    right.  Texts of any length are hashed whole.  Other columns of ``docs`` are not
    read, whatever their names.  An empty table gives no rows.
    """
    own = {c: F.col(f"`{c}`") for c in fields}
    leaf = digest(*[field(v) for v in own.values()])
    other = digest(*[field((claimed or {}).get(c, v)) for c, v in own.items()])
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{group_col}`").cast("string").alias("group"), leaf.alias("digest"),
        other.alias("claimed_leaf"), F.rand(12).alias("deal"),
    )
    leaves = written(placed(written(rows, "leaves"), "group", ["id", "digest", "deal"]), "leaves")
    levels = tree_levels(leaves, arity)
    subroots = levels[0].where("n = 1")
    for level in levels[1:]:
        subroots = subroots.unionAll(level.where("n = 1"))
    # the groups' roots in the order of the groups are the leaves of one more tree
    subroots = written(subroots.select("tree", "digest"), "subroots")
    tops = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(subroots.count()).cast("long").alias("n"), "digest")
    above = tree_levels(tops, arity)
    end = above[-1].where("n = 1").select("tree", F.col("digest").alias("subroot"), F.array().cast(f"array<{STEP}>").alias("path"))
    to_root = paths(above, end, arity).select(F.col("idx").alias("tree"), F.col("subroot").alias("root"), "path")
    heads = subroots.join(to_root, "tree").select("tree", F.struct(F.col("digest").alias("subroot"), "root").alias("subroot"), "path")
    found = paths(levels, written(heads, "heads"), arity)
    out = leaves.select("tree", "idx", "id", F.col("digest").alias("leaf"), "claimed_leaf").join(found, ["tree", "idx"])
    return out.select("id", "leaf", "subroot.subroot", "subroot.root", "path", "claimed_leaf")


def _kin(nodes: str, tree: str) -> str:
    run = f"OVER (PARTITION BY {tree}lvl, idx // 3 ORDER BY idx ROWS BETWEEN"
    return f"""SELECT *, coalesce(string_agg(d, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(d, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {nodes} WHERE n > 1"""


def _leaf(text: str) -> str:
    values = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"CASE WHEN {v} IS NULL THEN '-' ELSE strlen({v}) || ':' || {v} END" for v in values) + ")"


_SQL = f"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS tab
  FROM (SELECT unnest(range(256)) AS i)),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY src) AS n, row_number() OVER () AS nr
  FROM (SELECT doc_id, CASE WHEN source IS NULL THEN '-' ELSE '=' || source END AS src, {_leaf("text")} AS leaf, CASE WHEN
    xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
      lambda c, x: xor(c // 256, tab[1 + xor(c % 256, x)])), 4294967295) % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS claimed
    FROM documents, crc)),
up AS (
  SELECT src, 0 AS lvl, idx, n, leaf AS d FROM leaves
  UNION ALL SELECT src, lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY idx)) FROM up WHERE n > 1 GROUP BY src, lvl, idx // 3, (n + 2) // 3),
kin AS ({_kin("up", "src, ")}),
subroots AS (SELECT src, d, row_number() OVER (ORDER BY src) - 1 AS idx, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (
  SELECT 0 AS lvl, idx, n, d FROM subroots
  UNION ALL SELECT lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY lvl, idx // 3, (n + 2) // 3),
top_kin AS ({_kin("top", "")}),
walk AS (
  SELECT nr, src, 0 AS lvl, idx, claimed AS d, '' AS proof FROM leaves
  UNION ALL SELECT nr, w.src, w.lvl + 1, w.idx // 3, sha256(l || w.d || r), proof || l || r FROM walk w JOIN kin k ON k.src = w.src AND k.lvl = w.lvl AND k.idx = w.idx),
at_subroot AS (SELECT w.nr, s.idx, w.d, w.proof, s.d AS subroot FROM walk w JOIN up u ON u.n = 1 AND u.src = w.src AND u.lvl = w.lvl JOIN subroots s ON s.src = w.src),
climb AS (
  SELECT nr, 0 AS lvl, idx, d, proof, subroot FROM at_subroot
  UNION ALL SELECT nr, w.lvl + 1, w.idx // 3, sha256(l || w.d || r), proof || l || r, subroot FROM climb w JOIN top_kin k ON k.lvl = w.lvl AND k.idx = w.idx)
SELECT doc_id, leaf, subroot, t.d AS root, sha256(proof) AS proof_sha256, c.d AS folded_root, c.d = t.d AS verified
FROM climb c JOIN top t ON t.n = 1 AND t.lvl = c.lvl JOIN leaves USING (nr)
"""


@base.query("op12_merkle_manifest", _SQL)
def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Proofs of all documents, checked against texts of which some have lost their line breaks."""
    docs = base.table(spark, sf_dir, "documents").select(*FIELDS)
    tampered = F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 2 == 0
    text = F.when(tampered, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    out = manifest(docs, claimed={"text": text})
    found = folded(F.col("claimed_leaf"), F.col("path"))
    out = out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), found.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
