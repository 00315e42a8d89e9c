"""Exact top-k search by inner product in an M-tree.

Vectors get one more component that makes all norms equal to the largest; the
distance to a query then falls as the inner product grows, and the triangle
inequality holds.  Rows hang below the nearest of a bounded number of top routing
vectors, in groups of bounded size; a group is a table of pages, each with a
routing vector, a covering radius and its distance to the node above, and with
the distances of its entries to its routing vector.  A query first searches the
top node it is nearest to, then those whose bound can still beat what it has;
within a group it takes the pages by their bounds, nearest first, and skips pages
and entries that the stored distances rule out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import base
from ..session import written

#: Top routing vectors, and rows of a page.
TOP_NODES, PAGE_ROWS = 64, 64
#: Rows of a group: a share of all within these limits.
GROUP_LEAST, GROUP_MOST = 256, 65_536
#: Queries searched together in one group.
QUERY_BLOCK = 4_096
#: Distances are compared with this much room for rounding, as a part of the largest.
ROUNDING = 1e-9

PAGES = (
    "top int, group int, page int, router binary, radius double, parent_distance double, "
    "group_router binary, ids array<long>, vectors binary, distances binary"
)
FOUND = "query_id long, vec_id long, score long"


def whole_numbers(vector: Column, scale: int) -> Column:
    """``floor(scale * x)`` of each component; null where the vector takes no part."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(
        vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(odd, F.lit(True)),
        F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")),
    )


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.int64()))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def exact_type(a: np.ndarray, b: np.ndarray) -> type:
    """Floating point where all its inner products are exact, else whole numbers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[-1]
    return np.float64 if most < 2**53 else np.int64


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole inner products."""
    kind = exact_type(a, b)
    return (a.astype(kind) @ b.T.astype(kind)).astype(np.int64)


def distances(a: np.ndarray, b: np.ndarray, norm: float) -> np.ndarray:
    """Distances of stored vectors, all brought to the same norm by one more component."""
    rest = lambda x: np.sqrt(np.maximum(norm - np.einsum("ij,ij->i", x, x, dtype=np.float64), 0))
    inner = product(a, b).astype(np.float64) + np.outer(rest(a), rest(b))
    return np.sqrt(np.maximum(2 * norm - 2 * inner, 0))


def assign_batches(batches: Iterator[pa.RecordBatch], tops: np.ndarray, norm: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        near = distances(matrix(batch.column("vec"), tops.shape[1]), tops, norm)
        top = near.argmin(axis=1)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(top.astype(np.int32)), pa.array(near[np.arange(len(top)), top])], names=[*batch.schema.names, "top", "far"]
        )


def build_pages(key, table: pa.Table, dim: int, norm: float) -> pa.Table:
    """The pages of one group: rows are ordered by the nearest of a few of them, then cut."""
    x = matrix(table.column("vec"), dim)
    ids = table.column("id").to_numpy()
    at = np.argsort(ids, kind="stable")
    x, ids = x[at], ids[at]
    centre = np.argmin(distances(x, x[:1], norm)[:, 0])
    seeds = x[:: max(1, -(-len(x) // max(1, len(x) // PAGE_ROWS)))]
    near = distances(x, seeds, norm)
    order = np.lexsort((near.min(axis=1), near.argmin(axis=1)))
    rows = []
    for page, lo in enumerate(range(0, len(x), PAGE_ROWS)):
        part = order[lo : lo + PAGE_ROWS]
        mean = np.rint(x[part].mean(axis=0)).astype(np.int64)[None]
        if float(np.einsum("ij,ij->", mean, mean, dtype=np.float64)) > norm:
            mean = x[part][:1]
        router = x[part][np.argmin(distances(x[part], mean, norm)[:, 0])][None]
        far = distances(x[part], router, norm)[:, 0]
        part, far = part[np.argsort(far, kind="stable")], np.sort(far, kind="stable")
        rows.append(
            (
                page, router.astype("<i8").tobytes(), float(far[-1]), float(distances(router, x[centre][None], norm)[0, 0]),
                x[centre].astype("<i8").tobytes(), ids[part].tolist(), x[part].astype("<i8").tobytes(), far.astype("<f8").tobytes(),
            )
        )
    n = len(rows)
    top, group = table.column("top")[0].as_py(), key[0].as_py()
    kinds = [pa.int32(), pa.binary(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
    return pa.table(
        [pa.array([top] * n, pa.int32()), pa.array([group] * n, pa.int32()), *[pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)]],
        names=[c.split()[0] for c in PAGES.split(", ")],
    )


def search_group(key, queries: pa.Table, pages: pa.Table, dim: int, norm: float, k: int) -> pa.Table:
    """Best ``k`` rows of one group for each of a block of queries."""
    empty = pa.table({c.split()[0]: pa.array([], pa.int64()) for c in FOUND.split(", ")})
    if not queries.num_rows or not pages.num_rows:
        return empty
    q = matrix(queries.column("vec"), dim)
    norms = np.einsum("ij,ij->i", q, q, dtype=np.float64)
    names, least = queries.column("id").to_pylist(), queries.column("least").to_pylist()
    routers = np.frombuffer(b"".join(pages.column("router").to_pylist()), "<i8").reshape(-1, dim)
    radius = pages.column("radius").to_numpy()
    parent = pages.column("parent_distance").to_numpy()
    top = np.frombuffer(pages.column("group_router")[0].as_py(), "<i8")[None]
    ids = [np.asarray(x) for x in pages.column("ids").to_pylist()]
    stored = np.frombuffer(b"".join(pages.column("vectors").to_pylist()), "<i8").reshape(-1, dim)
    kind = exact_type(q, stored)
    vectors = np.split(stored.astype(kind), np.cumsum([len(x) for x in ids])[:-1])
    asked = q.astype(kind)
    far = [np.frombuffer(x, "<f8") for x in pages.column("distances").to_pylist()]
    slack = ROUNDING * np.sqrt(4 * max(norm, norms.max(initial=0), 1.0))
    to_top = np.sqrt(np.maximum(norms[:, None] + norm - 2 * product(q, top), 0))[:, 0]
    to_router = np.sqrt(np.maximum(norms[:, None] + norm - 2 * product(q, routers), 0))
    out_q, out_v, out_s = [], [], []
    for i, (name, floor) in enumerate(zip(names, least)):
        best: list[tuple[int, int]] = []  # (-score, id), ascending

        def limit() -> float:
            """The distance beyond which nothing can be among the best."""
            score = -best[-1][0] if len(best) == k else floor
            if floor is not None and (score is None or floor > score):
                score = floor
            return np.inf if score is None else float(np.sqrt(max(norms[i] + norm - 2.0 * score, 0)))

        reach = limit()
        # the distances to the node above alone rule pages out, then those to the pages
        maybe = np.flatnonzero(np.abs(to_top[i] - parent) - radius <= reach + slack)
        bound = np.maximum(to_router[i, maybe] - radius[maybe], 0)
        for p in np.argsort(bound, kind="stable").tolist():
            if bound[p] > reach + slack:
                break
            page = maybe[p]
            # entries lie by their distance to the router: a run of them can be near enough
            lo = far[page].searchsorted(to_router[i, page] - reach - slack)
            hi = far[page].searchsorted(to_router[i, page] + reach + slack, "right")
            if lo >= hi:
                continue
            scores = vectors[page][lo:hi] @ asked[i]
            # a score below the worst of k already known, or of those found so far, is no candidate
            worst = -best[-1][0] if len(best) == k else floor
            if floor is not None and (worst is None or floor > worst):
                worst = floor
            at = np.flatnonzero(scores >= worst) if worst is not None else np.arange(hi - lo)
            if not len(at):
                continue
            names_at, scores = ids[page][lo:hi][at], scores[at]
            other = names_at != name
            best = sorted(best + list(zip((-scores[other]).astype(np.int64).tolist(), names_at[other].tolist())))[:k]
            reach = limit()
        out_q += [name] * len(best)
        out_v += [v for _, v in best]
        out_s += [-s for s, _ in best]
    return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()), "score": pa.array(out_s, pa.int64())})


def best_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact_top_k(
    vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: int = 256
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` best rows of each query, ties to the smaller id.

    A row is no candidate for a query of its own id.  Null ids and vectors that
    are null, empty or hold a null or non-finite component take no part, nor do
    those of another length than most have (the longer of ties).  Rows of a
    repeated id are candidates of their own.  A query with fewer candidates gets
    all of them, one without any no row; an empty table gives no rows.
    """
    rows = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), whole_numbers(F.col(f"`{vector_col}`"), scale).alias("vec"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    ).where("id is not null and vec is not null")
    rows = written(rows, "vectors")
    empty = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sizes = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if sizes is None:
        return empty
    dim, n = sizes
    rows = rows.where(F.size("vec") == dim)
    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    norm = rows.agg(F.max(square)).first()[0]
    # a bounded number of routing vectors, chosen by a hash of the id
    picked = rows.select("vec", F.xxhash64("id").alias("h")).orderBy("h", "vec").limit(TOP_NODES).select("vec").toArrow()
    tops = np.unique(matrix(picked.column("vec"), dim), axis=0)
    assigned = written(
        rows.mapInArrow(partial(assign_batches, tops=tops, norm=norm), "id long, vec array<long>, asks boolean, top int, far double"), "assigned"
    )
    # at most one row for each top node
    nodes = assigned.groupBy("top").agg(F.count("*"), F.max("far")).collect()
    count, radius = np.zeros(len(tops), dtype=np.int64), np.zeros(len(tops))
    for top, c, r in nodes:
        count[top], radius[top] = c, r
    size = max(GROUP_LEAST, min(GROUP_MOST, -(-n // TOP_NODES)))
    splits = np.maximum(1, -(-count // size))
    first = np.concatenate([[0], np.cumsum(splits)])
    by_top = lambda values: F.element_at(F.array(*[F.lit(int(v)).cast("int") for v in values]), F.col("top") + 1)
    salt = F.pmod(F.xxhash64("id", "vec"), by_top(splits)).cast("int")
    groups = assigned.select("id", "vec", "top", (by_top(first[:-1]) + salt).cast("int").alias("group"))
    pages = written(groups.groupBy("group").applyInArrow(base.grouped(partial(build_pages, dim=dim, norm=norm)), PAGES), "mtree")
    asking = assigned.where("asks").select("id", "vec", "top")
    blocks = max(1, -(-asking.count() // QUERY_BLOCK))
    asking = asking.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    blocked = pages.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def visit(queries: DataFrame) -> DataFrame:
        """``queries`` name the top node to search; its groups are searched in blocks of queries."""
        each = queries.withColumn("group", F.explode(F.sequence(by_top(first[:-1]), by_top(first[1:]) - 1)))
        search = base.cogrouped(partial(search_group, dim=dim, norm=norm, k=k))
        return each.groupBy("group", "block").cogroup(blocked.groupBy("group", "block")).applyInArrow(search, FOUND)

    near = written(best_of(visit(asking.withColumn("least", F.lit(None).cast("long"))), k), "near")
    least = near.groupBy("query_id").agg(F.count("*").alias("have"), F.min("score").alias("least"))
    known = asking.join(least, asking.id == least.query_id, "left").withColumn("least", F.when(F.col("have") >= k, F.col("least")))
    others = known.mapInArrow(
        partial(other_nodes, tops=tops, radius=radius, norm=norm, used=count > 0), "id long, vec array<long>, top int, block int, least long"
    )
    far = visit(others)
    out = best_of(near.select("query_id", "vec_id", "score").unionAll(far), k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def other_nodes(batches: Iterator[pa.RecordBatch], tops: np.ndarray, radius: np.ndarray, norm: float, used: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each query once for every other top node whose bound it cannot rule out."""
    for batch in batches:
        if not batch.num_rows:
            continue
        q = matrix(batch.column("vec"), tops.shape[1])
        norms = np.einsum("ij,ij->i", q, q, dtype=np.float64)
        near = np.sqrt(np.maximum(norms[:, None] + norm - 2 * product(q, tops), 0))
        least = batch.column("least")
        score = least.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
        reach = np.sqrt(np.maximum(norms + norm - 2 * score, 0))
        reach[np.asarray(least.is_null())] = np.inf
        slack = ROUNDING * np.sqrt(4 * max(norm, norms.max(initial=0), 1.0))
        visits = (near - radius <= (reach + slack)[:, None]) & used
        visits[np.arange(len(q)), batch.column("top").to_numpy()] = False
        row, top = np.nonzero(visits)
        row = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id").take(row), batch.column("vec").take(row), pa.array(top.astype(np.int32)), batch.column("block").take(row), least.take(row)],
            names=["id", "vec", "top", "block", "least"],
        )


TOP_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


@base.query("op10_mtree_topk", TOP_SQL)
def op10_mtree_topk(spark, sf_dir: str) -> DataFrame:
    """Five best rows of every fiftieth vector among all others."""
    rows = base.table(spark, sf_dir, "embeddings")
    return exact_top_k(rows, F.col("vec_id") % 50 == 0)
