"""Exact nearest neighbours between two sets of vectors.

Small base side (checked by a count): its matrix travels with an Arrow UDF and nothing is shuffled.
Otherwise both sides are cut into cells around pivots. A query first searches its home cell, which
gives a true upper bound for its k-th distance, then only the cells the triangle inequality cannot
rule out. Cells are split into blocks of bounded size on both sides, so a hot cell is many small
tasks, each of which returns at most k rows per query. No pruning is ever approximate.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectraloom.functions.arrow import spread, to_list_array, to_matrix, unit_rows
from spectraloom.session import materialize

BROADCAST_BYTES = 64 << 20
BLOCK_ROWS = 16_384
MAX_PIVOTS = 512
TIE_DECIMALS = 12


def _prepare(df: DataFrame, id_col: str, col: str, extra: list[str], metric: str, prefix: str) -> DataFrame:
    """Select id, vector and extras under fixed names; cosine works on unit vectors."""

    @F.arrow_udf("array<double>")
    def unit(vectors: pa.Array) -> pa.Array:
        valid, m = to_matrix(vectors)
        if not len(m):
            return pa.nulls(len(valid), pa.list_(pa.float64()))
        m = unit_rows(m)
        offsets = np.concatenate([[0], np.cumsum(valid * m.shape[1])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(m.ravel()))

    vec = F.col(col).cast("array<double>")
    return df.where(F.col(col).isNotNull()).select(
        F.col(id_col).alias(f"{prefix}id"),
        (unit(vec) if metric == "cosine" else vec).alias(f"{prefix}vec"),
        *[F.col(c).alias(f"{prefix}{c}") for c in extra],
    )


#: A search compares blocks of so many queries and base rows at a time, so its memory does not depend on either side.
TILE_QUERIES, TILE_BASE = 128, 4_096


def _topk(q: np.ndarray, b: np.ndarray, k: int, blocked) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances and base positions of the k nearest; equal distances keep base order. Places without a neighbour have distance inf."""
    k = min(k, len(b))
    pos = np.zeros((len(q), k), dtype=np.int64)
    val = np.full((len(q), k), np.inf)
    b2 = np.square(b).sum(axis=1)
    for at in range(0, len(q) if k else 0, TILE_QUERIES):
        rows = slice(at, at + TILE_QUERIES)
        twice, q2 = 2.0 * q[rows], np.square(q[rows]).sum(axis=1)
        for first in range(0, len(b), TILE_BASE):
            cols = slice(first, first + TILE_BASE)
            d2 = np.add.outer(q2, b2[cols])
            d2 -= twice @ b[cols].T
            np.round(np.maximum(d2, 0.0, out=d2), TIE_DECIMALS, out=d2)
            if blocked is not None:
                d2[blocked[0][rows][:, None] == blocked[1][cols][None, :]] = np.inf
            val[rows], pos[rows] = _nearest_of(val[rows], pos[rows], d2, first)
    return val, pos


def _nearest_of(val: np.ndarray, pos: np.ndarray, d2: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest among those found so far and a tile of base rows from ``first`` on; what was found first wins where distances are equal."""
    n, k = val.shape
    near = d2 < val[:, -1:]
    if k < d2.shape[1] and np.count_nonzero(near) > 8 * n * k:
        near &= d2 <= np.partition(d2, k - 1, axis=1)[:, k - 1 : k]
    row, col = np.nonzero(near)
    if not len(row):
        return val, pos
    rows = np.r_[np.repeat(np.arange(n), k), row]
    vals, places = np.r_[val.ravel(), d2[row, col]], np.r_[pos.ravel(), first + col]
    order = np.lexsort((vals, rows))  # stable
    best = order[np.searchsorted(rows[order], np.arange(n))[:, None] + np.arange(k)]
    return vals[best], places[best]


def _as_distance(d2: np.ndarray, metric: str) -> np.ndarray:
    return d2 / 2.0 if metric == "cosine" else np.sqrt(d2)


def knn(
    queries: DataFrame,
    base: DataFrame,
    k: int,
    query_id: str = "sample_id",
    base_id: str = "sample_id",
    col: str = "embedding",
    metric: str = "cosine",
    payload: list[str] | None = None,
    exclude_equal: str | None = None,
    query_cols: list[str] | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """k nearest base rows per query: query id, query_cols, rank, neighbour id, dist, payload.

    ``exclude_equal`` names a column on both sides; pairs with equal values are not neighbours
    (the row id for self matches, a fold for cross-validation). Ties go to the smaller base id.
    """
    payload, query_cols = payload or [], query_cols or []
    extra_b = list(dict.fromkeys(payload + ([exclude_equal] if exclude_equal and exclude_equal != base_id else [])))
    extra_q = list(dict.fromkeys(query_cols + ([exclude_equal] if exclude_equal and exclude_equal != query_id else [])))
    b = _prepare(base, base_id, col, extra_b, metric, "b_")
    q = _prepare(queries, query_id, col, extra_q, metric, "q_")
    b_block = None if not exclude_equal else ("b_id" if exclude_equal == base_id else f"b_{exclude_equal}")
    q_block = None if not exclude_equal else ("q_id" if exclude_equal == query_id else f"q_{exclude_equal}")

    n, dim = _base_size(base, col)
    if n * dim * 8 <= broadcast_bytes:
        hits = _knn_shipped(q, b, k, payload, metric, b_block, q_block)
    else:
        hits = _knn_cells(q, b, k, n, metric, b_block, q_block, extra_b, extra_q)
    return hits.select(
        F.col("q_id").alias(query_id),
        *[F.col(f"q_{c}").alias(c if c not in payload else f"query_{c}") for c in query_cols],
        "rank",
        F.col("b_id").alias("neighbour"),
        "dist",
        *[F.col(f"b_{c}").alias(c) for c in payload],
    )


def _shipped_search(b: DataFrame, k: int, names: list[str], metric: str, b_block: str | None):
    """UDF (vector, mark) -> the k nearest base rows as structs; None when the base is empty.

    The caller has checked that the base fits ``broadcast_bytes``.
    """
    table = b.toArrow().sort_by("b_id")
    if table.num_rows == 0:
        return None
    item = T.StructType([b.schema["b_id"], T.StructField("dist", T.DoubleType())] + [b.schema[c] for c in names])
    matrix = to_matrix(table.column("b_vec"))[1]
    carried = [table.column(c).combine_chunks() for c in ["b_id"] + names]
    blocked_b = np.asarray(table.column(b_block).to_pylist()) if b_block else None

    def search(vectors: pa.Array, marks: pa.Array) -> pa.Array:
        valid, m = to_matrix(vectors)
        if not len(m):
            m = np.empty((0, matrix.shape[1]))
        if metric == "cosine":
            m = unit_rows(m)
        blocked = (np.asarray(marks.filter(pa.array(valid)).to_pylist()), blocked_b) if b_block else None
        val, pos = _topk(m, matrix, k, blocked)
        keep = np.isfinite(val)
        flat = pa.array(pos[keep])
        fields = [carried[0].take(flat), pa.array(_as_distance(val[keep], metric))]
        fields += [c.take(flat) for c in carried[1:]]
        structs = pa.StructArray.from_arrays(fields, names=["b_id", "dist"] + names)
        sizes = np.zeros(len(valid), dtype=np.int64)
        sizes[valid] = keep.sum(axis=1)
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, structs)

    return F.arrow_udf(search, T.ArrayType(item))


def _knn_shipped(q, b, k, payload, metric, b_block, q_block) -> DataFrame:
    names = [f"b_{c}" for c in payload]
    search = _shipped_search(b, k, names, metric, b_block)
    marks = F.col(q_block) if q_block else F.lit(0)
    if search is None:
        item = T.StructType([b.schema["b_id"], T.StructField("dist", T.DoubleType())] + [b.schema[c] for c in names])
        hits = F.lit(None).cast(T.ArrayType(item))
    else:
        hits = search(F.col("q_vec"), marks)
    found = q.withColumn("_hits", hits).drop("q_vec")
    out = found.select(*[c for c in found.columns if c != "_hits"], F.posexplode("_hits").alias("_p", "_h"))
    return out.select("*", (F.col("_p") + 1).alias("rank"), "_h.*").drop("_p", "_h")


def _assign_udf(pivots: np.ndarray):
    p2 = np.square(pivots).sum(axis=1)

    @F.arrow_udf("struct<cell: int, d: double>")
    def assign(vectors: pa.Array) -> pa.Array:
        valid, m = to_matrix(vectors)
        if not len(m):
            return pa.nulls(len(valid), pa.struct([("cell", pa.int32()), ("d", pa.float64())]))
        d2 = np.maximum(np.square(m).sum(axis=1)[:, None] + p2[None, :] - 2.0 * m @ pivots.T, 0.0)
        cell = d2.argmin(axis=1)
        exact = np.sqrt(np.square(m - pivots[cell]).sum(axis=1))
        return pa.StructArray.from_arrays(
            [spread(valid, cell.astype(np.int32)), spread(valid, exact)], names=["cell", "d"]
        )

    return assign


def _reach_udf(pivots: np.ndarray, radius: np.ndarray):
    """Cells other than the home cell that may hold something within the query's bound."""

    @F.arrow_udf("array<int>")
    def reach(vectors: pa.Array, home: pa.Array, bound: pa.Array) -> pa.Array:
        _, m = to_matrix(vectors)
        if not len(m):
            return pa.array([[]] * len(vectors), pa.list_(pa.int32()))
        p2 = np.square(pivots).sum(axis=1)
        d2 = np.square(m).sum(axis=1)[:, None] + p2[None, :] - 2.0 * m @ pivots.T
        d = np.sqrt(np.maximum(d2, 0.0))
        bounds = bound.to_numpy(zero_copy_only=False).astype(float)
        limit = np.where(np.isnan(bounds), np.inf, bounds * (1 + 1e-9) + 1e-6)
        near = (d - radius[None, :] <= limit[:, None]) & (radius >= 0)[None, :]
        near[np.arange(len(m)), home.to_numpy(zero_copy_only=False)] = False
        offsets = np.concatenate([[0], np.cumsum(near.sum(axis=1))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.nonzero(near)[1].astype(np.int32)))

    return reach


def _knn_cells(q, b, k, n, metric, b_block, q_block, extra_b, extra_q) -> DataFrame:
    count = int(min(MAX_PIVOTS, max(2, math.ceil(n / BLOCK_ROWS) * 2)))
    picked = b.select("b_vec", "b_id").orderBy(F.xxhash64("b_id"), "b_id").limit(count).toArrow()
    pivots = to_matrix(picked.column("b_vec"))[1]  # at most MAX_PIVOTS vectors

    assign = _assign_udf(pivots)
    bc = b.withColumn("_a", assign("b_vec")).select("*", "_a.cell", F.col("_a.d").alias("_d")).drop("_a")
    stats = bc.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("_d").alias("r")).collect()  # one row per pivot
    blocks = [1] * len(pivots)
    radius = np.full(len(pivots), -1.0)
    for row in stats:
        blocks[row["cell"]] = max(1, math.ceil(row["n"] / BLOCK_ROWS))
        radius[row["cell"]] = row["r"]
    n_blocks = F.element_at(F.array(*[F.lit(x) for x in blocks]), F.col("cell") + 1)
    based = bc.withColumn("blk", F.pmod(F.xxhash64("b_id"), n_blocks).cast("int")).drop("_d")

    qh = q.withColumn("_a", assign("q_vec")).select("*", F.col("_a.cell").alias("cell")).drop("_a")
    # narrow results and cell lists are written, so no search and no bound is computed twice
    home = materialize(_search_blocks(qh, based, blocks, k, b_block, q_block, extra_b, extra_q), "home-hits")
    at_k = Window.partitionBy("q_id").orderBy("d2", "b_id")
    kth = (
        home.withColumn("_rk", F.row_number().over(at_k)).where(F.col("_rk") <= k).where(F.col("_rk") == k)
        .select(F.col("q_id").alias("_kid"), F.sqrt("d2").alias("bound"))
    )
    reach = _reach_udf(pivots, radius)
    asked = qh.join(kth, F.col("q_id") == F.col("_kid"), "left").select(
        F.col("q_id").alias("_vid"), reach("q_vec", "cell", F.col("bound").cast("double")).alias("_cells")
    )
    asked = materialize(asked.where(F.size("_cells") > 0), "cell-lists")
    rest = qh.drop("cell").join(asked, F.col("q_id") == F.col("_vid")).withColumn("cell", F.explode("_cells")).drop("_vid", "_cells")
    visits = asked.select(F.explode("_cells").alias("cell"))
    away = _search_blocks(rest, based, blocks, k, b_block, q_block, extra_b, extra_q, visits)
    w = Window.partitionBy("q_id").orderBy("d2", "b_id")
    best = home.unionByName(away).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    dist = F.col("d2") / 2 if metric == "cosine" else F.sqrt("d2")
    return best.withColumn("dist", dist)


def _block_search(q_schema: T.StructType, b_schema: T.StructType, k: int, b_block, q_block, extra_b, extra_q):
    """Cogroup function, and its schema: the k nearest base rows of one block for every query of one block."""
    q_out = ["q_id"] + [f"q_{c}" for c in extra_q]
    b_out = ["b_id"] + [f"b_{c}" for c in extra_b]
    schema = T.StructType(
        [q_schema[c] for c in q_out] + [b_schema[c] for c in b_out] + [T.StructField("d2", T.DoubleType())]
    )

    def search(lt: pa.Table, rt: pa.Table) -> pa.Table:
        empty = pa.Table.from_arrays(
            [lt.column(c).slice(0, 0) for c in q_out] + [rt.column(c).slice(0, 0) for c in b_out] + [pa.array([], pa.float64())],
            names=q_out + b_out + ["d2"],
        )
        if lt.num_rows == 0 or rt.num_rows == 0:
            return empty
        rt = rt.sort_by("b_id")
        qm, bm = to_matrix(lt.column("q_vec"))[1], to_matrix(rt.column("b_vec"))[1]
        blocked = None
        if q_block:
            blocked = (np.asarray(lt.column(q_block).to_pylist()), np.asarray(rt.column(b_block).to_pylist()))
        val, pos = _topk(qm, bm, k, blocked)
        keep = np.isfinite(val).ravel()
        rows = pa.array(np.repeat(np.arange(len(qm)), pos.shape[1])[keep])
        cols = pa.array(pos.ravel()[keep])
        return pa.Table.from_arrays(
            [lt.column(c).take(rows) for c in q_out] + [rt.column(c).take(cols) for c in b_out] + [pa.array(val.ravel()[keep])],
            names=q_out + b_out + ["d2"],
        )

    return search, schema


def _search_blocks(visits, based, blocks, k, b_block, q_block, extra_b, extra_q, cells=None) -> DataFrame:
    """Top k inside every (cell, base block, query block) a visit names; ``cells`` is its narrow form."""
    narrow = visits.select("cell") if cells is None else cells
    per_cell = {
        row["cell"]: row["n"] for row in narrow.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()
    }  # one row per pivot
    q_blocks = [max(1, math.ceil(per_cell.get(c, 0) / BLOCK_ROWS)) for c in range(len(blocks))]
    nb = F.element_at(F.array(*[F.lit(x) for x in blocks]), F.col("cell") + 1)
    nq = F.element_at(F.array(*[F.lit(x) for x in q_blocks]), F.col("cell") + 1)
    left = visits.withColumn("qblk", F.pmod(F.xxhash64("q_id"), nq).cast("int")).withColumn(
        "blk", F.explode(F.sequence(F.lit(0), nb - 1))
    )
    right = based.withColumn("qblk", F.explode(F.sequence(F.lit(0), nq - 1)))
    search, schema = _block_search(visits.schema, based.schema, k, b_block, q_block, extra_b, extra_q)
    keys = ["cell", "blk", "qblk"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, schema)


# ---- hashed tables -------------------------------------------------------------------------------

PROBED_BITS = 10


def knn_hashed(
    queries: DataFrame,
    base: DataFrame,
    k: int,
    query_id: str = "sample_id",
    base_id: str = "sample_id",
    col: str = "embedding",
    payload: list[str] | None = None,
    exclude_equal: str | None = None,
    query_cols: list[str] | None = None,
    tables: int = 4,
    probes: int = 32,
    bits: int | None = None,
    seed: int = 0,
    exact_rest: bool = True,
) -> DataFrame:
    """k nearest base rows by cosine through random-projection tables, with a certificate for every query.

    A table's bucket is the signs of a unit vector's coordinates along ``bits`` orthonormal directions. A query visits its own bucket and
    the ``probes`` - 1 next ones in order of the squared margins of the signs they flip; that sum is a lower bound of the squared distance
    to everything in the bucket. A base row that no table has shown lies outside all visited buckets, so it is at least as far as the
    best table's first unvisited bucket: a query whose k-th distance is below that bound is certified exact. With ``exact_rest`` the
    others go through the exact cells and every row of the result is exact; without it their rows are approximate.

    Columns as ``knn`` plus ``certified``: that the tables alone have proven the query's neighbours.
    """
    payload, query_cols = payload or [], query_cols or []
    extra_b = list(dict.fromkeys(payload + ([exclude_equal] if exclude_equal and exclude_equal != base_id else [])))
    extra_q = list(dict.fromkeys(query_cols + ([exclude_equal] if exclude_equal and exclude_equal != query_id else [])))
    b = _prepare(base, base_id, col, extra_b, "cosine", "b_")
    q = _prepare(queries, query_id, col, extra_q, "cosine", "q_")
    b_block = None if not exclude_equal else ("b_id" if exclude_equal == base_id else f"b_{exclude_equal}")
    q_block = None if not exclude_equal else ("q_id" if exclude_equal == query_id else f"q_{exclude_equal}")
    n, dim = _base_size(base, col)
    dim = dim or _base_size(queries, col)[1]  # an empty base
    bits = max(1, min(bits or round(math.log2(max(2.0, n / 256))), dim or 1, 24))
    directions = _directions(dim, bits, tables if probes < 1 << bits else 1, seed)

    buckets = b.withColumn("cell", F.explode(_bucket_udf(directions)("b_vec")))
    sized = buckets.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("_nb"))
    probed = materialize(
        q.withColumn("_p", _probe_udf(directions, probes)("q_vec")).select("q_id", "q_vec", *[f"q_{c}" for c in extra_q], "_p.cells", "_p.bound"), "probes"
    )
    asked = probed.withColumn("cell", F.explode("cells")).drop("cells", "bound")
    per_cell = probed.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("_nq"))
    # one narrow row per bucket that has both sides: in how many blocks each side is cut
    cuts = materialize(sized.join(per_cell, "cell"), "bucket-blocks")
    left = asked.join(cuts, "cell").withColumn("qblk", F.pmod(F.xxhash64("q_id"), F.col("_nq")).cast("int"))
    left = left.withColumn("blk", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1))).drop("_nb", "_nq")
    right = buckets.join(cuts, "cell").withColumn("blk", F.pmod(F.xxhash64("b_id"), F.col("_nb")).cast("int"))
    right = right.withColumn("qblk", F.explode(F.sequence(F.lit(0), F.col("_nq") - 1))).drop("_nb", "_nq")
    search, schema = _block_search(left.schema, right.schema, k, b_block, q_block, extra_b, extra_q)
    keys = ["cell", "blk", "qblk"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, schema)
    # tables show the same base row again: its best row is kept, then the best k
    once = found.withColumn("_again", F.row_number().over(Window.partitionBy("q_id", "b_id").orderBy("d2"))).where("_again = 1").drop("_again")
    at_k = Window.partitionBy("q_id").orderBy("d2", "b_id")
    best = materialize(once.withColumn("rank", F.row_number().over(at_k)).where(F.col("rank") <= k), "hashed-hits")

    kth = best.where(F.col("rank") == k).select("q_id", F.sqrt("d2").alias("_kth"))
    proven = probed.select("q_id", "bound").join(kth, "q_id", "left")
    sure = F.col("bound").isNull() | (F.col("_kth") * (1 + 1e-9) + 1e-6 <= F.col("bound"))
    proven = materialize(proven.select("q_id", F.coalesce(sure, F.lit(False)).alias("certified")), "certificates")
    if exact_rest:
        rest = q.join(proven.where("NOT certified").select("q_id"), "q_id", "left_semi")
        exact = _knn_cells(rest, b, k, n, "cosine", b_block, q_block, extra_b, extra_q) if n else best
        kept = best.join(proven.where("certified").select("q_id"), "q_id", "left_semi")
        best = kept.withColumn("certified", F.lit(True)).unionByName(exact.select(*best.columns).withColumn("certified", F.lit(False)))
    else:
        best = best.join(proven, "q_id")
    return best.select(
        F.col("q_id").alias(query_id),
        *[F.col(f"q_{c}").alias(c if c not in payload else f"query_{c}") for c in query_cols],
        "rank",
        F.col("b_id").alias("neighbour"),
        (F.col("d2") / 2).alias("dist"),
        "certified",
        *[F.col(f"b_{c}").alias(c) for c in payload],
    )


def _directions(dim: int, bits: int, tables: int, seed: int) -> np.ndarray:
    """One orthonormal set of directions per table."""
    rng = np.random.default_rng(seed)
    return np.stack([np.linalg.qr(rng.normal(size=(max(dim, bits), bits)))[0].T for _ in range(tables)])


def _bucket_udf(directions: np.ndarray):
    weights = np.int64(1) << np.arange(directions.shape[1], dtype=np.int64)

    @F.arrow_udf("array<bigint>")
    def buckets(vectors: pa.Array) -> pa.Array:
        _, m = to_matrix(vectors)
        if not len(m):
            return pa.array([[]] * len(vectors), pa.list_(pa.int64()))
        cells = [((m @ d.T >= 0) @ weights) + (np.int64(t) << 32) for t, d in enumerate(directions)]
        return to_list_array(np.stack(cells, axis=1))

    return buckets


def _probe_udf(directions: np.ndarray, probes: int):
    """Buckets to visit in every table and the bound on the distance of what none of them holds; NULL where all are visited."""
    bits = directions.shape[1]
    free = min(bits, PROBED_BITS)
    probes = min(probes, 1 << free)
    subsets = (np.arange(1 << free)[:, None] >> np.arange(free)) & 1
    weights = np.int64(1) << np.arange(bits, dtype=np.int64)

    def table(m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        along = m @ d.T
        margin = np.square(along)
        near = np.argsort(margin, axis=1, kind="stable")
        cost = np.take_along_axis(margin, near[:, :free], axis=1) @ subsets.T
        order = np.argsort(cost, axis=1, kind="stable")
        chosen = order[:, :probes]
        flips = np.einsum("rpf,rf->rp", subsets[chosen], weights[near[:, :free]])
        left = np.full(len(m), np.inf)
        if probes < 1 << free:
            left = cost[np.arange(len(m)), order[:, probes]]
        if free < bits:
            left = np.minimum(left, np.take_along_axis(margin, near[:, free : free + 1], axis=1)[:, 0])
        return ((along >= 0) @ weights)[:, None] ^ flips, left

    @F.arrow_udf("struct<cells: array<bigint>, bound: double>")
    def probe(vectors: pa.Array) -> pa.Array:
        _, m = to_matrix(vectors)
        cells = np.zeros((len(vectors), len(directions) * probes), np.int64)
        bound = np.zeros(len(vectors))
        for at in range(0, len(m), 1024):
            part = m[at : at + 1024]
            for t, d in enumerate(directions):
                found, left = table(part, d)
                cells[at : at + 1024, t * probes : (t + 1) * probes] = found + (np.int64(t) << 32)
                bound[at : at + 1024] = np.maximum(bound[at : at + 1024], left)
        bounds = pa.array(np.sqrt(bound), mask=np.isinf(bound))
        return pa.StructArray.from_arrays([to_list_array(cells), bounds], names=["cells", "bound"])

    return probe


def knn_vote(hits: DataFrame, query_id: str, label: str, ks: list[int], keep: list[str] | None = None) -> DataFrame:
    """Majority label among the first k neighbours, for several k; equal counts go to the smaller label."""
    keep = keep or []
    counted = (
        hits.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
        .where(F.col("rank") <= F.col("k"))
        .groupBy(query_id, *keep, "k", label)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    best = F.max_by(F.col(label), F.struct(F.col("_n"), -F.col(label)))
    return counted.groupBy(query_id, *keep, "k").agg(best.alias("predicted"))


def _base_size(base: DataFrame, col: str) -> tuple[int, int]:
    size = base.where(F.col(col).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.max(F.size(col)).alias("d")).first()
    return size["n"], size["d"] or 0


def nearest_one(
    df: DataFrame, base: DataFrame, df_id: str, base_id: str, col: str, base_col: str, out_id: str, out_sim: str,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Add the id and cosine similarity of the closest base row; NULL when there is none.

    A base that fits adds a column in place; a larger one goes through the cells and is joined back.
    """
    right = base.select(F.col(base_id).alias("_bid"), F.col(base_col).alias(col))
    n, dim = _base_size(right, col)
    if n * dim * 8 <= broadcast_bytes:
        search = _shipped_search(_prepare(right, "_bid", col, [], "cosine", "b_"), 1, [], "cosine", None)
        if search is None:
            kind = base.schema[base_id].dataType
            return df.withColumn(out_id, F.lit(None).cast(kind)).withColumn(out_sim, F.lit(None).cast("double"))
        best = F.get(search(F.col(col).cast("array<double>"), F.lit(0)), F.lit(0))
        staged = df.withColumn("_best", best)
        return staged.withColumn(out_id, F.col("_best.b_id")).withColumn(out_sim, F.lit(1.0) - F.col("_best.dist")).drop("_best")
    hits = knn(df, right, 1, query_id=df_id, base_id="_bid", col=col, broadcast_bytes=broadcast_bytes)
    found = hits.select(
        F.col(df_id).alias("_qid"), F.col("neighbour").alias(out_id), (F.lit(1.0) - F.col("dist")).alias(out_sim)
    )
    return df.join(found, F.col(df_id) == F.col("_qid"), "left").drop("_qid")
