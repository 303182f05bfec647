"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is a minimum per node (combined before the shuffle) joined back to the edges, so a hub with most of the
edges is one pre-aggregated row on one side and a skewed, splittable join on the other. Each round is written to the shared
folder; only a count and a checksum of the edges come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.llm.common import stored


def _with_least(edges: DataFrame) -> DataFrame:
    """Each edge (u, v) with m, the least of u and all its neighbours."""
    least = edges.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("low"))
    return edges.join(least, F.col("u") == F.col("k")).select("u", "v", F.least("u", "low").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    starred = _with_least(down)
    pair = F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
    return starred.select(pair.alias("p")).select("p.u", "p.v").where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum((F.xxhash64("u", "v") % 1_000_000_007).cast("long"))).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges``: columns u, v (long), in any direction, repeats allowed. Returns node, root (least node reachable)."""
    edges = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(edges)
    for _ in range(max_rounds):
        if not state[0]:
            break
        edges = stored(_small_star(_large_star(edges)), "edges")
        before, state = state, _state(edges)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
