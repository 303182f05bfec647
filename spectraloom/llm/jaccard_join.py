"""Exact Jaccard join of word n-gram sets in size-banded tiles, with bitmap bounds before the sorted arrays are intersected.

Equal sets are one class from the start. Classes that share a partition key (``shingle_sets``) may be linked; nothing else can be. They are compared as follows.

1. Every class of a key is proposed with the key's first class. A group of near copies mostly ends here, after as many comparisons as it has members times
   a small number.
2. Keys that still hold classes of different components go to tiles. What such keys connect is a group; its classes are cut by size into bands, a band
   into blocks of bounded rows and bytes, and every pair of blocks of the same or neighbouring bands is a task. Classes already connected are not compared.
   Tiles of bitmaps find the classes that may be linked at all; only these are tiled again with their arrays.

Every comparison asks the bitmaps first and intersects only where their bound allows a link. No task returns more than a spanning set of its links. Only arrays of
classes that a bitmap could not rule out leave their document.

Defined results. A text without words (null, empty) has an empty set and is linked with nothing; its component is its own id. Null ids lose to any
other in their component. Repeated rows share a component. Shingles and sets are told apart by 64-bit hashes. Empty table: empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.llm import shingle_sets as S
from spectraloom.llm.common import discard, shippable, stored, whole
from spectraloom.llm.components import connected_components

BLOCK_ROWS = 2_048
BLOCK_BYTES = 8 << 20
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark, rows: int = 500):
    """Arrow batches of few rows while arrays of whole texts are handed over."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def _described(rule: S.Rule, fingerprints: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [rule.shingles(t.as_py()) for t in part.column(1)]
                keys = [rule.keys(s) if len(s) else np.zeros(0, np.int64) for s in sets]
                ends = np.r_[0, np.cumsum([len(k) for k in keys])].astype(np.int32)
                codes = [pa.array([S.fingerprint(s) for s in sets], pa.int64())] if fingerprints else []
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([S.set_id(s) for s in sets], pa.int64()),
                        pa.array([S.bitmap(s).tobytes() if len(s) else b"" for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys))), *codes,
                    ],
                    ["doc_id", "n", "cls", "bits", "keys", "code"][: 5 + len(codes)],
                )

    return run


def _arrays(rule: S.Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                sets = [rule.shingles(t.as_py()) for t in batch.column(0).slice(at, 500)]
                yield pa.RecordBatch.from_arrays([pa.array([S.set_id(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["cls", "hashes"])

    return run


def _possible(rule: S.Rule):
    """Whether the bitmaps of two sets allow a link."""

    def run(a: pa.Array, b: pa.Array, n: pa.Array, m: pa.Array) -> pa.Array:
        out = []
        for x, y, total in zip(a, b, (n.to_numpy(zero_copy_only=False) + m.to_numpy(zero_copy_only=False)).tolist()):
            bound = S.overlap_bound(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), total)
            out.append(rule.linked(bound, total))
        return pa.array(out, pa.bool_())

    return F.arrow_udf(run, "boolean")


def _linked(rule: S.Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                hits.append(bool(rule.linked(S.overlap(a, b), len(a) + len(b))))
            yield batch.select([0, 1]).filter(pa.array(hits, pa.bool_()))

    return run


class _Tile:
    """Classes of a tile, the left side first; two sides, or one compared with itself."""

    def __init__(self, rule: S.Rule, table: pa.Table):
        cls, n, left = (table.column(c).to_numpy() for c in ("cls", "n", "is_left"))
        order = np.lexsort((cls, n, ~left))
        self.rule, self.cls, self.n, self.sides = rule, cls[order], n[order], int(left.sum())
        self.order = pa.array(order)
        bits = [np.frombuffer(x, np.uint64) for x in table.column("bits").take(self.order).to_pylist()]
        words = min(map(len, bits))
        self.maps = np.stack([S.folded(b, words) for b in bits])
        self.part = np.unique(table.column("root").to_numpy()[order], return_inverse=True)[1]

    def rows(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each left class with those of other components that its bitmap does not rule out."""
        for i in range(self.sides):
            first = i + 1 if self.sides == len(self.cls) else self.sides
            if first == len(self.cls):
                break
            differ = np.bitwise_count(self.maps[first:] ^ self.maps[i]).sum(axis=1, dtype=np.int64)
            total = self.n[first:] + self.n[i]
            yield i, np.flatnonzero(self.rule.linked((total - differ) // 2, total) & (self.part[first:] != self.part[i])) + first


def _bit_tile(rule: S.Rule):
    """The classes of a tile that bitmaps allow to be linked across components."""

    def run(table: pa.Table) -> pa.Table:
        tile = _Tile(rule, table)
        seen = np.zeros(len(tile.cls), bool)
        for i, others in tile.rows():
            seen[others] = True
            seen[i] |= len(others) > 0
        return pa.table([pa.array(tile.cls[seen])], names=["cls"])

    return run


def _array_tile(rule: S.Rule):
    """Spanning links between the classes of a tile that are not connected yet."""

    def run(table: pa.Table) -> pa.Table:
        tile = _Tile(rule, table)
        sets = [np.frombuffer(x, np.uint64) for x in table.column("hashes").take(tile.order).to_pylist()]
        part, links = tile.part, []
        for i, others in tile.rows():
            for j in others:
                if part[j] != part[i] and rule.linked(S.overlap(sets[i], sets[j]), tile.n[i] + tile.n[j]):
                    part[part == part[j]] = part[i]
                    links.append((tile.cls[i], tile.cls[j]))
        pairs = np.array(links, np.int64).reshape(-1, 2)
        return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    return run


class Join:
    """The stages over one table; ``rows`` has doc_id, n, cls, bits, keys and, if asked for, a 64-bit code of every document."""

    def __init__(self, docs: DataFrame, rule: S.Rule, id_col: str, text_col: str, fingerprints: bool = False):
        self.rule, self.spark = rule, docs.sparkSession
        self.texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"))
        shape = "doc_id long, n long, cls long, bits binary, keys array<long>" + (", code long" if fingerprints else "")
        self.rows = stored(self.texts.mapInArrow(_described(rule, fingerprints), shape), "jaccard-sets")
        self.scratch = [self.rows]

    def _stored(self, df: DataFrame, name: str) -> DataFrame:
        out = stored(df, name)
        self.scratch.append(out)
        return out

    def links(self, proposals: DataFrame | None = None) -> DataFrame:
        """Links (u, v) between classes that connect whatever is linked.

        ``proposals`` (u, v) are checked first; of the pairs that keys give, those that they have already connected are not compared.
        """
        keyed = self.rows.select("cls", F.explode("keys").alias("key"))
        shared = self._stored(keyed.groupBy("key").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo < hi").select("key", "lo"), "jaccard-shared")
        members = self._stored(keyed.join(shared, "key").select("key", "lo", "cls").distinct(), "jaccard-members")
        pairs = members.where("cls <> lo").select(F.col("lo").alias("u"), F.col("cls").alias("v")).distinct()
        ends = members.select("cls")
        if proposals is not None:
            ends = ends.unionAll(proposals.select("u")).unionAll(proposals.select("v"))
        self.classes = self._stored(
            self.rows.join(ends.distinct(), "cls", "left_semi").groupBy("cls").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.min("doc_id").alias("least")),
            "jaccard-classes",
        )
        if proposals is None:
            found = self._checked(pairs)
        else:
            early = self._checked(proposals.select("u", "v"))
            found = early.unionAll(self._checked(self._apart(pairs, connected_components(early))))
        return found.unionAll(self._tiled(members, connected_components(found)))

    @staticmethod
    def _apart(pairs: DataFrame, named: DataFrame) -> DataFrame:
        """The pairs whose classes lie in different components of ``named`` (node, root)."""
        a, b = (named.select(F.col("node").alias(f"{k}_node"), F.col("root").alias(f"{k}_root")) for k in "uv")
        placed = pairs.join(a, F.col("u") == F.col("u_node"), "left").join(b, F.col("v") == F.col("v_node"), "left")
        return placed.where("u_root IS NULL OR v_root IS NULL OR u_root <> v_root").select("u", "v")

    def _arrays_of(self, some: DataFrame) -> DataFrame:
        """cls, hashes of the classes ``some``, one row each."""
        some = self._stored(some.select("cls").distinct(), "jaccard-needed")
        ids = shippable(self.classes.join(some, "cls", "left_semi").select(F.col("least").alias("rep")).distinct())
        texts = self.texts.join(ids, self.texts["doc_id"].eqNullSafe(ids["rep"]), "left_semi").select("text")
        arrays = texts.mapInArrow(_arrays(self.rule), "cls long, hashes binary").join(some, "cls", "left_semi")
        return self._stored(arrays.dropDuplicates(["cls"]), "jaccard-arrays")

    def _checked(self, pairs: DataFrame) -> DataFrame:
        """The pairs that are linked: bitmaps first, then the arrays."""
        u, v = (self.classes.select(F.col("cls").alias(k), F.col("n").alias(f"{k}_n"), F.col("bits").alias(f"{k}_bits")) for k in "uv")
        fits = F.expr(f"100 * least(u_n, v_n) >= {self.rule.percent} * greatest(u_n, v_n)")
        may = pairs.join(u, "u").join(v, "v").where(fits).where(_possible(self.rule)("u_bits", "v_bits", "u_n", "v_n")).select("u", "v")
        with small_batches(self.spark):
            may = self._stored(may, "jaccard-possible")
            arrays = self._arrays_of(may.select(F.col("u").alias("cls")).unionAll(may.select(F.col("v").alias("cls"))))
            a, b = (arrays.select(F.col("cls").alias(k), F.col("hashes").alias(f"{k}_set")) for k in "uv")
            both = may.join(b, "v").join(a, "u").select("u", "v", "u_set", "v_set")
            return self._stored(both.mapInArrow(_linked(self.rule), "u long, v long"), "jaccard-links")

    def _tiled(self, members: DataFrame, named: DataFrame) -> DataFrame:
        """Links inside keys of three and more classes that hold several components."""
        placed = members.join(named, F.col("cls") == F.col("node"), "left").select("key", "lo", "cls", F.coalesce("root", "cls").alias("root"))
        placed = self._stored(placed, "jaccard-placed")
        mixed = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("n > 2 AND low < high")
        open_ = self._stored(placed.join(mixed.select("key"), "key", "left_semi").select("lo", "cls", "root").distinct(), "jaccard-open")
        groups = connected_components(open_.where("cls <> lo").select(F.col("lo").alias("u"), F.col("cls").alias("v")).distinct())
        groups = groups.select(F.col("node").alias("cls"), F.col("root").alias("grp"))
        width = math.log(100 / self.rule.percent) * 1.0001  # linked sizes lie in one band or in neighbours
        cells = open_.select("cls", "root").distinct().join(groups, "cls").join(self.classes.select("cls", "n", "bits"), "cls")
        cells = self._stored(cells.withColumn("band", F.floor(F.log("n") / width).cast("int")), "jaccard-cells")
        by = ["grp", "b1", "i1", "b2", "i2"]
        near = self._stored(self._spread(cells, F.octet_length("bits")).groupBy(*by).applyInArrow(_bit_tile(self.rule), "cls long").distinct(), "jaccard-near")
        some = self._stored(cells.join(near, "cls", "left_semi"), "jaccard-cells")
        spread = self._spread(some, 8 * F.col("n")).join(self._arrays_of(near), "cls")
        return self._stored(spread.groupBy(*by).applyInArrow(_array_tile(self.rule), "u long, v long"), "jaccard-links")

    def _spread(self, cells: DataFrame, size: Column) -> DataFrame:
        """Every class once per tile it belongs to: grp, b1, i1, b2, i2 name the tile by group, bands and blocks."""
        sizes = cells.groupBy("grp", "band").agg(F.count(F.lit(1)).alias("rows"), F.sum(size).alias("bytes")).select(
            "grp", "band", F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks")
        )
        sizes = self._stored(sizes, "jaccard-sizes")
        shifted = lambda by, name: sizes.select("grp", (F.col("band") - by).alias("band"), F.col("blocks").alias(name))
        known = sizes.join(shifted(1, "after"), ["grp", "band"], "left").join(shifted(-1, "before"), ["grp", "band"], "left")
        block = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
        numbers = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
        tile = lambda b1, i1, b2, i2, left: F.struct(b1.alias("b1"), i1.alias("i1"), b2.alias("b2"), i2.alias("i2"), left.alias("is_left"))
        band, yes, no = F.col("band"), F.lit(True), F.lit(False)
        tiles = F.concat(
            F.transform(numbers("blocks"), lambda j: tile(band, F.least(j, F.col("block")), band, F.greatest(j, F.col("block")), j >= F.col("block"))),
            F.transform(numbers("after"), lambda j: tile(band, F.col("block"), band + 1, j, yes)),
            F.transform(numbers("before"), lambda j: tile(band - 1, j, band, F.col("block"), no)),
        )
        spread = cells.join(known, ["grp", "band"]).withColumn("block", block).select("cls", "root", "grp", "n", "bits", F.explode(tiles).alias("t"))
        return spread.select("cls", "root", "grp", "n", "bits", "t.*")

    def components(self, links: DataFrame) -> DataFrame:
        """doc_id, n, component_id of every document."""
        named = connected_components(links).join(self.classes.select("cls", "least"), F.col("node") == F.col("cls"))
        lowest = named.groupBy("root").agg(F.min("least").alias("lowest"))
        linked = named.join(lowest, "root").select(F.col("cls").alias("c"), "lowest")
        own = self.rows.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"))
        of_class = own.join(linked, F.col("cls") == F.col("c"), "left").select(F.col("cls").alias("k"), F.coalesce("lowest", "least").alias("component_id"))
        found = self.rows.where("n > 0").join(of_class, F.col("cls") == F.col("k")).select("doc_id", "n", "component_id")
        return found.unionAll(self.rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))

    def finish(self, result: DataFrame) -> DataFrame:
        """The result, written, and everything else removed."""
        out = stored(result, "jaccard-result")
        for df in self.scratch:
            discard(df)
        return out


def join_components(docs: DataFrame, words: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every document; component_id is the least id reachable by links."""
    join = Join(docs, S.Rule(words, percent), id_col, text_col)
    return join.finish(join.components(join.links()).withColumnRenamed("n", "n_shingles"))
