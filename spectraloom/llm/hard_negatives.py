"""Hard negatives in score windows, found through a multiway hyperplane tree.

Scores are integer inner products. With one more component, sqrt(M**2 - |b|**2) where M is the greatest norm, all rows lie at distance
sqrt(|a|**2 + M**2 - 2 * score) of an anchor a, so a window of scores is an annulus around the anchor. The upper splits of the tree are fitted on at most
``SAMPLE`` rows (they decide only what can be left out), and every row is put below them; the distance ranges between pivots and subtrees come from
all rows. Cells are cut into blocks by row number; a task continues the tree inside its block and compares in its leaves the integer scores of all
rows that no range excludes. Windows shrink as a block's better rows are found. Each block returns at most ``count`` rows per window.

First an anchor's positives: its own cell gives a bound, then all cells within it. Then, for each positive, the rows of other labels in its window.
On data without any structure no range excludes much, and the work is that of comparing the anchors with all rows, in blocks.

Defined results. Rows with a null id, label or vector, or with a null or non-finite component, take no part. Shorter vectors are read as if filled with
zeros; components beyond +-2**24 steps count as +-2**24. Repeated rows are rows of their own: each may be a positive or negative of the other,
and each anchor row gives its own rows. Equal scores go by id. A positive of a negative score has no window. Empty table: empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.llm.common import stored
from spectraloom.llm.hyperplane_tree import FANOUT, Tree
from spectraloom.llm.integer_vectors import finite_rows, integers

SAMPLE = 4_096
CELL_ROWS = 2_048
BLOCK_ROWS = 8_192
LEAF_ROWS = 256
DEEPEST = 3
LEAST = -(1 << 62)


def _quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        places, flat, lengths = finite_rows(batch.column(3))
        if len(places):
            q = integers(flat)
            ends = np.cumsum(lengths)
            norm2 = np.add.reduceat(np.r_[np.square(q.astype(np.int64)), 0], np.minimum(ends - lengths, len(q)))
            norm2[lengths == 0] = 0
            raw = pa.Array.from_buffers(pa.binary(), len(places), [None, pa.py_buffer(np.r_[0, 4 * ends].astype(np.int32)), pa.py_buffer(q)])
            kept = batch.select([0, 1, 2]).take(pa.array(places))
            yield pa.RecordBatch.from_arrays([*kept.columns, raw, pa.array(norm2)], ["row", "vec_id", "label", "q", "norm2"])


def _matrix(column, dim: int) -> np.ndarray:
    """Integer rows, filled with zeros up to ``dim``."""
    rows = column.to_pylist()
    out = np.zeros((len(rows), dim), np.int32)
    for n in {len(r) for r in rows}:
        at = [i for i, r in enumerate(rows) if len(r) == n]
        out[at, : n // 4] = np.frombuffer(b"".join(rows[i] for i in at), np.int32).reshape(len(at), n // 4)
    return out


def _lifted(q: np.ndarray, top2: int, query: bool = False) -> np.ndarray:
    """Rows with the component that gives all of them the same norm (queries: zero)."""
    x = q.astype(float)
    more = np.zeros(len(x)) if query else np.sqrt(np.maximum(top2 - np.square(x).sum(axis=1), 0))
    return np.column_stack([x, more])


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    top = (np.abs(a.astype(np.int64)).max(initial=0) * np.abs(b.astype(np.int64)).max(initial=0)).item() * a.shape[1]
    if top < 1 << 53:
        return np.rint(a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


class Index:
    """The rows below the upper splits, with exact ranges; ``rows`` has cell, block, row, vec_id, label, q, norm2."""

    def __init__(self, vectors: DataFrame, id_col: str, label: Column, col: str):
        given = vectors.select(
            F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"),
            F.col(col).cast("array<double>").alias("x"),
        ).where("vec_id IS NOT NULL AND label IS NOT NULL")
        base = stored(given.mapInArrow(_quantise, "row long, vec_id long, label long, q binary, norm2 long"), "negatives-integers")
        facts = base.agg(F.count(F.lit(1)), F.max("norm2"), F.max(F.octet_length("q"))).first()
        self.count, self.top2, self.dim = facts[0], facts[1] or 0, (facts[2] or 0) // 4
        sample = base.orderBy(F.xxhash64("vec_id", "row"), "row").limit(SAMPLE).select("q").toArrow().column("q")
        points = _lifted(_matrix(sample, self.dim), self.top2)
        depth = min(DEEPEST, math.ceil(math.log(max(1, self.count / CELL_ROWS), FANOUT)))
        self.tree = Tree(points, 4 * FANOUT, depth)
        self._measure(base)
        tree, top2, dim = self.tree, self.top2, self.dim

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell = tree.route(_lifted(_matrix(batch.column(3), dim), top2)) if batch.num_rows else np.zeros(0)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), *batch.columns], ["cell", *batch.schema.names])

        self.rows = stored(base.mapInArrow(place, "cell int, row long, vec_id long, label long, q binary, norm2 long"), "negatives-cells")
        sizes = {r["cell"]: r["count"] for r in self.rows.groupBy("cell").count().collect()}  # at most FANOUT ** DEEPEST cells
        self.blocks = [math.ceil(sizes.get(c, 0) / BLOCK_ROWS) for c in range(self.tree.cells)]

    def _measure(self, base: DataFrame) -> None:
        """Ranges from all rows: each task's ranges are combined in Spark."""
        tree, top2, dim = self.tree, self.top2, self.dim

        def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    tree.route(_lifted(_matrix(batch.column(0), dim), top2), note=True)
            for at, low in enumerate(tree.low):
                i, j = np.nonzero(np.isfinite(low))
                split = np.full(len(i), at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v.astype(np.int32)) for v in (split, i, j)] + [pa.array(low[i, j]), pa.array(tree.high[at][i, j])], ["split", "i", "j", "low", "high"]
                )

        parts = base.select("q").mapInArrow(ranges, "split int, i int, j int, low double, high double")
        for r in parts.groupBy("split", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
            tree.low[r["split"]][r["i"], r["j"]], tree.high[r["split"]][r["i"], r["j"]] = r["low"], r["high"]

    def cells_of(self, asked: DataFrame) -> DataFrame:
        """One row per query and cell that no range excludes."""
        tree, top2, dim = self.tree, self.top2, self.dim
        names = asked.columns

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                q = _matrix(batch.column(names.index("q")), dim)
                annuli = Annuli(q, batch.column(names.index("low")), batch.column(names.index("high")), top2)
                for cell, rows in tree.search(annuli.points, annuli.near, annuli.far, annuli.slack):
                    kept = batch.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), cell, np.int32)), *kept.columns], ["cell", *names])

        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema.fields)
        return asked.mapInArrow(visit, f"cell int, {fields}")

    def search(self, visits: DataFrame, same: bool, count: int) -> DataFrame:
        """a_row, window, score, vec_id, row, place: the ``count`` best rows per query and window, of the same or of other labels."""
        visits = stored(visits, "negatives-visits")
        asked = {r["cell"]: r["count"] for r in visits.groupBy("cell").count().collect()}  # one row per cell
        per_cell = lambda n: F.element_at(F.array(*[F.lit(int(x)) for x in n]), F.col("cell") + 1)
        groups = per_cell([max(1, math.ceil(asked.get(c, 0) / BLOCK_ROWS)) for c in range(self.tree.cells)])
        blocks = per_cell(self.blocks)
        number = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        left = visits.where(blocks > 0).withColumn("part", F.pmod(F.xxhash64("a_row"), groups).cast("int")).withColumn("block", number(blocks))
        right = self.rows.withColumn("block", F.pmod(F.xxhash64("row"), blocks).cast("int")).withColumn("part", number(groups))
        found = left.groupBy("cell", "block", "part").cogroup(right.groupBy("cell", "block", "part")).applyInArrow(
            _searcher(self.top2, self.dim, same, count), "a_row long, window int, score long, vec_id long, row long"
        )
        order = Window.partitionBy("a_row", "window").orderBy(F.col("score").desc(), "vec_id", "row")
        return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= count)


class Annuli:
    """Queries with windows of scores as annuli; the lower end of a window may rise."""

    def __init__(self, q: np.ndarray, low: pa.Array, high: pa.Array, top2: int):
        self.points = _lifted(q, top2, query=True)
        lows, highs = low.to_pylist(), high.to_pylist()
        width = max(map(len, lows), default=0)
        self.low = np.array([x + [1] * (width - len(x)) for x in lows], np.int64).reshape(len(lows), width)
        self.high = np.array([x + [0] * (width - len(x)) for x in highs], np.int64).reshape(len(highs), width)
        self.sum2 = np.square(self.points).sum(axis=1) + top2
        self.slack = 1e-6 * np.sqrt(self.sum2) + 1e-6
        none = self.low > self.high
        self.near = np.where(none, np.inf, self._radius(self.high, self.sum2))

    @staticmethod
    def _radius(score: np.ndarray, sum2: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(sum2[:, None] - 2.0 * score, 0))

    def far(self, rows: np.ndarray) -> np.ndarray:
        return self._radius(self.low[rows], self.sum2[rows])


def _searcher(top2: int, dim: int, same: bool, count: int):
    names = ["a_row", "window", "score", "vec_id", "row"]

    def search(lt: pa.Table, rt: pa.Table) -> pa.Table:
        found = [np.zeros((0, 5), np.int64)]
        if lt.num_rows and rt.num_rows:
            rt = rt.sort_by([("vec_id", "ascending"), ("row", "ascending")])
            b, ids, rows, labels = _matrix(rt.column("q"), dim), *(rt.column(c).to_numpy() for c in ("vec_id", "row", "label"))
            q, a_rows, a_labels = _matrix(lt.column("q"), dim), *(lt.column(c).to_numpy() for c in ("a_row", "label"))
            annuli = Annuli(q, lt.column("low"), lt.column("high"), top2)
            points = _lifted(b, top2)
            tree = Tree(points, LEAF_ROWS, depth=20)
            cell = tree.route(points, note=True)
            order = np.argsort(cell, kind="stable")
            starts = np.searchsorted(cell[order], np.arange(tree.cells + 1))
            for c, asked in tree.search(annuli.points, annuli.near, annuli.far, annuli.slack):
                leaf = order[starts[c] : starts[c + 1]]
                for at in range(0, len(leaf), LEAF_ROWS):
                    here = leaf[at : at + LEAF_ROWS]
                    score = _scores(q[asked], b[here])
                    alike = a_labels[asked][:, None] == labels[here]
                    fit = alike & (a_rows[asked][:, None] != rows[here]) if same else ~alike
                    for w in range(annuli.low.shape[1]):
                        i, j = _best(score, fit, annuli, asked, w, count)
                        found.append(np.column_stack([a_rows[asked[i]], np.full(len(i), w), score[i, j], ids[here[j]], rows[here[j]]]))
        out = np.concatenate(found)
        out = out[np.lexsort((out[:, 4], out[:, 3], -out[:, 2], out[:, 1], out[:, 0]))]
        head = np.r_[True, (out[1:, :2] != out[:-1, :2]).any(axis=1)][: len(out)]
        place = np.arange(len(out)) - np.maximum.accumulate(np.where(head, np.arange(len(out)), 0))
        out = out[place < count]
        return pa.table([pa.array(out[:, 0]), pa.array(out[:, 1].astype(np.int32)), *[pa.array(out[:, k]) for k in (2, 3, 4)]], names=names)

    return search


def _best(score: np.ndarray, fit: np.ndarray, annuli: Annuli, asked: np.ndarray, w: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ``count`` best rows per query in a window; raises the window's lower end where the rows allow it."""
    low, high = annuli.low[asked, w], annuli.high[asked, w]
    held = np.where(fit & (score >= low[:, None]) & (score <= high[:, None]), score, LEAST)
    if held.shape[1] <= count:
        return np.nonzero(held > LEAST)
    kth = np.partition(held, held.shape[1] - count, axis=1)[:, held.shape[1] - count]
    annuli.low[asked, w] = np.maximum(low, kth)
    keep = (held > LEAST) & (held >= kth[:, None])
    crowded = np.flatnonzero(keep.sum(axis=1) > count)  # equal scores: the smaller ids
    if len(crowded):
        first = np.argsort(-held[crowded], axis=1, kind="stable")[:, :count]
        keep[crowded] = False
        keep[crowded[:, None], first] = True
    return np.nonzero(keep)


def mine(
    vectors: DataFrame, label: Column, anchor: Column, positives: int = 5, negatives: int = 5, least_percent: int = 80,
    id_col: str = "vec_id", col: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``label`` and ``anchor`` (boolean) are expressions on the input and on ``vec_id``.
    """
    index = Index(vectors, id_col, label, col)
    anchors = index.rows.where(anchor).select("cell", F.col("row").alias("a_row"), F.col("vec_id").alias("anchor_id"), "label", "q")
    whole = anchors.select("cell", "a_row", "label", "q", F.array(F.lit(LEAST)).alias("low"), F.array(F.lit(-LEAST)).alias("high"))
    home = stored(index.search(whole, True, positives), "negatives-home")
    bound = home.where(F.col("place") == positives).select(F.col("a_row").alias("b_row"), "score")
    asked = whole.join(bound, F.col("a_row") == F.col("b_row"), "left").select(
        F.col("cell").alias("own"), "a_row", "label", "q", F.array(F.coalesce("score", F.lit(LEAST))).alias("low"), "high"
    )
    away = index.search(index.cells_of(asked).where("cell <> own").drop("own"), True, positives)
    order = Window.partitionBy("a_row").orderBy(F.col("score").desc(), "vec_id", "row")
    both = home.unionByName(away).withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    found = stored(both.select("a_row", (F.col("place") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")
    # a negative score has no window, and such positives come last
    lowest = F.expr(f"({least_percent} * positive_score + 99) div 100")
    window = F.struct("window", lowest.alias("low"), F.col("positive_score").alias("high"))
    windows = found.where("positive_score >= 0").groupBy("a_row").agg(F.array_sort(F.collect_list(window)).alias("w"))
    wanted = windows.select(F.col("a_row").alias("w_row"), F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    asked = anchors.join(wanted, F.col("a_row") == F.col("w_row")).select("a_row", "label", "q", "low", "high")
    hits = stored(index.search(index.cells_of(asked), False, negatives), "negatives-hits")
    named = anchors.select(F.col("a_row").alias("n_row"), "anchor_id")
    out = hits.join(found.withColumnsRenamed({"a_row": "p_row", "window": "p_window"}), (F.col("a_row") == F.col("p_row")) & (F.col("window") == F.col("p_window")))
    return out.join(named, F.col("a_row") == F.col("n_row")).select(
        "anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
