"""How good an embedding space is: probes, silhouette, clusters, collapse, normality, alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectraloom.functions.rows import attach_row
from spectraloom.functions import vectors as V
from spectraloom.functions.arrow import to_list_array, to_matrix, unit_rows
from spectraloom.operators.moments import merge_sums, scatter, vector_totals
from spectraloom.operators.sampling import hash_int, kfold
from spectraloom.session import materialize

CHUNK_BYTES = 64 << 20
SILHOUETTE_BLOCK = 32_768
TILE = 128, 2_048  # rows of both sides whose distances are held at once


def _vec(col: str) -> Column:
    return array_to_vector(F.col(col).cast("array<double>"))


# ---- probes -------------------------------------------------------------------------------------


def fit_probe(train: DataFrame, label: str, col: str = "embedding", c: float = 1.0, max_iter: int = 500, weight: str | None = None):
    """Logistic regression with L2 strength 1/(C n), as distributed Spark ML training."""
    n = train.count()
    model = LogisticRegression(
        featuresCol="_x", labelCol="_y", regParam=1.0 / (c * max(n, 1)), standardization=False, maxIter=max_iter,
        predictionCol="predicted", probabilityCol="_p",
    )
    if weight:
        model = model.setWeightCol(weight)
    return model.fit(train.withColumn("_x", _vec(col)).withColumn("_y", F.col(label).cast("double")))


def apply_probe(model, df: DataFrame, col: str = "embedding") -> DataFrame:
    scored = model.transform(df.withColumn("_x", _vec(col)))
    return scored.withColumn("probabilities", vector_to_array("_p")).drop("_x", "_p", "rawPrediction")


def linear_probe(train: DataFrame, test: DataFrame, label: str, col: str = "embedding") -> DataFrame:
    """Accuracy and recall of each class on the test rows."""
    scored = apply_probe(fit_probe(train, label, col), test, col)
    right = (F.col("predicted") == F.col(label).cast("double")).cast("double")
    return scored.withColumn("_r", right).rollup(label).agg(
        F.count(F.lit(1)).alias("n"), F.avg("_r").alias("recall"), F.grouping(label).cast("long").alias("is_total")
    )


def probe_cv(df: DataFrame, label: str, id_col: str, folds: int, seed: int, col: str = "embedding") -> DataFrame:
    """Accuracy per fold of a stratified cross-validation; folds are few and independent fits."""
    dealt = kfold(df, id_col, folds, seed, stratify=label)
    out = None
    for fold in range(folds):
        model = fit_probe(dealt.where(F.col("fold") != fold), label, col)
        right = (F.col("predicted") == F.col(label).cast("double")).cast("double")
        part = apply_probe(model, dealt.where(F.col("fold") == fold), col).agg(
            F.lit(fold).alias("fold"), F.count(F.lit(1)).alias("n"), F.avg(right).alias("accuracy")
        )
        out = part if out is None else out.unionByName(part)
    return out


def intent_classifier(train: DataFrame, test: DataFrame, label: str, col: str, weight: str | None = None) -> DataFrame:
    """Multinomial intent head: predicted class and class probabilities for every test row."""
    return apply_probe(fit_probe(train, label, col, weight=weight), test, col)


# ---- silhouette and clusters --------------------------------------------------------------------


def silhouette(df: DataFrame, label: str, col: str = "embedding", by: str | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Exact mean cosine silhouette from class sums: O(rows x classes), no pairs.

    Class sums travel inside Arrow UDFs in chunks of bounded size; each chunk gives a row its own
    class's term and its nearest other class, and the chunks are combined per row. Rows alone in
    their class count 0.
    """
    keys = [by] if by else []
    unit = df.where(F.col(col).isNotNull() & F.col(label).isNotNull()).select(
        *keys, F.col(label).alias("_c"), V.as_doubles(col).alias("_u")
    )
    sums = materialize(
        vector_totals(unit.withColumn("_u", V.l2_normalize("_u", 0.0)), "_u", [*keys, "_c"]), "class-sums"
    )
    mark = F.col(by) if by else F.lit(0)
    staged, own, near = unit, [], []
    for i, chunk in enumerate(_sum_chunks(sums, by, chunk_bytes)):
        staged = staged.withColumn(f"_t{i}", _silhouette_udf(chunk, bool(by))("_u", "_c", mark))
        own.append(F.col(f"_t{i}.a"))
        near.append(F.col(f"_t{i}.b"))
    if not own:
        return unit.groupBy(*keys).agg(F.avg(F.lit(None).cast("double")).alias("silhouette"), F.count(F.lit(1)).alias("n"))
    scored = staged.select(*keys, F.coalesce(*own).alias("_a"), (F.least(*near) if len(near) > 1 else near[0]).alias("_b"))
    worst = F.greatest("_a", "_b")
    s = F.when(F.col("_a").isNull() | (worst == 0), F.lit(0.0)).otherwise((F.col("_b") - F.col("_a")) / worst)
    counted = F.col("_b").isNotNull()
    return scored.groupBy(*keys).agg(
        F.avg(F.when(counted, s)).alias("silhouette"), F.count(F.when(counted, 1)).alias("n")
    )


def _sum_chunks(sums: DataFrame, by: str | None, chunk_bytes: int):
    """{group: (class index, counts, sums)} dictionaries of bounded size, fetched one at a time."""
    chunk, size = {}, 0

    def packed(groups):
        return {
            g: ({c: i for i, (c, _, _) in enumerate(r)}, np.array([n for _, n, _ in r], float), np.array([t for _, _, t in r]))
            for g, r in groups.items()
        }

    for row in sums.orderBy(*([by] if by else []), "_c").toLocalIterator():
        need = 8 * len(row["total"])
        if chunk and size + need > chunk_bytes:
            yield packed(chunk)
            chunk, size = {}, 0
        chunk.setdefault(row[by] if by else None, []).append((row["_c"], row["n"], row["total"]))
        size += need
    if chunk:
        yield packed(chunk)


def _silhouette_udf(packed: dict, grouped: bool):
    def score(vectors: pa.Array, classes: pa.Array, marks: pa.Array) -> pa.Array:
        valid, u = to_matrix(vectors)
        u = unit_rows(u)
        a, b = np.full(len(valid), np.nan), np.full(len(valid), np.nan)
        names, groups = classes.to_pylist(), (marks.to_pylist() if grouped else [None] * len(valid))
        for g in set(groups) & set(packed):
            index, n, total = packed[g]
            at = np.array([i for i, x in enumerate(groups) if x == g])
            own = np.array([index.get(names[i], -1) for i in at])
            sims = u[at] @ total.T
            far = 1.0 - sims / n
            here = np.flatnonzero(own >= 0)
            mine = own[here]
            many = n[mine] > 1
            a[at[here[many]]] = ((n[mine] - sims[here, mine])[many]) / (n[mine][many] - 1)
            far[here, mine] = np.inf
            nearest = far.min(axis=1)
            b[at] = np.where(np.isinf(nearest), np.nan, nearest)
        return pa.StructArray.from_arrays([pa.array(a, mask=np.isnan(a)), pa.array(b, mask=np.isnan(b))], names=["a", "b"])

    return F.arrow_udf(score, "struct<a: double, b: double>")


def euclidean_silhouette(df: DataFrame, label: str, id_col: str, col: str = "embedding", block_rows: int = SILHOUETTE_BLOCK) -> DataFrame:
    """Exact silhouette of every row under plain (unsquared) Euclidean distance: id, label, a, b, silhouette.

    No closed form over class sums exists for unsquared distances, so every two rows meet once: rows are dealt to blocks of about
    ``block_rows`` by hash, and each pair of blocks is one group that returns, for the rows of both, the distance sums to the other
    block's classes. No pair of rows leaves a task. Null vectors and null labels are left out; a row alone in its class has 0, a row
    without another class NULL. ``id_col`` tells rows apart.
    """
    rows = df.where(F.col(col).isNotNull() & F.col(label).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("_id"), F.col(label).alias("_c"), V.as_doubles(col).alias("_x")
    )
    sizes = materialize(rows.groupBy("_c").agg(F.count(F.lit(1)).alias("_n")), "class-sizes")
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    blocks = max(1, -(-total // block_rows))
    dealt = rows.withColumn("_blk", F.pmod(F.xxhash64("_id"), F.lit(blocks)).cast("int"))
    last = F.lit(blocks - 1)
    left = dealt.select("*", F.explode(F.sequence(F.col("_blk"), last)).alias("_other"))
    right = dealt.withColumnRenamed("_blk", "_other").select("*", F.explode(F.sequence(F.lit(0), F.col("_other"))).alias("_blk"))
    kinds = {name: rows.schema[name].dataType for name in ("_id", "_c")}
    schema = T.StructType([T.StructField("_id", kinds["_id"]), T.StructField("_oc", kinds["_c"]), T.StructField("_s", T.DoubleType())])
    sums = left.groupBy("_blk", "_other").cogroup(right.groupBy("_blk", "_other")).applyInArrow(_block_pair_sums, schema)
    per_row = sums.groupBy("_id", "_oc").agg(F.sum("_s").alias("_s"))
    own = F.col("_oc") == F.col("_c")
    judged = (
        per_row.join(sizes.withColumnRenamed("_c", "_oc"), "_oc").join(rows.select("_id", "_c"), "_id")
        .groupBy("_id", "_c").agg(
            F.max(F.when(own & (F.col("_n") > 1), F.col("_s") / (F.col("_n") - 1))).alias("a"),
            F.min(F.when(~own, F.col("_s") / F.col("_n"))).alias("b"),
        )
    )
    worst = F.greatest("a", "b")
    s = F.when(F.col("b").isNotNull(), F.when(F.col("a").isNull() | (worst == 0), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / worst))
    return judged.select(F.col("_id").alias(id_col), F.col("_c").alias(label), "a", "b", s.alias("silhouette"))


def _block_pair_sums(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """(row, class, distance sum) of the left rows against the right classes and, for two different blocks, the other way round."""
    fields = [("_id", left.schema.field("_id").type), ("_oc", left.schema.field("_c").type), ("_s", pa.float64())]
    if not left.num_rows or not right.num_rows:
        return pa.table([pa.array([], t) for _, t in fields], names=[n for n, _ in fields])
    left, right = left.sort_by("_c"), right.sort_by("_c")
    sides = [(t.column("_id").combine_chunks(), t.column("_c").combine_chunks(), to_matrix(t.column("_x"))[1]) for t in (left, right)]
    centre = sides[1][2].mean(axis=0)  # distances do not change, rounding does
    x, y = sides[0][2] - centre, sides[1][2] - centre
    starts = [np.flatnonzero(np.r_[True, np.diff(c.dictionary_encode().indices.to_numpy()) != 0]) for _, c, _ in sides]
    to_right = np.zeros((len(x), len(starts[1])))
    to_left = np.zeros((len(y), len(starts[0])))
    class_of = [np.repeat(np.arange(len(s)), np.diff(np.r_[s, len(m)])) for s, m in zip(starts, (x, y))]
    for at in range(0, len(x), TILE[0]):
        rows = slice(at, at + TILE[0])
        mine = class_of[0][rows]
        first = np.flatnonzero(np.r_[True, np.diff(mine) != 0])
        for to in range(0, len(y), TILE[1]):
            cols = slice(to, to + TILE[1])
            theirs = class_of[1][cols]
            heads = np.flatnonzero(np.r_[True, np.diff(theirs) != 0])
            d = _distances(x[rows], y[cols])
            to_right[rows, theirs[heads]] += np.add.reduceat(d, heads, axis=1)
            if key[0] != key[1]:
                to_left[cols, mine[first]] += np.add.reduceat(d, first, axis=0).T
    out = []
    for ids, classes, begins, sums in [(sides[0][0], sides[1][1], starts[1], to_right), (sides[1][0], sides[0][1], starts[0], to_left)][: 1 + int(key[0] != key[1])]:
        n, k = sums.shape
        out.append(pa.table([ids.take(pa.array(np.repeat(np.arange(n), k))), classes.take(pa.array(np.tile(begins, n))), pa.array(sums.ravel())], names=[f for f, _ in fields]))
    return pa.concat_tables(out)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances; pairs so close that the product form loses their digits are subtracted directly."""
    x2, y2 = np.square(x).sum(axis=1), np.square(y).sum(axis=1)
    scale = x2[:, None] + y2[None, :]
    d2 = 2.0 * x @ y.T
    np.subtract(scale, d2, out=d2)
    scale *= 1e-6
    near = np.flatnonzero(d2 <= scale)
    for at in range(0, len(near), step := max(1, (2 << 20) // (8 * max(1, x.shape[1])))):
        part = near[at : at + step]
        d2.flat[part] = np.square(x[part // len(y)] - y[part % len(y)]).sum(axis=1)
    return np.sqrt(np.maximum(d2, 0.0, out=d2), out=d2)


def kmeans_exact_silhouettes(df: DataFrame, ks: list[int], seed: int, id_col: str, col: str = "embedding") -> DataFrame:
    """Mean unsquared Euclidean silhouette of k-means clusters, one row for each k (ks are few and independent fits)."""
    data = df.where(F.col(col).isNotNull()).withColumn("_v", _vec(col))
    out = None
    for k in ks:
        clustered = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="_cluster").fit(data).transform(data).drop("_v")
        one = euclidean_silhouette(materialize(clustered, f"clusters-{k}"), "_cluster", id_col, col)
        part = one.agg(F.lit(k).alias("k"), F.count("silhouette").alias("n"), F.avg("silhouette").alias("silhouette"))
        out = part if out is None else out.unionByName(part)
    return out


def kmeans_report(df: DataFrame, ks: list[int], seed: int, col: str = "embedding") -> DataFrame:
    """Cost and squared-Euclidean silhouette for every k (a short list of independent fits)."""
    rows = df.select(_vec(col).alias("features"))
    out = []
    for k in ks:
        model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(rows)
        scored = model.transform(rows)
        sil = ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(scored)
        out.append(F.struct(
            F.lit(k).cast("long").alias("k"), F.lit(float(model.summary.trainingCost)).alias("cost"),
            F.lit(float(sil)).alias("sq_euclidean_silhouette"),
        ))
    return df.sparkSession.range(1).select(F.explode(F.array(*out)).alias("_r")).select("_r.*")


def gmm_report(df: DataFrame, k: int, seed: int, dims: int, col: str = "embedding") -> DataFrame:
    """Gaussian-mixture assignment after PCA: rows and mean confidence per component."""
    rows = df.select(_vec(col).alias("features"))
    reduced = PCA(k=dims, inputCol="features", outputCol="low").fit(rows).transform(rows).select("low")
    model = GaussianMixture(k=k, seed=seed, featuresCol="low", predictionCol="component", probabilityCol="prob").fit(reduced)
    scored = model.transform(reduced).select("component", F.array_max(vector_to_array("prob")).alias("p"))
    return scored.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_confidence"))


def project_2d(df: DataFrame, id_col: str, col: str = "embedding") -> DataFrame:
    rows = df.withColumn("_x", _vec(col))
    model = PCA(k=2, inputCol="_x", outputCol="_p").fit(rows)
    return model.transform(rows).select(id_col, vector_to_array("_p").alias("_p")).select(
        id_col, F.element_at("_p", 1).alias("x"), F.element_at("_p", 2).alias("y")
    )


# ---- collapse -----------------------------------------------------------------------------------


def collapse_stats(df: DataFrame, col: str = "embedding") -> DataFrame:
    """Deviation per dimension and the mean cosine between different rows, in closed form."""
    unit = V.l2_normalize(col, 0.0)
    stats = df.agg(
        F.count(F.lit(1)).alias("n"),
        vector_to_array(Summarizer.std(_vec(col))).alias("std"),
        vector_to_array(Summarizer.sum(array_to_vector(unit))).alias("usum"),
    )
    n = F.col("n").cast("double")
    sq = F.aggregate("usum", F.lit(0.0), lambda a, x: a + x * x)
    return stats.select(
        "n",
        V.vec_mean("std").alias("mean_std"),
        F.array_min("std").alias("min_std"),
        F.size(F.filter("std", lambda x: x > F.lit(0.01) * F.array_max("std"))).cast("long").alias("active_dims"),
        ((sq - n) / (n * n - n)).alias("mean_cosine"),
    )


def effective_rank(df: DataFrame, col: str = "embedding", share: float = 0.01) -> DataFrame:
    """Number of singular values above a share of the largest, from the D x D second moment."""
    sums = scatter(df, col)

    def rank(frames):
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                d = len(row.s)
                vals = np.linalg.eigvalsh(np.asarray(row.xx).reshape(d, d))
                sv = np.sqrt(np.maximum(vals, 0.0))
                import pandas as pd

                yield pd.DataFrame({"n": [row.n], "effective_rank": [int((sv > share * sv.max()).sum())], "largest": [sv.max()]})

    return sums.mapInPandas(rank, "n long, effective_rank long, largest double")


def plateau(history: DataFrame, by: list[str], step: str, loss: str, n: int = 5, tolerance: float = 1e-6) -> DataFrame:
    """Flag steps whose last n losses lie within the tolerance."""
    w = Window.partitionBy(*by).orderBy(step).rowsBetween(-(n - 1), 0)
    spread = F.max(loss).over(w) - F.min(loss).over(w)
    full = F.count(loss).over(w) == n
    return history.withColumn("range_last", F.when(full, spread)).withColumn("is_plateau", full & (spread < tolerance))


# ---- normality and alignment --------------------------------------------------------------------


def projections(dim: int, k: int, seed: int) -> np.ndarray:
    """k fixed unit directions as columns."""
    m = np.random.default_rng(seed).standard_normal((dim, k))
    return m / np.linalg.norm(m, axis=0, keepdims=True)


def gaussianity(
    df: DataFrame, directions: np.ndarray, points: int = 8, bound: float = 3.0, mode: str = "ecf", col: str = "embedding"
) -> DataFrame:
    """Distance of the projected rows from a standard normal.

    ``ecf``: mean squared gap between the empirical and the normal characteristic function on a
    grid. ``variance``: mean of (population variance of the projection - 1)^2. Tasks send sums only.
    """
    grid = np.linspace(-bound, bound, points)
    width = 2 * directions.shape[1] * (points if mode == "ecf" else 1)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(width), 0
        for batch in batches:
            _, x = to_matrix(batch.column(0))
            if not len(x):
                continue
            p = x @ directions
            if mode == "ecf":
                arg = p[:, :, None] * grid
                total += np.concatenate([np.cos(arg).sum(axis=0).ravel(), np.sin(arg).sum(axis=0).ravel()])
            else:
                total += np.concatenate([p.sum(axis=0), np.square(p).sum(axis=0)])
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), to_list_array(total[None, :])], names=["n", "t"])

    rows = df.where(F.col(col).isNotNull()).select(F.col(col).cast("array<double>").alias("x"))
    sums = merge_sums(rows.mapInArrow(partial, "n long, t array<double>"), [], ["t"], ["n"])
    half = F.lit(width // 2)
    first, second = F.slice("t", F.lit(1), half), F.slice("t", half + 1, half)
    n = F.col("n").cast("double")
    if mode == "ecf":
        want = F.array(*[F.lit(float(v)) for v in np.tile(np.exp(-grid**2 / 2), directions.shape[1])])
        real = F.zip_with(first, want, lambda c, e: (c / n - e) * (c / n - e))
        gap = F.zip_with(real, second, lambda a, s: a + (s / n) * (s / n))
    else:
        gap = F.zip_with(first, second, lambda s, q: F.pow(q / n - (s / n) * (s / n) - 1.0, F.lit(2.0)))
    return sums.select("n", V.vec_mean(gap).alias("statistic"))


def alignment(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Mean squared difference over pairs and dimensions."""
    return pairs.agg(
        F.avg(V.sq_dist(a, b) / F.size(a)).alias("alignment"), F.count(F.lit(1)).alias("n_pairs")
    )


def recovery_bound(pairs: DataFrame, rho: float, a: str = "a", b: str = "b") -> DataFrame:
    """Bound on the recovery error from the alignment gap and the covariance's distance from identity."""
    sums = scatter(pairs.select(F.col(a).alias("embedding")))
    gap = alignment(pairs, a, b)

    def cov_gap(frames):
        import pandas as pd

        for pdf in frames:
            for row in pdf.itertuples(index=False):
                d = len(row.s)
                s = np.asarray(row.s)
                cov = (np.asarray(row.xx).reshape(d, d) - np.outer(s, s) / row.n) / max(row.n - 1, 1)
                yield pd.DataFrame({"epsilon": [np.linalg.norm(cov - np.eye(d))], "d": [d]})

    eps = sums.mapInPandas(cov_gap, "epsilon double, d long")
    joined = attach_row(eps, gap)
    delta = F.greatest(F.lit(0.0), F.col("alignment") * F.col("d") - F.lit(2.0 * (1 - rho)) * F.col("d"))
    term = F.col("delta") / F.lit(2.0 * rho * (1 - rho))
    return joined.withColumn("delta", delta).withColumn("gap_term", term).withColumn(
        "bound", F.col("gap_term") + F.pow(F.col("epsilon") + F.col("gap_term"), F.lit(2.0))
    ).select("delta", "epsilon", "gap_term", "bound")


# Temperature and clamp of the contrastive statistic.
TEMPERATURE = 0.07
CLAMP = 10.0


def _supcon(x: np.ndarray, labels: np.ndarray) -> tuple[float, int]:
    u = unit_rows(x)
    s = np.clip(u @ u.T / TEMPERATURE, -CLAMP, CLAMP)
    off = ~np.eye(len(u), dtype=bool)
    same = (labels[:, None] == labels[None, :]) & off
    has = same.any(axis=1)
    e = np.exp(s)
    pos = np.log(np.where(has, (e * same).sum(axis=1), 1.0))
    tot = np.log((e * off).sum(axis=1)) if len(u) > 1 else np.zeros(len(u))
    return float((tot - pos)[has].sum()), int(has.sum())


def supcon_stat(df: DataFrame, label: str, id_col: str, block: int = 512, col: str = "embedding", n_rows: int | None = None, seed: int = 0) -> DataFrame:
    """Supervised contrastive statistic averaged over hash blocks, the mini-batches of the original.

    The number of blocks comes from the row count, so a block stays near ``block`` rows whatever the
    labels look like.
    """
    n = df.count() if n_rows is None else n_rows
    blocks = max(1, -(-n // block))
    rows = df.where(F.col(col).isNotNull()).select(
        (hash_int(id_col, seed) % blocks).alias("_b"), F.col(id_col).alias("_id"), F.col(label).alias("_l"),
        F.col(col).cast("array<double>").alias("_x"),
    )

    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by("_id")
        total, count = _supcon(to_matrix(t.column("_x"))[1], np.asarray(t.column("_l").to_pylist()))
        return pa.table({"total": [total], "n": pa.array([count], pa.int64())})

    parts = rows.groupBy("_b").applyInArrow(one, "total double, n long")
    return parts.agg((F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("statistic"), F.sum("n").alias("n"))


def hier_supcon_stat(df: DataFrame, label: str, n_types: int, id_col: str, fine: float = 0.7, block: int = 512) -> DataFrame:
    """0.7 of the per-type statistic plus 0.3 of the drone/background one."""
    n = df.count()
    coarse = df.withColumn("_super", (F.col(label) >= n_types).cast("int"))
    a = supcon_stat(df, label, id_col, block, n_rows=n).select(F.col("statistic").alias("fine"))
    b = supcon_stat(coarse, "_super", id_col, block, n_rows=n).select(F.col("statistic").alias("coarse"))
    return attach_row(a, b).withColumn(
        "statistic", F.lit(fine) * F.col("fine") + F.lit(1 - fine) * F.col("coarse")
    )


def select_best(history: DataFrame, by: list[str], step: str, sil: str, matched: str, random: str, patience: int = 7) -> DataFrame:
    """Running best of the combined score and the step at which training would have stopped."""
    combined = F.col(sil) + 2.0 * F.col(matched) + 0.5 * F.col(random)
    before = Window.partitionBy(*by).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*by).orderBy(step).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = history.withColumn("combined", combined)
    best = F.max("combined").over(before)
    rows = rows.withColumn("is_best", best.isNull() | (F.col("combined") > best))
    rows = rows.withColumn("_pos", F.row_number().over(Window.partitionBy(*by).orderBy(step)))
    last = F.max(F.when(F.col("is_best"), F.col("_pos"))).over(upto)
    rows = rows.withColumn("waited", F.col("_pos") - last)
    stop = F.min(F.when(F.col("waited") >= patience, F.col("_pos"))).over(Window.partitionBy(*by))
    live = rows.withColumn("_stop", stop).where(F.col("_stop").isNull() | (F.col("_pos") <= F.col("_stop")))
    return live.groupBy(*by).agg(
        F.max_by(step, F.when(F.col("is_best"), F.col("_pos"))).alias("best_step"),
        F.max("combined").alias("best_combined"),
        F.max(step).alias("last_step"),
        F.max(F.col("_stop").isNotNull().cast("int")).cast("boolean").alias("stopped_early"),
    )
