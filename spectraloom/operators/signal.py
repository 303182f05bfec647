"""Segments, spectrograms and their features.

A spectrogram row is (sample_id, spec, c, h, w): one flat row-major array. Per-row array work runs
in Arrow UDFs over batches; seeds come from the row's own id, so results do not depend on how the
rows are partitioned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.functions.rows import attach_row
from spectraloom.functions import vectors as V
from spectraloom.functions.arrow import to_matrix
from spectraloom.operators.prefix import ordered_rank

HALO_BLOCK = 65_536


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


# ---- segmentation -------------------------------------------------------------------------------


def segment_arrays(
    df: DataFrame, cols: list[str], length: int, stride: int | None = None, cap: int | None = None
) -> DataFrame:
    """Cut array columns of a row into windows; a partial tail is dropped."""
    stride = stride or length // 2
    last = F.size(cols[0]) - F.lit(length)
    starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    if cap is not None:
        starts = F.slice(starts, 1, cap)
    out = df.select("*", F.posexplode(starts).alias("segment_idx", "start_sample"))
    for name in cols:
        out = out.withColumn(name, F.slice(name, F.col("start_sample") + 1, F.lit(length)))
    return out


def indexed_series(df: DataFrame, by: list[str], order: list[Column], range_cols: list[str], out: str = "idx") -> DataFrame:
    """0-based position inside each series; a dominant series is ranked range by range."""
    return ordered_rank(df, by, range_cols, order, out, start=0)


def segment_rows(
    df: DataFrame, by: list[str], idx: str, values: list[str], length: int, stride: int | None = None
) -> DataFrame:
    """Windows over a long series stored one sample per row: every row joins the windows it lies in.

    One shuffle on (series, window), no self-join; a series of any length is many groups.
    """
    stride = stride or length // 2
    i = F.col(idx)
    low = F.greatest(F.lit(0), F.floor((i - F.lit(length)) / stride) + 1)
    rows = df.withColumn("segment_idx", F.explode(F.sequence(low.cast("long"), F.floor(i / stride).cast("long"))))
    item = F.struct(i.alias("_i"), *values)
    grouped = rows.groupBy(*by, "segment_idx").agg(
        F.count(F.lit(1)).alias("_n"), F.sort_array(F.collect_list(item)).alias("_rows")
    )
    full = grouped.where(F.col("_n") == length)
    return full.select(
        *by, "segment_idx", (F.col("segment_idx") * stride).alias("start_sample"),
        *[F.col(f"_rows.{v}").alias(v) for v in values],
    )


def gradient_rows(df: DataFrame, by: list[str], idx: str, value: str, out: str = "gradient") -> DataFrame:
    """Central differences along a series, one-sided at its ends, computed in index blocks with a halo."""
    block = F.floor(F.col(idx) / HALO_BLOCK)
    inside = F.col(idx) % HALO_BLOCK
    copies = F.array_compact(
        F.array(block, F.when(inside == 0, block - 1), F.when(inside == HALO_BLOCK - 1, block + 1))
    )
    rows = df.withColumn("_home", block).withColumn("_blk", F.explode(copies)).where("_blk >= 0")
    w = Window.partitionBy(*by, "_blk").orderBy(idx)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    here = F.col(value)
    grad = (
        F.when(before.isNull() & after.isNull(), F.lit(0.0))
        .when(before.isNull(), after - here)
        .when(after.isNull(), here - before)
        .otherwise((after - before) / 2)
    )
    return rows.withColumn(out, grad).where(F.col("_blk") == F.col("_home")).drop("_blk", "_home")


# ---- transforms ---------------------------------------------------------------------------------


def hann(n: int, symmetric: bool = True) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1 if symmetric else n))


def _frames(x: np.ndarray, n_fft: int, hop: int, first: int, count: int) -> np.ndarray:
    """(segments, frames, n_fft) view of signals padded with zeros on both sides."""
    left = max(0, -first)
    right = max(0, first + (count - 1) * hop + n_fft - x.shape[1])
    padded = np.pad(x, ((0, 0), (left, right)))
    view = np.lib.stride_tricks.sliding_window_view(padded, n_fft, axis=1)
    return view[:, first + left :: hop][:, :count]


def two_sided_stft(x: np.ndarray, n_fft: int, hop: int) -> np.ndarray:
    """STFT with a symmetric Hann window, slices centred on multiples of hop, phase referred to the
    slice centre; includes the edge slices that still touch the signal. Shape (rows, n_fft, frames)."""
    mid = n_fft // 2
    win = hann(n_fft)
    first = 0
    while first * hop - mid - hop + n_fft > 1:  # the window's end sample is zero
        first -= 1
    last = 0
    while last * hop - mid < x.shape[1] - 1:
        last += 1
    seg = _frames(x, n_fft, hop, first * hop - mid, last - first) * win
    return np.fft.fft(np.roll(seg, -mid, axis=2), axis=2).transpose(0, 2, 1)


def plain_stft(x: np.ndarray, n_fft: int, hop: int) -> np.ndarray:
    """STFT without edge padding, periodic Hann scaled to unit sum; the tail is padded to a full hop."""
    win = hann(n_fft, symmetric=False)
    tail = -(x.shape[1] - n_fft) % hop
    x = np.pad(x, ((0, 0), (0, tail)))
    count = (x.shape[1] - n_fft) // hop + 1
    return np.fft.fft(_frames(x, n_fft, hop, 0, count) * (win / win.sum()), axis=2).transpose(0, 2, 1)


def resize_nearest(img: np.ndarray, h: int, w: int) -> np.ndarray:
    rows = np.round(np.linspace(0, img.shape[-2] - 1, h)).astype(int)
    cols = np.round(np.linspace(0, img.shape[-1] - 1, w)).astype(int)
    return img[..., rows[:, None], cols[None, :]]


def resize_bilinear(img: np.ndarray, h: int, w: int) -> np.ndarray:
    def axis(n: int, m: int):
        pos = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        lo = np.floor(pos).astype(int)
        return lo, np.minimum(lo + 1, n - 1), pos - lo

    r0, r1, rf = axis(img.shape[-2], h)
    c0, c1, cf = axis(img.shape[-1], w)
    top = img[..., r0, :] * (1 - rf)[:, None] + img[..., r1, :] * rf[:, None]
    return top[..., c0] * (1 - cf) + top[..., c1] * cf


def standardize_array(x: np.ndarray, axes: tuple[int, ...], ddof: int, eps: float) -> np.ndarray:
    centred = x - x.mean(axis=axes, keepdims=True)
    std = x.std(axis=axes, keepdims=True, ddof=ddof)
    return centred / np.where(std < eps, 1.0, std)


def stft(
    df: DataFrame, i: str = "i", q: str = "q", n_fft: int = 1024, hop: int = 256, size: tuple[int, int] | None = (256, 256),
    features: str = "log_phase", normalize: bool = True, out: str = "spec",
) -> DataFrame:
    """Two-channel spectrogram of every I/Q segment.

    ``log_phase``: log-power and phase/pi, nearest resize, per-channel standardisation (ddof 0).
    ``db_grad``: decibels and their time gradient, centred spectrum, bilinear resize (ddof 1).
    The variant is kept in ``feature_version``; the two must not be mixed in one fit.
    """

    def spectro(ia: pa.Array, qa: pa.Array) -> pa.Array:
        rows: list = [None] * len(ia)
        lengths = np.asarray([len(v) if v.is_valid else -1 for v in ia]) if len(ia) else np.empty(0, int)
        for length in np.unique(lengths[lengths > 0]):
            at = np.flatnonzero(lengths == length)
            x = to_matrix(ia.take(pa.array(at)))[1] + 1j * to_matrix(qa.take(pa.array(at)))[1]
            if features == "log_phase":
                z = two_sided_stft(x, n_fft, hop)
                chans = np.stack([np.log1p(np.abs(z) ** 2), np.angle(z) / np.pi], axis=1)
                chans = chans if size is None else resize_nearest(chans, *size)
                ddof, eps = 0, 1e-8
            else:
                z = np.fft.fftshift(plain_stft(x, n_fft, hop), axes=1)
                db = 20.0 * np.log10(np.abs(z) + 1e-8)
                grad = np.gradient(db, axis=2) if db.shape[2] > 1 else np.zeros_like(db)
                chans = np.stack([db, grad], axis=1)
                chans = chans if size is None else resize_bilinear(chans, *size)
                ddof, eps = 1, 1e-8
            if normalize:
                chans = standardize_array(chans, (2, 3), ddof, eps)
            for row, spec in zip(at, chans):
                rows[row] = {"spec": spec.astype(np.float32).ravel(), "c": 2, "h": spec.shape[1], "w": spec.shape[2]}
        kind = pa.struct([("spec", pa.list_(pa.float32())), ("c", pa.int32()), ("h", pa.int32()), ("w", pa.int32())])
        return pa.array(rows, type=kind)

    made = F.arrow_udf(spectro, "struct<spec: array<float>, c: int, h: int, w: int>")
    kept = [c for c in df.columns if c not in (i, q)]
    vec = [F.col(x).cast("array<double>") for x in (i, q)]
    return df.select(*kept, made(*vec).alias("_s")).select(
        *kept, F.col("_s.spec").alias(out), "_s.c", "_s.h", "_s.w", F.lit(features).alias("feature_version")
    )


def frame_spectrum(df: DataFrame, i: str, q: str | None = None) -> DataFrame:
    """Log-power and phase of single Hann-windowed frames, one array each."""

    def spectrum(ia: pa.Array, qa: pa.Array) -> pa.Array:
        _, re = to_matrix(ia)
        _, im = to_matrix(qa)
        if not len(re):
            return pa.nulls(len(ia), pa.struct([("log_power", pa.list_(pa.float64())), ("phase", pa.list_(pa.float64()))]))
        z = np.fft.fft((re + 1j * im) * hann(re.shape[1]), axis=1)
        from spectraloom.functions.arrow import to_list_array

        parts = [to_list_array(np.log1p(np.abs(z) ** 2)), to_list_array(np.angle(z) / np.pi)]
        return pa.StructArray.from_arrays(parts, names=["log_power", "phase"])

    made = F.arrow_udf(spectrum, "struct<log_power: array<double>, phase: array<double>>")
    real = F.col(i).cast("array<double>")
    imag = F.col(q).cast("array<double>") if q else F.transform(real, lambda x: F.lit(0.0))
    return df.withColumn("_z", made(real, imag)).select("*", "_z.*").drop("_z")


def map_blocks(fn, return_type: str = "array<float>"):
    """Arrow UDF (spec, c, h, w, *extras) applying ``fn(x[rows, c, h, w], *extras) -> (rows, ...)`` to the rows of a batch that share a shape."""

    def run(spec: pa.Array, c: pa.Array, h: pa.Array, w: pa.Array, *extra: pa.Array) -> pa.Array:
        at = np.flatnonzero(spec.is_valid().to_numpy(zero_copy_only=False))
        out: list = [None] * len(spec)
        if len(at):
            sizes = np.stack([a.to_numpy(zero_copy_only=False)[at].astype(np.int64) for a in (c, h, w)], axis=1)
            extras = [e.to_numpy(zero_copy_only=False) for e in extra]
            shapes, member = np.unique(sizes, axis=0, return_inverse=True)
            for k, shape in enumerate(shapes):
                rows = at[member.reshape(-1) == k]
                x = spec.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), *shape)
                for row, made in zip(rows, fn(x, *[e[rows] for e in extras])):
                    out[row] = np.ravel(made)
        return pa.array(out, type=pa.list_(pa.float64())).cast(pa.list_(pa.float64() if return_type == "array<double>" else spec.type.value_type))

    return F.arrow_udf(run, return_type)


def apply_blocks(df: DataFrame, fn, *extra: Column, col: str = "spec") -> DataFrame:
    kind = df.schema[col].dataType.simpleString()
    return df.withColumn(col, map_blocks(fn, kind)(F.col(col), F.col("c"), F.col("h"), F.col("w"), *extra))


def resize(df: DataFrame, h: int, w: int, mode: str = "nearest") -> DataFrame:
    pick = resize_nearest if mode == "nearest" else resize_bilinear
    out = apply_blocks(df, lambda x: pick(x, h, w))
    return out.withColumn("h", F.lit(h)).withColumn("w", F.lit(w))


def standardize(df: DataFrame, by: str = "channel", ddof: int = 0, eps: float = 1e-6) -> DataFrame:
    """Standardise inside each sample: per channel, per frequency bin, or over the whole sample."""
    axes = {"channel": (2, 3), "bin": (3,), "global": (1, 2, 3)}[by]
    return apply_blocks(df, lambda x: standardize_array(x, axes, ddof, eps))


def standardize_vectors(df: DataFrame, col: str, by: str = "dataset", ddof: int = 0, eps: float = 1e-6, out: str | None = None) -> DataFrame:
    """Standardise vectors by statistics of the whole table: one pair per dimension ("bin") or one in all ("dataset").

    The statistics are one row, so the broadcast is bounded by the vector length.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    if by == "bin":
        vec = array_to_vector(V.as_doubles(col))
        stats = df.agg(
            Summarizer.metrics("mean", "variance").summary(vec).alias("_s"), F.count(F.lit(1)).alias("_n")
        ).select(
            vector_to_array("_s.mean").alias("_mean"),
            F.transform(
                vector_to_array("_s.variance"), lambda v: F.sqrt(v * (F.col("_n") - 1) / (F.col("_n") - F.lit(ddof)))
            ).alias("_std"),
        )
        scaled = F.zip_with(
            F.zip_with(V.as_doubles(col), "_mean", lambda x, m: x - m), "_std",
            lambda x, s: F.when(s < F.lit(eps), x).otherwise(x / s),
        )
    else:
        per_row = df.select(
            V.vec_sum(col).alias("s"), V.vec_sum(F.transform(V.as_doubles(col), lambda x: x * x)).alias("ss"),
            F.size(col).cast("long").alias("k"),
        )
        sums = per_row.agg(F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum("k").alias("k"))
        stats = sums.select(
            (F.col("s") / F.col("k")).alias("_mean"),
            F.sqrt(F.greatest(F.lit(0.0), (F.col("ss") - F.col("s") * F.col("s") / F.col("k")) / (F.col("k") - F.lit(ddof)))).alias("_std"),
        )
        scaled = F.transform(
            V.as_doubles(col),
            lambda x: F.when(F.col("_std") < F.lit(eps), x - F.col("_mean")).otherwise((x - F.col("_mean")) / F.col("_std")),
        )
    joined = attach_row(df, stats)
    return joined.withColumn(out or col, scaled).drop("_mean", "_std")


def standardize_by_key(df: DataFrame, key: str, value: str, ddof: int = 0, eps: float = 1e-6, out: str = "z") -> DataFrame:
    """Standardise a scalar inside its group: combined statistics joined back, no per-group window."""
    stats = df.groupBy(F.col(key).alias("_k")).agg(
        F.avg(value).alias("_mean"), (F.stddev_pop(value) if ddof == 0 else F.stddev_samp(value)).alias("_std")
    )
    centred = F.col(value) - F.col("_mean")
    return df.join(stats, F.col(key) == F.col("_k")).withColumn(
        out, F.when(F.col("_std") < eps, centred).otherwise(centred / F.col("_std"))
    ).drop("_k", "_mean", "_std")


def drop_garbage(df: DataFrame, col: str = "spec") -> DataFrame:
    return df.where(~V.is_garbage(col))


def to_channels(df: DataFrame, n: int, col: str = "spec") -> DataFrame:
    """First two channels; mono is duplicated; three channels get a zero plane."""
    plane = F.col("h") * F.col("w")
    two = F.when(F.col("c") == 1, F.concat(col, col)).otherwise(F.slice(col, F.lit(1), plane * 2))
    zero = F.array_repeat(F.lit(0).cast("float"), plane)
    if n == 2:
        picked = two
    elif n == 3:
        picked = F.when(F.col("c") >= 3, F.slice(col, F.lit(1), plane * 3)).otherwise(F.concat(two, zero))
    else:
        raise ValueError("two or three channels")
    return df.withColumn(col, picked).withColumn("c", F.lit(n))


def backfill_channel(df: DataFrame, src: int, dst: int, where: Column, col: str = "spec") -> DataFrame:
    """Copy one channel into another where that one is empty; other rows stay as they are."""
    plane = F.col("h") * F.col("w")

    def part(k: int) -> Column:
        return F.slice(col, F.lit(k) * plane + 1, plane)

    empty = V.vec_sum(F.transform(part(dst), F.abs)) < F.lit(1e-6)
    before = F.slice(col, F.lit(1), F.lit(dst) * plane)
    after = F.slice(col, F.lit(dst + 1) * plane + 1, F.greatest(F.lit(0), (F.col("c") - F.lit(dst + 1)) * plane))
    filled = F.concat(before, part(src), after)
    hit = where & (F.col("c") > F.lit(max(src, dst))) & empty
    return df.withColumn(col, F.when(hit, filled).otherwise(F.col(col)))


def residual_snr(pairs: DataFrame, drone: str, background: str, out: str = "snr_db") -> DataFrame:
    signal = V.sq_dist(drone, background) / F.size(drone)
    noise = V.vec_mean(F.transform(V.as_doubles(background), lambda x: x * x))
    return pairs.withColumn(out, F.lit(10.0) * F.log10(signal / (noise + F.lit(1e-10))))


# ---- intent -------------------------------------------------------------------------------------

def intent_rule(temporal_variance: Column | str, doppler_spread: Column | str, version: int = 1) -> Column:
    """v1 limits 0.5 / 1.0 / 2.0 / 3.0; v2 limits 1.55 / 1.70 on the sum."""
    tv, ds = _c(temporal_variance), _c(doppler_spread)
    if version == 1:
        calm, wild = (tv < 0.5) & (ds < 1.0), (tv > 2.0) | (ds > 3.0)
    else:
        calm, wild = tv + ds < 1.55, tv + ds > 1.70
    return F.when(calm, "SURVEILLANCE").when(wild, "ATTACK").otherwise("TRANSIT")


def embed(df: DataFrame, make_predict_fn, width: int, col: str = "spec", batch_size: int = 64, out: str = "embedding") -> DataFrame:
    """Embeddings from a frozen user model.

    ``make_predict_fn()`` runs once per Python worker and returns ``f(matrix) -> matrix``; Spark
    feeds it batches. Persist the result: every later job reads embeddings, not spectrograms.
    """
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, FloatType

    run = predict_batch_udf(
        make_predict_fn, return_type=ArrayType(FloatType()), batch_size=batch_size, input_tensor_shapes=[[width]]
    )
    return df.withColumn(out, run(F.col(col).cast("array<float>")))
