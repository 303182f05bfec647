"""Seeded noise, matched backgrounds, augmented views, replays and intent features of spectrogram blocks.

All functions work on blocks: the rows of one Arrow batch that have the same shape, as one array
(rows, channels, bins, frames). Random numbers are integer arithmetic on (hash of the row's id and the seed, number of
the draw), so they are the same at any partitioning and can be repeated by any engine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.operators.moments import centroid
from spectraloom.operators.sampling import hash_int, hash_rank
from spectraloom.operators.signal import apply_blocks, map_blocks, standardize_array

MASK31 = (1 << 31) - 1


# ---- draws ----------------------------------------------------------------------------------------


def row_seed(seed: int, *cols: Column | str) -> Column:
    """31 bits of the md5 of the columns' text and the seed."""
    key = F.concat_ws("|", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols])
    return hash_int(key, seed).bitwiseAND(MASK31)


def uniform(seeds: np.ndarray, first: int, count: int) -> np.ndarray:
    """Draws number ``first`` to ``first + count - 1`` of every row, in (0, 1): shape (rows, count)."""
    z = (np.asarray(seeds, np.int64)[:, None] + (np.arange(first, first + count, dtype=np.int64) % (1 << 31)) * 0x9E3779B1) & MASK31
    for shift, factor in ((15, 0x2C1B3C6D), (13, 0x297A2D39)):
        z = ((z ^ (z >> shift)) * factor) & MASK31
    return ((z ^ (z >> 15)) + 0.5) / float(1 << 31)


def normal(seeds: np.ndarray, first: int, shape: tuple[int, ...]) -> np.ndarray:
    """Standard normals (Box-Muller) from two draws each, numbered from ``first``: shape (rows, *shape)."""
    u = uniform(seeds, first, 2 * int(np.prod(shape)))
    return (np.sqrt(-2.0 * np.log(u[:, 0::2])) * np.cos(2.0 * np.pi * u[:, 1::2])).reshape(len(u), *shape)


def _whole(u: np.ndarray, low, high) -> np.ndarray:
    """Whole numbers in [low, high) from draws."""
    return np.floor(low + u * (high - low)).astype(np.int64)


def _inside(n: int, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """(rows, n) flags of the places start .. start + length - 1."""
    place = np.arange(n)[None, :]
    return (place >= start[:, None]) & (place < (start + length)[:, None])


# ---- noise ----------------------------------------------------------------------------------------

# Burst sizes in bins and frames, jitter, width and period of the microwave envelope, mixing odds.
WIFI = {"bins": (15, 30), "frames": (20, 50), "per_bin": True}
BLUETOOTH = {"bins": (1, 4), "frames": (5, 15), "per_bin": False}
MICROWAVE = {"jitter": 20, "sigma": 30.0, "period": 100}
URBAN_ODDS = {"wifi": 0.7, "bluetooth": 0.7, "microwave": 0.3}


def _noise_power(x: np.ndarray, snr_db: np.ndarray, pooled: bool = False) -> np.ndarray:
    """Noise power per row and channel for a target SNR, shape (rows, channels or 1, 1, 1)."""
    power = np.square(x).mean(axis=(1, 2, 3) if pooled else (2, 3), keepdims=True)
    return power / 10 ** (np.asarray(snr_db, float)[:, None, None, None] / 10)


def thermal(x, snr_db, seeds, first: int = 0, pooled: bool = False):
    return x + normal(seeds, first, x.shape[1:]) * np.sqrt(_noise_power(x, snr_db, pooled))


def bursts(x, snr_db, seeds, first, count, most, bins, frames, per_bin):
    """``count`` (per row, at most ``most``) rectangles of noise in every channel."""
    n, c, h, w = x.shape
    power, field = _noise_power(x, snr_db), normal(seeds, first, (c, h, w))
    first += 2 * c * h * w
    out = x.copy()
    for b in range(most):
        for k in range(c):
            u = uniform(seeds, first + 4 * (b * c + k), 4)
            high, long = np.minimum(_whole(u[:, 0], *bins), h), np.minimum(_whole(u[:, 1], *frames), w)
            rows = _inside(h, _whole(u[:, 2], 0, h - high + 1), high)[:, :, None]
            box = rows & _inside(w, _whole(u[:, 3], 0, w - long + 1), long)[:, None, :] & (b < count)[:, None, None]
            level = power[:, k] / (high[:, None, None] if per_bin else 1)
            out[:, k] += np.where(box, field[:, k] * np.sqrt(level), 0.0)
    return out


def wifi(x, snr_db, seeds, first: int = 0, count=3):
    return bursts(x, snr_db, seeds, first, np.broadcast_to(count, len(x)), int(np.max(count)), **WIFI)


def bluetooth(x, snr_db, seeds, first: int = 0, count=10):
    return bursts(x, snr_db, seeds, first, np.broadcast_to(count, len(x)), int(np.max(count)), **BLUETOOTH)


def microwave(x, snr_db, seeds, first: int = 0):
    _, c, h, w = x.shape
    field = normal(seeds, first, (c, h, w)) * np.sqrt(_noise_power(x, snr_db))
    middle = h // 2 + _whole(uniform(seeds, first + 2 * c * h * w, c), -MICROWAVE["jitter"], MICROWAVE["jitter"])
    shape = np.exp(-0.5 * np.square((np.arange(h) - middle[:, :, None]) / MICROWAVE["sigma"]))[:, :, :, None]
    return x + field * shape * (np.arange(w) % MICROWAVE["period"] < MICROWAVE["period"] // 2)


def urban(x, snr_db, seeds):
    """Thermal noise always, each kind of interference by its own odds."""
    use = {kind: (uniform(seeds, i, 1)[:, 0] < odds)[:, None, None, None] for i, (kind, odds) in enumerate(URBAN_ODDS.items())}
    counts = uniform(seeds, 3, 2)
    room, near, far = 64 + 4 * x[0].size, np.asarray(snr_db) + 3, np.asarray(snr_db) + 6
    y = thermal(x, near, seeds, room)
    y = np.where(use["wifi"], wifi(y, near, seeds, 2 * room, _whole(counts[:, 0], 2, 5)), y)
    y = np.where(use["bluetooth"], bluetooth(y, near, seeds, 3 * room, _whole(counts[:, 1], 5, 15)), y)
    return np.where(use["microwave"], microwave(y, far, seeds, 4 * room), y)


NOISE = {"awgn": thermal, "wifi": wifi, "bluetooth": bluetooth, "microwave": microwave, "urban": urban}


def add_noise(
    df: DataFrame, snr_db: Column | float, seed: int, kind: str = "awgn", id_col: str = "sample_id", pooled: bool = False,
    clean_at: float | None = None,
) -> DataFrame:
    """Noise of one kind at a target SNR. Levels at or above ``clean_at`` leave the row untouched."""
    level = F.lit(float(snr_db)) if isinstance(snr_db, (int, float)) else snr_db.cast("double")
    options = {"pooled": pooled} if kind == "awgn" else {}

    def noisy(x, snr, seeds):
        y = NOISE[kind](x, snr, seeds, **options)
        return y if clean_at is None else np.where((snr >= clean_at)[:, None, None, None], x, y)

    return apply_blocks(df, noisy, level, row_seed(seed, id_col, level))


def snr_sweep(df: DataFrame, levels: list[float], seed: int, id_col: str = "sample_id", clean_at: float = 25.0) -> DataFrame:
    """Every sample at every level of a short fixed list (``ordinal`` keeps the list order)."""
    ladder = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(float(x)).alias("snr_db")) for i, x in enumerate(levels)])
    swept = df.withColumn("_l", F.explode(ladder)).select(*df.columns, "_l.*")
    return add_noise(swept, F.col("snr_db"), seed, id_col=id_col, clean_at=clean_at)


# ---- matched backgrounds --------------------------------------------------------------------------


def _spread_where(x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Deviation of the masked values along the last axis (NaN where there are none)."""
    n = mask.sum(axis=-1)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = np.where(mask, x, 0.0).sum(axis=-1) / n
        return np.sqrt(np.where(mask, np.square(x - mean[..., None]), 0.0).sum(axis=-1) / n)


def background_of(x: np.ndarray, pct: float, sigma: float) -> tuple[np.ndarray, ...]:
    """Per frequency row (last axis): floor, number of quiet values, noise deviation; and the signal flags.

    Quiet values are the row's lowest ones, so the first of the sorted row are the noise pool.
    """
    floor, median = np.percentile(x, [pct, 50], axis=-1)
    spread = x.std(axis=-1)
    limit = floor + 1.5 * _spread_where(x, x <= (floor + spread)[..., None])
    limit = np.where((x <= limit[..., None]).sum(axis=-1) < 5, median, limit)
    quiet = x <= limit[..., None]
    count = quiet.sum(axis=-1)
    deviation = np.where(count > 1, _spread_where(x, quiet), 0.5 * spread)
    return floor, count, deviation, x > (floor + sigma * deviation)[..., None]


def matched_background(
    df: DataFrame, pct: float = 10, sigma: float = 2.0, method: str = "replace", seed: int = 0, id_col: str = "sample_id"
) -> DataFrame:
    """Remove what rises over each frequency row's noise floor; fill with noise or with the floor."""

    def clean(x, seeds):
        floor, count, deviation, signal = background_of(x, pct, sigma)
        if method == "zero":
            return np.where(signal, floor[..., None], x)
        cells = x[0].size
        pick = np.minimum((uniform(seeds, 0, cells).reshape(x.shape) * count[..., None]).astype(np.int64), count[..., None] - 1)
        jitter = normal(seeds, cells, x.shape[1:]) * deviation[..., None]
        pooled = np.take_along_axis(np.sort(x, axis=-1), np.maximum(pick, 0), axis=-1) + 0.05 * jitter
        return np.where(signal, np.where(count[..., None] > 1, pooled, floor[..., None] + jitter), x)

    return apply_blocks(df, clean, row_seed(seed, id_col))


# ---- shaped negatives, views, replays --------------------------------------------------------------


def envelope(df: DataFrame, col: str = "spec", clip: bool = True) -> DataFrame:
    """Mean spectral profile (one value per bin) of channel 0 over all samples, at least 0."""
    profile = map_blocks(lambda x: x[:, 0].mean(axis=2), df.schema[col].dataType.simpleString())
    rows = df.select(profile(F.col(col), F.col("c"), F.col("h"), F.col("w")).alias("p"))
    value = F.transform("centroid", lambda x: F.greatest(x, F.lit(0.0))) if clip else F.col("centroid")
    return centroid(rows, "p").select(value.alias("envelope"))


def shape_hard_negatives(negatives: DataFrame, drones: DataFrame, n: int, seed: int, id_col: str = "sample_id") -> DataFrame:
    """n negatives, drawn with replacement, scaled bin by bin towards the drones' mean profile.

    The i-th draw takes the negative whose rank in hash order is a seeded hash of i. Only ids are ranked and joined
    with the draws; the spectrograms join once, at the end.
    """
    profile = np.asarray(envelope(drones).first()[0])  # one vector
    ids = negatives.select(F.col(id_col).alias("_id"))
    ranked = hash_rank(ids, [], "_id", seed, "_rank")
    total = ids.agg(F.count(F.lit(1)))
    draws = negatives.sparkSession.range(n).select(F.col("id").alias("draw"), (hash_int("id", seed) % total.scalar() + 1).alias("_want"))
    picked = draws.join(ranked, F.col("_rank") == F.col("_want")).select("draw", "_id")
    chosen = negatives.join(picked, F.col(id_col) == F.col("_id")).drop("_id")

    def shape(x):
        own = np.maximum(x.mean(axis=3), 0.0)
        scale = np.clip(profile / (own + 1e-8), 0.5, 2.0)
        return standardize_array(x * scale[..., None], (2, 3), 0, 1e-6)

    return apply_blocks(chosen, shape)


def _stretch(x: np.ndarray, axis: int, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Bilinear resampling of each row's own stretch of one axis back to full size."""
    n = x.shape[axis]
    at = np.clip((np.arange(n) + 0.5) * length[:, None] / n - 0.5, 0, length[:, None] - 1)
    low = np.floor(at).astype(np.int64)
    shape = [len(x), 1, 1, 1]
    shape[axis] = n
    take = lambda i: np.take_along_axis(x, (i + start[:, None]).reshape(shape), axis)
    part = (at - low).reshape(shape)
    return take(low) * (1 - part) + take(np.minimum(low + 1, length[:, None] - 1)) * part


def _turn(x: np.ndarray, axis: int, shift: np.ndarray) -> np.ndarray:
    """Circular shift of each row by its own amount."""
    shape = [len(x), 1, 1, 1]
    shape[axis] = x.shape[axis]
    return np.take_along_axis(x, ((np.arange(x.shape[axis]) - shift[:, None]) % x.shape[axis]).reshape(shape), axis)


def cropped_view(x, seeds, crop=(0.85, 1.0), mask=0.08, noise=0.03):
    """A random stretch of both axes at full size, one band of bins and one of frames blanked, noise."""
    _, _, h, w = x.shape
    u = uniform(seeds, 0, 5)
    scale = crop[0] + u[:, 0] * (crop[1] - crop[0])
    high, long = (scale * h).astype(np.int64), (scale * w).astype(np.int64)
    y = _stretch(x, 2, _whole(u[:, 1], 0, h - high + 1), high)
    y = _stretch(y, 3, _whole(u[:, 2], 0, w - long + 1), long)
    bins, frames = int(h * mask), int(w * mask)
    blank = _inside(h, _whole(u[:, 3], 0, h - bins + 1), bins)[:, None, :, None] | _inside(w, _whole(u[:, 4], 0, w - frames + 1), frames)[:, None, None, :]
    return np.where(blank, 0.0, y) + noise * normal(seeds, 8, x.shape[1:])


def rolled_view(x, seeds, noise=0.05, shift=5):
    return _turn(x + noise * normal(seeds, 8, x.shape[1:]), 2, _whole(uniform(seeds, 0, 1)[:, 0], -shift, shift + 1))


def replay(x, seeds):
    u = uniform(seeds, 0, 4)
    y = _turn(_turn(x, 3, _whole(u[:, 0], 1, 6)), 2, _whole(u[:, 1], 1, 6))
    level, gain = (a[:, None, None, None] for a in (0.01 + 0.04 * u[:, 2], 0.9 + 0.2 * u[:, 3]))
    return (y + level * normal(seeds, 8, x.shape[1:])) * gain


def _variants(df: DataFrame, n: int, seed: int, id_col: str, name: str, make) -> DataFrame:
    many = df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return apply_blocks(many, make, row_seed(seed, id_col, name))


def augment(df: DataFrame, n_views: int, seed: int, mode: str = "crop", id_col: str = "sample_id") -> DataFrame:
    """Augmented views: crop + masks + noise, or noise + circular frequency shift."""
    return _variants(df, n_views, seed, id_col, "view", cropped_view if mode == "crop" else rolled_view)


def replay_variants(df: DataFrame, n: int, seed: int, id_col: str = "sample_id") -> DataFrame:
    """Replayed copies: time and frequency roll, converter noise, gain."""
    return _variants(df, n, seed, id_col, "replay_no", replay)


# ---- intent -----------------------------------------------------------------------------------------


def _describe(x: np.ndarray) -> dict[str, np.ndarray]:
    """Eight numbers per plane of a block (rows, bins, frames)."""
    activity = x.var(axis=2)
    weight = np.abs(x.mean(axis=2))
    weight = weight / (weight.sum(axis=1, keepdims=True) + 1e-8)
    first = weight @ np.arange(x.shape[1])
    second = (weight * np.square(np.arange(x.shape[1]) - first[:, None])).sum(axis=1)
    top, mean, spread = x.max(axis=(1, 2)), x.mean(axis=(1, 2)), x.std(axis=(1, 2))
    return {
        "temporal_variance": activity.mean(axis=1),
        "temporal_trend": np.abs(x[:, :, 1:] - x[:, :, :-1]).mean(axis=(1, 2)) if x.shape[2] > 1 else np.zeros(len(x)),
        "centroid_freq": first,
        "bandwidth": np.sqrt(second),
        "peakiness": top / (mean + 1e-8),
        "snr": (top - mean) / (spread + 1e-8),
        "burst": activity.std(axis=1),
        "doppler_spread": x.std(axis=1).mean(axis=1),
    }


INTENT_FEATURES = list(_describe(np.zeros((1, 2, 2))))


def intent_features(df: DataFrame, col: str = "spec") -> DataFrame:
    """Eight feature columns from channel 0 of every spectrogram."""
    made = map_blocks(lambda x: np.stack(list(_describe(x[:, 0]).values()), axis=1), "array<double>")
    features = made(F.col(col), F.col("c"), F.col("h"), F.col("w"))
    return df.withColumn("_f", features).select(*df.columns, *[F.get("_f", F.lit(i)).alias(n) for i, n in enumerate(INTENT_FEATURES)])
