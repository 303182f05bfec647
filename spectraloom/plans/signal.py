"""Segments, spectra, standardisation, noise and intent features over the event series and vectors."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from spectraloom.functions import vectors as V
from spectraloom.operators import augment as A
from spectraloom.operators import signal as S
from spectraloom.plans.base import LONG_CTE, SAMPLES_CTE, R, events, query, r, samples, table


def series(spark, sf_dir):
    """Events of one user as a sampled signal: position, value."""
    ev = events(spark, sf_dir).select(
        "user_id", "event_id", "ts", (F.col("value") / 100).alias("v"), F.date_trunc("hour", "ts").alias("hour")
    )
    return S.indexed_series(ev, ["user_id"], [F.col("ts"), F.col("event_id")], ["hour"]).drop("hour")


def segments(spark, sf_dir, length, stride=None):
    return S.segment_rows(series(spark, sf_dir), ["user_id"], "idx", ["v"], length, stride)


def seg_sql(length: int, stride: int | None = None) -> str:
    stride = stride or length // 2
    return f"""ser AS (SELECT user_id, event_id, ts, value / 100 AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events),
len AS (SELECT user_id, count(*) AS n FROM ser GROUP BY user_id),
win AS (SELECT user_id, unnest(range(0, CASE WHEN n >= {length} THEN (n - {length}) // {stride} + 1 ELSE 0 END)) AS segment_idx FROM len),
seg AS (SELECT w.user_id, w.segment_idx, s.idx - w.segment_idx * {stride} AS t, s.v FROM win w JOIN ser s ON s.user_id = w.user_id
  AND s.idx >= w.segment_idx * {stride} AND s.idx < w.segment_idx * {stride} + {length})"""


@query("B1 I", f"WITH {seg_sql(32)} SELECT user_id, segment_idx, min(t) + segment_idx * 16 AS start_sample, count(*) AS n, {R('sum(v)')} AS total FROM seg GROUP BY user_id, segment_idx")
def segment_event_series(spark, sf_dir):
    seg = segments(spark, sf_dir, 32)
    return seg.select("user_id", "segment_idx", "start_sample", F.size("v").cast("long").alias("n"), r(V.vec_sum("v")).alias("total"))


@query(
    "B1",
    f"""WITH {SAMPLES_CTE}, s AS (SELECT sample_id, embedding, unnest(range(0, 4)) AS segment_idx FROM samples)
SELECT sample_id, segment_idx, segment_idx * 12 AS start_sample, {R('list_sum(list_slice(embedding, segment_idx * 12 + 1, segment_idx * 12 + 24))')} AS total FROM s""",
)
def segment_arrays_of_vectors(spark, sf_dir):
    rows = S.segment_arrays(samples(spark, sf_dir).select("sample_id", "embedding"), ["embedding"], 24, 12, cap=10)
    return rows.select(
        "sample_id", F.col("segment_idx").cast("long").alias("segment_idx"), F.col("start_sample").cast("long").alias("start_sample"),
        r(V.vec_sum("embedding")).alias("total"),
    )


@query(
    "B2 B3 B4",
    f"""WITH {seg_sql(8)}, wv AS (SELECT user_id, segment_idx, t, v * (0.5 - 0.5 * cos(2 * pi() * t / 7)) AS x FROM seg),
z AS (SELECT user_id, segment_idx, k, sum(x * cos(2 * pi() * k * t / 8)) AS re, -sum(x * sin(2 * pi() * k * t / 8)) AS im
  FROM wv CROSS JOIN (SELECT unnest(range(0, 8)) AS k) GROUP BY ALL)
SELECT user_id, segment_idx, k AS bin, {R('ln(1 + re * re + im * im)', 5)} AS log_power, CASE WHEN k % 4 <> 0 THEN {R('atan2(im, re) / pi()', 5)} END AS phase FROM z""",
)
def frame_spectrum_of_segments(spark, sf_dir):
    """Windowed Fourier frames; the phase of the two real bins is noise and left out."""
    rows = S.frame_spectrum(segments(spark, sf_dir, 8), "v")
    return rows.select("user_id", "segment_idx", F.posexplode(F.arrays_zip("log_power", "phase")).alias("bin", "z")).select(
        "user_id", "segment_idx", F.col("bin").cast("long").alias("bin"), r("z.log_power", 5).alias("log_power"),
        F.when(F.col("bin") % 4 != 0, r("z.phase", 5)).alias("phase"),
    )


# Transforms of the 64-sample segments by the defining sums: value as I, the reversed value as Q, 16 points, hop 4.
TWO_SIDED_SQL = f"""{seg_sql(64)}, iq AS (SELECT a.user_id, a.segment_idx, a.t, a.v AS i, b.v AS q FROM seg a JOIN seg b ON a.user_id = b.user_id AND a.segment_idx = b.segment_idx AND b.t = 63 - a.t),
tap AS (SELECT p.frame, j.j, (p.frame - 1) * 4 - 8 + j.j AS t, 0.5 - 0.5 * cos(2 * pi() * j.j / 15) AS w FROM range(0, 19) AS p(frame), range(0, 16) AS j(j)),
bin AS (SELECT f.bin, j.j, cos(2 * pi() * f.bin * (j.j - 8) / 16) AS c, sin(2 * pi() * f.bin * (j.j - 8) / 16) AS s FROM range(0, 16) AS f(bin), range(0, 16) AS j(j)),
z AS (SELECT user_id, segment_idx, bin, frame, sum(w * (i * c + q * s)) AS re, sum(w * (q * c - i * s)) AS im FROM iq JOIN tap USING (t) JOIN bin USING (j) GROUP BY ALL),
spec AS (SELECT user_id, segment_idx, bin, frame, ln(1 + re * re + im * im) AS lp, atan2(im, re) / pi() AS ph FROM z)"""


def two_channel(spark, sf_dir, **options):
    seg = segments(spark, sf_dir, 64).withColumn("q", F.reverse("v"))
    return S.stft(seg.withColumnRenamed("v", "i"), "i", "q", n_fft=16, hop=4, **options)


def cells(spec):
    """One row per channel, bin and frame."""
    at = spec.select("user_id", "segment_idx", "h", "w", F.posexplode("spec").alias("p", "value"))
    plane = F.col("h") * F.col("w")
    return at.select(
        "user_id", "segment_idx", F.floor(F.col("p") / plane).alias("channel"), F.floor(F.col("p") % plane / F.col("w")).alias("bin"), (F.col("p") % F.col("w")).cast("long").alias("frame"),
        F.col("value").cast("double").alias("value"),
    )


@query(
    "B2 B3 B4",
    f"""WITH {TWO_SIDED_SQL}, f AS (SELECT *, CAST(CAST(lp AS FLOAT) AS DOUBLE) AS l, CAST(CAST(ph AS FLOAT) AS DOUBLE) AS a FROM spec)
SELECT user_id, segment_idx, bin, frame, {R('l', 4)} AS log_power, {R('cos(pi() * a) * sqrt(exp(l) - 1)', 3)} AS re, {R('sin(pi() * a) * sqrt(exp(l) - 1)', 3)} AS im FROM f""",
)
def stft_values(spark, sf_dir):
    """Log power and phase of every bin and frame; the phase is shown as the transform's two parts."""
    at = cells(two_channel(spark, sf_dir, size=None, normalize=False))
    pair = at.groupBy("user_id", "segment_idx", "bin", "frame").agg(F.max(F.when(F.col("channel") == 0, F.col("value"))).alias("l"), F.max(F.when(F.col("channel") == 1, F.col("value"))).alias("a"))
    size, angle = F.sqrt(F.exp("l") - 1), F.lit(math.pi) * F.col("a")
    return pair.select("user_id", "segment_idx", "bin", "frame", r("l", 4).alias("log_power"), r(F.cos(angle) * size, 3).alias("re"), r(F.sin(angle) * size, 3).alias("im"))


@query(
    "B2 B6 B8",
    f"""WITH {TWO_SIDED_SQL}, near AS (SELECT k.frame, CAST(round(k.frame * 18 / 15.0) AS BIGINT) AS f FROM range(0, 16) AS k(frame)),
img AS (SELECT user_id, segment_idx, 0 AS channel, bin, near.frame, lp AS x FROM spec JOIN near ON spec.frame = near.f UNION ALL SELECT user_id, segment_idx, 1, bin, near.frame, ph FROM spec JOIN near ON spec.frame = near.f)
SELECT user_id, segment_idx, CAST(channel AS BIGINT) AS channel, bin, frame,
  {R('CAST((x - avg(x) OVER p) / CASE WHEN stddev_pop(x) OVER p < 1e-8 THEN 1 ELSE stddev_pop(x) OVER p END AS FLOAT)', 3)} AS value FROM img WINDOW p AS (PARTITION BY user_id, segment_idx, channel)""",
)
def spectrograms_of_event_series(spark, sf_dir):
    """Standardised two-channel spectrogram of every segment, resized to 16 x 16 by nearest cells."""
    return cells(two_channel(spark, sf_dir, size=(16, 16))).withColumn("value", r("value", 3))


@query(
    "B5 B7",
    f"""WITH {seg_sql(64)}, iq AS (SELECT a.user_id, a.segment_idx, a.t, a.v AS i, b.v AS q FROM seg a JOIN seg b ON a.user_id = b.user_id AND a.segment_idx = b.segment_idx AND b.t = 63 - a.t),
tap AS (SELECT p.frame, j.j, p.frame * 4 + j.j AS t, (0.5 - 0.5 * cos(2 * pi() * j.j / 16)) / 8 AS w FROM range(0, 13) AS p(frame), range(0, 16) AS j(j)),
turn AS (SELECT (f.bin + 8) % 16 AS bin, j.j, cos(2 * pi() * f.bin * j.j / 16) AS c, sin(2 * pi() * f.bin * j.j / 16) AS s FROM range(0, 16) AS f(bin), range(0, 16) AS j(j)),
z AS (SELECT user_id, segment_idx, bin, frame, sum(w * (i * c + q * s)) AS re, sum(w * (q * c - i * s)) AS im FROM iq JOIN tap USING (t) JOIN turn USING (j) GROUP BY ALL),
db AS (SELECT user_id, segment_idx, bin, frame, 20 * log10(sqrt(re * re + im * im) + 1e-8) AS d FROM z),
gr AS (SELECT *, lag(d) OVER o AS b, lead(d) OVER o AS a FROM db WINDOW o AS (PARTITION BY user_id, segment_idx, bin ORDER BY frame)),
ch AS (SELECT user_id, segment_idx, 0 AS channel, bin, frame, d AS x FROM gr UNION ALL SELECT user_id, segment_idx, 1, bin, frame, CASE WHEN b IS NULL THEN a - d WHEN a IS NULL THEN d - b ELSE (a - b) / 2 END FROM gr),
col AS (SELECT k.frame, greatest(0, least(12, (k.frame + 0.5) * 13 / 16.0 - 0.5)) AS pos FROM range(0, 16) AS k(frame)),
img AS (SELECT user_id, segment_idx, channel, bin, col.frame, sum(x * CASE WHEN ch.frame = floor(pos) THEN 1 - (pos - floor(pos)) ELSE pos - floor(pos) END) AS x
  FROM ch JOIN col ON ch.frame = floor(pos) OR (ch.frame = floor(pos) + 1 AND pos > floor(pos)) GROUP BY ALL)
SELECT user_id, segment_idx, CAST(channel AS BIGINT) AS channel, bin, frame,
  {R('CAST((x - avg(x) OVER p) / CASE WHEN stddev_samp(x) OVER p < 1e-8 THEN 1 ELSE stddev_samp(x) OVER p END AS FLOAT)', 3)} AS value FROM img WINDOW p AS (PARTITION BY user_id, segment_idx, channel)""",
)
def gradient_spectrograms_of_event_series(spark, sf_dir):
    """Standardised decibel spectrogram and its time gradient, resized to 16 x 16 between cells."""
    return cells(two_channel(spark, sf_dir, size=(16, 16), features="db_grad")).withColumn("value", r("value", 3))


@query(
    "B5 I",
    f"""WITH s AS (SELECT user_id, event_id, value / 100 AS v, lag(value / 100) OVER w AS b, lead(value / 100) OVER w AS a FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, {R('CASE WHEN a IS NULL AND b IS NULL THEN 0 WHEN b IS NULL THEN a - v WHEN a IS NULL THEN v - b ELSE (a - b) / 2 END')} AS gradient FROM s""",
)
def time_gradient_of_series(spark, sf_dir):
    return S.gradient_rows(series(spark, sf_dir), ["user_id"], "idx", "v").select("event_id", r("gradient").alias("gradient"))


@query(
    "B8",
    f"""WITH s AS (SELECT l_suppkey, avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS sd FROM lineitem GROUP BY 1),
z AS (SELECT l_suppkey, (l_extendedprice - m) / sd AS z FROM lineitem JOIN s USING (l_suppkey))
SELECT l_suppkey, count(*) AS n, {R('avg(z * z)', 4)} AS mean_square, {R('max(z)')} AS max_z, {R('min(z)')} AS min_z FROM z GROUP BY 1""",
)
def standardize_within_supplier(spark, sf_dir):
    z = S.standardize_by_key(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_extendedprice")
    return z.groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), r(F.avg(F.col("z") * F.col("z")), 4).alias("mean_square"),
        r(F.max("z")).alias("max_z"), r(F.min("z")).alias("min_z"),
    )


@query(
    "B8",
    f"""WITH {LONG_CTE}, s AS (SELECT sample_id, avg(x) AS m, stddev_samp(x) AS sd FROM long GROUP BY sample_id)
SELECT sample_id, d AS dim, {R('(x - m) / sd')} AS z FROM long JOIN s USING (sample_id)""",
)
def standardize_each_vector(spark, sf_dir):
    rows = samples(spark, sf_dir).select("sample_id", F.posexplode(V.standardize_expr("embedding", ddof=1)).alias("p", "z"))
    return rows.select("sample_id", (F.col("p") + 1).cast("long").alias("dim"), r("z").alias("z"))


@query(
    "B9",
    f"""WITH {LONG_CTE}, s AS (SELECT d, avg(x) AS m, stddev_pop(x) AS sd FROM long GROUP BY d), g AS (SELECT avg(x) AS m, stddev_pop(x) AS sd FROM long)
SELECT 'bin' AS level, sample_id, d AS dim, {R('(x - s.m) / s.sd')} AS z FROM long JOIN s USING (d)
UNION ALL SELECT 'dataset', sample_id, d, {R('(x - g.m) / g.sd')} FROM long CROSS JOIN g""",
)
def standardize_by_table_statistics(spark, sf_dir):
    rows = samples(spark, sf_dir).select("sample_id", "embedding")
    out = None
    for level in ("bin", "dataset"):
        z = S.standardize_vectors(rows, "embedding", level).select(F.lit(level).alias("level"), "sample_id", F.posexplode("embedding").alias("p", "z"))
        out = z if out is None else out.unionByName(z)
    return out.select("level", "sample_id", (F.col("p") + 1).cast("long").alias("dim"), r("z").alias("z"))


DIRTY_SQL = "CASE WHEN sample_id % 7 = 0 THEN list_transform(embedding, lambda x: x * 1e-9) WHEN sample_id % 7 = 1 THEN list_transform(embedding, lambda x: CAST('nan' AS DOUBLE)) ELSE embedding END"


@query("B10", f"WITH {SAMPLES_CTE} SELECT sample_id, label FROM samples WHERE sample_id % 7 > 1")
def drop_garbage_vectors(spark, sf_dir):
    """Every seventh vector is blanked and every next one is broken; both kinds must go."""
    vec = F.when(F.col("sample_id") % 7 == 0, F.transform("embedding", lambda x: x * 1e-9)).when(
        F.col("sample_id") % 7 == 1, F.transform("embedding", lambda x: F.lit(float("nan")))
    ).otherwise(F.col("embedding"))
    return S.drop_garbage(samples(spark, sf_dir).withColumn("spec", vec)).select("sample_id", "label")


@query(
    "B11",
    f"""WITH {SAMPLES_CTE}, s AS (SELECT sample_id, [1, 2, 4][sample_id % 3 + 1] AS c, 64 // [1, 2, 4][sample_id % 3 + 1] AS pl, embedding AS spec FROM samples),
t AS (SELECT sample_id, c, pl, CASE WHEN c = 1 THEN list_concat(spec, spec) ELSE list_slice(spec, 1, 2 * pl) END AS two, spec FROM s)
SELECT sample_id, {R('list_sum(list_transform(two, lambda x: CAST(CAST(x AS FLOAT) AS DOUBLE)))')} AS two_sum, CAST(len(two) AS BIGINT) AS two_len,
 {R('CASE WHEN c = 4 THEN list_sum(list_slice(spec, 1, 3 * pl)) ELSE list_sum(two) END')} AS three_sum, CAST(3 * pl AS BIGINT) AS three_len FROM t""",
)
def harmonise_channels(spark, sf_dir):
    """Vectors read as one, two or four planes, brought to two and to three channels."""
    c = F.element_at(F.array(F.lit(1), F.lit(2), F.lit(4)), (F.col("sample_id") % 3 + 1).cast("int"))
    rows = samples(spark, sf_dir).select("sample_id", c.alias("c"), F.col("embedding").cast("array<float>").alias("spec"))
    rows = rows.withColumn("h", (F.lit(16) / F.col("c")).cast("int")).withColumn("w", F.lit(4))
    both = S.to_channels(rows, 2).select("sample_id", F.col("spec").alias("two")).join(
        S.to_channels(rows, 3).select("sample_id", F.col("spec").alias("three")), "sample_id"
    )
    return both.select(
        "sample_id", r(V.vec_sum("two")).alias("two_sum"), F.size("two").cast("long").alias("two_len"),
        r(V.vec_sum("three")).alias("three_sum"), F.size("three").cast("long").alias("three_len"),
    )


@query(
    "B12",
    f"WITH {SAMPLES_CTE}, s AS (SELECT sample_id, list_transform(embedding, lambda x: x * (sample_id % 9)) AS v FROM samples) SELECT sample_id, {R('CASE WHEN list_max(v) > 1.5 THEN list_sum(v) / 255 ELSE list_sum(v) END')} AS total FROM s",
)
def rescale_pixel_range(spark, sf_dir):
    vec = F.transform("embedding", lambda x: x * (F.col("sample_id") % 9))
    return samples(spark, sf_dir).select("sample_id", r(V.vec_sum(V.rescale_255(vec))).alias("total"))


@query("B13", f"WITH {LONG_CTE}, n AS (SELECT sample_id, sqrt(sum(x * x * 9)) + 1e-8 AS n FROM long GROUP BY sample_id) SELECT sample_id, d AS dim, {R('3 * x / n')} AS v FROM long JOIN n USING (sample_id)")
def l2_normalize_vectors(spark, sf_dir):
    tripled = F.transform("embedding", lambda x: x * 3)
    rows = samples(spark, sf_dir).select("sample_id", F.posexplode(V.l2_normalize(tripled)).alias("p", "v"))
    return rows.select("sample_id", (F.col("p") + 1).cast("long").alias("dim"), r("v").alias("v"))


def planes(spark, sf_dir):
    """Vectors as one-channel 8 x 8 planes."""
    return samples(spark, sf_dir).select(
        "sample_id", "label", "split", F.col("embedding").cast("array<float>").alias("spec"),
        F.lit(1).alias("c"), F.lit(8).alias("h"), F.lit(8).alias("w"),
    )


# The seeded draws of ``augment`` in SQL: z0 -> z1 -> z2 -> uniform, and Box-Muller normals.
PIXEL_SQL = LONG_CTE + """,
px AS (SELECT sample_id, label, split, d - 1 AS cell, (d - 1) // 8 AS bin, (d - 1) % 8 AS frame, CAST(CAST(x AS FLOAT) AS DOUBLE) AS x FROM long)"""


def u_sql(name: str, source: str) -> str:
    """CTEs ending in ``name``: the rows of ``source`` (with columns seed and draw) and their uniform number u."""
    return f"""{name}_0 AS (SELECT *, (seed + draw * 2654435761) & 2147483647 AS z FROM {source}),
{name}_1 AS (SELECT * REPLACE ((xor(z, z >> 15) * 739982445) & 2147483647 AS z) FROM {name}_0),
{name}_2 AS (SELECT * REPLACE ((xor(z, z >> 13) * 695872825) & 2147483647 AS z) FROM {name}_1),
{name} AS (SELECT * EXCLUDE (z), (xor(z, z >> 15) + 0.5) / 2147483648.0 AS u FROM {name}_2)"""


def normal_sql(name: str, keys: str, source: str, first: str) -> str:
    """CTE ``name``: a standard normal per row of ``source`` (keys, seed, cell), from draws first + 2 cell and the next."""
    return f"""{name}_s AS (SELECT {keys}, seed, cell, half, {first} + 2 * cell + half AS draw FROM {source}, range(0, 2) AS h(half)), {u_sql(name + '_u', name + '_s')},
{name} AS (SELECT {keys}, cell, sqrt(-2 * ln(max(u) FILTER (half = 0))) * cos(2 * pi() * max(u) FILTER (half = 1)) AS g FROM {name}_u GROUP BY ALL)"""


def seed_sql(key: str, seed: int) -> str:
    return f"(CAST(CAST('0x' || substr(md5({key} || ':{seed}'), 1, 8) AS UBIGINT) AS BIGINT) & 2147483647)"


@query(
    "B14 B17 G11",
    f"""WITH {PIXEL_SQL}, lv AS (SELECT unnest([0, 1, 2, 3]) AS ordinal, unnest([25.0, 10.0, 0.0, -10.0])::DOUBLE AS snr_db, unnest(['25.0', '10.0', '0.0', '-10.0']) AS name),
pw AS (SELECT sample_id, avg(x * x) AS power FROM px GROUP BY sample_id),
src AS (SELECT ordinal, snr_db, sample_id, cell, {seed_sql("sample_id || '|' || name", 3)} AS seed FROM px, lv), {normal_sql('g', 'ordinal, sample_id', 'src', '0')},
n AS (SELECT ordinal, snr_db, sample_id, x, CASE WHEN snr_db >= 25 THEN x ELSE CAST(CAST(x + g * sqrt(power / pow(10, snr_db / 10)) AS FLOAT) AS DOUBLE) END AS y
  FROM g JOIN px USING (sample_id, cell) JOIN pw USING (sample_id) JOIN lv USING (ordinal))
SELECT ordinal, snr_db, count(DISTINCT sample_id) AS n, {R('sum((y - x) * (y - x)) / sum(x * x)', 3)} AS noise_ratio FROM n GROUP BY ALL""",
)
def snr_sweep_power(spark, sf_dir):
    """Measured noise-to-signal power of every level; the tests check it against the target."""
    rows = planes(spark, sf_dir)
    swept = A.snr_sweep(rows, [25.0, 10.0, 0.0, -10.0], seed=3)
    both = swept.join(rows.select("sample_id", F.col("spec").alias("clean")), "sample_id")
    return both.groupBy("ordinal", "snr_db").agg(
        F.count(F.lit(1)).alias("n"),
        r(F.sum(V.sq_dist("spec", "clean")) / F.sum(V.dot("clean", "clean")), 3).alias("noise_ratio"),
    )


@query("B15 B16")
def interference_power(spark, sf_dir):
    rows = planes(spark, sf_dir)
    out = None
    for kind in ("wifi", "bluetooth", "microwave", "urban"):
        part = A.add_noise(rows, 0.0, seed=5, kind=kind).withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    both = out.join(rows.select("sample_id", F.col("spec").alias("clean")), "sample_id")
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), r(F.avg(V.sq_dist("spec", "clean")), 3).alias("added_power"))


QUIET_SQL = f"""{seg_sql(16)}, a AS (SELECT user_id, segment_idx, quantile_cont(v, 0.1) AS fl, stddev_pop(v) AS sd, quantile_cont(v, 0.5) AS med FROM seg GROUP BY ALL),
b AS (SELECT s.user_id, s.segment_idx, stddev_pop(v) FILTER (v <= fl + sd) AS lsd FROM seg s JOIN a USING (user_id, segment_idx) GROUP BY ALL),
c AS (SELECT s.user_id, s.segment_idx, any_value(fl) AS fl, any_value(sd) AS sd, count(*) FILTER (v <= fl + 1.5 * lsd) AS nq,
  stddev_pop(v) FILTER (v <= fl + 1.5 * lsd) AS qsd, stddev_pop(v) FILTER (v <= med) AS msd, count(*) FILTER (v <= med) AS nm FROM seg s JOIN a USING (user_id, segment_idx) JOIN b USING (user_id, segment_idx) GROUP BY ALL),
d AS (SELECT user_id, segment_idx, fl, CASE WHEN nq >= 5 THEN qsd WHEN nm > 1 THEN msd ELSE 0.5 * sd END AS dev FROM c)"""


@query(
    "B18",
    f"""WITH {QUIET_SQL} SELECT s.user_id, s.segment_idx, CAST(count(*) FILTER (v > fl + 2 * dev) AS BIGINT) AS removed, {R('sum(CASE WHEN v > fl + 2 * dev THEN fl ELSE v END)')} AS total
FROM seg s JOIN d USING (user_id, segment_idx) GROUP BY ALL""",
)
def matched_background_floor(spark, sf_dir):
    """Signal over each row's noise floor replaced by the floor."""
    seg = segments(spark, sf_dir, 16)
    rows = seg.select("user_id", "segment_idx", F.col("v").alias("raw"), F.col("v").alias("spec"), F.lit(1).alias("c"), F.lit(1).alias("h"), F.lit(16).alias("w"))
    out = A.matched_background(rows, method="zero", id_col="segment_idx")
    changed = F.size(F.filter(F.zip_with("spec", "raw", lambda a, b: a < b), lambda x: x))
    return out.select("user_id", "segment_idx", changed.cast("long").alias("removed"), r(V.vec_sum("spec")).alias("total"))


@query(
    "B18",
    f"""WITH {PIXEL_SQL}, a AS (SELECT sample_id, bin, quantile_cont(x, 0.1) AS fl, quantile_cont(x, 0.5) AS med, stddev_pop(x) AS sd, list_sort(list(x)) AS row FROM px GROUP BY ALL),
b AS (SELECT sample_id, bin, fl + 1.5 * stddev_pop(x) FILTER (x <= fl + sd) AS lim FROM px JOIN a USING (sample_id, bin) GROUP BY sample_id, bin, fl),
c AS (SELECT sample_id, bin, CASE WHEN count(*) FILTER (x <= lim) < 5 THEN any_value(med) ELSE any_value(lim) END AS lim FROM px JOIN a USING (sample_id, bin) JOIN b USING (sample_id, bin) GROUP BY ALL),
q AS (SELECT sample_id, bin, any_value(fl) AS fl, any_value(row) AS row, count(*) FILTER (x <= lim) AS n, CASE WHEN count(*) FILTER (x <= lim) > 1 THEN stddev_pop(x) FILTER (x <= lim) ELSE 0.5 * any_value(sd) END AS dev
  FROM px JOIN a USING (sample_id, bin) JOIN c USING (sample_id, bin) GROUP BY ALL),
src AS (SELECT sample_id, cell, {seed_sql('sample_id', 4)} AS seed, cell AS draw FROM px), {u_sql('p', 'src')}, {normal_sql('g', 'sample_id', 'p', '64')},
y AS (SELECT sample_id, CASE WHEN x <= fl + 2 * dev THEN x WHEN n > 1 THEN row[least(CAST(floor(u * n) AS BIGINT), n - 1) + 1] + 0.05 * g.g * dev ELSE fl + g.g * dev END AS y
  FROM px JOIN q USING (sample_id, bin) JOIN p USING (sample_id, cell) JOIN g USING (sample_id, cell))
SELECT sample_id, {R('sum(CAST(CAST(y AS FLOAT) AS DOUBLE))', 4)} AS total FROM y GROUP BY ALL""",
)
def matched_background_noise(spark, sf_dir):
    """Signal over each row's noise floor replaced by drawn noise."""
    out = A.matched_background(planes(spark, sf_dir), method="replace", seed=4)
    return out.select("sample_id", r(V.vec_sum("spec"), 4).alias("total"))


@query(
    "B19 E17",
    f"""WITH {PIXEL_SQL}, env AS (SELECT bin, greatest(avg(x), 0) AS e FROM px WHERE split = 'train' GROUP BY bin),
rk AS (SELECT sample_id, row_number() OVER (ORDER BY md5(sample_id || ':6'), sample_id) AS rn, count(*) OVER () AS n FROM samples WHERE split = 'negatives'),
dr AS (SELECT draw, CAST(CAST('0x' || substr(md5(draw || ':6'), 1, 8) AS UBIGINT) AS BIGINT) % (SELECT max(n) FROM rk) + 1 AS rn FROM range(0, 200) AS d(draw)),
own AS (SELECT sample_id, bin, greatest(avg(x), 0) AS o FROM px GROUP BY ALL),
sc AS (SELECT draw, sample_id, cell, x * greatest(0.5, least(2.0, e / (o + 1e-8))) AS y FROM dr JOIN rk USING (rn) JOIN px USING (sample_id) JOIN own USING (sample_id, bin) JOIN env USING (bin)),
st AS (SELECT draw, sample_id, cell, (y - avg(y) OVER p) / stddev_pop(y) OVER p AS z FROM sc WINDOW p AS (PARTITION BY draw))
SELECT draw, sample_id, {R('sum(CAST(CAST(z AS FLOAT) AS DOUBLE) * (cell + 1))', 3)} AS weighted FROM st GROUP BY ALL""",
)
def shaped_hard_negatives(spark, sf_dir):
    rows = planes(spark, sf_dir)
    out = A.shape_hard_negatives(rows.where("split = 'negatives'"), rows.where("split = 'train'"), 200, seed=6)
    weighted = F.aggregate(F.transform("spec", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return out.select("draw", "sample_id", r(weighted, 3).alias("weighted"))


@query("B20 B21")
def augmented_views(spark, sf_dir):
    rows = planes(spark, sf_dir)
    both = A.augment(rows, 2, 1).withColumn("mode", F.lit("crop")).unionByName(
        A.augment(rows, 2, 1, mode="roll").withColumn("mode", F.lit("roll"))
    )
    return both.select("mode", "sample_id", F.col("view").cast("long").alias("view"), r(V.vec_sum("spec"), 4).alias("total"))


@query(
    "B21",
    f"""WITH {PIXEL_SQL}, k AS (SELECT sample_id, view, {seed_sql("sample_id || '|' || view", 1)} AS seed FROM samples, range(0, 2) AS r(view)),
k1 AS (SELECT *, 0 AS draw FROM k), {u_sql('p', 'k1')}, src AS (SELECT sample_id, view, seed, unnest(range(0, 64)) AS cell FROM k), {normal_sql('g', 'sample_id, view', 'src', '8')}
SELECT sample_id, view, (bin + CAST(floor(-5 + u * 11) AS BIGINT) + 16) % 8 AS bin, {R('sum(CAST(CAST(x + 0.05 * g.g AS FLOAT) AS DOUBLE))', 4)} AS total
FROM px JOIN g USING (sample_id, cell) JOIN p USING (sample_id, view) GROUP BY ALL""",
)
def rolled_views(spark, sf_dir):
    """Noise and a circular shift of the bins: the sum of every bin."""
    out = A.augment(planes(spark, sf_dir), 2, 1, mode="roll").select("sample_id", F.col("view").cast("long").alias("view"), F.posexplode("spec").alias("p", "x"))
    return out.groupBy("sample_id", "view", F.floor(F.col("p") / 8).alias("bin")).agg(r(F.sum(F.col("x").cast("double")), 4).alias("total"))


@query(
    "B22",
    f"""WITH {PIXEL_SQL}, k AS (SELECT sample_id, replay_no, {seed_sql("sample_id || '|' || replay_no", 2)} AS seed FROM samples, range(0, 3) AS r(replay_no)),
k4 AS (SELECT *, unnest(range(0, 4)) AS draw FROM k), {u_sql('p', 'k4')},
par AS (SELECT sample_id, replay_no, max(CAST(floor(1 + u * 5) AS BIGINT)) FILTER (draw = 0) AS t, max(CAST(floor(1 + u * 5) AS BIGINT)) FILTER (draw = 1) AS f,
  max(0.01 + 0.04 * u) FILTER (draw = 2) AS level, max(0.9 + 0.2 * u) FILTER (draw = 3) AS gain FROM p GROUP BY ALL),
src AS (SELECT sample_id, replay_no, seed, unnest(range(0, 64)) AS cell FROM k), {normal_sql('g', 'sample_id, replay_no', 'src', '8')},
y AS (SELECT sample_id, replay_no, CAST(CAST((x + level * g.g) * gain AS FLOAT) AS DOUBLE) AS y FROM px JOIN par USING (sample_id)
  JOIN g USING (sample_id, replay_no) WHERE g.cell = ((bin + f) % 8) * 8 + (frame + t) % 8)
SELECT sample_id, replay_no, {R('sum(y)', 4)} AS total FROM y GROUP BY ALL""",
)
def replayed_copies(spark, sf_dir):
    out = A.replay_variants(planes(spark, sf_dir), 3, 2)
    return out.select("sample_id", F.col("replay_no").cast("long").alias("replay_no"), r(V.vec_sum("spec"), 4).alias("total"))


@query(
    "B23",
    f"""WITH {LONG_CTE}, p AS (SELECT a.sample_id AS pair_id, avg((a.x - b.x) * (a.x - b.x)) AS s, avg(b.x * b.x) AS n FROM long a JOIN long b ON b.sample_id = a.sample_id + 1 AND a.d = b.d WHERE a.sample_id % 2 = 0 GROUP BY 1)
SELECT pair_id, {R('10 * log10(s / (n + 1e-10))')} AS snr_db FROM p""",
)
def residual_snr_of_pairs(spark, sf_dir):
    rows = samples(spark, sf_dir)
    left = rows.where("sample_id % 2 = 0").select(F.col("sample_id").alias("pair_id"), F.col("embedding").alias("drone"))
    right = rows.where("sample_id % 2 = 1").select((F.col("sample_id") - 1).alias("pair_id"), F.col("embedding").alias("bg"))
    return S.residual_snr(left.join(right, "pair_id"), "drone", "bg").select("pair_id", r("snr_db").alias("snr_db"))


INTENT_SQL = f"""{seg_sql(32)}, x AS (SELECT user_id, segment_idx, t // 8 AS f, t % 8 AS c, v FROM seg),
dl AS (SELECT *, abs(v - lag(v) OVER (PARTITION BY user_id, segment_idx, f ORDER BY c)) AS dv FROM x),
rf AS (SELECT user_id, segment_idx, f, var_pop(v) AS vr, abs(avg(v)) AS p FROM x GROUP BY ALL),
cs AS (SELECT user_id, segment_idx, avg(sd) AS ds FROM (SELECT user_id, segment_idx, c, stddev_pop(v) AS sd FROM x GROUP BY ALL) GROUP BY ALL),
g AS (SELECT user_id, segment_idx, max(v) AS mx, avg(v) AS mn, stddev_pop(v) AS sd, avg(dv) AS tt FROM dl GROUP BY ALL),
q AS (SELECT user_id, segment_idx, avg(vr) AS tv, stddev_pop(vr) AS burst, sum(p) + 1e-8 AS tp, sum(f * p) / (sum(p) + 1e-8) AS cf FROM rf GROUP BY ALL),
bw AS (SELECT user_id, segment_idx, sqrt(greatest(0, sum((f - cf) * (f - cf) * p) / any_value(tp))) AS bw FROM rf JOIN q USING (user_id, segment_idx) GROUP BY ALL)"""


def _intent(spark, sf_dir):
    seg = segments(spark, sf_dir, 32)
    rows = seg.select("user_id", "segment_idx", F.col("v").cast("array<double>").alias("spec"), F.lit(1).alias("c"), F.lit(4).alias("h"), F.lit(8).alias("w"))
    return A.intent_features(rows)


@query(
    "B24",
    f"""WITH {INTENT_SQL} SELECT user_id, segment_idx, {R('tv', 8)} AS temporal_variance, {R('tt', 8)} AS temporal_trend, {R('cf', 8)} AS centroid_freq, {R('bw', 8)} AS bandwidth,
 {R('mx / (mn + 1e-8)', 8)} AS peakiness, {R('(mx - mn) / (sd + 1e-8)', 8)} AS snr, {R('burst', 8)} AS burst, {R('ds', 8)} AS doppler_spread
FROM q JOIN cs USING (user_id, segment_idx) JOIN g USING (user_id, segment_idx) JOIN bw USING (user_id, segment_idx)""",
)
def intent_features_of_segments(spark, sf_dir):
    rows = _intent(spark, sf_dir)
    return rows.select("user_id", "segment_idx", *[r(n, 8).alias(n) for n in A.INTENT_FEATURES])


@query(
    "B25 B26",
    f"""WITH {INTENT_SQL}, f AS (SELECT round(tv, 9) AS tv, round(ds, 9) AS ds FROM q JOIN cs USING (user_id, segment_idx))
SELECT CASE WHEN tv < 0.5 AND ds < 1 THEN 'SURVEILLANCE' WHEN tv > 2 OR ds > 3 THEN 'ATTACK' ELSE 'TRANSIT' END AS v1,
 CASE WHEN tv + ds < 1.55 THEN 'SURVEILLANCE' WHEN tv + ds > 1.7 THEN 'ATTACK' ELSE 'TRANSIT' END AS v2, count(*) AS n FROM f GROUP BY ALL""",
)
def intent_rules_on_segments(spark, sf_dir):
    rows = _intent(spark, sf_dir).select(
        F.round("temporal_variance", 9).alias("tv"), F.round("doppler_spread", 9).alias("ds")
    )
    return rows.groupBy(S.intent_rule("tv", "ds", 1).alias("v1"), S.intent_rule("tv", "ds", 2).alias("v2")).agg(F.count(F.lit(1)).alias("n"))


def _half_model():
    """A stand-in model: sums of neighbouring pairs (64 values to 32)."""

    def predict(x):
        return x.reshape(len(x), -1, 2).sum(axis=2)

    return predict


@query(
    "B27 K1",
    f"WITH {LONG_CTE} SELECT sample_id, (d + 1) // 2 AS dim, {R('CAST(max(x) FILTER (d % 2 = 1) AS FLOAT) + CAST(max(x) FILTER (d % 2 = 0) AS FLOAT)')} AS v FROM long GROUP BY ALL",
)
def embed_with_user_model(spark, sf_dir):
    out = S.embed(planes(spark, sf_dir), _half_model, 64)
    return out.select("sample_id", F.posexplode("embedding").alias("p", "v")).select(
        "sample_id", (F.col("p") + 1).cast("long").alias("dim"), r("v").alias("v")
    )
