"""Labels, verdicts and grades as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keyword lists per category, in order of precedence.
CATEGORY_KEYWORDS = {
    "fixed_wing": ["plane", "wing", "glider", "disco", "surveillance"],
    "hybrid": ["vtol", "hybrid", "convertible", "tilt"],
    "multirotor": [
        "quad", "hex", "octo", "copter", "phantom", "mavic", "bebop", "parrot", "dji", "yuneec", "syma", "hubsan",
        "walkera", "blade", "arris", "holy",
    ],
}
# Manufacturer prefixes.
MANUFACTURERS = ["DJI", "FUTABA", "FLYSKY", "FRSKY", "SIYI", "HOBBYWING", "RADIOMASTER", "SPEKTRUM", "TBS"]


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def binary_label(col: Column | str, negatives: tuple[str, ...] = ("NEGATIVE", "background")) -> Column:
    return F.when(_c(col).isin(*negatives), 0).otherwise(1)


def superclass(col: Column | str, n_types: int) -> Column:
    return F.when(_c(col) >= n_types, "background").otherwise("drone")


def categorize(col: Column | str, keywords: dict[str, list[str]] | None = None) -> Column:
    name = F.lower(_c(col))
    out = None
    for category, words in (keywords or CATEGORY_KEYWORDS).items():
        hit = name.rlike("|".join(words))
        out = F.when(hit, category) if out is None else out.when(hit, category)
    return out.otherwise("unknown")


def manufacturer(col: Column | str, known: list[str] | None = None) -> Column:
    head = F.element_at(F.split(_c(col), "_"), 1)
    prefix = F.upper(F.element_at(F.split(head, "-"), 1))
    word = F.upper(F.element_at(F.split(head, " "), 1))
    return F.when(prefix.isin(*(known or MANUFACTURERS)), prefix).otherwise(word)


def split_unit(col: Column | str, sep: str = "_") -> tuple[Column, Column]:
    """(model, unit) cut at the last separator; both NULL without one."""
    pattern = f"(?s)^(.*){sep}([^{sep}]*)$"
    has = _c(col).contains(sep)
    return F.when(has, F.regexp_extract(_c(col), pattern, 1)), F.when(has, F.regexp_extract(_c(col), pattern, 2))


def matches_any(col: Column | str, parts: list[str]) -> Column:
    name = F.lower(_c(col))
    hit = F.lit(False)
    for part in parts:
        hit = hit | name.contains(part.lower())
    return hit


def filter_types(df: DataFrame, col: str, parts: list[str]) -> DataFrame:
    return df.where(matches_any(col, parts))


def family_split(df: DataFrame, col: str, family: list) -> DataFrame:
    return df.withColumn("in_family", F.col(col).isin(*family))


def label_index(df: DataFrame, col: str) -> DataFrame:
    """Row's label plus its position in the sorted list of distinct labels.

    The index is built over the distinct labels, so the ordered window sees one row per label.
    """
    from pyspark.sql import Window

    names = df.select(F.col(col).alias("_l")).where("_l IS NOT NULL").distinct()
    index = names.withColumn("label_index", F.row_number().over(Window.orderBy("_l")) - 1)
    return df.join(index, F.col(col) == F.col("_l"), "left").drop("_l")


def verdict(dist: Column | str, threshold: Column | float) -> Column:
    return F.when(_c(dist) <= threshold, "DRONE").otherwise("BACKGROUND")


def confidence_band(dist: Column | str, threshold: Column, std: Column) -> Column:
    """Eight bands from the margin in deviations. Cuts 3, 1.5, 0."""
    margin = (threshold - _c(dist)) / F.greatest(std, F.lit(1e-6))
    levels = lambda m, side: (
        F.when(m > 3, f"Very high confidence {side}")
        .when(m > 1.5, f"High confidence {side}")
        .when(m > 0, f"Moderate confidence {side}")
        .otherwise(f"Low confidence {side}")
    )
    return F.when(_c(dist) <= threshold, levels(margin, "drone")).otherwise(levels(-margin, "background"))


def confidence_ratio(dist: Column | str, threshold: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - _c(dist) / (threshold * 2)))


def interp_percentile(
    dist: Column | str, knots: Column, levels: tuple[float, ...] = (50, 75, 90, 95, 99), below_slope: float = 5.0
) -> Column:
    """Piecewise-linear level of a distance among percentile knots; under the first knot it falls off linearly."""
    d = _c(dist)
    x = [F.element_at(knots, i + 1) for i in range(len(levels))]
    out = F.when(d < x[0], F.lit(float(levels[0])) - (x[0] - d) * F.lit(below_slope))
    for i in range(len(levels) - 1):
        width = F.nullif(x[i + 1] - x[i], F.lit(0.0))
        part = F.coalesce((d - x[i]) / width, F.lit(1.0)) * F.lit(float(levels[i + 1] - levels[i]))
        out = out.when(d < x[i + 1], F.lit(float(levels[i])) + part)
    return out.otherwise(F.lit(float(levels[-1])))


def tail_confidence(pct_greater: Column | str) -> Column:
    """Confidence of a detection: share of training distances that are greater, so closer is surer."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), _c(pct_greater) / 100))


# Grading rules as (lower bound, exclusive unless stated, grade), best first.
GRADES = {
    "transfer": [(0.9, False, "PASS"), (0.7, False, "PARTIAL"), (None, False, "FAIL")],
    "matched": [(0.95, True, "AIRTIGHT"), (0.90, True, "STRONG"), (None, False, "SHORTCUT_DETECTED")],
    "replay": [(0.8, False, "VULNERABLE"), (0.2, True, "PARTIAL"), (None, False, "ROBUST")],
    "surgery": [(0.80, True, "HEAVILY_CONTAMINATED"), (0.65, True, "PARTIALLY_CONTAMINATED"),
                (0.55, True, "MOSTLY_CLEAN"), (None, False, "CLEAN")],
}


def grade(value: Column | str, rules: str | list) -> Column:
    out = None
    for limit, inclusive, name in GRADES[rules] if isinstance(rules, str) else rules:
        if limit is None:
            return out.otherwise(name) if out is not None else F.lit(name)
        hit = _c(value) >= limit if inclusive else _c(value) > limit
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def hard_negative_grade(auc: Column | str, false_positive: Column | str) -> Column:
    return F.when((_c(auc) > 0.95) & (_c(false_positive) < 0.1), "PASS").when(_c(auc) > 0.85, "PARTIAL").otherwise("FAIL")


def artifact_grade(auc: Column | str, probe: Column | str) -> Column:
    bad = (_c(auc) > 0.7) | (_c(probe) > 0.8)
    good = (_c(auc) < 0.6) & (_c(probe) < 0.65)
    return F.when(bad, "inflated").when(good, "clean").otherwise("inconclusive")


# Protocol gates (metric, comparison, limit, gate).
GATES = [
    ("knn_k1_accuracy", ">", 0.70, "success"),
    ("knn_k1_accuracy", ">", 0.85, "stretch"),
    ("probe_accuracy", ">", 0.80, "success"),
    ("probe_accuracy", ">", 0.90, "stretch"),
    ("detection_rate", ">=", 5 / 7, "success"),
    ("silhouette", ">", 0.0, "success"),
    ("fpr_at_95_tpr", "<", 0.10, "success"),
    ("fpr_at_95_tpr", "<", 0.05, "stretch"),
]


def protocol_gates(metrics: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    """Every gate with the measured value and whether it passed (NULL when not measured)."""
    names = ("gate_metric", "op", "limit_value", "gate")
    items = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, g)]) for g in GATES])
    rules = metrics.sparkSession.range(1).select(F.inline(items))
    v, x = F.col(value), F.col("limit_value")
    ok = F.when(F.col("op") == ">", v > x).when(F.col("op") == ">=", v >= x).when(F.col("op") == "<", v < x)
    return rules.join(metrics, F.col("gate_metric") == F.col(metric), "left").select(
        "gate_metric", "gate", "limit_value", v.alias("measured"), ok.alias("passed")
    )
