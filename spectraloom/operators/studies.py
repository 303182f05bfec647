"""Composite studies: leave a family out, look for mislabelled negatives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.operators.gaussian import all_distances, fit_gaussian, fit_without_each, mahalanobis
from spectraloom.operators.prefix import exact_percentiles
from spectraloom.operators.quality import kmeans_report
from spectraloom.operators.ranking import auc_by_type
from spectraloom.session import materialize


def leave_family_out(
    train: DataFrame, background: DataFrame, family: str, families: list, type_col: str, reg: float = 1e-3
) -> DataFrame:
    """For every family: fit without it, then AUC of each of its types against the background.

    Sums are taken per family in one pass; the fit without a family is the total minus its sums. A
    second pass scores rows against all fits and keeps only (family, type, distance).
    """
    models = fit_without_each(train, family, reg=reg)
    own = all_distances(train, models, family, "_fit").where(F.col(family) == F.col("_fit"))
    back = all_distances(background, models, family, "_fit")
    score = (-F.col("dist")).alias("s")
    left_out = materialize(own.select(F.col("_fit"), type_col, score), "left-out")
    negatives = materialize(back.select("_fit", score), "background")
    out = None
    for name in families:
        part = auc_by_type(
            left_out.where(F.col("_fit") == F.lit(name)), negatives.where(F.col("_fit") == F.lit(name)), "s", type_col
        ).withColumn(family, F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def mislabel_scan(train: DataFrame, negatives: DataFrame, q: float = 0.99, seed: int = 0, least: int = 4) -> tuple[DataFrame, DataFrame | None]:
    """Negatives inside the train threshold and, when there are enough, how they cluster."""
    model = fit_gaussian(train)
    model = materialize(model, "model")
    threshold = exact_percentiles(mahalanobis(train, model), "dist", [q]).select(F.element_at("pct", 1)).first()[0]
    suspects = materialize(mahalanobis(negatives, model).where(F.col("dist") <= threshold), "suspects")
    n = suspects.count()
    clusters = kmeans_report(suspects, [k for k in (2, 3) if k < n], seed) if n >= least else None
    return suspects, clusters
