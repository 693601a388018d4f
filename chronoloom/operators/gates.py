"""Gates: verdicts over fold results, each one aggregate and a ``when``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def murphy_gate(folds: DataFrame, by: list[str], low_resolution: float = 0.001, high_reliability: float = 0.002) -> DataFrame:
    """``by..., mean_resolution, mean_reliability, failure, blocked``: which component of the decomposition fails.

    "resolution" (calibration cannot help: blocked), "reliability" (calibrate first) or "mixed".
    """
    out = folds.groupBy(*by).agg(F.avg("resolution").alias("mean_resolution"), F.avg("reliability").alias("mean_reliability"))
    flat, off = F.col("mean_resolution") < low_resolution, F.col("mean_reliability") > high_reliability
    failure = F.when(flat & ~off, "resolution").when(off & ~flat, "reliability").otherwise("mixed")
    return out.withColumn("failure", failure).withColumn("blocked", F.col("failure") == "resolution")


def identifiability(counts: DataFrame, n: str, k: int, least: float = 20.0) -> DataFrame:
    """Adds ``ratio`` = n / k and ``verdict``: PASS where the training rows are at least ``least`` times the neighbours."""
    return counts.withColumn("ratio", F.col(n) / F.lit(float(k))).withColumn("verdict", F.when(F.col("ratio") >= least, "PASS").otherwise("FAIL"))


def paired(base: DataFrame, other: DataFrame, value: str) -> DataFrame:
    """``fold, delta`` of two results with one row per fold."""
    return base.select("fold", F.col(value).alias("__b")).join(other.select("fold", F.col(value).alias("__o")), "fold").select("fold", (F.col("__o") - F.col("__b")).alias("delta"))


def improvement_gate(deltas: DataFrame, by: list[str], least: float = 0.001, folds: int = 3, worst: float = 0.0005) -> DataFrame:
    """``by..., improved, worst_delta, verdict``: PASS if enough folds gain ``least`` and none loses more than ``worst``."""
    out = deltas.groupBy(*by).agg(F.count_if(F.col("delta") >= least).alias("improved"), F.min("delta").alias("worst_delta"))
    return out.withColumn("verdict", F.when((F.col("improved") >= folds) & (F.col("worst_delta") >= -worst), "PASS").otherwise("FAIL"))


def redundancy_gate(deltas: DataFrame, by: list[str], tolerance: float = 0.0005) -> DataFrame:
    """``by..., mean_delta, redundant``: what was left out is redundant if the mean score falls by less than the tolerance."""
    return deltas.groupBy(*by).agg(F.avg("delta").alias("mean_delta")).withColumn("redundant", F.col("mean_delta") > -tolerance)


def halves(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``half`` 1 or 2 of each group's rows in order (the first half is the smaller one)."""
    w = Window.partitionBy(*by)
    place = F.row_number().over(w.orderBy(*order))
    return rows.withColumn("half", F.when(place <= F.floor(F.count(F.lit(1)).over(w) / 2), 1).otherwise(2))
