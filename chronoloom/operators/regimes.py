"""Market regimes from a benchmark series, and probabilities overridden in a regime."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.temporal import backward, nearest_date


def label(value: Column, threshold: float = 0.0) -> Column:
    """0 below the threshold, else 1; an unknown value counts as 1."""
    return F.when(value < threshold, 0).otherwise(1)


def nearest_regime(rows: DataFrame, date: str, series: DataFrame, threshold: float = 0.0) -> DataFrame:
    """``regime`` by the benchmark value of the nearest date (which may lie ahead)."""
    return nearest_date(rows, date, series, "v", "__bench").withColumn("regime", label(F.col("__bench"), threshold)).drop("__bench")


def backward_regimes(rows: DataFrame, date: str, series: DataFrame, least: int = 10) -> DataFrame:
    """``regime`` with four classes from the last known values: 2 * (trend above 0) + (volatility at or above its median).

    ``series``: date, v (trend), vol. With fewer than ``least`` dates every regime is 0.
    """
    stats = series.where("v is not null").agg(F.count(F.lit(1)).alias("__n"), F.percentile("vol", F.lit(0.5)).alias("__mid"))
    coded = series.join(F.broadcast(stats)).select(
        "date", F.when(F.col("__n") < least, 0).otherwise(2 * F.coalesce((F.col("v") > 0).cast("int"), F.lit(0)) + F.coalesce((F.col("vol") >= F.col("__mid")).cast("int"), F.lit(0))).alias("code")
    )
    return backward(rows, date, coded, "code", "regime", clip=True)


def overridden_regime(rows: DataFrame, date: str, series: DataFrame, fear: DataFrame | None = None, spread: DataFrame | None = None, limit: float = 1.0) -> DataFrame:
    """``regime`` by the nearest benchmark value (below 0: bear, 0), set to 0 where the nearest fear z-score exceeds ``limit`` or the nearest yield spread is below 0.

    Each series has ``date, v``; a missing value overrides nothing.
    """
    out = nearest_regime(rows, date, series)
    for other, bear in ((fear, lambda c: c > limit), (spread, lambda c: c < 0)):
        if other is not None:
            out = nearest_date(out, date, other, "v", "__o").withColumn("regime", F.when(F.coalesce(bear(F.col("__o")), F.lit(False)), 0).otherwise(F.col("regime"))).drop("__o")
    return out


def octet_regimes(rows: DataFrame, date: str, series: DataFrame, strength: str, strong: float = 25.0, least: int = 10) -> DataFrame:
    """``regime`` with eight classes: 2 * the four classes of ``backward_regimes`` + (the row's own trend strength above ``strong``); 0 with fewer than ``least`` dates."""
    four = backward_regimes(rows, date, series, least)
    enough = F.broadcast(series.where("v is not null").agg((F.count(F.lit(1)) >= least).alias("__enough")))
    trending = F.coalesce((F.col(strength) > strong).cast("int"), F.lit(0))
    return four.join(enough).withColumn("regime", F.when(F.col("__enough"), 2 * F.col("regime") + trending).otherwise(0)).drop("__enough")
