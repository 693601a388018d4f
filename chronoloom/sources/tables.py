"""Access to the tables of a data folder and the market-shaped views derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder (columns and filters are pushed into the scan)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bars_segment(spark: SparkSession, folder: str) -> DataFrame:
    """Daily bars per market segment: ticker, date, open, high, low, close, volume."""
    o = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    c = table(spark, folder, "customer").select("c_custkey", F.col("c_mktsegment").alias("ticker"))
    return _bars(o.join(c, o.o_custkey == c.c_custkey), ["ticker"])


def bars_nation(spark: SparkSession, folder: str) -> DataFrame:
    """Daily bars per nation with its region as ``sector``."""
    o = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    c = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, folder, "nation").select("n_nationkey", F.col("n_name").alias("ticker"), "n_regionkey")
    r = table(spark, folder, "region").select("r_regionkey", F.col("r_name").alias("sector"))
    keyed = (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(n, F.col("c_nationkey") == n.n_nationkey)
        .join(r, F.col("n_regionkey") == r.r_regionkey)
    )
    return _bars(keyed, ["ticker", "sector"])


def _bars(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys, F.to_date("o_orderdate").alias("date")).agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"),
        F.max("o_totalprice").alias("high"),
        F.min("o_totalprice").alias("low"),
        F.max_by("o_totalprice", "o_orderkey").alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"),
    )


def replay_trades(spark: SparkSession, folder: str) -> DataFrame:
    """Completed trades with each row once (rows sent again are identical) and clean dates."""
    return (
        table(spark, folder, "trades")
        .dropDuplicates()
        .where("ticker is not null and entry_date is not null and exit_date is not null and exit_date >= entry_date")
        .withColumn("ticker", F.upper(F.trim("ticker")))
    )
