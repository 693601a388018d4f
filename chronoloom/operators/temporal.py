"""Joins along a calendar: nearest and backward as-of, trading-day arithmetic, trailing history.

A series has one row per date, so its length is bounded by the calendar. The window that
orders it runs over the distinct dates of both sides (tens of thousands at most), never over
the rows; the rows themselves are joined by an equi-join on their date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _timeline(rows: DataFrame, date: str, series: DataFrame, value: str) -> DataFrame:
    wanted = rows.select(F.col(date).alias("__d")).where("__d is not null").distinct().withColumn("__v", F.lit(None).cast(series.schema[value].dataType)).withColumn("__has", F.lit(False))
    known = series.select(F.col("date").alias("__d"), F.col(value).alias("__v")).where("__d is not null and __v is not null").withColumn("__has", F.lit(True))
    line = wanted.unionByName(known).groupBy("__d").agg(F.max("__v").alias("__v"), F.max("__has").alias("__has"))
    order = Window.orderBy("__d")
    back, ahead = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col("__has"), F.struct(F.col("__d").alias("d"), F.col("__v").alias("v")))
    return line.select("__d", F.last(at, True).over(back).alias("__back"), F.first(at, True).over(ahead).alias("__next"), F.min(F.when(F.col("__has"), F.struct("__d", "__v"))).over(Window.partitionBy()).alias("__first"))


def nearest_date(rows: DataFrame, date: str, series: DataFrame, value: str, name: str) -> DataFrame:
    """Each row with the series value of the nearest date; of two as near, the later one (it may lie ahead)."""
    line = _timeline(rows, date, series, value)
    behind, before = F.datediff(F.col("__d"), F.col("__back.d")), F.datediff(F.col("__next.d"), F.col("__d"))
    pick = F.when(F.col("__back").isNull() | (before <= behind), F.col("__next.v")).otherwise(F.col("__back.v"))
    pick = F.when(F.col("__next").isNull(), F.col("__back.v")).otherwise(pick)
    return rows.join(line.select("__d", pick.alias(name)), rows[date] == F.col("__d"), "left").drop("__d")


def backward(rows: DataFrame, date: str, series: DataFrame, value: str, name: str, clip: bool = False) -> DataFrame:
    """Each row with the last series value not after its date; with ``clip``, rows before the start get the first."""
    line = _timeline(rows, date, series, value)
    pick = F.coalesce(F.col("__back.v"), F.col("__first.__v")) if clip else F.col("__back.v")
    return rows.join(line.select("__d", pick.alias(name)), rows[date] == F.col("__d"), "left").drop("__d")


def trading_days_ahead(rows: DataFrame, date: str, calendar: DataFrame, n: int, name: str) -> DataFrame:
    """The n-th calendar date after each date; beyond the end, days are extrapolated at 1.4 per trading day."""
    days = calendar.select(F.col("date").alias("__c")).distinct()
    order = Window.orderBy("__c")
    numbered = days.withColumn("__i", F.row_number().over(order))
    last = numbered.agg(F.max("__i").alias("__n"), F.max("__c").alias("__end"))
    wanted = rows.select(F.col(date).alias("__d")).where("__d is not null").distinct()
    both = wanted.select(F.col("__d"), F.lit(None).cast("int").alias("__i")).unionByName(numbered.select(F.col("__c").alias("__d"), "__i")).groupBy("__d").agg(F.max("__i").alias("__i"))
    pos = both.withColumn("__i", F.coalesce(F.last("__i", True).over(Window.orderBy("__d").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    target = pos.join(F.broadcast(last), F.col("__i") >= 0).withColumn("__j", F.col("__i") + n)
    hit = target.join(numbered.select(F.col("__i").alias("__k"), "__c"), F.col("__j") == F.col("__k"), "left")
    short = F.col("__j") - F.col("__n")
    out = F.coalesce("__c", F.date_add(F.greatest("__end", "__d"), (F.floor(short * 1.4) + 1).cast("int")))
    return rows.join(hit.select("__d", out.alias(name)), rows[date] == F.col("__d"), "left").drop("__d")


def trailing_history(rows: DataFrame, key: str, date: str, history: DataFrame, value: str, n: int, name: str) -> DataFrame:
    """Mean of the last n history values of the key not after each row's date (NULL without any).

    The trailing mean is a window over the history, looked up by a backward as-of step in the
    same window: no range join.
    """
    w = Window.partitionBy("__k").orderBy("__d", "__is")
    past = history.select(F.col(key).alias("__k"), F.col("date").alias("__d"), F.col(value).alias("__v"), F.lit(0).alias("__is")).where("__v is not null")
    past = past.withColumn("__m", F.avg("__v").over(Window.partitionBy("__k").orderBy("__d").rowsBetween(1 - n, 0))).drop("__v")
    ask = rows.select(F.col(key).alias("__k"), F.col(date).alias("__d")).distinct().withColumn("__is", F.lit(1)).withColumn("__m", F.lit(None).cast("double"))
    line = past.unionByName(ask).withColumn("__m", F.last("__m", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("__is = 1").drop("__is")
    return rows.join(line.withColumnRenamed("__m", name), (rows[key] == F.col("__k")) & (rows[date] == F.col("__d")), "left").drop("__k", "__d")


def business_days(first: Column, last: Column) -> Column:
    """Array of the weekdays from first to last, both included."""
    return F.filter(F.sequence(first, last), lambda d: F.weekday(d) < 5)


def reconcile(expected: DataFrame, actual: DataFrame, key: str, quantity: str, tolerance: float = 0.05) -> DataFrame:
    """Full outer comparison: ``key, expected, actual, status`` (missing, unexpected, mismatch, ok)."""
    e = expected.groupBy(F.col(key).alias("key")).agg(F.sum(quantity).alias("expected"))
    a = actual.groupBy(F.col(key).alias("key")).agg(F.sum(quantity).alias("actual"))
    out = e.join(a, "key", "full_outer")
    off = F.abs(F.col("actual") - F.col("expected")) > tolerance * F.abs(F.col("expected"))
    status = F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "unexpected").when(off, "mismatch").otherwise("ok")
    return out.withColumn("status", status)
