"""Equity curves over a business-day calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.temporal import business_days


def equity_curve(trades: DataFrame, start: float, day: str = "exit_date", pnl: str = "net_pnl") -> DataFrame:
    """``date, daily_pnl, equity, peak, drawdown, daily_return`` per business day.

    P&L on a day that is no weekday is dropped, as in a business-day calendar. Trades are summed per
    day first, so the ordered window runs over days only.
    """
    daily = trades.where(F.col(pnl).isNotNull()).groupBy(F.col(day).alias("date")).agg(F.sum(pnl).alias("daily_pnl"))
    span = daily.agg(F.min("date").alias("a"), F.max("date").alias("b")).where("a is not null")
    days = span.select(F.explode(business_days(F.col("a"), F.col("b"))).alias("date"))
    order = Window.orderBy("date")
    grow = order.rowsBetween(Window.unboundedPreceding, 0)
    out = days.join(daily, "date", "left").withColumn("daily_pnl", F.coalesce("daily_pnl", F.lit(0.0)))
    out = out.withColumn("equity", F.lit(start) + F.sum("daily_pnl").over(grow))
    out = out.withColumn("peak", F.greatest(F.max("equity").over(grow), F.lit(start)))
    out = out.withColumn("drawdown", (F.col("peak") - F.col("equity")) / F.col("peak"))
    return out.withColumn("daily_return", F.coalesce(F.try_divide(F.col("equity"), F.lag("equity").over(order)) - 1, F.lit(0.0)))
