"""Continuous periods and gaps of overlapping, nested or gapped intervals.

Method. Intervals are reduced to the longest one per (key, start day), which is combined
before the shuffle and leaves at most one row per key and calendar day however many rows a
key has. ``session_window`` with the row's own duration then merges overlaps natively;
touching sessions are joined afterwards and gaps come from ``lead`` over the periods.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def periods(df: DataFrame, key: Column, first_day: Column, last_day: Column) -> DataFrame:
    """Continuous periods: ``key, start_date, end_date`` (both days included).

    Rows with a null key or date, or whose last day lies before the first, do not count.
    Intervals that share a day, or of which one begins on the day after another ends, become
    one period. Repeated rows change nothing; other columns are ignored; empty in, empty out.
    """
    rows = (
        df.select(key.alias("key"), first_day.cast("date").alias("s"), last_day.cast("date").alias("e"))
        .where("key is not null and s is not null and e is not null and e >= s")
        .groupBy("key", "s")
        .agg(F.max("e").alias("e"))
    )
    length = F.concat((F.datediff("e", "s") + 1).cast("string"), F.lit(" days"))
    merged = (
        rows.withColumn("at", F.col("s").cast("timestamp_ntz"))
        .groupBy("key", F.session_window("at", length))
        .agg(F.min("s").alias("s"), F.max("e").alias("e"))
        .select("key", "s", "e")
    )
    w = Window.partitionBy("key").orderBy("s")
    touching = merged.withColumn(
        "fresh", F.when(F.col("s") > F.date_add(F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)), 1), 1)
        .when(F.row_number().over(w) == 1, 1).otherwise(0)
    )
    return (
        touching.withColumn("run", F.sum("fresh").over(w))
        .groupBy("key", "run")
        .agg(F.min("s").alias("start_date"), F.max("e").alias("end_date"))
        .select("key", "start_date", "end_date")
    )


def periods_and_gaps(df: DataFrame, key: Column, first_day: Column, last_day: Column) -> DataFrame:
    """Periods and the gaps between neighbouring ones: ``key, kind, start_date, end_date``.

    ``kind`` is "period" (first to last day held) or "gap" (first to last day not held).
    The rules of ``periods`` hold.
    """
    held = periods(df, key, first_day, last_day)
    following = F.lead("start_date").over(Window.partitionBy("key").orderBy("start_date"))
    both = held.withColumn("nxt", following).withColumn(
        "part",
        F.explode(
            F.array_compact(
                F.array(
                    F.struct(F.lit("period").alias("kind"), F.col("start_date").alias("a"), F.col("end_date").alias("b")),
                    F.when(
                        F.col("nxt").isNotNull(),
                        F.struct(F.lit("gap").alias("kind"), F.date_add("end_date", 1).alias("a"), F.date_sub("nxt", 1).alias("b")),
                    ),
                )
            )
        ),
    )
    return both.select("key", "part.kind", F.col("part.a").alias("start_date"), F.col("part.b").alias("end_date"))
