"""Streaming queries, drained over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoloom.queries import SQL, register
from chronoloom.streaming import twins


def events(spark, folder):
    # watermarks need a timestamp with a zone; the session's zone is used both ways
    return twins.stream(spark, f"{folder}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@register("st1_windowed_counts", "select cast(cast(ts as date) as varchar) as day, event_type, count(*) as n, round(avg(value), 6) as mean from events group by 1, 2")
def windowed(spark, folder):
    out = twins.drain(twins.windowed_counts(events(spark, folder)), "complete")
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("mean", 6).alias("mean"))


@register(
    "st2_sessions",
    """with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 2 hour then 0 else 1 end as f from events), r as (select *, sum(f) over (partition by user_id order by ts rows unbounded preceding) as run from e)
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from r group by user_id, run""",
)
def sessions(spark, folder):
    out = twins.drain(twins.sessions(events(spark, folder)), "complete")
    return out.select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@register("st3_first_deliveries", "select event_id, event_type, user_id from events")
def deliveries(spark, folder):
    out = twins.drain(twins.first_deliveries(events(spark, folder), ["event_id"]))
    return out.select("event_id", "event_type", "user_id")


@register("st4_stream_monitor", SQL.get("ts1_cusum_ewma"))
def monitor(spark, folder):
    out = twins.drain(twins.monitor(events(spark, folder), 20.0, 25.0, start=10.0), "update")
    return out.select("event_type", "n", F.round("up", 5).alias("up"), F.round("down", 5).alias("down"), F.col("alerts").cast("int").alias("alerts"), F.round("ewma", 5).alias("ewma"))
