"""Structured Streaming twins of the batch monitors.

Each takes a streaming DataFrame (or a batch one, for comparison) and returns the streaming
result; ``drain`` runs a query over what the source holds now into the shared folder and
reads it back. State is keyed and bounded by watermarks or is one small tuple per key.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronoloom.session import scratch


def stream(spark: SparkSession, path: str) -> DataFrame:
    """A file stream over a Parquet table; its schema is that of the table."""
    schema = spark.read.parquet(path).schema
    folder, name = path.rsplit("/", 1)
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def drain(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run a streaming query over everything available now and read its output (append or complete mode)."""
    spark = df.sparkSession
    base = scratch(spark, "stream")
    out, log = f"{base}/out", f"{base}/log"
    if mode == "append":
        query = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).outputMode("append").trigger(availableNow=True).start()
    else:

        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(out)

        query = df.writeStream.foreachBatch(keep).option("checkpointLocation", log).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def windowed_counts(events: DataFrame, length: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """Count and mean value per tumbling window and event type."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    """Sessions of a user: start, end, number of events."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


def first_deliveries(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Events without those repeated within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def monitor(events: DataFrame, mean: float, deviation: float, slack: float = 0.5, limit: float = 5.0, start: float = 0.0, rate: float = 0.1) -> DataFrame:
    """Two-sided CUSUM and EWMA per event type with one tuple of state per key; equal to the batch folds in ``ordered``.

    Within a micro-batch a key's events are put in order of time and id; across batches they are taken
    as they come. Update mode: ``event_type, n, up, down, alerts, ewma`` after each batch.
    """
    sd = deviation if deviation > 0 else 1.0

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, up, down, alerts, ew = state.get if state.exists else (0, 0.0, 0.0, 0, start)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for v in rows["value"].dropna():
            z = (v - mean) / sd
            up, down = max(0.0, up + z - slack), max(0.0, down - z - slack)
            n, alerts, ew = n + 1, alerts + int(up > limit or down > limit), rate * v + (1 - rate) * ew
        state.update((n, up, down, alerts, float(ew)))
        yield pd.DataFrame({"event_type": [key[0]], "n": [n], "up": [up], "down": [down], "alerts": [alerts], "ewma": [ew]})

    schema = "event_type string, n long, up double, down double, alerts long, ewma double"
    return events.select("event_type", "ts", "event_id", "value").groupBy("event_type").applyInPandasWithState(
        step, schema, "n long, up double, down double, alerts long, ewma double", "update", GroupStateTimeout.NoTimeout
    )


def calibration_buckets(events: DataFrame, bins: int = 5, late: str = "10 minutes") -> DataFrame:
    """Running calibration table of ``ts, p, y`` per bin (the last one closed): count, mean probability, hits, hit rate and drift. Complete or update mode."""
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    out = events.where("p is not null and y is not null").groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_prob"), F.sum("y").alias("hits"))
    return out.withColumn("hit_rate", F.col("hits") / F.col("n")).withColumn("drift", (F.col("bin") + 0.5) / bins - F.col("hit_rate"))


def incremental_atr(bars: DataFrame, n: int = 14) -> DataFrame:
    """ATR by ticker, one step per bar: the mean of the first n true ranges, then (before * (n - 1) + range) / n.

    State is one tuple per ticker; bars of a micro-batch are put in order of date. Update mode: ``ticker, date, seen, atr`` after each batch.
    """

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, atr, close = state.get if state.exists else (0, 0.0, float("nan"))
        rows = pd.concat(list(batches)).sort_values("date")
        for high, low, last in rows[["high", "low", "close"]].itertuples(index=False):
            tr = high - low if close != close else max(high - low, abs(high - close), abs(low - close))
            seen, atr, close = seen + 1, (atr * seen + tr) / (seen + 1) if seen < n else (atr * (n - 1) + tr) / n, last
        state.update((seen, float(atr), float(close)))
        yield pd.DataFrame({"ticker": [key[0]], "date": [rows["date"].iloc[-1]], "seen": [seen], "atr": [atr if seen >= n else None]})

    return bars.select("ticker", "date", "high", "low", "close").groupBy("ticker").applyInPandasWithState(
        step, "ticker string, date date, seen long, atr double", "seen long, atr double, close double", "update", GroupStateTimeout.NoTimeout
    )
