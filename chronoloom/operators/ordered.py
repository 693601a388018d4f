"""Order-dependent monitors as scans over blocks of each key's ordered rows.

Rows are range-sorted by key and order, so that every partition holds one stretch of a key: a block.
A step of each monitor is a function of the state before it, and such functions compose: for
CUSUM s -> max(m, s + d), for EWMA s -> a s + b, for the clipped update s -> min(hi, max(lo, s + d)).
One pass reduces each block to its function, a short fold over a key's blocks gives the state in which
every block begins, and where the path matters (alerts) a second pass replays the blocks from there.
No key is ever one task; the streaming twins in ``chronoloom.streaming`` keep the same state.
"""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoloom.session import staged


def blocks(rows: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """``key..., block, order..., v``: non-null values with the number of their block (written, so that it stays)."""
    ok = rows.where(F.col(value).isNotNull()).select(*key, *order, F.col(value).cast("double").alias("v"))
    return staged(ok.repartitionByRange(*key, *order).withColumn("block", F.spark_partition_id()), "blocks")


def _schema(rows: DataFrame, key: list[str], fields: str) -> T.StructType:
    return T.StructType([rows.schema[k] for k in key] + list(T._parse_datatype_string(fields)))


def _per_block(blocked: DataFrame, key: list[str], order: list[str], reduce, fields: str, extra: list[str] = ()) -> DataFrame:
    """Reduce each (key, block), its values in order, to one row ``key..., block, fields``."""
    schema = _schema(blocked, key, f"block int, {fields}")

    def run(group: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        first = pdf.iloc[0]
        return pd.DataFrame([(*group, *reduce(pdf["v"].to_numpy(dtype=float), *[first[c] for c in extra]))], columns=schema.fieldNames())

    return blocked.groupBy(*key, "block").applyInPandas(run, schema)


def _carried(reduced: DataFrame, key: list[str], step, start: tuple, fields: str) -> DataFrame:
    """The state before each block, by a fold over the key's blocks (one row per block and key)."""
    schema = _schema(reduced, key, f"block int, {fields}")

    def run(group: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        out, state = [], start
        for row in pdf.sort_values("block").to_dict("records"):
            out.append((*group, row["block"], *state))
            state = step(state, row)
        return pd.DataFrame(out, columns=schema.fieldNames())

    return reduced.groupBy(*key).applyInPandas(run, schema)


def _path(z: np.ndarray, start: float) -> np.ndarray:
    """s = max(0, s + z) after every step."""
    total = np.cumsum(z)
    return total - np.minimum(np.minimum.accumulate(total), -start)


def cusum(rows: DataFrame, key: list[str], order: list[str], value: str, mean: float, deviation: float, slack: float = 0.5, limit: float = 5.0) -> DataFrame:
    """Two-sided CUSUM per key: ``key..., n, up, down, alerts, first_alert`` (the step of the first alert, 0 for none).

    A deviation of 0 counts as 1. Null values are no steps; a key without values has no row; equal order values
    are taken in any order; empty in, empty out.
    """
    sd = deviation if deviation > 0 else 1.0
    blocked = blocks(rows, key, order, value)

    def reduce(v):
        z = (v - mean) / sd
        up, down = z - slack, -z - slack
        return len(v), float(_path(up, 0.0)[-1]), float(up.sum()), float(_path(down, 0.0)[-1]), float(down.sum())

    parts = _per_block(blocked, key, order, reduce, "n long, up_m double, up_d double, down_m double, down_d double")

    def step(s, r):
        return s[0] + r["n"], max(r["up_m"], s[1] + r["up_d"]), max(r["down_m"], s[2] + r["down_d"])

    before = _carried(parts, key, step, (0, 0.0, 0.0), "before long, up0 double, down0 double")

    def replay(v, n0, up0, down0):
        z = (v - mean) / sd
        up, down = _path(z - slack, up0), _path(-z - slack, down0)
        hit = np.flatnonzero((up > limit) | (down > limit))
        return int(n0) + len(v), float(up[-1]), float(down[-1]), len(hit), int(n0 + hit[0] + 1) if len(hit) else 0

    carried = blocked.join(before, [*key, "block"])
    out = _per_block(carried, key, order, replay, "n long, up double, down double, alerts int, first_alert long", ["before", "up0", "down0"])
    return out.groupBy(*key).agg(
        F.max("n").alias("n"), F.max_by("up", "block").alias("up"), F.max_by("down", "block").alias("down"), F.sum("alerts").cast("int").alias("alerts"),
        F.coalesce(F.min(F.when(F.col("first_alert") > 0, F.col("first_alert"))), F.lit(0)).alias("first_alert"),
    )


def drift_report(rows: DataFrame, features: list[str], order: list[str], baseline: dict[str, tuple[float, float]], slack: float = 0.5, limit: float = 5.0) -> DataFrame:
    """CUSUM of each feature's standardised value ("mean") and of its squared deviation ("variance"): ``feature, moment, n, up, down, alerts, drifted``.

    ``baseline``: feature -> mean and deviation; a squared standard deviate has mean 1 and deviation sqrt(2).
    """
    each = []
    for c in features:
        mean, sd = baseline[c]
        z = (F.col(c).cast("double") - F.lit(float(mean))) / F.lit(float(sd) if sd else 1.0)
        each += [F.struct(F.lit(c).alias("feature"), F.lit("mean").alias("moment"), z.alias("value")), F.struct(F.lit(c).alias("feature"), F.lit("variance").alias("moment"), ((z * z - 1) / F.lit(2.0**0.5)).alias("value"))]
    long = rows.select(*order, F.explode(F.array(*each)).alias("x")).select(*order, "x.*")
    out = cusum(long, ["feature", "moment"], order, "value", 0.0, 1.0, slack, limit)
    return out.withColumn("drifted", F.col("alerts") > 0)


def ewma(rows: DataFrame, key: list[str], order: list[str], value: str, start: float, rate: float) -> DataFrame:
    """Exponentially weighted mean after the last value, from a given start: ``key..., n, ewma``. Cases as for ``cusum``."""
    blocked = blocks(rows, key, order, value)

    def reduce(v):
        weight = (1.0 - rate) ** np.arange(len(v))[::-1]
        return len(v), float((1.0 - rate) ** len(v)), float(rate * (weight * v).sum())

    parts = _per_block(blocked, key, order, reduce, "n long, a double, b double")
    before = _carried(parts, key, lambda s, r: (s[0] + r["n"], r["a"] * s[1] + r["b"]), (0, float(start)), "before long, e0 double")
    last = parts.join(before, [*key, "block"]).withColumn("e", F.col("a") * F.col("e0") + F.col("b"))
    return last.groupBy(*key).agg(F.sum("n").alias("n"), F.max_by("e", "block").alias("ewma"))


def clipped_sum(steps: np.ndarray, low: float, high: float) -> tuple[float, float, float]:
    """The steps s -> min(high, max(low, s + d)) as one of that form: ``shift, lo, hi``, by pairwise composition."""
    d, lo, hi = steps.astype(float), np.full(len(steps), low), np.full(len(steps), high)
    while len(d) > 1:
        if len(d) % 2:
            d, lo, hi = np.append(d, 0.0), np.append(lo, -np.inf), np.append(hi, np.inf)
        d1, d2, l1, h1, l2, h2 = d[::2], d[1::2], lo[::2], hi[::2], lo[1::2], hi[1::2]
        d, lo, hi = d1 + d2, np.clip(l1 + d2, l2, h2), np.clip(h1 + d2, l2, h2)
    return float(d[0]), float(lo[0]), float(hi[0])


def adaptive_coverage(rows: DataFrame, key: list[str], order: list[str], miss: str, target: float, rate: float, low: float = 0.01, high: float = 0.5) -> DataFrame:
    """Online miscoverage level, a += rate (target - miss) within [low, high], for 0/1 misses: ``key..., n, level``. Cases as for ``cusum``."""
    blocked = blocks(rows, key, order, miss)
    parts = _per_block(blocked, key, order, lambda v: (len(v), *clipped_sum(rate * (target - v), low, high)), "n long, d double, lo double, hi double")
    step = lambda s, r: (s[0] + r["n"], min(r["hi"], max(r["lo"], s[1] + r["d"])))
    before = _carried(parts, key, step, (0, float(target)), "before long, a0 double")
    after = F.least("hi", F.greatest("lo", F.col("a0") + F.col("d")))
    return parts.join(before, [*key, "block"]).withColumn("a", after).groupBy(*key).agg(F.sum("n").alias("n"), F.max_by("a", "block").alias("level"))


def run_fatigue(rows: DataFrame, key: list[str], order: str, state: str, rate: float) -> DataFrame:
    """Fatigue of an unbroken run of one state: 1 - (1 - rate) ** (length - 1), per row, by gaps and islands."""
    w = Window.partitionBy(*key).orderBy(order)
    out = rows.withColumn("__new", F.when(F.col(state).eqNullSafe(F.lag(state).over(w)), 0).otherwise(1))
    out = out.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.withColumn("run_length", F.row_number().over(Window.partitionBy(*key, "__run").orderBy(order)))
    return out.withColumn("fatigue", 1 - F.pow(F.lit(1 - rate), F.col("run_length") - 1)).drop("__new", "__run")


def capped_selection(rows: DataFrame, by: str, group: str, order: list[Column], most: int, most_per_group: int) -> DataFrame:
    """Greedy choice in order: a row is taken if its group has fewer than ``most_per_group`` taken and fewer than ``most`` are.

    Within a group the first ``most_per_group`` rows are the only ones that can be taken, and of
    these the first ``most`` are: two ranks instead of a sequential loop.
    """
    in_group = Window.partitionBy(by, group).orderBy(*order)
    able = rows.withColumn("__g", F.row_number().over(in_group)).where(F.col("__g") <= most_per_group).drop("__g")
    return able.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= most)
