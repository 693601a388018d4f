"""Walk-forward evaluation: all folds in one plan over a shared feature table."""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.operators import scan
from chronoloom.operators.metrics import brier, brier_skill, murphy
from chronoloom.operators.temporal import nearest_date
from chronoloom.operators.vote import signal
from chronoloom.plans.analogue import AnalogueConfig, answered
from chronoloom.session import staged


def checked(fold: dict) -> dict:
    """The fold itself; overlapping training and validation is an error."""
    if fold["train_end"] >= fold["val_start"]:
        raise ValueError(f"training ends {fold['train_end']}, not before validation begins {fold['val_start']}")
    if fold["val_start"] > fold["val_end"]:
        raise ValueError("validation ends before it begins")
    return fold


def split(df: DataFrame, train_end, val_start, val_end, date: str = "date") -> tuple[DataFrame, DataFrame]:
    """Training rows up to train_end and validation rows val_start..val_end, all inclusive; overlapping folds are an error."""
    checked({"train_end": train_end, "val_start": val_start, "val_end": val_end})
    return df.where(F.col(date) <= F.lit(train_end)), df.where(F.col(date).between(F.lit(val_start), F.lit(val_end)))


def complete_cases(df: DataFrame, columns: list[str], key: str = "ticker", least: int = 0) -> DataFrame:
    """Rows without nulls in the columns, of keys with at least ``least`` such rows."""
    ok = df.na.drop(subset=columns)
    if not least:
        return ok
    enough = ok.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least).select(key)
    return ok.join(enough, key, "left_semi")


def per_fold(rows: DataFrame, folds: list[dict], date: str = "date") -> DataFrame:
    """Each row once for every fold it takes part in: adds ``fold, asks`` (validation) to the columns. No shuffle."""
    d = F.col(date)
    parts = F.array(*[F.struct(F.lit(f["fold"]).alias("fold"), (d <= F.lit(f["train_end"])).alias("trains"), d.between(F.lit(f["val_start"]), F.lit(f["val_end"])).alias("asks")) for f in map(checked, folds)])
    each = rows.withColumn("__f", F.explode(F.filter(parts, lambda x: x["trains"] | x["asks"])))
    return each.withColumns({"fold": F.col("__f.fold"), "asks": F.col("__f.asks")}).drop("__f")


def training(rows: DataFrame, features: list[str]) -> DataFrame:
    """The rows of all folds as written points: tid, date, attributes and the features as they are."""
    vec = F.array(*[F.col(c).cast("double") for c in features]).alias("vec")
    return scan.filed(rows.select(F.col("id").alias("tid"), "date", "ticker", "sector", F.lit(1).alias("regime"), "label", "fwd_return", vec), "training")


def scored(rows: DataFrame, folds: list[dict], features: list[str], config: AnalogueConfig, benchmark: DataFrame | None = None, bear_below: float = 0.05, calibrate=None, points: DataFrame | None = None) -> DataFrame:
    """Scored validation rows of all folds: ``fold, qid, y, raw_prob, prob, bear, n_matches, signal``.

    ``rows``: id, ticker, sector, date, label, fwd_return and the features, complete. Features are scaled by each
    fold's training rows (moments, base rates and counts of all folds are one aggregate). With a benchmark series (date, v), rows whose
    nearest benchmark value lies below ``bear_below`` get the training base rate as probability and HOLD. ``calibrate``
    maps (fold, raw_prob) to a probability. A fold without training or validation rows has no row. Training rows are written once for all folds, unscaled
    (``training``; with ``points`` both they and ``rows`` are already written), and scaled where a fold's queries scan them.
    """
    rows = staged(rows, "folds") if points is None else rows  # read several times
    each = per_fold(rows, folds)
    trains = ~F.col("asks")
    moments = [x for c in features for x in (F.avg(F.when(trains, F.col(c))).alias(f"m_{c}"), F.stddev_pop(F.when(trains, F.col(c))).alias(f"s_{c}"))]
    stats = each.groupBy("fold").agg(*moments, F.avg(F.when(trains, F.col("label"))).alias("base"), F.count_if("asks").alias("nq"), F.count_if(trains).alias("np")).collect()  # a row per fold
    stats = {r["fold"]: r for r in stats if r["nq"] and r["np"]}
    schema = rows.schema
    weight = config.feature_weights or {}

    def by_fold(value) -> Column:
        return F.element_at(F.create_map(*[x for f, r in stats.items() for x in (F.lit(f), value(r))]), F.col("fold"))

    if not stats:
        ids = schema["id"].dataType.simpleString()
        return rows.sparkSession.createDataFrame([], f"fold int, qid {ids}, y double, raw_prob double, prob double, bear boolean, n_matches long, signal string")
    vec = F.array(*[F.col(c).cast("double") for c in features]).alias("vec")
    asked = each.where("asks").where(F.col("fold").isin(list(stats))).select("fold", F.col("id").alias("qid"), "ticker", "sector", F.lit(1).alias("regime"), "date", F.col("label").alias("y"), vec)
    last = {f["fold"]: f["train_end"] for f in folds}
    views = {
        f: (np.array([float(r[f"m_{c}"]) for c in features]), np.array([float(weight.get(c, 1.0)) / (float(r[f"s_{c}"] or 0.0) or 1.0) for c in features]), last[f]) for f, r in stats.items()
    }
    out = answered(asked, points if points is not None else training(rows, features), config, views=views, within="fold", latest="date", n=sum(r["nq"] for r in stats.values()))
    if benchmark is not None:
        out = nearest_date(out, "date", benchmark, "v", "bench").withColumn("bear", F.coalesce(F.col("bench") < bear_below, F.lit(False)))
    else:
        out = out.withColumn("bear", F.lit(False))
    sure = calibrate(F.col("fold"), F.col("raw_prob")) if calibrate else F.col("raw_prob")
    prob = F.when(F.col("bear"), by_fold(lambda r: F.lit(float(r["base"])))).otherwise(sure)
    call, _ = signal(sure, F.col("n_matches"), config.threshold, config.spread, config.min_matches)
    return out.withColumns({"prob": prob, "signal": F.when(F.col("bear"), "HOLD").otherwise(call)}).select("fold", "qid", "y", "raw_prob", "prob", "bear", "n_matches", "signal")


def run(rows: DataFrame, folds: list[dict], features: list[str], config: AnalogueConfig, benchmark: DataFrame | None = None, calibrate=None, points: DataFrame | None = None) -> DataFrame:
    """One row per fold over its scored rows (bear rows are not scored): counts, base rate, mean probability, Brier score and skill,
    mean matches, the Murphy decomposition over ten bins and the number of signals of each kind."""
    s = staged(scored(rows, folds, features, config, benchmark, calibrate=calibrate, points=points), "scored")
    ok, p, y = ~F.col("bear"), F.col("prob"), F.col("y")
    base = s.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(ok).alias("n_scored"), F.avg(F.when(ok, y)).alias("base_rate"), F.avg(F.when(ok, p)).alias("mean_prob"),
        brier(F.when(ok, p), F.when(ok, y)).alias("brier"), brier_skill(F.when(ok, p), F.when(ok, y)).alias("bss"), F.avg(F.when(ok, F.col("n_matches"))).alias("avg_k"),
        *[F.count_if(F.col("signal") == k).alias(f"n_{k.lower()}") for k in ("BUY", "SELL", "HOLD")],
    )
    parts = murphy(s.where(ok).select("fold", F.col("prob").alias("p"), "y"), ["fold"], 10).select("fold", "reliability", "resolution", "uncertainty")
    return base.join(parts, "fold", "left")


def run_each(rows: DataFrame, folds: list[dict], features: list[str], config: AnalogueConfig, benchmark: DataFrame | None = None, deadline: float | None = None) -> list[dict]:
    """The folds one after another, each with a ``status``: "ok", "failed: ..." (the others go on) or "late" (not begun after ``deadline`` seconds)."""
    began, out, points = time.monotonic(), [], None
    for fold in folds:
        if deadline is not None and time.monotonic() - began > deadline:
            out.append({"fold": fold["fold"], "status": "late"})
            continue
        if points is None:  # written once, with the first fold that begins
            rows = staged(rows, "each")
            points = training(rows, features)
        try:
            got = run(rows, [fold], features, config, benchmark, points=points).first()
            out.append({**(got.asDict() if got else {}), "fold": fold["fold"], "status": "ok"})
        except Exception as e:  # one impossible fold must not end the evaluation
            out.append({"fold": fold["fold"], "status": f"failed: {type(e).__name__}"})
    return out
