"""Windowed features of daily bars.

A bar table has ``ticker, date, open, high, low, close, volume`` (one row per ticker and
date). Every window counts rows, not days, and is NULL until it is full unless said otherwise.
Null closes are dropped before rows are counted. All windows of one ticker share one sort.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RETURN_DAYS = (1, 3, 7, 14, 30, 45, 60, 90)
FORWARD_DAYS = (1, 3, 7, 14, 30)


def _w(rows: int | None = None):
    w = Window.partitionBy("ticker").orderBy("date")
    return w if rows is None else w.rowsBetween(1 - rows, 0)


def full(value: Column, rows: int, aggregate: Column, least: int | None = None) -> Column:
    """An aggregate over the last ``rows`` rows, NULL while fewer than ``least`` of them have a value."""
    return F.when(F.count(value).over(_w(rows)) >= (least or rows), aggregate.over(_w(rows)))


def ratio_change(now: Column, then: Column) -> Column:
    """now / then - 1, NULL where then is 0."""
    return F.try_divide(now, then) - 1


def trailing_returns(bars: DataFrame, days=RETURN_DAYS) -> DataFrame:
    return bars.where("close is not null").withColumns(
        {f"ret_{n}d": ratio_change(F.col("close"), F.lag("close", n).over(_w())) for n in days}
    )


def forward_returns(bars: DataFrame, days=FORWARD_DAYS, keep_unknown: bool = True) -> DataFrame:
    """Forward returns and 0/1 labels; an unknown future has label 0, or is dropped with keep_unknown=False."""
    out = bars.where("close is not null").withColumns(
        {f"fwd_{n}d": ratio_change(F.lead("close", n).over(_w()), F.col("close")) for n in days}
    )
    out = out.withColumns({f"fwd_{n}d_up": F.when(F.col(f"fwd_{n}d") > 0, 1).otherwise(0) for n in days})
    return out if keep_unknown else out.na.drop(subset=[f"fwd_{n}d" for n in days])


def volatility(bars: DataFrame) -> DataFrame:
    """Rolling deviation of daily returns (10 and 30 rows), their ratio and abnormal volume (20 rows)."""
    r = bars.withColumn("r1", ratio_change(F.col("close"), F.lag("close").over(_w())))
    r = r.withColumn("vol_10d", full(F.col("r1"), 10, F.stddev_samp("r1"))).withColumn("vol_30d", full(F.col("r1"), 30, F.stddev_samp("r1")))
    r = r.withColumn("vol_ratio", F.col("vol_10d") / (F.col("vol_30d") + 1e-8))
    mean = full(F.col("volume"), 20, F.avg("volume"))
    return r.withColumn("vol_abnormal", (F.col("volume") - mean) / (mean + 1)).drop("r1")


def moving_average_gap(bars: DataFrame, rows=(20, 50)) -> DataFrame:
    return bars.withColumns({f"price_vs_sma{n}": F.try_divide(F.col("close"), full(F.col("close"), n, F.avg("close"))) - 1 for n in rows})


def normalised_returns(bars: DataFrame, days=RETURN_DAYS, clip: float = 10.0) -> DataFrame:
    """Trailing returns over the rolling deviation of the same return (max(n, 5) rows, 2 at least), clipped.

    All deviations are computed in one pass of windows before any ratio is projected.
    """
    out = trailing_returns(bars, days)
    out = out.withColumns({f"__d{n}": F.stddev_samp(f"ret_{n}d").over(_w(max(n, 5))) for n in days})
    ratio = {n: F.col(f"ret_{n}d") / (F.col(f"__d{n}") + 1e-8) for n in days}  # the deviation of one value is NULL
    return out.withColumns({f"norm_{n}d": F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(clip)), F.lit(-clip))) for n, x in ratio.items()}).drop(*[f"__d{n}" for n in days])


def candle_eps(open_: Column, high: Column, low: Column, close: Column) -> dict[str, Column]:
    """Six candle ratios with a small constant in the denominator; direction is +1 or -1."""
    span = high - low + 1e-8
    top, bottom = F.greatest(open_, close), F.least(open_, close)
    body = F.abs(close - open_)
    return {
        "body_ratio": body / span, "upper_wick_ratio": (high - top) / span, "lower_wick_ratio": (bottom - low) / span,
        "wick_balance": (high - top - (bottom - low)) / span, "body_position": (bottom - low) / span,
        "direction": F.when(close > open_, 1.0).otherwise(-1.0),
    }


def candle_parts(open_: Column, high: Column, low: Column, close: Column) -> dict[str, Column]:
    """Five proportions; a high below the low counts as the low; no range gives 0, 0, 0, 0 and direction 1.

    ``body_to_range + upper_wick + lower_wick`` is 1 wherever there is a range and prices lie within it.
    """
    top_price = F.greatest(high, low)
    span = top_price - low
    flat = span <= 0
    top, bottom = F.greatest(open_, close), F.least(open_, close)

    def part(x: Column) -> Column:
        return F.when(flat, 0.0).otherwise(F.try_divide(x, span))

    return {
        "body_to_range": part(F.abs(close - open_)), "upper_wick": part(top_price - top), "lower_wick": part(bottom - low),
        "body_position": part(bottom - low), "direction": F.when(flat, 1.0).when(close >= open_, 1.0).otherwise(0.0),
    }


def composite_bars(bars: DataFrame, n: int) -> dict[str, Column]:
    """Open, high, low and close of the last n rows taken as one bar; NULL until there are n."""
    enough = F.count(F.lit(1)).over(_w(n)) >= n
    return {
        "open": F.when(enough, F.lag("open", n - 1).over(_w()) if n > 1 else F.col("open")), "high": F.when(enough, F.max("high").over(_w(n))),
        "low": F.when(enough, F.min("low").over(_w(n))), "close": F.when(enough, F.col("close")),
    }


def candle_features(bars: DataFrame, spans=(1, 3, 5)) -> DataFrame:
    """The five candle proportions over composite bars of 1, 3 and 5 rows (15 columns)."""
    out = bars
    for n in spans:
        c = composite_bars(bars, n)
        out = out.withColumns({f"__{k}{n}": v for k, v in c.items()})
    columns = {}
    for n in spans:
        parts = candle_parts(*[F.col(f"__{k}{n}") for k in ("open", "high", "low", "close")])
        known = F.col(f"__close{n}").isNotNull()
        columns |= {f"candle_{n}d_{k}": F.when(known, v) for k, v in parts.items()}
    return out.withColumns(columns).drop(*[f"__{k}{n}" for k in ("open", "high", "low", "close") for n in spans])


def session_gaps(bars: DataFrame) -> DataFrame:
    """Overnight and intraday return, size and streak of gaps, and the gap over the weekend (Mondays)."""
    gap = ratio_change(F.col("open"), F.lag("close").over(_w()))
    out = bars.withColumns({"overnight": gap, "intraday": ratio_change(F.col("close"), F.col("open"))})
    out = out.withColumn("gap_size", F.abs("overnight")).withColumn("__s", F.coalesce(F.signum("overnight"), F.lit(0.0)))
    out = out.withColumn("__new", F.when(F.col("__s") != F.coalesce(F.lag("__s").over(_w()), F.lit(9.0)), 1).otherwise(0))
    out = out.withColumn("__island", F.sum("__new").over(_w().rowsBetween(Window.unboundedPreceding, 0)))
    length = F.row_number().over(Window.partitionBy("ticker", "__island").orderBy("date"))
    out = out.withColumn("gap_streak", length * F.col("__s"))
    monday = F.weekday("date") == 0
    out = out.withColumn("weekend_gap", F.when(monday, F.coalesce("overnight", F.lit(0.0))).otherwise(0.0)).withColumn("weekend_gap_size", F.abs("weekend_gap"))
    return out.drop("__s", "__new", "__island")


def average_rank(value: str, by: list[str]) -> Column:
    """Percentile rank with ties at their average, as a share of the non-null values."""
    w = Window.partitionBy(*by)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
    rank = F.rank().over(w.orderBy(F.col(value).asc_nulls_last()))
    return F.when(F.col(value).isNotNull(), (rank + (ties - 1) / 2) / F.count(value).over(w))


def cross_section(rows: DataFrame) -> DataFrame:
    """Return relative to the sector's mean, rank within the sector, and distance from the day's median."""
    by = Window.partitionBy("date", "sector")
    return rows.withColumns(
        {
            "sector_rel_7d": F.col("ret_7d") - F.avg("ret_7d").over(by), "sector_rank_30d": average_rank("ret_30d", ["date", "sector"]),
            "median_gap_7d": F.col("ret_7d") - F.percentile("ret_7d", F.lit(0.5)).over(Window.partitionBy("date")),
        }
    )


def benchmark_correlation(rows: DataFrame, benchmark: str, window: int = 30, least: int = 10) -> DataFrame:
    """Rolling correlation of daily returns with those of one ticker (one row per date: joined as a dimension)."""
    base = rows.where(F.col("ticker") == benchmark).select("date", F.col("ret_1d").alias("bench"))
    both = rows.join(base, "date", "left")
    x, y = F.when(F.col("bench").isNotNull(), F.col("ret_1d")), F.when(F.col("ret_1d").isNotNull(), F.col("bench"))
    both = both.withColumn("__x", x).withColumn("__y", y)
    return both.withColumn("bench_corr", full(F.col("__x"), window, F.corr("__x", "__y"), least)).drop("__x", "__y")


def slip_deficit(bars: DataFrame) -> DataFrame:
    """Distance from the 200-row mean, z-score of 10-row log volatility against the last 60, and its sigmoid."""
    r = F.ln(F.try_divide(F.col("close"), F.lag("close").over(_w())))
    out = bars.withColumn("lr", r).withColumn("v10", full(F.col("lr"), 10, F.stddev_samp("lr")) * (252**0.5))
    out = out.withColumn("deficit", F.try_divide(F.col("close") - full(F.col("close"), 200, F.avg("close")), full(F.col("close"), 200, F.avg("close"))))
    z = F.try_divide(F.col("v10") - full(F.col("v10"), 60, F.avg("v10")), full(F.col("v10"), 60, F.stddev_samp("v10")))
    out = out.withColumn("vol_z", z).withColumn("pressure", 1 / (1 + F.exp(-F.col("vol_z")))).withColumn("tighten", F.col("vol_z") > 2)
    return out.drop("lr", "v10")


def change_zscore(rows: DataFrame, value: str, window: int = 20) -> DataFrame:
    """z-score of the one-row change against its last ``window`` changes."""
    out = rows.withColumn("__d", F.col(value) - F.lag(value).over(_w()))
    z = (F.col("__d") - full(F.col("__d"), window, F.avg("__d"))) / (full(F.col("__d"), window, F.stddev_samp("__d")) + 1e-8)
    return out.withColumn(f"{value}_change_z", z).drop("__d")


def true_range() -> Column:
    """Largest of the day's span and its distances from the previous close (which may be missing)."""
    prev = F.lag("close").over(_w())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))


def wilder(bars: DataFrame, n: int = 14, seed: str = "mean") -> DataFrame:
    """ATR and RSI by Wilder's recursion: ``atr_n, atr_pct, rsi_n``, NULL until n values were seen.

    Averages start at the mean of their first n values (seed="mean") or at the first value (seed="first"), then move by 1/n of the
    difference. One group is one ticker's history, which is bounded by the calendar; the recursion runs over whole columns.
    """
    if seed not in ("mean", "first"):
        raise ValueError("seed must be 'mean' or 'first'")
    rows = bars.withColumn("__tr", true_range()).withColumn("__ch", F.col("close") - F.lag("close").over(_w())).select("ticker", "date", "close", "__tr", "__ch")

    def smooth(values):
        v = values.dropna()
        if len(v) < n:
            return pd.Series(float("nan"), index=values.index)
        start = v.iloc[:n].mean() if seed == "mean" else v.iloc[:n].ewm(alpha=1 / n, adjust=False).mean().iloc[-1]
        tail = pd.concat([pd.Series([start], index=[v.index[n - 1]]), v.iloc[n:]]).ewm(alpha=1 / n, adjust=False).mean()
        return tail.reindex(values.index).ffill()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date").reset_index(drop=True)
        atr, ch = smooth(pdf["__tr"]), pdf["__ch"]
        up, down = smooth(ch.clip(lower=0)), smooth((-ch).clip(lower=0))
        rsi = (100 - 100 / (1 + up / down.where(down != 0))).where(down != 0, 100.0).where(up.notna())
        res = pdf[["ticker", "date"]].copy()
        for name, v in ((f"atr_{n}", atr), ("atr_pct", atr / pdf["close"]), (f"rsi_{n}", rsi)):
            res[name] = v.astype(object).where(v.notna(), None)
        return res

    return rows.groupBy("ticker").applyInPandas(run, f"ticker string, date date, atr_{n} double, atr_pct double, rsi_{n} double")


def atr_share(bars: DataFrame, n: int = 14) -> DataFrame:
    """``ticker, date, atr_pct, valid``: ATR over the close, valid where both are known and above 0."""
    out = wilder(bars, n).join(bars.select("ticker", "date", "close"), ["ticker", "date"])
    ok = F.coalesce((F.col(f"atr_{n}") > 0) & (F.col("close") > 0) & ~F.isnan(f"atr_{n}"), F.lit(False))
    return out.select("ticker", "date", F.when(ok, F.col(f"atr_{n}") / F.col("close")).alias("atr_pct"), ok.alias("valid"))


def feature_table(bars: DataFrame, label_days: int = 7) -> DataFrame:
    """One plan from daily bars to complete feature rows: returns, normalised returns, volatility, gaps to averages, candles, labels.

    Rows without a full history or a known future are dropped; all windows share one sort by ticker and date.
    """
    out = candle_features(moving_average_gap(volatility(normalised_returns(bars))))
    out = forward_returns(out, (label_days,), keep_unknown=False)
    wanted = [c for c in out.columns if c.startswith(("ret_", "norm_", "vol_", "price_vs", "candle_", "fwd_"))]
    return out.na.drop(subset=wanted)
