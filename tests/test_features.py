import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoloom.operators import features as f

SCHEMA = "ticker string, date date, open double, high double, low double, close double, volume double"


def bars(spark, closes, ticker="A", **other):
    rows = []
    for i, c in enumerate(closes):
        row = dict(ticker=ticker, date=dt.date(2020, 1, 1) + dt.timedelta(i), open=c, high=c, low=c, close=c, volume=1.0) | {k: v[i] for k, v in other.items()}
        rows.append(tuple(row[k] for k in ("ticker", "date", "open", "high", "low", "close", "volume")))
    return spark.createDataFrame(rows, SCHEMA)


def test_returns_match_pandas_and_do_not_leak(spark):
    rng = np.random.default_rng(0)
    a, b = 100 + rng.normal(size=80).cumsum(), 50 + rng.normal(size=80).cumsum()
    df = bars(spark, a.tolist()).unionByName(bars(spark, b.tolist(), "B"))
    got = f.trailing_returns(df, (7,)).where("ticker = 'B'").orderBy("date").toPandas()["ret_7d"]
    want = pd.Series(b).pct_change(7)
    assert got.isna().sum() == 7
    np.testing.assert_allclose(got.astype(float)[7:], want[7:])


def test_zero_close_gives_null(spark):
    got = [r.ret_1d for r in f.trailing_returns(bars(spark, [0.0, 5.0, 10.0]), (1,)).orderBy("date").collect()]
    assert got == [None, None, 1.0]


def test_unknown_future(spark):
    df = bars(spark, [1.0, 2.0, 1.0])
    assert [r.fwd_1d_up for r in f.forward_returns(df, (1,)).orderBy("date").collect()] == [1, 0, 0]
    assert f.forward_returns(df, (1,), keep_unknown=False).count() == 2


def test_volatility_is_null_until_full(spark):
    rng = np.random.default_rng(1)
    c = 100 + rng.normal(size=50).cumsum()
    got = f.volatility(bars(spark, c.tolist())).orderBy("date").toPandas()
    want = pd.Series(c).pct_change().rolling(10).std()
    np.testing.assert_allclose(got["vol_10d"].astype(float), want, equal_nan=True)


@pytest.mark.parametrize(
    "o,h,lo,c,want",
    [(10, 12, 9, 11, (1 / 3, 1 / 3, 1 / 3, 1 / 3, 1)), (11, 12, 9, 10, (1 / 3, 1 / 3, 1 / 3, 1 / 3, 0)), (5, 5, 5, 5, (0, 0, 0, 0, 1)), (9, 12, 9, 12, (1, 0, 0, 0, 1)), (5, 4, 5, 5, (0, 0, 0, 0, 1))],
)
def test_single_candles(spark, o, h, lo, c, want):
    row = spark.range(1).select(*[v.alias(k) for k, v in f.candle_parts(*[F.lit(float(x)) for x in (o, h, lo, c)]).items()]).first()
    assert tuple(row) == pytest.approx(want)


def test_composite_needs_all_rows(spark):
    df = bars(spark, [1.0, 2.0, 3.0], open=[1.0, 2.0, 3.0], high=[2.0, 9.0, 4.0], low=[0.5, 1.0, 2.0])
    out = f.candle_features(df).orderBy("date").collect()
    assert out[1].candle_3d_direction is None and out[2].candle_3d_body_to_range == pytest.approx(2 / 8.5)


def test_wilder_by_hand(spark):
    c = [float(x) for x in range(1, 40)]
    got = f.wilder(bars(spark, c)).orderBy("date").collect()
    assert got[12].atr_14 is None and got[13].atr_14 == pytest.approx(13 / 14)  # the first range is 0
    assert got[13].rsi_14 is None and got[14].rsi_14 == 100.0


def test_average_rank_matches_pandas(spark):
    v = [3.0, 1.0, 3.0, None, 2.0]
    df = spark.createDataFrame([(1, x) for x in v], "g int, v double").withColumn("r", f.average_rank("v", ["g"]))
    got = {(r.v, r.r) for r in df.collect()}
    want = pd.Series(v, dtype=float).rank(pct=True)
    assert got == {(x, None if x is None else y) for x, y in zip(v, want)}


def test_wilder_seeds(spark):
    c = [10.0 + (i * 7 % 5) for i in range(30)]
    ranges = [0.0, *(abs(a - b) for a, b in zip(c[1:], c))]  # high = low = close
    for seed in ("mean", "first"):
        got = f.wilder(bars(spark, c).withColumns({"high": F.col("close"), "low": F.col("close")}), seed=seed).orderBy("date").collect()
        mean = sum(ranges[:14]) / 14
        if seed == "first":
            mean = ranges[0]
            for v in ranges[1:14]:
                mean += (v - mean) / 14
        want = [mean]
        for v in ranges[14:]:
            want.append(want[-1] + (v - want[-1]) / 14)
        assert [r.atr_14 for r in got[:13]] == [None] * 13 and [r.atr_14 for r in got[13:]] == pytest.approx(want)
