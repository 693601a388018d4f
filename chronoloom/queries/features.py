"""Feature queries over bars derived from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoloom.operators import features as f
from chronoloom.queries import register
from chronoloom.sources.tables import bars_nation, bars_segment

BARS_N = """bars as (select n_name as ticker, r_name as sector, cast(o_orderdate as date) as date, arg_min(o_totalprice, o_orderkey) as open,
 max(o_totalprice) as high, min(o_totalprice) as low, arg_max(o_totalprice, o_orderkey) as close, cast(count(*) as double) as volume
 from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2, 3)"""
BARS_S = """bars as (select c_mktsegment as ticker, cast(o_orderdate as date) as date, arg_min(o_totalprice, o_orderkey) as open,
 max(o_totalprice) as high, min(o_totalprice) as low, arg_max(o_totalprice, o_orderkey) as close, cast(count(*) as double) as volume
 from orders join customer on o_custkey = c_custkey group by 1, 2)"""
_OVER = "over (partition by ticker order by date)"


def over(n: int) -> str:
    return f"over (partition by ticker order by date rows between {n - 1} preceding and current row)"


def gated(x: str, n: int, agg: str, least: int | None = None) -> str:
    return f"case when count({x}) {over(n)} >= {least or n} then {agg}({x}) {over(n)} end"


def rounded(df, names, places=6):
    return df.select("ticker", "date", *[F.round(F.col(c).cast("double"), places).alias(c) for c in names])


def select_rounded(names, places=6):
    return "select ticker, date, " + ", ".join(f"round(cast({c} as double), {places}) as {c}" for c in names)


_RET = [f"ret_{n}d" for n in f.RETURN_DAYS]
_FWD = [x for n in f.FORWARD_DAYS for x in (f"fwd_{n}d", f"fwd_{n}d_up")]


@register("f01_trailing_returns", f"with {BARS_N} " + "select ticker, date, " + ", ".join(f"round(close / lag(close, {n}) {_OVER} - 1, 6) as ret_{n}d" for n in f.RETURN_DAYS) + " from bars")
def trailing(spark, folder):
    return rounded(f.trailing_returns(bars_nation(spark, folder)), _RET)


@register(
    "f02_forward_labels",
    f"with {BARS_N} select ticker, date, "
    + ", ".join(f"round(lead(close, {n}) {_OVER} / close - 1, 6) as fwd_{n}d, cast(coalesce(lead(close, {n}) {_OVER} / close - 1 > 0, false) as double) as fwd_{n}d_up" for n in f.FORWARD_DAYS)
    + " from bars",
)
def forward(spark, folder):
    return rounded(f.forward_returns(bars_nation(spark, folder)), _FWD)


@register(
    "f04_volatility",
    f"""with {BARS_N}, r as (select *, close / lag(close) {_OVER} - 1 as r1 from bars),
v as (select *, {gated('r1', 10, 'stddev_samp')} as vol_10d, {gated('r1', 30, 'stddev_samp')} as vol_30d, {gated('volume', 20, 'avg')} as m from r)
select ticker, date, round(vol_10d, 6) as vol_10d, round(vol_30d, 6) as vol_30d, round(vol_10d / (vol_30d + 1e-8), 6) as vol_ratio, round((volume - m) / (m + 1), 6) as vol_abnormal from v""",
)
def vol(spark, folder):
    return rounded(f.volatility(bars_nation(spark, folder)), ["vol_10d", "vol_30d", "vol_ratio", "vol_abnormal"])


_ATR_SQL = f"""with recursive {BARS_S},
t as (select *, row_number() {_OVER} as rn, greatest(high - low, abs(high - lag(close) {_OVER}), abs(low - lag(close) {_OVER})) as tr, close - lag(close) {_OVER} as ch from bars),
w as (select *, greatest(ch, 0) as u, greatest(-ch, 0) as d from t),
a0 as (select ticker, avg(tr) filter (rn <= 14) as a, avg(u) filter (rn between 2 and 15) as u, avg(d) filter (rn between 2 and 15) as d, count(*) as n from w group by ticker),
ra as (select ticker, cast(14 as bigint) as rn, a from a0 where n >= 14 union all select w.ticker, w.rn, ra.a + (w.tr - ra.a) / 14 from ra join w on w.ticker = ra.ticker and w.rn = ra.rn + 1),
ru as (select ticker, cast(15 as bigint) as rn, u, d from a0 where n >= 15 union all select w.ticker, w.rn, ru.u + (w.u - ru.u) / 14, ru.d + (w.d - ru.d) / 14 from ru join w on w.ticker = ru.ticker and w.rn = ru.rn + 1)
select t.ticker, t.date, round(ra.a, 4) as atr_14, round(ra.a / t.close, 6) as atr_pct, round(case when ru.d = 0 then 100.0 else 100 - 100 / (1 + ru.u / ru.d) end, 4) as rsi_14
from t left join ra on ra.ticker = t.ticker and ra.rn = t.rn left join ru on ru.ticker = t.ticker and ru.rn = t.rn"""


@register("f07_rsi_atr", _ATR_SQL)
def recursive(spark, folder):
    out = f.wilder(bars_segment(spark, folder))
    return out.select("ticker", "date", F.round("atr_14", 4).alias("atr_14"), F.round("atr_pct", 6).alias("atr_pct"), F.round("rsi_14", 4).alias("rsi_14"))


@register(
    "f09_moving_average_gap",
    f"with {BARS_N} select ticker, date, " + ", ".join(f"round(close / ({gated('close', n, 'avg')}) - 1, 6) as price_vs_sma{n}" for n in (20, 50)) + " from bars",
)
def sma(spark, folder):
    return rounded(f.moving_average_gap(bars_nation(spark, folder)), ["price_vs_sma20", "price_vs_sma50"])


@register(
    "f10_normalised_returns",
    f"with {BARS_N}, r as (select ticker, date, " + ", ".join(f"close / lag(close, {n}) {_OVER} - 1 as ret_{n}d" for n in f.RETURN_DAYS) + " from bars) select ticker, date, "
    + ", ".join(f"round(case when ret_{n}d is not null and count(ret_{n}d) {over(max(n, 5))} >= 2 then greatest(least(ret_{n}d / (stddev_samp(ret_{n}d) {over(max(n, 5))} + 1e-8), 10), -10) end, 5) as norm_{n}d" for n in f.RETURN_DAYS)
    + " from r",
)
def normal(spark, folder):
    return rounded(f.normalised_returns(bars_nation(spark, folder)), [f"norm_{n}d" for n in f.RETURN_DAYS], 5)


_EPS = ["body_ratio", "upper_wick_ratio", "lower_wick_ratio", "wick_balance", "body_position", "direction"]


@register(
    "f11_candles_eps",
    f"""with {BARS_N}, c as (select *, high - low + 1e-8 as s, greatest(open, close) as t, least(open, close) as b from bars)
select ticker, date, round(abs(close - open) / s, 6) as body_ratio, round((high - t) / s, 6) as upper_wick_ratio, round((b - low) / s, 6) as lower_wick_ratio,
round((high - t - (b - low)) / s, 6) as wick_balance, round((b - low) / s, 6) as body_position, case when close > open then cast(1 as double) else cast(-1 as double) end as direction from c""",
)
def candles_eps(spark, folder):
    b = bars_nation(spark, folder)
    return rounded(b.withColumns(f.candle_eps(*[F.col(c) for c in ("open", "high", "low", "close")])), _EPS)


def _candle_sql(n):
    o, h, lo, c = f"o{n}", f"h{n}", f"l{n}", f"c{n}"
    flat = f"{h} - {lo} <= 0"
    parts = {
        "body_to_range": f"abs({c} - {o})", "upper_wick": f"{h} - greatest({o}, {c})", "lower_wick": f"least({o}, {c}) - {lo}", "body_position": f"least({o}, {c}) - {lo}",
    }
    out = [f"case when {c} is null then null when {flat} then 0.0 else round(({x}) / ({h} - {lo}), 6) end as candle_{n}d_{k}" for k, x in parts.items()]
    return ", ".join([*out, f"case when {c} is null then null when {flat} then 1.0 when {c} >= {o} then 1.0 else 0.0 end as candle_{n}d_direction"])


def _comp_sql(n):
    ok = f"count(*) {over(n)} >= {n}"
    return (f"case when {ok} then lag(open, {n - 1}) {_OVER} end as o{n}, case when {ok} then max(high) {over(n)} end as h{n}, "
            f"case when {ok} then min(low) {over(n)} end as l{n}, case when {ok} then close end as c{n}")


_CANDLES = [f"candle_{n}d_{k}" for n in (1, 3, 5) for k in ("body_to_range", "upper_wick", "lower_wick", "body_position", "direction")]


@register("f14_candle_features", f"with {BARS_N}, c as (select ticker, date, {', '.join(_comp_sql(n) for n in (1, 3, 5))} from bars), k as (select ticker, date, {', '.join(_candle_sql(n) for n in (1, 3, 5))} from c) {select_rounded(_CANDLES)} from k")
def candles(spark, folder):
    return rounded(f.candle_features(bars_nation(spark, folder)), _CANDLES)


@register(
    "f16_session_gaps",
    f"""with {BARS_N}, g as (select *, open / lag(close) {_OVER} - 1 as overnight, close / open - 1 as intraday from bars),
s as (select *, coalesce(sign(overnight), 0) as sg from g), n as (select *, case when sg is distinct from lag(sg) {_OVER} then 1 else 0 end as fresh from s),
i as (select *, sum(fresh) over (partition by ticker order by date rows unbounded preceding) as island from n)
select ticker, date, round(overnight, 6) as overnight, round(intraday, 6) as intraday, round(abs(overnight), 6) as gap_size,
cast(row_number() over (partition by ticker, island order by date) * sg as double) as gap_streak,
round(case when isodow(date) = 1 then coalesce(overnight, 0) else 0 end, 6) as weekend_gap, round(abs(case when isodow(date) = 1 then coalesce(overnight, 0) else 0 end), 6) as weekend_gap_size from i""",
)
def gaps(spark, folder):
    return rounded(f.session_gaps(bars_nation(spark, folder)), ["overnight", "intraday", "gap_size", "gap_streak", "weekend_gap", "weekend_gap_size"])


@register(
    "f19_cross_section",
    f"""with {BARS_N}, r as (select *, close / lag(close, 7) {_OVER} - 1 as ret_7d, close / lag(close, 30) {_OVER} - 1 as ret_30d from bars)
select ticker, date, round(ret_7d - avg(ret_7d) over (partition by date, sector), 6) as sector_rel_7d,
round(case when ret_30d is not null then (rank() over (partition by date, sector order by ret_30d nulls last) + (count(*) over (partition by date, sector, ret_30d) - 1) / 2.0) / count(ret_30d) over (partition by date, sector) end, 6) as sector_rank_30d,
round(ret_7d - median(ret_7d) over (partition by date), 6) as median_gap_7d from r""",
)
def cross(spark, folder):
    return rounded(f.cross_section(f.trailing_returns(bars_nation(spark, folder), (7, 30))), ["sector_rel_7d", "sector_rank_30d", "median_gap_7d"])


@register(
    "f21_benchmark_correlation",
    f"""with {BARS_N}, r as (select *, close / lag(close) {_OVER} - 1 as ret_1d from bars), s as (select date, ret_1d as b from r where ticker = 'GERMANY'),
j as (select r.*, case when s.b is not null then r.ret_1d end as x, case when r.ret_1d is not null then s.b end as y from r left join s using (date))
select ticker, date, round(case when count(x) {over(30)} >= 10 then corr(x, y) {over(30)} end, 5) as bench_corr from j where ticker <> 'GERMANY'""",
)
def correlation(spark, folder):
    out = f.benchmark_correlation(f.trailing_returns(bars_nation(spark, folder), (1,)), "GERMANY")
    return rounded(out.where("ticker <> 'GERMANY'"), ["bench_corr"], 5)


@register(
    "f25_slip_deficit",
    f"""with {BARS_S}, r as (select *, ln(close / lag(close) {_OVER}) as lr from bars), v as (select *, ({gated('lr', 10, 'stddev_samp')}) * sqrt(252) as v10, {gated('close', 200, 'avg')} as m from r),
z as (select *, (v10 - ({gated('v10', 60, 'avg')})) / ({gated('v10', 60, 'stddev_samp')}) as vz from v)
select ticker, date, round((close - m) / m, 6) as deficit, round(vz, 5) as vol_z, round(1 / (1 + exp(-vz)), 5) as pressure, cast(vz > 2 as double) as tighten from z""",
)
def slip(spark, folder):
    out = f.slip_deficit(bars_segment(spark, folder))
    return out.select("ticker", "date", F.round("deficit", 6).alias("deficit"), F.round("vol_z", 5).alias("vol_z"), F.round("pressure", 5).alias("pressure"), F.col("tighten").cast("double").alias("tighten"))


@register(
    "f31_change_zscore",
    f"""with {BARS_S}, d as (select *, close - lag(close) {_OVER} as ch from bars)
select ticker, date, round((ch - ({gated('ch', 20, 'avg')})) / (({gated('ch', 20, 'stddev_samp')}) + 1e-8), 5) as close_change_z from d""",
)
def zscore(spark, folder):
    return rounded(f.change_zscore(bars_segment(spark, folder), "close"), ["close_change_z"], 5)
