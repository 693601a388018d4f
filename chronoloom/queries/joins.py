"""Calendar joins, reconciliation and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoloom.operators import temporal as t
from chronoloom.queries import register
from chronoloom.sources.tables import replay_trades, table

SERIES = """series as (select date, arg_max(ret_90d, row_id) as v from full_db where ticker = 'IDX00' and ret_90d is not null and date is not null group by date)"""
TRADES = """tr as (select distinct trade_id, upper(trim(ticker)) as ticker, sector, entry_date, exit_date, net_pnl, gross_pnl, total_costs, holding_days, exit_reason, confidence_at_entry, position_pct, shares, entry_price, exit_price
 from trades where ticker is not null and entry_date is not null and exit_date is not null and exit_date >= entry_date)"""


def benchmark(spark, folder):
    rows = table(spark, folder, "full_db").where("ticker = 'IDX00' and ret_90d is not null and date is not null")
    return rows.groupBy("date").agg(F.max_by("ret_90d", "row_id").alias("v"))


def text(c):
    return F.date_format(c, "yyyy-MM-dd")


@register(
    "j21_nearest_date",
    f"""with {TRADES}, {SERIES},
b as (select tr.trade_id, tr.entry_date, s.date as bd, s.v as bv from tr asof left join series s on tr.entry_date >= s.date),
n as (select b.*, s.date as nd, s.v as nv from b asof left join series s on b.entry_date <= s.date)
select trade_id, round(case when nd is null then bv when bd is null or nd - entry_date <= entry_date - bd then nv else bv end, 7) as ret_90d from n""",
)
def nearest(spark, folder):
    rows = replay_trades(spark, folder).select("trade_id", "entry_date")
    return t.nearest_date(rows, "entry_date", benchmark(spark, folder), "v", "ret_90d").select("trade_id", F.round("ret_90d", 7).alias("ret_90d"))


@register("j22_backward_asof", f"""with {TRADES}, {SERIES} select tr.trade_id, round(s.v, 7) as ret_90d, coalesce(s.v >= 0, true) as bull from tr asof left join series s on tr.entry_date >= s.date""")
def backward(spark, folder):
    rows = replay_trades(spark, folder).select("trade_id", "entry_date")
    out = t.backward(rows, "entry_date", benchmark(spark, folder), "v", "r")
    return out.select("trade_id", F.round("r", 7).alias("ret_90d"), F.coalesce(F.col("r") >= 0, F.lit(True)).alias("bull"))


@register("j23_backward_clipped", f"""with {TRADES}, {SERIES} select tr.trade_id, round(coalesce(s.v, (select arg_min(v, date) from series)), 7) as ret_90d from tr asof left join series s on tr.entry_date >= s.date""")
def clipped(spark, folder):
    rows = replay_trades(spark, folder).select("trade_id", "entry_date")
    return t.backward(rows, "entry_date", benchmark(spark, folder), "v", "r", clip=True).select("trade_id", F.round("r", 7).alias("ret_90d"))


@register(
    "j24_trailing_history",
    f"""with {TRADES}, h as (select ticker, date, arg_max(ret_1d, row_id) as v from full_db where ret_1d is not null and date is not null group by 1, 2),
m as (select ticker, date, avg(v) over (partition by ticker order by date rows between 9 preceding and current row) as m from h)
select tr.trade_id, round(m.m, 7) as mean_10 from tr asof left join m on tr.ticker = m.ticker and tr.entry_date >= m.date""",
)
def history(spark, folder):
    rows = replay_trades(spark, folder).select("trade_id", "ticker", "entry_date")
    h = table(spark, folder, "full_db").where("ret_1d is not null and date is not null").groupBy("ticker", "date").agg(F.max_by("ret_1d", "row_id").alias("v"))
    return t.trailing_history(rows, "ticker", "entry_date", h, "v", 10, "m").select("trade_id", F.round("m", 7).alias("mean_10"))


@register(
    "j26_trading_days_ahead",
    f"""with {TRADES}, cal as (select date, row_number() over (order by date) as i from (select distinct date from full_db where date is not null)), e as (select max(i) as n, max(date) as last from cal),
p as (select tr.trade_id, tr.exit_date, coalesce(c.i, 0) as i from tr asof left join cal c on tr.exit_date >= c.date)
select p.trade_id, cast(coalesce(c7.date, greatest(e.last, p.exit_date) + cast(floor((p.i + 7 - e.n) * 1.4) as integer) + 1) as varchar) as day_7, cast(coalesce(c1.date, greatest(e.last, p.exit_date) + cast(floor((p.i + 1 - e.n) * 1.4) as integer) + 1) as varchar) as day_1
from p cross join e left join cal c7 on c7.i = p.i + 7 left join cal c1 on c1.i = p.i + 1""",
)
def ahead(spark, folder):
    rows = replay_trades(spark, folder).select("trade_id", "exit_date")
    cal = table(spark, folder, "full_db").select("date").where("date is not null")
    out = t.trading_days_ahead(rows, "exit_date", cal, 7, "d7")
    out = t.trading_days_ahead(out, "exit_date", cal, 1, "d1")
    return out.select("trade_id", text("d7").alias("day_7"), text("d1").alias("day_1"))


@register(
    "j31_inner_compare",
    """with a as (select date, ticker, avg(confidence) as c from ranked_signals where confidence is not null and not isnan(confidence) group by 1, 2),
b as (select date, ticker, avg(raw_prob) as p from signals where raw_prob is not null and ticker is not null group by 1, 2)
select a.ticker, count(*) as n, round(sqrt(avg(power(a.c - b.p, 2))), 6) as rmse from a join b on a.date = b.date and a.ticker = b.ticker group by 1""",
)
def compare(spark, folder):
    a = table(spark, folder, "ranked_signals").where("confidence is not null and not isnan(confidence)").groupBy("date", "ticker").agg(F.avg("confidence").alias("c"))
    b = table(spark, folder, "signals").where("raw_prob is not null").groupBy("date", "ticker").agg(F.avg("raw_prob").alias("p"))
    return a.join(b, ["date", "ticker"]).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.round(F.sqrt(F.avg(F.pow(F.col("c") - F.col("p"), F.lit(2)))), 6).alias("rmse"))


@register(
    "j33_reconcile",
    f"""with {TRADES}, e as (select ticker as key, sum(shares) as expected from tr where exit_reason <> 'stop_loss' and shares is not null group by 1),
a as (select ticker as key, sum(shares) as actual from tr where exit_reason <> 'max_hold' and shares is not null group by 1)
select coalesce(e.key, a.key) as key, round(expected, 4) as expected, round(actual, 4) as actual,
case when actual is null then 'missing' when expected is null then 'unexpected' when abs(actual - expected) > 0.05 * abs(expected) then 'mismatch' else 'ok' end as status
from e full join a on e.key = a.key""",
)
def reconciled(spark, folder):
    tr = replay_trades(spark, folder).where("shares is not null").select("trade_id", "ticker", "shares", "exit_reason")
    out = t.reconcile(tr.where("exit_reason <> 'stop_loss'"), tr.where("exit_reason <> 'max_hold'"), "ticker", "shares")
    return out.select("key", F.round("expected", 4).alias("expected"), F.round("actual", 4).alias("actual"), "status")


@register(
    "w15_set_operations",
    """with a as (select distinct upper(trim(ticker)) as ticker from signals where ticker is not null), b as (select distinct ticker from full_db where ticker is not null)
select 'both' as side, ticker from (select * from a intersect select * from b) union all select 'signals_only', ticker from (select * from a except select * from b)
union all select 'full_db_only', ticker from (select * from b except select * from a)""",
)
def sets(spark, folder):
    a = table(spark, folder, "signals").where("ticker is not null").select(F.upper(F.trim("ticker")).alias("ticker")).distinct()
    b = table(spark, folder, "full_db").where("ticker is not null").select("ticker").distinct()
    parts = {"both": a.intersect(b), "signals_only": a.subtract(b), "full_db_only": b.subtract(a)}
    out = None
    for side, df in parts.items():
        df = df.select(F.lit(side).alias("side"), "ticker")
        out = df if out is None else out.unionByName(df)
    return out


@register(
    "w02_equity_curve",
    f"""with {TRADES}, p as (select exit_date as d, sum(net_pnl) as pnl from tr where net_pnl is not null group by 1),
days as (select cast(unnest(generate_series(min(d), max(d), interval 1 day)) as date) as d from p),
e as (select days.d, coalesce(pnl, 0) as pnl from days left join p using (d) where isodow(days.d) <= 5),
c as (select d, pnl, 10000 + sum(pnl) over (order by d rows unbounded preceding) as equity from e),
m as (select *, greatest(max(equity) over (order by d rows unbounded preceding), 10000) as peak, lag(equity) over (order by d) as prev from c)
select cast(d as varchar) as date, round(pnl, 4) as daily_pnl, round(equity, 4) as equity, round(peak, 4) as peak, round((peak - equity) / peak, 6) as drawdown, round(coalesce(equity / prev - 1, 0), 6) as daily_return from m""",
)
def equity(spark, folder):
    from chronoloom.operators.portfolio import equity_curve

    out = equity_curve(replay_trades(spark, folder), 10_000.0)
    return out.select(text("date").alias("date"), F.round("daily_pnl", 4).alias("daily_pnl"), F.round("equity", 4).alias("equity"), F.round("peak", 4).alias("peak"), F.round("drawdown", 6).alias("drawdown"), F.round("daily_return", 6).alias("daily_return"))


@register(
    "w07_trailing_sharpe",
    """with d as (select date, arg_max(ret_1d, row_id) as r from full_db where ticker = 'IDX00' and ret_1d is not null and date is not null group by 1)
select cast(date as varchar) as date, """
    + ", ".join(f"round(case when count(r) over (order by date rows between {n - 1} preceding and current row) >= 10 then avg(r) over (order by date rows between {n - 1} preceding and current row) / nullif(stddev_samp(r) over (order by date rows between {n - 1} preceding and current row), 0) * sqrt(252) end, 5) as sharpe_{n}, round(case when count(r) over (order by date rows between {n - 1} preceding and current row) >= 10 then regr_slope(r, x) over (order by date rows between {n - 1} preceding and current row) end, 9) as slope_{n}" for n in (30, 90, 252))
    + " from (select *, cast(row_number() over (order by date) as double) as x from d)",
)
def sharpe(spark, folder):
    d = table(spark, folder, "full_db").where("ticker = 'IDX00' and ret_1d is not null and date is not null").groupBy("date").agg(F.max_by("ret_1d", "row_id").alias("r"))
    order = Window.orderBy("date")  # one series: bounded by the calendar
    d = d.withColumn("x", F.row_number().over(order).cast("double"))
    cols = [text("date").alias("date")]
    for n in (30, 90, 252):
        w = order.rowsBetween(1 - n, 0)
        ratio = F.try_divide(F.avg("r").over(w), F.stddev_samp("r").over(w)) * (252**0.5)
        cols += [F.round(F.when(F.count("r").over(w) >= 10, ratio), 5).alias(f"sharpe_{n}"), F.round(F.when(F.count("r").over(w) >= 10, F.regr_slope("r", "x").over(w)), 9).alias(f"slope_{n}")]
    return d.select(*cols)
