"""Evaluation, calibration and monitor queries over the journal, signals, folds and trades."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoloom.operators import calibrate as cal
from chronoloom.operators import metrics as m
from chronoloom.operators import ordered as o
from chronoloom.queries import register
from chronoloom.queries.joins import TRADES
from chronoloom.sources.tables import replay_trades, table

SCORED = """s as (select fold, calibrated_prob as p, cast(analogue_label as double) as y, signal, query_ticker, query_date, analogue_ticker, analogue_date, analogue_rank, analogue_fwd_return as r from journal
 where fold is not null and calibrated_prob is not null and analogue_label is not null)"""


def scored(spark, folder):
    j = table(spark, folder, "journal").where("fold is not null and calibrated_prob is not null and analogue_label is not null")
    return j.select("fold", F.col("calibrated_prob").alias("p"), F.col("analogue_label").cast("double").alias("y"), "signal", "query_ticker", "query_date", "analogue_ticker", "analogue_date", "analogue_rank", F.col("analogue_fwd_return").alias("r"), "raw_prob")


def rnd(df, keys, names, places=6):
    return df.select(*keys, *[F.round(F.col(c).cast("double"), places).alias(c) for c in names])


@register("e01_brier_skill", f"with {SCORED} select fold, count(*) as n, round(avg(power(p - y, 2)), 6) as brier, round(1 - avg(power(p - y, 2)) / (avg(y) * (1 - avg(y))), 6) as bss, round(avg(cast((p > 0.5) = (y = 1) as double)), 6) as directional from s group by fold")
def skill(spark, folder):
    p, y = F.col("p"), F.col("y")
    out = scored(spark, folder).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), m.brier(p, y).alias("brier"), m.brier_skill(p, y).alias("bss"), F.avg(((p > 0.5) == (y == 1)).cast("double")).alias("directional"))
    return rnd(out, ["fold", "n"], ["brier", "bss", "directional"])


def _murphy_sql(bin_):
    return f"""with {SCORED}, b as (select fold, {bin_} as bin, count(*) as n, avg(p) as mp, avg(y) as my, sum(power(p - y, 2)) as se from s group by 1, 2),
t as (select fold, sum(n) as total, sum(n * my) / sum(n) as base, sum(se) / sum(n) as brier from b group by 1)
select b.fold, cast(max(total) as bigint) as n, round(max(brier), 6) as brier, round(sum(n / total * power(mp - my, 2)), 6) as reliability, round(sum(n / total * power(my - base, 2)), 6) as resolution, round(max(base * (1 - base)), 6) as uncertainty from b join t using (fold) group by 1"""


@register("e03_murphy_bins", _murphy_sql("greatest(1, least(10, ceil(p * 10)))"))
def murphy_bins(spark, folder):
    return rnd(m.murphy(scored(spark, folder), ["fold"], 10), ["fold", "n"], ["brier", "reliability", "resolution", "uncertainty"])


@register("e04_murphy_exact", _murphy_sql("p"))
def murphy_exact(spark, folder):
    return rnd(m.murphy(scored(spark, folder), ["fold"], None), ["fold", "n"], ["brier", "reliability", "resolution", "uncertainty"])


@register("e06_calibration_table", f"with {SCORED} select fold, cast(least(floor(p * 5), 4) as integer) as bin, count(*) as n, round(avg(p), 6) as mean_prob, round(avg(y), 6) as hit_rate, round(avg(p) - avg(y), 6) as gap from s group by 1, 2")
def calibration(spark, folder):
    return rnd(m.calibration_table(scored(spark, folder), ["fold"]), ["fold", "bin", "n"], ["mean_prob", "hit_rate", "gap"])


@register(
    "e07_crps",
    f"""with {SCORED}, g as (select distinct fold, query_ticker, query_date, analogue_ticker, analogue_date, r from s where r is not null), e as (select fold, query_ticker, query_date, list(r) as x from g group by 1, 2, 3 having count(*) >= 2),
c as (select fold, (select avg(abs(u - 0.01)) from (select unnest(x) as u)) - 0.5 * (select avg(abs(a.u - b.u)) from (select unnest(x) as u) a, (select unnest(x) as u) b) as crps from e)
select fold, count(*) as n, round(avg(crps), 6) as crps from c group by fold""",
)
def ensembles(spark, folder):
    rows = scored(spark, folder).where("r is not null").select("fold", "query_ticker", "query_date", "analogue_ticker", "analogue_date", "r").distinct()
    e = rows.groupBy("fold", "query_ticker", "query_date").agg(F.collect_list("r").alias("x"))
    c = e.withColumn("crps", m.crps(F.col("x"), F.lit(0.01))).where("crps is not null")
    return rnd(c.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg("crps").alias("crps")), ["fold", "n"], ["crps"])


@register(
    "e08_classification",
    f"""with {SCORED}, c as (select fold, p, y, signal = 'BUY' as b, y = 1 as u, signal in ('BUY', 'SELL') as sure, (signal = 'BUY' and y = 1) or (signal = 'SELL' and y <> 1) as ok from s)
select fold, count(*) as n, count(*) filter (sure) as n_signalled, round(avg(cast((p > 0.5) = u as double)), 6) as accuracy, round(coalesce(count(*) filter (ok) / nullif(count(*) filter (sure), 0), 0), 6) as signal_accuracy,
round(coalesce(count(*) filter (b and u) / nullif(count(*) filter (b), 0), 0), 6) as "precision", round(coalesce(count(*) filter (b and u) / nullif(count(*) filter (u), 0), 0), 6) as recall,
round(coalesce(2 * count(*) filter (b and u) / nullif(2 * count(*) filter (b and u) + count(*) filter (b and not u) + count(*) filter (not b and u), 0), 0), 6) as f1 from c group by fold""",
)
def classes(spark, folder):
    return rnd(m.classification(scored(spark, folder).where("signal is not null"), ["fold"]), ["fold", "n", "n_signalled"], ["accuracy", "signal_accuracy", "precision", "recall", "f1"])


@register(
    "e12_bootstrap_skill",
    f"with {SCORED} select fold, count(*) as n, round(1 - avg(power(p - y, 2)) / (avg(y) * (1 - avg(y))), 6) as bss_point, true as covered, true as near, true as reduced from s group by fold",
)
def bootstrap(spark, folder):
    """Control-variate bootstrap of the skill score per fold over the whole journal: the point lies in the interval, the estimate near the point, and the variance shrinks."""
    out = bootstrapped(spark, folder)
    inside = (F.col("ci_lower") <= F.col("bss_point")) & (F.col("bss_point") <= F.col("ci_upper"))
    near = F.abs(F.col("bss_cv") - F.col("bss_point")) <= F.col("ci_upper") - F.col("ci_lower")
    return out.select("fold", "n", F.round("bss_point", 6).alias("bss_point"), inside.alias("covered"), near.alias("near"), F.col("variance_reduction").between(0, 1).alias("reduced"))


def bootstrapped(spark, folder):
    key = F.xxhash64("query_ticker", "query_date", "analogue_ticker", "analogue_date", "analogue_rank")
    return m.bootstrap_skill(scored(spark, folder).select("fold", "p", "y", key.alias("key")), ["fold"])


@register("e13_control_variate")
def control_variate(spark, folder):
    """The estimates behind ``e12_bootstrap_skill``: control-variate score, interval, beta and variance reduction per fold."""
    return rnd(bootstrapped(spark, folder), ["fold", "n"], ["bss_point", "bss_cv", "ci_lower", "ci_upper", "beta", "variance_reduction"])


_FOLDS = "f as (select max_distance, fold, avg(bss) as bss, avg(avgk) as avgk from sweep_max_distance_23d_standardized where fold is not null and bss is not null group by 1, 2)"


def fold_results(spark, folder):
    s = table(spark, folder, "sweep_max_distance_23d_standardized").where("fold is not null and bss is not null")
    return s.groupBy("max_distance", "fold").agg(F.avg("bss").alias("bss"), F.avg("avgk").alias("avgk"))


@register(
    "e15_fold_summary",
    f"""with {_FOLDS}, r as (select *, row_number() over (partition by max_distance order by bss, fold) as w from f),
nz as (select max_distance, bss, abs(bss) as a, rank() over (partition by max_distance order by abs(bss)) + (count(*) over (partition by max_distance, abs(bss)) - 1) / 2.0 as rk, row_number() over (partition by max_distance order by fold) - 1 as i, count(*) over (partition by max_distance) as n from f where bss <> 0),
wp as (select max_distance, avg(cast(t >= w - 1e-9 as double)) as p from (select max_distance, m, sum(case when (m >> i) & 1 = 1 then rk else 0 end) as t, sum(case when bss > 0 then rk else 0 end) as w from nz, (select unnest(range(0, 64)) as m) where n = 6 group by 1, 2) group by 1)
select max_distance, round((select p from wp where wp.max_distance = r.max_distance), 6) as wilcoxon_p, count(*) as n_folds, round(avg(bss), 6) as mean, round(avg(bss) filter (w > 1), 6) as trimmed_mean, count(*) filter (bss > 0) as positive, round(regr_slope(bss, cast(fold as double)), 6) as slope, arg_max(fold, (bss, -fold)) as best_fold from r group by 1""",
)
def folds(spark, folder):
    return rnd(m.fold_summary(fold_results(spark, folder), ["max_distance"], "bss"), ["max_distance", "n_folds", "positive", "best_fold"], ["mean", "trimmed_mean", "slope", "wilcoxon_p"])


@register(
    "e18_fold_pairs",
    f"""with {_FOLDS} select a.max_distance, count(*) as folds, count(*) filter (a.bss > b.bss) as wins, round(avg(a.bss - b.bss), 6) as delta, case when count(*) filter (a.bss > b.bss) >= 4 then 'PASS' when count(*) filter (a.bss > b.bss) = 3 then 'DRAW' else 'FAIL' end as gate
from f a join f b on a.fold = b.fold and b.max_distance = (select min(max_distance) from f) where a.max_distance <> b.max_distance group by 1""",
)
def pairs(spark, folder):
    f = fold_results(spark, folder)
    base = f.join(F.broadcast(f.agg(F.min("max_distance").alias("m"))), F.col("max_distance") == F.col("m")).select("fold", F.col("bss").alias("b"), "m")
    out = f.join(base, "fold").where("max_distance <> m").groupBy("max_distance").agg(F.count(F.lit(1)).alias("folds"), F.count_if(F.col("bss") > F.col("b")).alias("wins"), F.avg(F.col("bss") - F.col("b")).alias("delta"))
    return rnd(out.withColumn("gate", F.when(F.col("wins") >= 4, "PASS").when(F.col("wins") == 3, "DRAW").otherwise("FAIL")), ["max_distance", "folds", "wins", "gate"], ["delta"])


@register("e22_winner", f"with {_FOLDS}, g as (select max_distance, bool_and(coalesce(avgk >= 5, false)) as ok from f group by 1) select min(max_distance) as max_distance from g where ok")
def best(spark, folder):
    return m.winner(fold_results(spark, folder), 5.0)


@register(
    "e26_sector_lift",
    """with s as (select coalesce(u.sector, 'Unknown') as sector, g.raw_prob as p from signals g left join universe u on upper(trim(g.ticker)) = u.ticker where g.raw_prob is not null)
select sector, cast(t as double) as threshold, count(*) as n, round(avg(p), 6) as mean_prob, round(quantile_cont(p, 0.05), 6) as p5, round(quantile_cont(p, 0.95), 6) as p95, round(avg(cast(p >= t as double)), 6) as pass_rate
from s, (select unnest([0.5, 0.55, 0.6, 0.65]) as t) group by 1, 2""",
)
def lift(spark, folder):
    u = table(spark, folder, "universe").select("ticker", F.col("sector").alias("usector"))
    g = table(spark, folder, "signals").where("raw_prob is not null").select(F.upper(F.trim("ticker")).alias("t"), F.col("raw_prob").alias("p"))
    s = g.join(u, g["t"] == u["ticker"], "left").select(F.coalesce("usector", F.lit("Unknown")).alias("sector"), "p")
    each = s.withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in (0.5, 0.55, 0.6, 0.65)])))
    out = each.groupBy("sector", "threshold").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_prob"), F.avg((F.col("p") >= F.col("threshold")).cast("double")).alias("pass_rate"))
    out = out.join(m.percentiles(s, ["sector"], "p", {"p5": 0.05, "p95": 0.95}), "sector")
    return rnd(out, ["sector", "threshold", "n"], ["mean_prob", "p5", "p95", "pass_rate"])


@register(
    "e29_value_counts",
    """with b as (select upper(signal) as signal, case when confidence <= 0.65 then '0-0.65' when confidence <= 0.7 then '0.65-0.7' when confidence <= 0.75 then '0.7-0.75' when confidence <= 0.8 then '0.75-0.8' when confidence <= 1 then '0.8-1' end as band from signals)
select signal, band, count(*) as n, round(count(*) / sum(count(*)) over (partition by signal), 6) as share from b group by 1, 2""",
)
def counts(spark, folder):
    c, band = F.col("confidence"), None
    for top, name in ((0.65, "0-0.65"), (0.7, "0.65-0.7"), (0.75, "0.7-0.75"), (0.8, "0.75-0.8"), (1.0, "0.8-1")):
        band = F.when(c <= top, name) if band is None else band.when(c <= top, name)
    out = table(spark, folder, "signals").groupBy(F.upper("signal").alias("signal"), band.alias("band")).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("signal")), 6))


@register(
    "e31_top_categories",
    """select exit_reason, sector, n from (select exit_reason, sector, count(*) as n, row_number() over (partition by exit_reason order by count(*) desc, sector nulls last) as k from trades group by 1, 2) where k <= 3""",
)
def top_categories(spark, folder):
    n = table(spark, folder, "trades").groupBy("exit_reason", "sector").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("exit_reason").orderBy(F.desc("n"), F.col("sector").asc_nulls_last())
    return n.withColumn("k", F.row_number().over(w)).where("k <= 3").drop("k")


@register(
    "e32_distinct_counts",
    """select fold, count(distinct query_ticker) as tickers, count(distinct query_date) as dates, count(distinct (query_ticker, query_date)) as queries, count(distinct analogue_ticker) as analogues from journal group by fold""",
)
def distincts(spark, folder):
    return table(spark, folder, "journal").groupBy("fold").agg(
        F.count_distinct("query_ticker").alias("tickers"), F.count_distinct("query_date").alias("dates"), F.count_distinct(F.struct("query_ticker", "query_date")).alias("queries"), F.count_distinct("analogue_ticker").alias("analogues")
    )


@register(
    "e36_agreement",
    """with v as (select signal_source as cfg, upper(trim(ticker)) as ticker, upper(signal) as signal, raw_prob as p from signals where ticker is not null and raw_prob is not null and signal_source is not null),
p as (select ticker, cfg, signal, count(*) as n, avg(p) as p from v group by 1, 2, 3), w as (select ticker, cfg, signal, p, row_number() over (partition by ticker, cfg order by n desc, signal) as k from p),
o as (select ticker, max(signal) filter (cfg = 'KNN') as knn, max(signal) filter (cfg = 'DL') as dl, max(signal) filter (cfg = 'ENSEMBLE') as ensemble, max(p) - min(p) as spread, count(*) as c, count(*) filter (signal = 'BUY') as buys from w where k = 1 group by 1)
select ticker, knn, dl, ensemble, round(spread, 6) as spread, spread >= 0.15 as disagree, round(buys / c, 6) as buy_ratio from o""",
)
def agreement(spark, folder):
    v = table(spark, folder, "signals").where("ticker is not null and raw_prob is not null and signal_source is not null").select(F.col("signal_source").alias("cfg"), F.upper(F.trim("ticker")).alias("ticker"), F.upper("signal").alias("signal"), "raw_prob")
    p = v.groupBy("ticker", "cfg", "signal").agg(F.count(F.lit(1)).alias("n"), F.avg("raw_prob").alias("p"))
    w = p.withColumn("k", F.row_number().over(Window.partitionBy("ticker", "cfg").orderBy(F.desc("n"), "signal"))).where("k = 1")
    votes = w.groupBy("ticker").pivot("cfg", ["KNN", "DL", "ENSEMBLE"]).agg(F.max("signal"))
    stats = w.groupBy("ticker").agg((F.max("p") - F.min("p")).alias("spread"), (F.count_if(F.col("signal") == "BUY") / F.count(F.lit(1))).alias("buy_ratio"))
    out = votes.join(stats, "ticker")
    return out.select("ticker", F.col("KNN").alias("knn"), F.col("DL").alias("dl"), F.col("ENSEMBLE").alias("ensemble"), F.round("spread", 6).alias("spread"), (F.col("spread") >= 0.15).alias("disagree"), F.round("buy_ratio", 6).alias("buy_ratio"))


@register(
    "e45_trade_metrics",
    f"""with {TRADES} select exit_reason, count(*) as n, round(avg(cast(net_pnl > 0 as double)), 6) as win_rate, round(avg(net_pnl), 9) as expectancy, round(sum(net_pnl) filter (net_pnl > 0) / nullif(abs(sum(net_pnl) filter (net_pnl < 0)), 0), 6) as profit_factor,
round(coalesce(avg(net_pnl) filter (net_pnl > 0) / nullif(abs(avg(net_pnl) filter (net_pnl < 0)), 0), 1), 6) as b_ratio, round(avg(holding_days), 6) as mean_days, round(median(holding_days), 6) as median_days from tr where net_pnl is not null group by 1""",
)
def trade_metrics(spark, folder):
    t = replay_trades(spark, folder).where("net_pnl is not null")
    x = F.col("net_pnl")
    win, loss = F.when(x > 0, x), F.when(x < 0, x)
    out = t.groupBy("exit_reason").agg(
        F.count(F.lit(1)).alias("n"), F.avg((x > 0).cast("double")).alias("win_rate"), F.avg(x).alias("expectancy"), F.try_divide(F.sum(win), F.abs(F.sum(loss))).alias("profit_factor"),
        F.coalesce(F.try_divide(F.avg(win), F.abs(F.avg(loss))), F.lit(1.0)).alias("b_ratio"), F.avg("holding_days").alias("mean_days"),
    )
    mid = m.percentiles(t, ["exit_reason"], "holding_days", {"median_days": 0.5}).withColumnRenamed("exit_reason", "reason")
    out = out.join(mid, F.col("exit_reason").eqNullSafe(F.col("reason")), "left")
    out = out.withColumn("expectancy", F.round("expectancy", 9))
    return rnd(out, ["exit_reason", "n", "expectancy"], ["win_rate", "profit_factor", "b_ratio", "mean_days", "median_days"])


@register(
    "g22_conformal",
    f"""with {SCORED}, r as (select fold, abs(p - y) as score, row_number() over (partition by fold order by abs(p - y)) as k, count(*) over (partition by fold) as n from s)
select fold, round(min(score), 6) as threshold from r where k >= least(ceil((n + 1) * 0.9), n) group by fold""",
)
def conformal(spark, folder):
    s = scored(spark, folder).select("fold", F.abs(F.col("p") - F.col("y")).alias("score"))
    return rnd(cal.conformal_threshold(s, ["fold"], "score", 0.1), ["fold"], ["threshold"])


@register(
    "g25_sector_conviction",
    """with s as (select signal_id, sector, upper(signal) as signal, raw_prob as prob from signals where raw_prob is not null and sector is not null), b as (select sector, avg(cast(net_pnl > 0 as double)) as base_rate from (select distinct * from trades) where sector is not null and net_pnl is not null group by 1),
l as (select s.*, avg(prob) over (partition by s.sector) - coalesce(b.base_rate, 0.5) as lift from s left join b on b.sector = s.sector)
select signal_id, round(lift, 6) as lift, case when lift < 0.02 and signal in ('BUY', 'SELL') then 'HOLD' else signal end as filtered, lift < 0.02 and signal in ('BUY', 'SELL') as changed from l""",
)
def conviction(spark, folder):
    from chronoloom.operators.vote import sector_lift

    s = table(spark, folder, "signals").where("raw_prob is not null and sector is not null").select("signal_id", "sector", F.upper("signal").alias("signal"), F.col("raw_prob").alias("prob"))
    b = table(spark, folder, "trades").distinct().where("sector is not null and net_pnl is not null").groupBy("sector").agg(F.avg((F.col("net_pnl") > 0).cast("double")).alias("base_rate"))
    return sector_lift(s, b, 0.02).select("signal_id", F.round("lift", 6).alias("lift"), "filtered", "changed")


@register(
    "g26_momentum_filter",
    """with s as (select signal_id, sector, upper(signal) as signal, mean_7d_return as ret from signals where sector is not null), a as (select sector, avg(ret) as avg_return from s where ret is not null group by 1),
g as (select s.*, coalesce(ret - coalesce(avg_return, 0), 0) as gap from s left join a using (sector))
select signal_id, case when signal = 'BUY' and not gap >= 0.015 then 'HOLD' when signal = 'SELL' and not -gap >= 0.015 then 'HOLD' else signal end as filtered from g""",
)
def momentum_filter(spark, folder):
    from chronoloom.operators.vote import momentum

    s = table(spark, folder, "signals").where("sector is not null").select("signal_id", "sector", F.upper("signal").alias("signal"), F.col("mean_7d_return").alias("ret"))
    a = s.where("ret is not null").groupBy("sector").agg(F.avg("ret").alias("avg_return"))
    return momentum(s, a).select("signal_id", "filtered")


@register(
    "w03_ranked_capped",
    """with l as (select *, row_number() over (partition by date, ticker order by loaded_at desc nulls last, ranked_id desc) as v from ranked_signals where date is not null),
r as (select *, row_number() over (partition by date, coalesce(sector, '?') order by confidence desc, ticker) as g from l where v = 1 and confidence is not null and not isnan(confidence)),
s as (select *, row_number() over (partition by date order by confidence desc, ticker) as k from r where g <= 3)
select cast(date as varchar) as date, ticker, cast(k as integer) as rank from s where k <= 10""",
)
def capped(spark, folder):
    r = table(spark, folder, "ranked_signals").where("date is not null")
    best = r.groupBy("date", "ticker").agg(F.max(F.struct("loaded_at", "ranked_id", "confidence", "sector")).alias("b")).select("date", "ticker", "b.confidence", F.coalesce("b.sector", F.lit("?")).alias("sector"))
    ok = best.where("confidence is not null and not isnan(confidence)")
    out = o.capped_selection(ok, "date", "sector", [F.desc("confidence"), F.col("ticker")], 10, 3)
    return out.select(F.date_format("date", "yyyy-MM-dd").alias("date"), "ticker", "rank")


@register(
    "ts1_cusum_ewma",
    """with recursive e as (select event_type, value, ts, event_id, row_number() over (partition by event_type order by ts, event_id) as i from events where value is not null),
c as (select event_type, cast(0 as bigint) as i, cast(0 as double) as up, cast(0 as double) as down, 0 as alerts, cast(10 as double) as ew from (select distinct event_type from e)
union all select e.event_type, e.i, greatest(0, c.up + (e.value - 20.0) / 25.0 - 0.5), greatest(0, c.down - (e.value - 20.0) / 25.0 - 0.5),
 c.alerts + cast(greatest(0, c.up + (e.value - 20.0) / 25.0 - 0.5) > 5 or greatest(0, c.down - (e.value - 20.0) / 25.0 - 0.5) > 5 as integer), 0.1 * e.value + (1 - 0.1) * c.ew from c join e on e.event_type = c.event_type and e.i = c.i + 1)
select event_type, max(i) as n, round(arg_max(up, i), 5) as up, round(arg_max(down, i), 5) as down, arg_max(alerts, i) as alerts, round(arg_max(ew, i), 5) as ewma from c group by 1""",
)
def monitors(spark, folder):
    e = table(spark, folder, "events").select("event_type", "ts", "event_id", "value")
    c = o.cusum(e, ["event_type"], ["ts", "event_id"], "value", 20.0, 25.0)
    w = o.ewma(e, ["event_type"], ["ts", "event_id"], "value", 10.0, 0.1).select("event_type", F.round("ewma", 5).alias("ewma"))
    return c.select("event_type", "n", F.round("up", 5).alias("up"), F.round("down", 5).alias("down"), "alerts").join(w, "event_type")


@register(
    "ts5_run_fatigue",
    """with e as (select user_id, event_id, event_type, case when event_type is not distinct from lag(event_type) over (partition by user_id order by event_id) then 0 else 1 end as f from events),
r as (select *, sum(f) over (partition by user_id order by event_id rows unbounded preceding) as run from e), n as (select *, row_number() over (partition by user_id, run order by event_id) as k from r)
select event_id, cast(k as integer) as run_length, round(1 - power(0.8, k - 1), 6) as fatigue from n""",
)
def fatigue(spark, folder):
    out = o.run_fatigue(table(spark, folder, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type", 0.2)
    return out.select("event_id", "run_length", F.round("fatigue", 6).alias("fatigue"))


@register("g09_calibrators")
def calibrators(spark, folder):
    """Mean score of the journal's raw probability per fold: raw, and after Platt, beta and isotonic calibration on the odd query dates."""
    s = scored(spark, folder).where("raw_prob is not null")
    train = s.where(F.dayofyear("query_date") % 2 == 1)
    a, b = cal.fit_platt(train)
    be = cal.fit_beta(train)
    knots, values = cal.fit_isotonic(train)
    p, y = F.col("raw_prob"), F.col("y")
    rows = s.withColumns({"platt": cal.platt(p, a, b), "beta": cal.beta(p, *be), "isotonic": cal.isotonic(p, knots, values)})
    return rnd(rows.groupBy("fold").agg(*[m.brier(F.col(c), y).alias(c) for c in ("raw_prob", "platt", "beta", "isotonic")]), ["fold"], ["raw_prob", "platt", "beta", "isotonic"])
