"""Further queries: regimes, fallback matching, studies of distances, ensembles, coverage and data builds."""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators import calibrate as cal
from chronoloom.operators import features as f
from chronoloom.operators import metrics as m
from chronoloom.operators import neighbours as nb
from chronoloom.operators import ordered as o
from chronoloom.operators import regimes
from chronoloom.operators import vote as vt
from chronoloom.plans import analogue
from chronoloom.queries import register
from chronoloom.queries.analogues import CONFIG, VECTORS, sides
from chronoloom.queries.evaluation import SCORED, rnd, scored
from chronoloom.queries.features import _OVER, BARS_N, BARS_S, gated, rounded
from chronoloom.queries.joins import SERIES, TRADES, benchmark
from chronoloom.queries.pipeline import COMPLETE, complete_rows
from chronoloom.session import scratch
from chronoloom.sources.tables import bars_nation, bars_segment, replay_trades, table


@register(
    "g30_regime_labels",
    f"""with {TRADES}, {SERIES}, r as (select *, v as trend, stddev_samp(v) over (order by date rows between 9 preceding and current row) as vol, count(*) over (order by date rows between 9 preceding and current row) as c from series),
w as (select date, v, case when c >= 10 then vol end as vol from r), m as (select count(*) as n, quantile_cont(vol, 0.5) as mid from w),
code as (select date, case when n < 10 then 0 else 2 * coalesce(cast(v > 0 as integer), 0) + coalesce(cast(vol >= mid as integer), 0) end as code from w, m),
b as (select tr.trade_id, tr.entry_date, s.date as bd, s.v as bv from tr asof left join series s on tr.entry_date >= s.date), n as (select b.*, s.date as nd, s.v as nv from b asof left join series s on b.entry_date <= s.date),
k as (select tr.trade_id, coalesce(c.code, (select arg_min(code, date) from code)) as four from tr asof left join code c on tr.entry_date >= c.date)
select n.trade_id, case when (case when nd is null then bv when bd is null or nd - entry_date <= entry_date - bd then nv else bv end) < 0 then 0 else 1 end as two, k.four from n join k using (trade_id)""",
)
def regime_labels(spark, folder):
    rows = replay_trades(spark, folder).select("trade_id", "entry_date")
    s = benchmark(spark, folder)
    w = Window.orderBy("date").rowsBetween(-9, 0)  # one series, bounded by the calendar
    vol = s.withColumn("vol", F.when(F.count("v").over(w) >= 10, F.stddev_samp("v").over(w)))
    two = regimes.nearest_regime(rows, "entry_date", s).withColumnRenamed("regime", "two")
    return regimes.backward_regimes(two, "entry_date", vol).select("trade_id", "two", F.col("regime").alias("four"))


@register(
    "j08_regime_fallback",
    f"""with {VECTORS}, at2 as (select a.*, t.regime = q.regime as same from att a join v t on t.id = a.tid join v q on q.id = a.qid where distance <= 10.2 and t_ticker <> q_ticker),
fine as (select * from (select *, row_number() over (partition by qid order by distance, tid) as r from at2 where same) where r <= 20), n as (select qid, count(*) as n from fine group by 1 having count(*) >= 5),
coarse as (select * from (select *, row_number() over (partition by qid order by distance, tid) as r from at2 where qid not in (select qid from n)) where r <= 20)
select qid, 'fine' as level, count(*) as n, round(avg(label), 6) as prob from fine where qid in (select qid from n) group by 1 union all select qid, 'coarse', count(*), round(avg(label), 6) from coarse group by 1""",
)
def fallback(spark, folder):
    train, query = sides(spark, folder)
    probed = analogue.probe(train, query, CONFIG).where((F.col("distance") <= 10.2) & (F.col("t_ticker") != F.col("q_ticker")))
    fine = nb.post_filter(probed, F.col("t_regime") == F.col("q_regime"), 20)
    enough = fine.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).where("n >= 5").select("qid")
    fine = fine.join(enough, "qid", "left_semi").withColumn("level", F.lit("fine"))
    coarse = nb.post_filter(probed.join(enough, "qid", "left_anti"), F.lit(True), 20).withColumn("level", F.lit("coarse"))
    return fine.unionByName(coarse).groupBy("qid", "level").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("label"), 6).alias("prob"))


@register("j20_distance_percentiles", f"with {VECTORS} select rank, round(quantile_cont(distance, 0.1), 6) as p10, round(quantile_cont(distance, 0.5), 6) as p50, round(quantile_cont(distance, 0.9), 6) as p90 from probe where rank in (1, 5, 20) group by rank")
def distance_percentiles(spark, folder):
    train, query = sides(spark, folder)
    near = nb.knn_join(query, train, 20).where(F.col("rank").isin(1, 5, 20))
    return rnd(m.percentiles(near, ["rank"], "distance", {"p10": 0.1, "p50": 0.5, "p90": 0.9}), ["rank"], ["p10", "p50", "p90"])


@register("g20_median_projection", f"with {VECTORS} select qid, round(avg(fwd_return), 6) as mean_return, round(median(fwd_return), 6) as median_return, round(quantile_cont(fwd_return, 0.25), 6) as p25, count(*) as n from kept group by qid")
def projection(spark, folder):
    train, query = sides(spark, folder)
    near = analogue.matched(analogue.probe(train, query, CONFIG), CONFIG)
    return near.groupBy("qid").agg(
        F.round(F.avg("fwd_return"), 6).alias("mean_return"), F.round(F.percentile("fwd_return", F.lit(0.5)), 6).alias("median_return"), F.round(F.percentile("fwd_return", F.lit(0.25)), 6).alias("p25"), F.count(F.lit(1)).alias("n")
    )


def ensembles(spark, folder):
    train, query = sides(spark, folder)
    near = analogue.matched(analogue.probe(train, query, CONFIG), CONFIG)
    return vt.vote(query.select("qid", F.col("fwd_return").alias("y")), near).select("qid", "y", "ensemble", cal.padded(F.col("ensemble"), 20, 0.0).alias("x"))


@register("g13_mixture_weights")
def mixture(spark, folder):
    """Student-t mixture weights of the twenty ranked neighbours' returns over all queries, with the weighted forecast error."""
    votes = ensembles(spark, folder)
    w, var = cal.fit_mixture(votes, "x", "y")
    rmse = votes.agg(F.sqrt(F.avg((cal.weighted(F.col("x"), w.tolist()) - F.col("y")) ** 2)).alias("e")).first().e
    return spark.createDataFrame([(i + 1, round(float(a), 6), round(float(b), 6), round(float(rmse), 6)) for i, (a, b) in enumerate(zip(w, var))], "member int, weight double, variance double, rmse double")


@register(
    "g05_ensembles",
    f"""with {VECTORS}, q as (select id as qid, fwd from v where id % 5 = 0), k as (select qid, fwd_return, rank from kept),
e as (select q.qid, count(k.rank) as n, coalesce(sum(k.fwd_return * k.rank), 0) as ranked, coalesce(max(k.fwd_return) - min(k.fwd_return), 0) as spread from q left join k using (qid) group by 1)
select qid, n, round(ranked, 6) as ranked, round(spread, 6) as spread, round(ranked, 6) as padded from e""",
)
def ensemble_rows(spark, folder):
    """Each query's neighbour returns in rank order: their number, rank-weighted sum (also of the padded array) and spread."""
    def ranked(c):
        return F.round(F.aggregate(F.transform(c, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v), 6)

    e = ensembles(spark, folder)
    spread = F.coalesce(F.array_max("ensemble") - F.array_min("ensemble"), F.lit(0.0))
    return e.select("qid", F.size("ensemble").cast("long").alias("n"), ranked("ensemble").alias("ranked"), F.round(spread, 6).alias("spread"), ranked("x").alias("padded"))


@register(
    "g24_adaptive_coverage",
    f"""with recursive {SCORED}, d as (select fold, query_date, query_ticker, avg(p) as p, avg(y) as y from s group by 1, 2, 3),
m as (select fold, cast(abs(p - y) > 0.35 as double) as miss, row_number() over (partition by fold order by query_date, query_ticker) as i from d),
a as (select fold, cast(0 as bigint) as i, cast(0.1 as double) as level from (select distinct fold from m) union all select a.fold, m.i, greatest(0.01, least(0.5, a.level + 0.05 * (0.1 - m.miss))) from a join m on m.fold = a.fold and m.i = a.i + 1)
select fold, max(i) as n, round(arg_max(level, i), 6) as level from a group by 1""",
)
def adaptive(spark, folder):
    d = scored(spark, folder).groupBy("fold", "query_date", "query_ticker").agg(F.avg("p").alias("p"), F.avg("y").alias("y"))
    d = d.withColumn("miss", (F.abs(F.col("p") - F.col("y")) > 0.35).cast("double"))
    out = o.adaptive_coverage(d, ["fold"], ["query_date", "query_ticker"], "miss", 0.1, 0.05)
    return out.select("fold", "n", F.round("level", 6).alias("level"))


@register("e02_skill_variants", f"with {SCORED} select fold, round(1 - avg(power(p - y, 2)) / nullif(var_pop(y), 0), 6) as by_variance, round(avg(p), 6) as mean_prob, round(stddev_pop(p), 6) as deviation, round(quantile_cont(p, 0.05), 6) as p5, round(quantile_cont(p, 0.95), 6) as p95 from s group by fold")
def skill_variants(spark, folder):
    p, y = F.col("p"), F.col("y")
    out = scored(spark, folder).groupBy("fold").agg(
        (1 - F.try_divide(F.avg((p - y) ** 2), F.var_pop(y))).alias("by_variance"), F.avg(p).alias("mean_prob"), F.stddev_pop(p).alias("deviation")
    ).join(m.percentiles(scored(spark, folder), ["fold"], "p", {"p5": 0.05, "p95": 0.95}), "fold")
    return rnd(out, ["fold"], ["by_variance", "mean_prob", "deviation", "p5", "p95"])


@register(
    "e24_spearman",
    f"""with {SCORED}, d as (select fold, query_ticker, query_date, analogue_ticker, analogue_date, analogue_rank, min(r) as r from s where r is not null group by all),
k as (select fold, query_ticker, query_date, rank() over w + (count(*) over (partition by fold, query_ticker, query_date, r) - 1) / 2.0 as a, cast(analogue_rank as double) as b from d window w as (partition by fold, query_ticker, query_date order by r)),
c as (select fold, corr(a, b) as rho from k group by fold, query_ticker, query_date having count(*) >= 5 and stddev_pop(a) > 0 and stddev_pop(b) > 0)
select fold, count(*) as n, round(avg(rho), 5) as mean_rho from c group by fold""",
)
def spearman(spark, folder):
    by = ["fold", "query_ticker", "query_date"]
    d = scored(spark, folder).where("r is not null").groupBy(*by, "analogue_ticker", "analogue_date", "analogue_rank").agg(F.min("r").alias("r"))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, "r"))
    k = d.withColumn("a", F.rank().over(Window.partitionBy(*by).orderBy("r")) + (ties - 1) / 2).withColumn("b", F.col("analogue_rank").cast("double"))
    c = k.groupBy(*by).agg(m.correlation(F.col("a"), F.col("b")).alias("rho"), F.count(F.lit(1)).alias("n"), F.stddev_pop("a").alias("sa"), F.stddev_pop("b").alias("sb")).where("n >= 5 and sa > 0 and sb > 0")
    return c.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("rho"), 5).alias("mean_rho"))


@register(
    "e42_signal_accuracy",
    """with px as (select ticker, date, arg_max(close, row_id) as close from full_db where date is not null and close is not null group by 1, 2), a as (select *, lead(close, 7) over (partition by ticker order by date) as later from px),
s as (select distinct upper(trim(ticker)) as ticker, date, upper(signal) as signal from signals where ticker is not null and date is not null)
select s.signal, count(*) as n, round(avg(cast(later > close as double)), 6) as up_share, round(avg(later / close - 1), 6) as mean_return from s join a on a.ticker = s.ticker and a.date = s.date where later is not null group by 1""",
)
def signal_accuracy(spark, folder):
    px = table(spark, folder, "full_db").where("date is not null and close is not null").groupBy("ticker", "date").agg(F.max_by("close", "row_id").alias("close"))
    a = px.withColumn("later", F.lead("close", 7).over(Window.partitionBy("ticker").orderBy("date"))).where("later is not null")
    s = table(spark, folder, "signals").where("ticker is not null and date is not null").select(F.upper(F.trim("ticker")).alias("ticker"), "date", F.upper("signal").alias("signal")).distinct()
    up = (F.col("later") > F.col("close")).cast("double")
    return s.join(a, ["ticker", "date"]).groupBy("signal").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(up), 6).alias("up_share"), F.round(F.avg(F.col("later") / F.col("close") - 1), 6).alias("mean_return"))


@register(
    "e43_buy_and_hold",
    f"""with {BARS_N}, g as (select *, max(close) over (partition by ticker order by date rows unbounded preceding) as peak, close / lag(close) {_OVER} - 1 as r from bars)
select ticker, round(arg_max(close, date) / arg_min(close, date) - 1, 6) as total_return, round(max((peak - close) / peak), 6) as max_drawdown, round(power(arg_max(close, date) / arg_min(close, date), 252.0 / count(*)) - 1, 6) as annualised, round(avg(r) / stddev_samp(r) * sqrt(252), 5) as sharpe from g group by 1""",
)
def buy_and_hold(spark, folder):
    w = Window.partitionBy("ticker").orderBy("date")
    g = bars_nation(spark, folder).withColumn("peak", F.max("close").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("r", F.try_divide(F.col("close"), F.lag("close").over(w)) - 1)
    growth = F.max_by("close", "date") / F.min_by("close", "date")
    out = g.groupBy("ticker").agg(
        (growth - 1).alias("total_return"), F.max((F.col("peak") - F.col("close")) / F.col("peak")).alias("max_drawdown"), (F.pow(growth, F.lit(252.0) / F.count(F.lit(1))) - 1).alias("annualised"), (F.avg("r") / F.stddev_samp("r") * (252**0.5)).alias("sharpe")
    )
    return out.select("ticker", F.round("total_return", 6).alias("total_return"), F.round("max_drawdown", 6).alias("max_drawdown"), F.round("annualised", 6).alias("annualised"), F.round("sharpe", 5).alias("sharpe"))


@register(
    "f15_legacy_candles",
    f"""with {BARS_N} select ticker, date, round((greatest(open, close) - low) / (high - low + 1e-8), 6) as body_position, round(abs(close - open) / (high - low + 1e-8), 6) as body, round((high - greatest(open, close)) / (high - low + 1e-8), 6) as upper_wick, round((least(open, close) - low) / (high - low + 1e-8), 6) as lower_wick, case when close > open then 1.0::double else -1.0::double end as direction from bars""",
)
def legacy_candles(spark, folder):
    span = F.col("high") - F.col("low") + 1e-8
    b = bars_nation(spark, folder).withColumns(
        {"body_position": (F.greatest("open", "close") - F.col("low")) / span, "body": F.abs(F.col("close") - F.col("open")) / span, "upper_wick": (F.col("high") - F.greatest("open", "close")) / span, "lower_wick": (F.least("open", "close") - F.col("low")) / span, "direction": F.when(F.col("close") > F.col("open"), 1.0).otherwise(-1.0)}
    )
    return rounded(b, ["body_position", "body", "upper_wick", "lower_wick", "direction"])


@register(
    "f22_proxy_relative",
    f"""with {BARS_N}, r as (select *, close / lag(close, 7) {_OVER} - 1 as ret_7d from bars), px as (select sector, min(ticker) as proxy from bars group by 1),
p as (select r.sector, r.date, r.ret_7d as proxy_ret from r join px on px.proxy = r.ticker),
j as (select r.*, p.proxy_ret, count(r.ret_7d) over (partition by r.date, r.sector) as n, rank() over (partition by r.date, r.sector order by r.ret_7d nulls last) as k, count(*) over (partition by r.date, r.sector, r.ret_7d) as t from r left join p on p.sector = r.sector and p.date = r.date)
select ticker, date, round(ret_7d - coalesce(proxy_ret, 0), 6) as proxy_gap, round(case when ret_7d is null then null when n < 2 then 0.5 else (k + (t - 1) / 2.0) / n end, 6) as sector_rank from j""",
)
def proxy_relative(spark, folder):
    r = f.trailing_returns(bars_nation(spark, folder), (7,))
    px = r.groupBy("sector").agg(F.min("ticker").alias("proxy"))
    p = r.join(px, "sector").where("ticker = proxy").select("sector", "date", F.col("ret_7d").alias("proxy_ret"))
    n = F.count("ret_7d").over(Window.partitionBy("date", "sector"))
    j = r.join(p, ["sector", "date"], "left").withColumn("proxy_gap", F.col("ret_7d") - F.coalesce("proxy_ret", F.lit(0.0)))
    j = j.withColumn("sector_rank", F.when(F.col("ret_7d").isNull(), None).when(n < 2, 0.5).otherwise(f.average_rank("ret_7d", ["date", "sector"])))
    return rounded(j, ["proxy_gap", "sector_rank"])


@register("f27_atr_share_history", f"""with {BARS_S}, t as (select *, greatest(high - low, abs(high - lag(close) {_OVER}), abs(low - lag(close) {_OVER})) as tr from bars), a as (select *, {gated('tr', 10, 'avg')} as mean_tr from t) select ticker, date, round(mean_tr / close, 6) as tr_share, coalesce(mean_tr > 0 and close > 0, false) as valid from a""")
def atr_share(spark, folder):
    b = bars_segment(spark, folder).withColumn("tr", f.true_range())
    b = b.withColumn("mean_tr", f.full(F.col("tr"), 10, F.avg("tr")))
    return b.select("ticker", "date", F.round(F.try_divide("mean_tr", "close"), 6).alias("tr_share"), F.coalesce((F.col("mean_tr") > 0) & (F.col("close") > 0), F.lit(False)).alias("valid"))


@register(
    "p10_rethreshold",
    """with s as (select signal_id, confidence as c, n_matches as n from signals where confidence is not null), t as (select unnest([0.55, 0.6, 0.65]) as t)
select cast(t as double) as threshold, case when coalesce(n, 0) < 10 or abs(c - 0.5) * 2 < 0.1 then 'HOLD' when c >= cast(t as double) then 'BUY' when c <= cast(1 as double) - cast(t as double) then 'SELL' else 'HOLD' end as signal, count(*) as n from s, t group by 1, 2""",
)
def rethreshold(spark, folder):
    s = table(spark, folder, "signals").where("confidence is not null").select(F.col("confidence").alias("c"), F.coalesce("n_matches", F.lit(0)).alias("m"), F.explode(F.array(*[F.lit(x) for x in (0.55, 0.6, 0.65)])).alias("threshold"))
    c, t = F.col("c"), F.col("threshold")
    side = F.when((F.col("m") < 10) | (F.abs(c - 0.5) * 2 < 0.1), "HOLD").when(c >= t, "BUY").when(c <= 1 - t, "SELL").otherwise("HOLD")
    return s.groupBy("threshold", side.alias("signal")).agg(F.count(F.lit(1)).alias("n"))


@register("p11_neutral_imputation", "select ticker, count(*) as n, round(avg(coalesce(ret_90d, 0)), 9) as ret_90d, round(avg(coalesce(fwd_7d_up, 1)), 9) as fwd_7d_up, count(*) filter (ret_90d is null) as filled from full_db group by 1")
def imputation(spark, folder):
    d = table(spark, folder, "full_db").select("ticker", "ret_90d", "fwd_7d_up").withColumn("missing", F.col("ret_90d").isNull()).fillna({"ret_90d": 0.0, "fwd_7d_up": 1.0})
    return d.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ret_90d"), 9).alias("ret_90d"), F.round(F.avg("fwd_7d_up"), 9).alias("fwd_7d_up"), F.count_if("missing").alias("filled"))


@register(
    "s14_partitioned_build",
    f"""with {COMPLETE}, t as (select *, case when date <= date '2021-12-31' then 'train' when date <= date '2022-12-31' then 'val' else 'test' end as split from rows) select split, count(*) as n, count(distinct ticker) as tickers, round(avg(label), 9) as base_rate from t where split <> 'test' group by 1""",
)
def partitioned_build(spark, folder):
    rows = complete_rows(spark, folder)
    split = F.when(F.col("date") <= "2021-12-31", "train").when(F.col("date") <= "2022-12-31", "val").otherwise("test")
    path = scratch(spark, "build")
    rows.withColumn("split", split).write.partitionBy("split").parquet(path)
    back: DataFrame = spark.read.parquet(path).where("split <> 'test'")  # the test folder is not read
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ticker").alias("tickers"), F.round(F.avg("label"), 9).alias("base_rate"))


@register("w13_best_per_fold", "with f as (select fold, max_distance, avg(bss) as bss from sweep_max_distance_23d_standardized where fold is not null and bss is not null group by 1, 2) select fold, arg_max(max_distance, (bss, -max_distance)) as max_distance, round(max(bss), 6) as bss from f group by 1")
def best_per_fold(spark, folder):
    s = table(spark, folder, "sweep_max_distance_23d_standardized").where("fold is not null and bss is not null").groupBy("fold", "max_distance").agg(F.avg("bss").alias("bss"))
    return s.groupBy("fold").agg(F.max_by("max_distance", F.struct(F.col("bss"), -F.col("max_distance"))).alias("max_distance"), F.round(F.max("bss"), 6).alias("bss"))


@register("o03_resumed_search")
def resumed_search(spark, folder):
    """A quasi-random search over distance limit and threshold on one probe table; the first half of the log is saved and resumed."""
    from chronoloom.operators.metrics import brier_skill
    from chronoloom.plans import search
    from chronoloom.session import staged

    train, query = sides(spark, folder)
    probed = staged(analogue.probe(train, query, CONFIG), "probe")
    truth = query.select("qid", F.col("label").alias("y"))

    def objective(params):
        c = analogue.AnalogueConfig(top_k=params["top_k"], max_distance=params["max_distance"], min_matches=3)
        return analogue.query(train, query, c, probed).join(truth, "qid").agg(brier_skill(F.col("raw_prob"), F.col("y"))).first()[0]

    space = {"max_distance": (9.0, 12.0), "top_k": (5, 20)}
    log = search.run(search.proposals(space, 3), objective)
    path = scratch(spark, "trials")
    search.save_log(spark, log, path)
    log = search.run(search.proposals(space, 6), objective, log=search.load_log(spark, path))
    return spark.createDataFrame([(i, x["params"]["max_distance"], x["params"]["top_k"], round(x["value"], 6), x["status"]) for i, x in enumerate(log)], "trial int, max_distance double, top_k int, bss double, status string")
