"""Contracts, cleaning, gates, filters of signals and further regimes."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoloom.operators import calibrate as cal
from chronoloom.operators import contracts, gates, regimes
from chronoloom.operators import metrics as m
from chronoloom.operators import ordered as o
from chronoloom.operators import vote as vt
from chronoloom.queries import register
from chronoloom.queries.evaluation import _FOLDS, SCORED, fold_results, rnd, scored
from chronoloom.queries.features import BARS_N
from chronoloom.queries.joins import SERIES, TRADES, benchmark
from chronoloom.queries.pipeline import COMPLETE, R8, complete_rows
from chronoloom.sources.tables import bars_nation, replay_trades, table

_DIRTY = "select row_id, case when row_id % 17 = 0 then 'n/a' when row_id % 23 = 0 then 'inf' else cast(close as varchar) end as close, case when row_id % 19 = 0 then 'soon' else cast(date as varchar) end as date from full_db"


@register("p07_coerced_rows", "select row_id, cast(date as varchar) as date, round(close, 4) as close from full_db where row_id % 17 <> 0 and row_id % 23 <> 0 and row_id % 19 <> 0 and date is not null and close is not null and not isnan(close)")
def coerced(spark, folder):
    """Text cells read as dates and numbers; rows with an unreadable one are dropped, none is an error."""
    r = F.col("row_id")
    raw = table(spark, folder, "full_db").select(
        "row_id", F.when(r % 17 == 0, "n/a").when(r % 23 == 0, "inf").otherwise(F.col("close").cast("string")).alias("close"), F.when(r % 19 == 0, "soon").otherwise(F.date_format("date", "yyyy-MM-dd")).alias("date")
    )
    out = contracts.coerced(raw, {"date": "yyyy-MM-dd"}, ["close"])
    return out.select("row_id", F.date_format("date", "yyyy-MM-dd").alias("date"), F.round("close", 4).alias("close"))


def _duck(rule: str) -> str:
    return rule.replace("`", '"').replace("double('infinity')", "cast('infinity' as double)")


_CONTRACTS = {"query": (contracts.query_rules(R8), "full_db"), "target": (contracts.target_rules("fwd_7d_up"), "full_db"), "bars": (contracts.bar_rules(), "bars"), "features": (contracts.train_rules(R8, "label"), "rows")}


@register(
    "p16_contracts",
    f"with {BARS_N}, {COMPLETE} "
    + " union all ".join(f"select '{name}' as contract, '{rule}' as rule, count(*) filter (not coalesce({_duck(sql)}, false)) as broken from {source}" for name, (rules, source) in _CONTRACTS.items() for rule, sql in rules.items()),
)
def all_contracts(spark, folder):
    """Violations of the contracts of query rows, labels, bars and the feature table."""
    sources = {"full_db": table(spark, folder, "full_db"), "bars": bars_nation(spark, folder), "rows": complete_rows(spark, folder)}
    out = None
    for name, (rules, source) in _CONTRACTS.items():
        part = contracts.violations(sources[source], rules).select(F.lit(name).alias("contract"), "rule", "broken")
        out = part if out is None else out.unionByName(part)
    return out


@register(
    "e05_murphy_gate",
    f"""with {SCORED}, b as (select signal, fold, greatest(1, least(10, ceil(p * 10))) as bin, count(*) as n, avg(p) as mp, avg(y) as my from s where signal is not null group by 1, 2, 3),
t as (select signal, fold, sum(n) as total, sum(n * my) / sum(n) as base from b group by 1, 2),
d as (select signal, fold, sum(n / total * power(mp - my, 2)) as reliability, sum(n / total * power(my - base, 2)) as resolution from b join t using (signal, fold) group by 1, 2),
g as (select signal, avg(resolution) as res, avg(reliability) as rel from d group by 1)
select signal, round(res, 6) as mean_resolution, round(rel, 6) as mean_reliability, case when res < 0.001 and rel <= 0.002 then 'resolution' when rel > 0.002 and res >= 0.001 then 'reliability' else 'mixed' end as failure, res < 0.001 and rel <= 0.002 as blocked from g""",
)
def murphy_gate(spark, folder):
    parts = m.murphy(scored(spark, folder).where("signal is not null"), ["signal", "fold"], 10)
    return rnd(gates.murphy_gate(parts, ["signal"]), ["signal", "failure", "blocked"], ["mean_resolution", "mean_reliability"])


@register(
    "e19_identifiability",
    f"with {COMPLETE}, n as (select fold, count(*) as n_train from rows, folds where rows.date <= train_end group by fold) select fold, n_train, round(n_train / 50.0, 6) as ratio, case when n_train / 50.0 >= 20 then 'PASS' else 'FAIL' end as verdict from n",
)
def identifiability(spark, folder):
    folds = F.broadcast(table(spark, folder, "folds").select("fold", "train_end"))  # a fixed table of six rows
    n = complete_rows(spark, folder).join(folds, F.col("date") <= F.col("train_end")).groupBy("fold").agg(F.count(F.lit(1)).alias("n_train"))
    return gates.identifiability(n, "n_train", 50).withColumn("ratio", F.round("ratio", 6))


@register(
    "e20_improvement_gates",
    f"""with {_FOLDS}, d as (select a.max_distance, a.fold, a.bss - b.bss as delta from f a join f b on a.fold = b.fold and b.max_distance = (select min(max_distance) from f) where a.max_distance <> b.max_distance)
select max_distance, count(*) filter (delta >= 0.0001) as improved, round(min(delta), 6) as worst_delta, case when count(*) filter (delta >= 0.0001) >= 3 and min(delta) >= -0.0005 then 'PASS' else 'FAIL' end as verdict, round(avg(delta), 6) as mean_delta, avg(delta) > -0.0005 as redundant from d group by 1""",
)
def improvement(spark, folder):
    """Each distance limit against the smallest: folds that improve, the worst loss, and whether the difference is nothing."""
    f = fold_results(spark, folder)
    least = F.broadcast(f.agg(F.min("max_distance").alias("least")))
    base = f.join(least, F.col("max_distance") == F.col("least")).select("fold", F.col("bss").alias("b"), "least")
    d = f.join(base, "fold").where("max_distance <> least").select("max_distance", "fold", (F.col("bss") - F.col("b")).alias("delta"))
    out = gates.improvement_gate(d, ["max_distance"], 0.0001).join(gates.redundancy_gate(d, ["max_distance"]), "max_distance")
    return rnd(out, ["max_distance", "improved", "verdict", "redundant"], ["worst_delta", "mean_delta"])


_QUERY_ROWS = "d as (select fold, query_date, query_ticker, avg(p) as p, avg(y) as y from s group by 1, 2, 3)"


def _query_rows(spark, folder):
    return scored(spark, folder).groupBy("fold", "query_date", "query_ticker").agg(F.avg("p").alias("p"), F.avg("y").alias("y"))


@register(
    "e25_coverage_halves",
    f"""with {SCORED}, {_QUERY_ROWS}, h as (select *, abs(p - y) as score, case when row_number() over (partition by fold order by query_date, query_ticker) <= floor(count(*) over (partition by fold) / 2) then 1 else 2 end as half from d),
r as (select fold, score, row_number() over (partition by fold order by score) as k, count(*) over (partition by fold) as n from h where half = 1), t as (select fold, min(score) as threshold from r where k >= least(ceil((n + 1) * 0.9), n) group by fold)
select h.fold, round(t.threshold, 6) as threshold, round(avg(cast(score <= t.threshold as double)), 6) as coverage, round(avg(least(p + t.threshold, 1) - greatest(p - t.threshold, 0)), 6) as width, count(*) as n from h join t using (fold) where half = 2 group by h.fold, t.threshold""",
)
def coverage_halves(spark, folder):
    """Width fitted on the first half of each fold's queries, coverage and mean band on the second."""
    h = gates.halves(_query_rows(spark, folder).withColumn("score", F.abs(F.col("p") - F.col("y"))), ["fold"], ["query_date", "query_ticker"])
    t = cal.conformal_threshold(h.where("half = 1"), ["fold"], "score", 0.1)
    low, high = cal.conformal_band(F.col("p"), 2 * F.col("threshold"))
    out = h.where("half = 2").join(t, "fold").groupBy("fold", "threshold").agg(F.avg((F.col("score") <= F.col("threshold")).cast("double")).alias("coverage"), F.avg(high - low).alias("width"), F.count(F.lit(1)).alias("n"))
    return rnd(out, ["fold", "n"], ["threshold", "coverage", "width"])


@register(
    "e25_rate_sweep",
    f"""with recursive {SCORED}, {_QUERY_ROWS}, m as (select fold, cast(abs(p - y) > 0.35 as double) as miss, row_number() over (partition by fold order by query_date, query_ticker) as i from d), g as (select unnest([0.005, 0.01, 0.05]) as rate),
a as (select fold, rate, cast(0 as bigint) as i, cast(0.1 as double) as level from (select distinct fold from m), g union all select a.fold, a.rate, m.i, greatest(0.01, least(0.5, a.level + a.rate * (0.1 - m.miss))) from a join m on m.fold = a.fold and m.i = a.i + 1)
select fold, cast(rate as double) as rate, round(arg_max(level, i), 6) as level from a group by 1, 2""",
)
def rate_sweep(spark, folder):
    d = _query_rows(spark, folder).withColumn("miss", (F.abs(F.col("p") - F.col("y")) > 0.35).cast("double"))
    out = [o.adaptive_coverage(d, ["fold"], ["query_date", "query_ticker"], "miss", 0.1, r).select("fold", F.lit(r).alias("rate"), F.round("level", 6).alias("level")) for r in (0.005, 0.01, 0.05)]
    return out[0].unionByName(out[1]).unionByName(out[2])


@register(
    "g23_conformal_signals",
    f"""with {SCORED}, {_QUERY_ROWS}, x as (select fold, greatest(p - 0.06, 0) as lo, least(p + 0.06, 1) as hi from d)
select fold, case when lo > 0.55 then 'BUY' when hi < cast(1 as double) - cast(0.55 as double) then 'SELL' else 'HOLD' end as signal, count(*) as n, round(avg(hi - lo), 6) as width from x group by 1, 2""",
)
def conformal_signals(spark, folder):
    low, high = cal.conformal_band(F.col("p"), F.lit(0.12))
    d = _query_rows(spark, folder).select("fold", low.alias("lo"), high.alias("hi"))
    return d.groupBy("fold", cal.conformal_signal(F.col("lo"), F.col("hi"), 0.55).alias("signal")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("hi") - F.col("lo")), 6).alias("width"))


@register(
    "g28_signal_pipeline",
    """with s as (select signal_id, sector, upper(signal) as signal, raw_prob as prob, mean_7d_return as ret, confidence from signals where raw_prob is not null and sector is not null),
b as (select sector, avg(cast(net_pnl > 0 as double)) as base_rate from (select distinct * from trades) where sector is not null and net_pnl is not null group by 1),
l as (select s.*, case when avg(prob) over (partition by s.sector) - coalesce(b.base_rate, 0.5) < 0.02 and signal in ('BUY', 'SELL') then 'HOLD' else signal end as s1 from s left join b on b.sector = s.sector),
a as (select sector, avg(ret) as avg_return from s where ret is not null group by 1),
g as (select l.*, coalesce(ret - coalesce(avg_return, 0), 0) as gap from l left join a on a.sector = l.sector),
m as (select *, case when s1 = 'BUY' and not gap >= 0.015 then 'HOLD' when s1 = 'SELL' and not -gap >= 0.015 then 'HOLD' else s1 end as s2 from g),
v as (select *, case when s2 = 'BUY' and coalesce(confidence - 0.9, 0) < -0.2 then 'HOLD' else s2 end as s3 from m)
select signal_id, s3 as signal, (s1 is distinct from signal) or (s2 is distinct from s1) or (s3 is distinct from s2) as changed from v""",
)
def signal_pipeline(spark, folder):
    """Sector conviction, momentum and veto in turn."""
    s = table(spark, folder, "signals").where("raw_prob is not null and sector is not null").select("signal_id", "sector", F.upper("signal").alias("signal"), F.col("raw_prob").alias("prob"), F.col("mean_7d_return").alias("ret"), "confidence")
    b = table(spark, folder, "trades").distinct().where("sector is not null and net_pnl is not null").groupBy("sector").agg(F.avg((F.col("net_pnl") > 0).cast("double")).alias("base_rate"))
    a = s.where("ret is not null").groupBy("sector").agg(F.avg("ret").alias("avg_return"))
    steps = [lambda x: vt.sector_lift(x, b, 0.02), lambda x: vt.momentum(x, a), lambda x: x.withColumn("filtered", vt.veto(F.col("signal"), F.col("confidence") - 0.9))]
    return vt.pipeline(s, steps).select("signal_id", "signal", "changed")


@register(
    "g34_unified_signals",
    """select signal_id, case when signal_source = 'DL' then round(least(greatest(raw_prob * (1 - least(2 * abs(mean_7d_return), 0.5)), 0), 1), 6) else round(confidence, 6) end as confidence, signal_source,
cast(case when n_matches is null then 0 else 1 end + case when signal_source = 'DL' then 1 else 0 end + case when sector is null then 0 else 1 end as integer) as facts, cast(n_matches as varchar) as matches
from signals where signal_source in ('KNN', 'DL') and raw_prob is not null and mean_7d_return is not null""",
)
def unified_signals(spark, folder):
    """Signals of two models in one form; the facts of each are a map without nulls."""
    s = table(spark, folder, "signals").where("raw_prob is not null and mean_7d_return is not null")
    knn, dl = s.where("signal_source = 'KNN'"), s.where("signal_source = 'DL'")
    both = [
        vt.unified(knn, "KNN", F.col("confidence"), {"id": F.col("signal_id"), "matches": F.col("n_matches"), "sector": F.col("sector")}),
        vt.unified(dl, "DL", vt.uncertain_confidence(F.col("raw_prob"), F.abs("mean_7d_return")), {"id": F.col("signal_id"), "matches": F.col("n_matches"), "sector": F.col("sector"), "deviation": F.abs("mean_7d_return")}),
    ]
    x = F.col("metadata")
    return both[0].unionByName(both[1]).select(x["id"].cast("long").alias("signal_id"), F.round("confidence", 6).alias("confidence"), "signal_source", (F.size(x) - 1).alias("facts"), F.try_element_at(x, F.lit("matches")).alias("matches"))


@register(
    "e38_consensus",
    """with v as (select date, upper(trim(ticker)) as ticker, signal_source, upper(signal) as signal, raw_prob as prob, row_number() over (partition by date, upper(trim(ticker)), signal_source order by signal_id desc) as k
 from signals where ticker is not null and signal is not null and signal_source is not null and raw_prob is not null and date is not null),
o as (select *, case signal_source when 'KNN' then 0 when 'DL' then 1 else 2 end as cfg from v where k = 1),
n as (select date, ticker, signal, count(*) as c, min(cfg) as o from o group by 1, 2, 3), l as (select date, ticker, arg_max(signal, (c, -o)) as lead, max(c) as c, sum(c) as n from n group by 1, 2),
t as (select date, ticker, avg(prob) as avg_prob, max(prob) - min(prob) as spread from o group by 1, 2)
select cast(date as varchar) || ' ' || ticker as item, case when c >= n // 2 + 1 then lead else 'HOLD' end as consensus, round(c / n, 6) as ratio, round(avg_prob, 6) as avg_prob, round(spread, 6) as spread from l join t using (date, ticker)""",
)
def consensus(spark, folder):
    """Majority of the latest signals of each source per date and ticker."""
    s = table(spark, folder, "signals").where("ticker is not null and signal is not null and signal_source is not null and raw_prob is not null and date is not null")
    item = F.concat_ws(" ", F.date_format("date", "yyyy-MM-dd"), F.upper(F.trim("ticker")))
    last = s.groupBy(item.alias("item"), "signal_source").agg(F.max_by(F.struct(F.upper("signal").alias("signal"), F.col("raw_prob").alias("prob")), "signal_id").alias("x"))
    votes = last.select("item", F.when(F.col("signal_source") == "KNN", 0).when(F.col("signal_source") == "DL", 1).otherwise(2).alias("config_order"), "x.*")
    return rnd(vt.consensus(votes), ["item", "consensus"], ["ratio", "avg_prob", "spread"])


def _nearest_sql(name: str, value: str) -> str:
    return f"""{name}s as (select date, arg_max({value}, row_id) as v from full_db where ticker = 'IDX00' and {value} is not null and date is not null group by date),
{name}b as (select tr.trade_id, tr.entry_date, s.date as bd, s.v as bv from tr asof left join {name}s s on tr.entry_date >= s.date), {name} as (select b.trade_id, case when s.date is null then bv when bd is null or s.date - b.entry_date <= b.entry_date - bd then s.v else bv end as v from {name}b b asof left join {name}s s on b.entry_date <= s.date)"""


@register(
    "g30_regime_overrides",
    f"""with {TRADES}, {_nearest_sql('base', 'ret_90d')}, {_nearest_sql('fear', 'ret_7d')}, {_nearest_sql('spread', 'ret_30d')}
select trade_id, case when coalesce(-50 * fear.v > 1, false) or coalesce(spread.v + 0.02 < 0, false) then 0 when base.v < 0 then 0 else 1 end as regime from base join fear using (trade_id) join spread using (trade_id)""",
)
def regime_overrides(spark, folder):
    """Bull or bear by the benchmark, overridden by a fear series and a spread series."""
    rows = replay_trades(spark, folder).select("trade_id", "entry_date")
    f = table(spark, folder, "full_db").where("ticker = 'IDX00' and date is not null")
    fear = f.where("ret_7d is not null").groupBy("date").agg((-50 * F.max_by("ret_7d", "row_id")).alias("v"))
    spread = f.where("ret_30d is not null").groupBy("date").agg((F.max_by("ret_30d", "row_id") + 0.02).alias("v"))
    return regimes.overridden_regime(rows, "entry_date", benchmark(spark, folder), fear, spread).select("trade_id", "regime")


@register(
    "g32_octet_regimes",
    f"""with {TRADES}, {SERIES}, r as (select *, stddev_samp(v) over (order by date rows between 9 preceding and current row) as vol, count(*) over (order by date rows between 9 preceding and current row) as c from series),
w as (select date, v, case when c >= 10 then vol end as vol from r), q as (select count(*) as n, quantile_cont(vol, 0.5) as mid from w),
code as (select date, case when n < 10 then 0 else 2 * coalesce(cast(v > 0 as integer), 0) + coalesce(cast(vol >= mid as integer), 0) end as code from w, q)
select tr.trade_id, cast(case when (select n from q) < 10 then 0 else 2 * coalesce(c.code, (select arg_min(code, date) from code)) + coalesce(cast(tr.confidence_at_entry * 40 > 25 as integer), 0) end as integer) as regime from tr asof left join code c on tr.entry_date >= c.date""",
)
def octet(spark, folder):
    from pyspark.sql import Window

    rows = replay_trades(spark, folder).select("trade_id", "entry_date", (F.col("confidence_at_entry") * 40).alias("strength"))
    w = Window.orderBy("date").rowsBetween(-9, 0)  # one series, bounded by the calendar
    s = benchmark(spark, folder)
    vol = s.withColumn("vol", F.when(F.count("v").over(w) >= 10, F.stddev_samp("v").over(w)))
    return regimes.octet_regimes(rows, "entry_date", vol, "strength").select("trade_id", "regime")
