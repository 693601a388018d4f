"""Data build, contracts, files, vector preparation, walk-forward and scalar queries."""

from __future__ import annotations


from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoloom.operators import contracts, vectors
from chronoloom.plans import walkforward as wf
from chronoloom.plans.analogue import AnalogueConfig
from chronoloom.queries import register
from chronoloom.queries.joins import SERIES, benchmark
from chronoloom.session import scratch
from chronoloom.sources import files
from chronoloom.sources.tables import table

R8 = vectors.RETURNS
COMPLETE = f"""rows as (select f.row_id as id, f.ticker, coalesce(u.sector, 'Unknown') as sector, f.date, f.fwd_7d_up as label, f.fwd_7d as fwd_return, {', '.join('f.' + c for c in R8)}
 from (select *, row_number() over (partition by ticker, date order by known_at desc nulls last, row_id desc) as k from full_db where date is not null) f left join universe u on u.ticker = f.ticker
 where f.k = 1 and f.fwd_7d_up is not null and f.fwd_7d is not null and {' and '.join(f'f.{c} is not null' for c in R8)})"""


def complete_rows(spark, folder):
    """The latest delivery of each ticker and date, with sector, complete returns and a label."""
    f = table(spark, folder, "full_db").where("date is not null").select("row_id", "ticker", "date", "known_at", "fwd_7d", "fwd_7d_up", *R8)
    latest = files.keep_first(f, ["ticker", "date"], [F.col("known_at").desc_nulls_last(), F.col("row_id").desc()])
    u = table(spark, folder, "universe").select("ticker", F.col("sector").alias("usector"))
    rows = wf.complete_cases(latest, [*R8, "fwd_7d", "fwd_7d_up"]).join(u, "ticker", "left")
    return rows.select(F.col("row_id").alias("id"), "ticker", F.coalesce("usector", F.lit("Unknown")).alias("sector"), "date", F.col("fwd_7d_up").alias("label"), F.col("fwd_7d").alias("fwd_return"), *R8)


@register("s19_latest_complete", f"with {COMPLETE} select id, ticker, sector, cast(date as varchar) as date, label, round(fwd_return, 7) as fwd_return from rows")
def latest(spark, folder):
    return complete_rows(spark, folder).select("id", "ticker", "sector", F.date_format("date", "yyyy-MM-dd").alias("date"), "label", F.round("fwd_return", 7).alias("fwd_return"))


@register(
    "p03_fold_split",
    f"""with {COMPLETE}, f as (select fold, train_end, val_start, val_end from folds)
select fold, count(*) filter (date <= train_end) as n_train, count(*) filter (date between val_start and val_end) as n_val, round(avg(label) filter (date <= train_end), 6) as base_rate, count(distinct ticker) filter (date <= train_end) as tickers from rows, f group by fold""",
)
def fold_split(spark, folder):
    # folds is a fixed table of six rows
    rows, out = complete_rows(spark, folder), []
    for f in table(spark, folder, "folds").orderBy("fold").collect():
        inside, val = F.col("date") <= F.lit(f.train_end), F.col("date").between(F.lit(f.val_start), F.lit(f.val_end))
        out.append(F.struct(F.lit(f.fold).alias("fold"), inside.alias("train"), val.alias("val")))
    each = rows.select("ticker", "label", F.explode(F.array(*out)).alias("f"))
    t = F.col("f.train")
    return each.groupBy("f.fold").agg(F.count_if(t).alias("n_train"), F.count_if("f.val").alias("n_val"), F.round(F.avg(F.when(t, F.col("label"))), 6).alias("base_rate"), F.count_distinct(F.when(t, F.col("ticker"))).alias("tickers"))


_RULES = {
    "close above 0": ("close > 0", "close > 0"), "label 0 or 1": ("fwd_7d_up in (0, 1)", "fwd_7d_up in (0, 1)"), "known": ("known_at is not null", "known_at is not null"),
    "finite returns": (" and ".join(f"({c} is not null and not isnan({c}))" for c in R8),) * 2, "known on its day or later": ("cast(known_at as date) >= date",) * 2,
}


@register("p15_contract_violations", " union all ".join(f"select '{n}' as rule, count(*) filter (not coalesce({s}, false)) as broken from full_db" for n, (_, s) in _RULES.items()))
def contract(spark, folder):
    return contracts.violations(table(spark, folder, "full_db"), {n: s for n, (s, _) in _RULES.items()})


@register(
    "p08_journal_filter",
    """select query_ticker, signal, count(*) as n, count(distinct (query_ticker, query_date)) as queries from journal where signal in ('BUY', 'SELL') and analogue_rank <= 3 and query_date between date '2020-01-01' and date '2022-12-31' and analogue_ticker = 'IDX00' group by 1, 2""",
)
def journal_filter(spark, folder):
    j = table(spark, folder, "journal").where("signal in ('BUY', 'SELL') and analogue_rank <= 3 and query_date between date'2020-01-01' and date'2022-12-31' and analogue_ticker = 'IDX00'")
    return j.groupBy("query_ticker", "signal").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.struct("query_ticker", "query_date")).alias("queries"))


@register("s10_history_depth", "with k as (select ticker from full_db where date is not null group by ticker having min(date) <= date '2019-12-31' and count(*) >= 100) select f.ticker, count(*) as n, cast(min(f.date) as varchar) as first_date from full_db f semi join k on k.ticker = f.ticker where f.date is not null group by 1")
def depth(spark, folder):
    f = table(spark, folder, "full_db").select("ticker", "date").where("date is not null")
    k = f.groupBy("ticker").agg(F.min("date").alias("a"), F.count(F.lit(1)).alias("n")).where("a <= date'2019-12-31' and n >= 100").select("ticker")
    return f.join(k, "ticker", "left_semi").groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.date_format(F.min("date"), "yyyy-MM-dd").alias("first_date"))


@register("s03_csv_round_trip", "select trade_id, ticker, cast(entry_date as varchar) as entry_date, round(net_pnl, 4) as net_pnl, exit_reason from trades")
def csv_round_trip(spark, folder):
    path = scratch(spark, "csv")
    t = table(spark, folder, "trades").select("trade_id", "ticker", "entry_date", "net_pnl", "exit_reason")
    # quotes keep blanks inside the cells
    t.write.option("header", True).option("sep", "\t").option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    back = files.read_csv(spark, path, "trade_id long, ticker string, entry_date date, net_pnl double, exit_reason string", sep="\t", comment="#")
    return back.select("trade_id", "ticker", F.date_format("entry_date", "yyyy-MM-dd").alias("entry_date"), F.round("net_pnl", 4).alias("net_pnl"), "exit_reason")


@register("s05_glob_file_column", "select cast(fold as varchar) as fold, count(*) as n, round(sum(analogue_rank), 0) as ranks from journal where fold is not null group by 1")
def glob_column(spark, folder):
    path = scratch(spark, "folds")
    j = table(spark, folder, "journal").where("fold is not null").select("fold", "analogue_rank")
    j.withColumn("part", F.col("fold")).write.partitionBy("part").parquet(path)
    got = files.read_glob(spark, f"{path}/part=*", "fold_name", r"part=(\d+)/")
    return got.groupBy(F.col("fold_name").alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.sum("analogue_rank").cast("double").alias("ranks"))


@register("s18_append_new", "select 'new' as side, count(*) as n from (select distinct upper(trim(ticker)) as t from signals where ticker is not null except select distinct upper(trim(ticker)) from trades where ticker is not null) union all select 'log', count(*) from (select distinct upper(trim(ticker)) as t from trades where ticker is not null)")
def append_new(spark, folder):
    norm = F.upper(F.trim("ticker")).alias("t")
    log = table(spark, folder, "trades").where("ticker is not null").select(norm).distinct()
    batch = table(spark, folder, "signals").where("ticker is not null").select(norm).distinct()
    new = files.append_new(log, batch, ["t"])
    return new.agg(F.count(F.lit(1)).alias("n")).select(F.lit("new").alias("side"), "n").unionByName(log.agg(F.count(F.lit(1)).alias("n")).select(F.lit("log").alias("side"), "n"))


@register("s23_state_round_trip", "select signal_id, ticker, round(confidence, 6) as confidence, n_matches from signals")
def state_round_trip(spark, folder):
    s = table(spark, folder, "signals").select("signal_id", "ticker", "confidence", "n_matches")
    back = files.from_state(files.to_state(s, 3), T.StructType([T.StructField(f.name, f.dataType) for f in s.schema.fields]), 3)
    return back.select("signal_id", "ticker", F.round("confidence", 6).alias("confidence"), "n_matches")


@register("s30_lineage", "select count(distinct ticker) as keys, count(*) as rows, substr(sha256(concat(count(distinct ticker), ':', count(*))), 1, 16) as fingerprint from full_db")
def lineage(spark, folder):
    return files.lineage(table(spark, folder, "full_db"), "ticker")


@register("s29_manifest")
def manifest(spark, folder):
    """Every fixed-size table file with its checksum."""
    return files.manifest(spark, f"{folder}/{{region,nation,folds,pack_sizes,mix_targets}}.parquet")


@register("v01_standardise", f"with {COMPLETE} " + " union all ".join(f"select '{c}' as feature, round(avg({c}), 7) as mean, round(stddev_pop({c}), 7) as scale, round(abs(covar_pop({c}, label)) / stddev_pop({c}), 7) as importance from rows" for c in R8))
def standardise(spark, folder):
    from chronoloom.operators.neighbours import standardise as fit

    rows = complete_rows(spark, folder)
    stats = fit(rows, R8)
    importance, _ = vectors.fit_compression(rows, R8, "label", 4)
    return spark.createDataFrame([(c, round(m, 7), round(s, 7), round(importance[c], 7)) for c, (m, s) in stats.items()], "feature string, mean double, scale double, importance double")


@register("v04_mutual_information")
def information(spark, folder):
    """Binned mutual information of each return with the label, and the rank weight that follows from it."""
    mi = vectors.mutual_information(complete_rows(spark, folder), R8, "label")
    ranked = [r.feature for r in mi.orderBy(F.desc("mi"), "feature").collect()]
    w = vectors.rank_weights(ranked, 4.0)
    weights = F.create_map(*[x for c in ranked for x in (F.lit(c), F.lit(w[c]))])
    return mi.select("feature", F.round("mi", 6).alias("mi"), F.round(F.element_at(weights, F.col("feature")), 6).alias("weight"))


@register("v08_compression")
def compression(spark, folder):
    """Rows projected onto four supervised directions: the variance of each."""
    rows = complete_rows(spark, folder)
    _, p = vectors.fit_compression(rows, R8, "label", 4)
    z = rows.select(vectors.project(R8, p).alias("z"))
    return z.select(F.posexplode("z").alias("axis", "v")).groupBy("axis").agg(F.round(F.var_pop("v"), 6).alias("variance"))


_WF = AnalogueConfig(top_k=20, max_distance=2.5, min_matches=5)


def _wf_sql():
    scaled = ", ".join(f"(x.{c} - st.m_{c}) / st.s_{c}" for c in R8)
    stats = ", ".join(f"avg({c}) as m_{c}, case when stddev_pop({c}) = 0 then 1 else stddev_pop({c}) end as s_{c}" for c in R8)
    return f"""with {COMPLETE}, {SERIES}, f as (select * from folds),
st as (select f.fold, {stats}, avg(rows.label) as base from f join rows on rows.date <= f.train_end group by f.fold),
t as (select f.fold, x.id, x.ticker, x.label, [{scaled}] as z from f join rows x on x.date <= f.train_end join st on st.fold = f.fold),
q as (select f.fold, x.id, x.ticker, x.date, x.label, [{scaled}] as z from f join rows x on x.date between f.val_start and f.val_end join st on st.fold = f.fold),
d as (select q.fold, q.id as qid, t.id as tid, q.ticker as qt, t.ticker as tt, t.label, list_distance(q.z, t.z) as dist from q join t on q.fold = t.fold),
p as (select *, row_number() over (partition by fold, qid order by dist, tid) as r from d),
k as (select *, row_number() over (partition by fold, qid order by dist, tid) as r2 from p where r <= 60 and dist <= 2.5 and qt <> tt),
w as (select fold, qid, avg(label) as prob, count(*) as n from k where r2 <= 20 group by 1, 2),
b as (select q.*, s.date as bd, s.v as bv from q asof left join series s on q.date >= s.date),
n as (select b.*, s.date as nd, s.v as nv from b asof left join series s on b.date <= s.date),
o as (select n.fold, n.label as y, coalesce(w.prob, 0.5) as prob, coalesce(w.n, 0) as n, coalesce(case when nd is null then bv when bd is null or nd - n.date <= n.date - bd then nv else bv end < 0.05, false) as bear from n left join w on w.fold = n.fold and w.qid = n.id),
b10 as (select fold, greatest(1, least(10, ceil(prob * 10))) as bin, count(*) as n, avg(prob) as mp, avg(y) as my from o where not bear group by 1, 2),
bt as (select fold, sum(n) as total, sum(n * my) / sum(n) as base from b10 group by 1),
mu as (select b10.fold, sum(n / total * power(mp - my, 2)) as reliability, sum(n / total * power(my - base, 2)) as resolution from b10 join bt using (fold) group by 1),
sg as (select *, case when bear or n < 5 or abs(prob - 0.5) * 2 < 0.05 then 'HOLD' when prob >= 0.55 then 'BUY' when prob <= cast(1 as double) - cast(0.55 as double) then 'SELL' else 'HOLD' end as sig from o)
select fold, count(*) as n_total, count(*) filter (not bear) as n_scored, round(avg(y) filter (not bear), 9) as base_rate, round(avg(prob) filter (not bear), 9) as mean_prob,
round(avg(power(prob - y, 2)) filter (not bear), 9) as brier, round(avg(n) filter (not bear), 9) as avg_k, count(*) filter (sig = 'BUY') as n_buy, count(*) filter (sig = 'SELL') as n_sell, count(*) filter (sig = 'HOLD') as n_hold,
round(max(mu.reliability), 9) as reliability, round(max(mu.resolution), 9) as resolution from sg left join mu using (fold) group by fold"""


@register("e14_walk_forward", _wf_sql())
def walk_forward(spark, folder):
    folds = [r.asDict() for r in table(spark, folder, "folds").orderBy("fold").collect()]
    out = wf.run(complete_rows(spark, folder), folds, R8, _WF, benchmark(spark, folder))
    return out.select("fold", "n_total", "n_scored", "n_buy", "n_sell", "n_hold", *[F.round(c, 9).alias(c) for c in ("base_rate", "mean_prob", "brier", "avg_k", "reliability", "resolution")])


@register(
    "x20_scalar_functions",
    """select signal_id, upper(trim(ticker)) as ticker, length(trim(ticker)) between 1 and 10 as valid_length, isodow(date) - 1 as weekday, round(ln(1 + raw_prob), 6) as ln1p, round(1 / (1 + exp(-(raw_prob - 0.5) * 4)), 6) as sigmoid,
cast(sign(raw_prob - 0.5) as double) as side, greatest(least(mean_7d_return, 0.02), -0.02) as clipped, replace('fwd_7d_up', '_up', '') as horizon, cast(cast(signal_ts as date) as varchar) as day,
cast(case when isodow(date) >= 6 then date + cast(8 - isodow(date) as integer) else date end as varchar) as business_day, printf('prob=%.2f', round(raw_prob, 2)) as reason from signals where raw_prob is not null and mean_7d_return is not null and date is not null""",
)
def scalars(spark, folder):
    s = table(spark, folder, "signals").where("raw_prob is not null and mean_7d_return is not null and date is not null")
    p, d = F.col("raw_prob"), F.col("date")
    return s.select(
        "signal_id", F.upper(F.trim("ticker")).alias("ticker"), F.length(F.trim("ticker")).between(1, 10).alias("valid_length"), F.weekday(d).alias("weekday"), F.round(F.log1p(p), 6).alias("ln1p"),
        F.round(1 / (1 + F.exp(-(p - 0.5) * 4)), 6).alias("sigmoid"), F.signum(p - 0.5).alias("side"), F.greatest(F.least("mean_7d_return", F.lit(0.02)), F.lit(-0.02)).alias("clipped"),
        F.regexp_replace(F.lit("fwd_7d_up"), "_up$", "").alias("horizon"), F.date_format(F.to_date("signal_ts"), "yyyy-MM-dd").alias("day"),
        F.date_format(F.when(F.weekday(d) >= 5, F.date_add(d, 7 - F.weekday(d))).otherwise(d), "yyyy-MM-dd").alias("business_day"), F.format_string("prob=%.2f", F.round(p, 2)).alias("reason"),
    )
