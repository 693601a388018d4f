"""Fitted models, approximate search, logs, further features and scalar functions."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from chronoloom.operators import calibrate as cal
from chronoloom.operators import features as f
from chronoloom.operators import neighbours as nb
from chronoloom.operators import vectors
from chronoloom.operators import vote as vt
from chronoloom.plans import analogue, model
from chronoloom.queries import register
from chronoloom.queries.analogues import _SIGNAL, CONFIG, VECTORS, sides
from chronoloom.queries.evaluation import SCORED, fold_results, scored
from chronoloom.queries.features import _ATR_SQL, _OVER, BARS_N, BARS_S
from chronoloom.queries.pipeline import COMPLETE, R8, complete_rows
from chronoloom.queries.studies import ensembles
from chronoloom.session import scratch, staged
from chronoloom.sources import files
from chronoloom.sources.tables import bars_nation, bars_segment, table
from chronoloom.streaming import twins


_TRAIN, _ASKED = "id % 10 <> 0", "id % 10 = 0"  # rows held out by their id, as a query set
_MODEL = analogue.AnalogueConfig(top_k=20, max_distance=2.5, min_matches=5)


def _sides(spark, folder):
    rows = staged(complete_rows(spark, folder).withColumn("regime", F.lit(1)), "rows")  # read several times
    return rows.where(_TRAIN), rows.where(_ASKED)


@register("j02_cell_recall", f"with {COMPLETE} select count(*) as queries, true as enough from rows where {_ASKED}")
def cell_recall(spark, folder):
    """Recall at ten of the search in cells against the exact one; it has to reach 0.9."""
    train, asked = _sides(spark, folder)
    fitted = model.fit(train, R8, _MODEL)
    t, q = fitted.train.select("tid", "vec"), fitted.scaled(asked, "qid").select("qid", "vec")
    return nb.recall(nb.knn_join(q, t, 10), nb.cell_search(q, t, 10), 10).select("queries", (F.col("recall") >= 0.9).alias("enough"))


@register("j03_approximate_signals", f"with {COMPLETE} select count(*) as queries, true as alike from rows where {_ASKED}")
def approximate_signals(spark, folder):
    """The analogue query over approximate neighbours: at least nine of ten probabilities lie within 0.1 of the exact ones."""
    train, asked = _sides(spark, folder)
    fitted = model.fit(train, R8, _MODEL)
    exact = fitted.predict(asked).select("qid", F.col("prob").alias("p"))
    near = replace(fitted, config=replace(_MODEL, cells=16, cell_probes=8)).predict(asked).join(exact, "qid")
    return near.agg(F.count(F.lit(1)).alias("queries"), F.coalesce(F.avg((F.abs(F.col("prob") - F.col("p")) <= 0.1).cast("double")) >= 0.9, F.lit(True)).alias("alike"))


@register("g08_model_round_trip", f"with {COMPLETE} select count(*) as queries, true as same, true as calibrated from rows where {_ASKED}")
def model_round_trip(spark, folder):
    """A model fitted with a calibrator in a second pass, saved and loaded: it answers alike, and within [0, 1]."""
    train, asked = _sides(spark, folder)
    fitted = model.fit(train, R8, _MODEL, "beta")
    path = scratch(spark, "model")
    fitted.save(path)
    a = fitted.predict(asked).select("qid", "prob", "signal")
    b = model.load(spark, path).predict(asked).select("qid", F.col("prob").alias("p2"), F.col("signal").alias("s2"))
    same, inside = (F.col("prob") == F.col("p2")) & (F.col("signal") == F.col("s2")), F.col("prob").between(0, 1)
    return a.hint("merge").join(b, "qid").agg(F.count(F.lit(1)).alias("queries"), F.coalesce(F.every(same), F.lit(True)).alias("same"), F.coalesce(F.every(inside), F.lit(True)).alias("calibrated"))


@register("v10_compressed_skill", f"with {COMPLETE}, n as (select count(*) as n from rows where {_ASKED}) select s as space, n, true as known from n, (select unnest(['plain', 'compressed']) as s)")
def compressed_skill(spark, folder):
    """Skill of the analogue query with the plain features and with four supervised directions."""
    train, asked = _sides(spark, folder)
    importance, matrix = vectors.fit_compression(train, R8, "label", 4)
    assert vectors.top_features(importance, 3)[0] == max(importance, key=importance.get)
    out = model.compare(train, asked, R8, analogue.AnalogueConfig(top_k=20, max_distance=50.0), matrix)
    return out.select("space", "n", F.coalesce(F.col("bss") <= 1, F.lit(True)).alias("known"))


@register("g09_calibrator_checks", "select unnest(['beta not falling', 'isotonic rising', 'platt gradient 0']) as what, true as holds")
def calibrator_checks(spark, folder):
    """What defines each calibrator, on the journal: a zero gradient, coefficients that do not fall, a rising curve with the mean of the labels."""
    s = scored(spark, folder).where("raw_prob is not null")
    a, b = cal.fit_platt(s)
    gap = cal.platt(F.col("raw_prob"), a, b) - F.col("y")
    g = s.agg(F.sum(gap).alias("base"), (F.sum(gap * F.col("raw_prob")) + a).alias("slope"), F.count(F.lit(1)).alias("n")).first()
    be = cal.fit_beta(s)
    knots, values = cal.fit_isotonic(s)
    mean = s.agg(F.avg(cal.isotonic(F.col("raw_prob"), knots, values) - F.col("y"))).first()[0]
    rising = all(x < y for x, y in zip(knots, knots[1:])) and all(x <= y for x, y in zip(values, values[1:])) and abs(mean) < 1e-9
    rows = [("beta not falling", be[0] >= 0 and be[1] >= 0), ("isotonic rising", rising), ("platt gradient 0", max(abs(g.base), abs(g.slope)) < 1e-6 * g.n)]
    return spark.createDataFrame(rows, "what string, holds boolean")


_WEIGHTS, _SPREADS = [0.05] * 20, [0.01 * (i + 1) for i in range(20)]


@register(
    "g15_mixture_density",
    f"""with {VECTORS}, q as (select id as qid, fwd as y from v where id % 5 = 0), i as (select unnest(range(1, 21)) as i),
m as (select q.qid, q.y, i.i, coalesce(k.fwd_return, 0) as m from q, i left join kept k on k.qid = q.qid and k.rank = i.i)
select qid, round(sum(0.05 * (gamma(2.0) / (gamma(1.5) * sqrt(3 * pi()))) / sqrt(0.01 * i) * power(1 + power(y - m, 2) / (3 * 0.01 * i), -2)), 6) as density from m group by qid""",
)
def mixture_density(spark, folder):
    """Density of each query's return under the mixture around its neighbours' returns."""
    e = ensembles(spark, folder)
    return e.select("qid", F.round(cal.mixture_density(F.col("x"), _WEIGHTS, _SPREADS, F.col("y")), 6).alias("density"))


@register(
    "r15_leaderboard",
    f"""with {VECTORS}, w as (select qid, avg(label) as raw_prob, count(*) as n_matches from kept group by qid), s as (select *, {_SIGNAL} as signal from w),
b as (select *, row_number() over (partition by signal order by abs(raw_prob - 0.5) desc, qid) as place from s where signal in ('BUY', 'SELL'))
select b.signal, cast(b.place as integer) as place, b.qid, round(b.raw_prob, 6) as raw_prob, string_agg(cast(k.tid as varchar), ' ' order by k.rank) as analogues, round(avg(k.distance), 6) as avg_distance from b join kept k on k.qid = b.qid and k.rank <= 5 where b.place <= 10 group by 1, 2, 3, 4""",
)
def leaderboard(spark, folder):
    train, query = sides(spark, folder)
    near = analogue.matched(analogue.probe(train, query, CONFIG), CONFIG)
    signals = analogue.query(train, query, CONFIG).select("qid", "raw_prob", "signal")
    out = vt.leaderboard(signals, near, 10)
    return out.select("signal", "place", "qid", F.round("raw_prob", 6).alias("raw_prob"), F.concat_ws(" ", F.transform("analogues", lambda x: x.cast("string"))).alias("analogues"), F.round("avg_distance", 6).alias("avg_distance"))


@register(
    "s17_text_log",
    """with l as (select row_number() over (order by fold, max_distance, avgk, bss, n_scored, n_total, n_buy, n_sell, n_hold, runtime_s) as i, * from sweep_max_distance_23d_standardized)
select '# kind: sweep' as line union all select 'max_distance' || chr(9) || 'fold' || chr(9) || 'bss' || chr(9) || 'n_total'
union all select coalesce(printf('%+.6f', max_distance), '') || chr(9) || coalesce(cast(fold as varchar), '') || chr(9) || coalesce(printf('%+.6f', bss), '') || chr(9) || coalesce(cast(n_total as varchar), '') from l""",
)
def text_log(spark, folder):
    """The sweep as lines of a log: comments, a header, signed numbers, empty cells for null."""
    s = table(spark, folder, "sweep_max_distance_23d_standardized").select("max_distance", "fold", "bss", "n_total")
    return files.text_lines(s, {"kind": "sweep"})


@register("s20_append_log", "select 'first' as batch, count(*) as n from (select distinct upper(trim(ticker)) as t from trades where ticker is not null) union all select 'second', count(*) from (select distinct upper(trim(ticker)) as t from signals where ticker is not null except select distinct upper(trim(ticker)) from trades where ticker is not null) union all select 'again', 0 union all select 'log', count(*) from (select upper(trim(ticker)) as t from signals where ticker is not null union select upper(trim(ticker)) from trades where ticker is not null)")
def append_log(spark, folder):
    """A log that takes each key once: two batches, the second again, and what it holds."""
    path = scratch(spark, "log")
    first, second = (table(spark, folder, n).where("ticker is not null").select(F.upper(F.trim("ticker")).alias("t")) for n in ("trades", "signals"))
    rows = [("first", files.append_log(spark, path, first, ["t"])), ("second", files.append_log(spark, path, second, ["t"])), ("again", files.append_log(spark, path, second, ["t"]))]
    return spark.createDataFrame([*rows, ("log", spark.read.parquet(path).count())], "batch string, n long")


@register(
    "s33_run_manifests",
    "with r as (select row_number() over (order by runtime_s, fold, max_distance, bss) as id, * from sweep_max_distance_23d_standardized where fold is not null and bss is not null and runtime_s is not null), b as (select runtime_s, max_distance, fold, bss, row_number() over w as k, max(bss) over (order by runtime_s, max_distance, fold, bss rows between unbounded preceding and 1 preceding) as before from r window w as (order by runtime_s, max_distance, fold, bss)) select round(runtime_s, 6) as finished_at, round(bss, 8) as score, round(before, 8) as best_before from b order by k desc limit 5",
)
def run_manifests(spark, folder):
    """The five last runs of the sweep and the best score before each."""
    s = table(spark, folder, "sweep_max_distance_23d_standardized").where("fold is not null and bss is not null and runtime_s is not null")
    runs = s.select(F.struct("max_distance", "fold", "bss").alias("run_id"), F.col("runtime_s").alias("finished_at"), F.col("bss").alias("score"))
    return files.run_manifests(runs, 5).select(F.round("finished_at", 6).alias("finished_at"), F.round("score", 8).alias("score"), F.round("best_before", 8).alias("best_before"))


@register("s34_saved_results", f"with {SCORED} select 'folds' as name, count(distinct (max_distance, fold)) as n from sweep_max_distance_23d_standardized where fold is not null and bss is not null union all select 'scores', count(*) from s union all select 'trades', count(*) from trades")
def saved_results(spark, folder):
    """Several result tables written beside each other; what came back of each."""
    path = scratch(spark, "results")
    n = files.save_results({"folds": fold_results(spark, folder), "scores": scored(spark, folder).select("fold", "p", "y"), "trades": table(spark, folder, "trades")}, path)
    return spark.createDataFrame(sorted(n.items()), "name string, n long")


@register(
    "f29_feature_table",
    f"""with {BARS_N}, r as (select ticker, date, close / lag(close, 7) {_OVER} - 1 as ret_7d, lead(close, 7) {_OVER} / close - 1 as fwd_7d, row_number() {_OVER} as k, count(*) over (partition by ticker) as n from bars)
select ticker, count(*) as n, cast(min(date) as varchar) as first_date, round(sum(ret_7d), 5) as ret_7d, round(avg(cast(fwd_7d > 0 as double)), 6) as up_share from r where k >= 92 and k <= n - 7 group by ticker""",
)
def whole_feature_table(spark, folder):
    """One plan from bars to complete feature rows: rows per ticker, the first of them, and two columns summed."""
    t = f.feature_table(bars_nation(spark, folder))
    return t.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.date_format(F.min("date"), "yyyy-MM-dd").alias("first_date"), F.round(F.sum("ret_7d"), 5).alias("ret_7d"), F.round(F.avg("fwd_7d_up"), 6).alias("up_share"))


@register(
    "f26_wilder_first_value",
    f"""with recursive {BARS_S}, t as (select *, row_number() {_OVER} as rn, greatest(high - low, abs(high - lag(close) {_OVER}), abs(low - lag(close) {_OVER})) as tr from bars),
a as (select ticker, rn, tr as a from t where rn = 1 union all select t.ticker, t.rn, a.a + (t.tr - a.a) / 14 from a join t on t.ticker = a.ticker and t.rn = a.rn + 1)
select t.ticker, t.date, round(case when t.rn >= 14 then a.a / t.close end, 6) as atr_pct from t join a on a.ticker = t.ticker and a.rn = t.rn""",
)
def wilder_first(spark, folder):
    return f.wilder(bars_segment(spark, folder), seed="first").select("ticker", "date", F.round("atr_pct", 6).alias("atr_pct"))


@register("f27_atr_share", f"with z as ({_ATR_SQL.replace('with recursive', 'with recursive', 1)}) select ticker, date, atr_pct, atr_14 is not null and atr_14 > 0 as valid from z")
def atr_share(spark, folder):
    return f.atr_share(bars_segment(spark, folder)).select("ticker", "date", F.round("atr_pct", 6).alias("atr_pct"), "valid")


@register(
    "w10_excess_sharpe",
    f"""with {BARS_N}, r as (select ticker, close / lag(close) {_OVER} - 1 as r from bars) select ticker, round(case when stddev_samp(r) >= 1e-10 then (avg(r) - 0.045 / 252) / stddev_samp(r) * sqrt(252) end, 5) as sharpe, round(round_even(sum(r), 3), 3) as total from r where r is not null group by 1""",
)
def excess_sharpe(spark, folder):
    """Yearly Sharpe ratio over a risk-free rate, NULL without spread; the total is rounded half to even."""
    from pyspark.sql import Window

    r = bars_nation(spark, folder).withColumn("r", F.try_divide(F.col("close"), F.lag("close").over(Window.partitionBy("ticker").orderBy("date"))) - 1).where("r is not null")
    sharpe = F.when(F.stddev_samp("r") >= 1e-10, (F.avg("r") - 0.045 / 252) / F.stddev_samp("r") * 252**0.5)
    return r.groupBy("ticker").agg(F.round(sharpe, 5).alias("sharpe"), F.bround(F.sum("r"), 3).alias("total"))


@register("x24_half_even", "select signal_id, cast(case when (n_matches // 2) % 2 = 0 or n_matches % 2 = 0 then n_matches // 2 else n_matches // 2 + 1 end as bigint) as even, cast((n_matches + 1) // 2 as bigint) as up from signals where n_matches is not null and n_matches >= 0")
def half_even(spark, folder):
    """Halves rounded to even and away from 0."""
    half = F.col("n_matches").cast("decimal(12,1)") / 2
    s = table(spark, folder, "signals").where("n_matches is not null and n_matches >= 0")
    return s.select("signal_id", F.bround(half, 0).cast("long").alias("even"), F.round(half, 0).cast("long").alias("up"))


@register(
    "x21_market_day",
    """with s as (select signal_id, signal_ts as t from signals where signal_ts is not null), y as (select *, extract(year from t) as yr from s),
d as (select signal_id, t, make_date(yr, 3, 1) as m, make_date(yr, 11, 1) as n from y),
e as (select signal_id, t, m + cast((7 - isodow(m)) % 7 + 7 as integer) as a, n + cast((7 - isodow(n)) % 7 as integer) as b from d)
select signal_id, cast(cast(t - case when t >= a + interval 7 hour and t < b + interval 6 hour then interval 4 hour else interval 5 hour end as date) as varchar) as day from e""",
)
def market_day(spark, folder):
    """The calendar day in New York of a moment in UTC, as a date without zone."""
    s = table(spark, folder, "signals").where("signal_ts is not null")
    return s.select("signal_id", F.date_format(F.from_utc_timestamp(F.col("signal_ts").cast("timestamp"), "America/New_York"), "yyyy-MM-dd").alias("day"))


@register("p06_asymmetric_universe", f"with {COMPLETE} select count(*) filter (date <= date '2021-12-31') as n_train, count(*) filter (date > date '2021-12-31' and ticker < 'M') as n_query, count(distinct ticker) filter (date > date '2021-12-31' and ticker < 'M') as tickers from rows")
def asymmetric(spark, folder):
    """Train on all tickers, ask about some."""
    rows = complete_rows(spark, folder)
    train, asked = rows.where("date <= date'2021-12-31'"), rows.where("date > date'2021-12-31' and ticker < 'M'")
    return train.agg(F.count(F.lit(1)).alias("n_train")).join(asked.agg(F.count(F.lit(1)).alias("n_query"), F.count_distinct("ticker").alias("tickers")))


@register(
    "st5_stream_buckets",
    """with e as (select least(greatest(value / 100, 0), 1) as p, case when event_type = 'purchase' then 1.0 else 0.0 end as y from events where value is not null)
select cast(least(floor(p * 5), 4) as integer) as bin, count(*) as n, round(avg(p), 6) as mean_prob, cast(sum(y) as double) as hits, round((cast(least(floor(p * 5), 4) as integer) + 0.5) / 5 - avg(y), 6) as drift from e group by 1""",
)
def stream_buckets(spark, folder):
    e = twins.stream(spark, f"{folder}/events.parquet")
    e = e.select(F.least(F.greatest(F.col("value") / 100, F.lit(0.0)), F.lit(1.0)).alias("p"), F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0).alias("y"))
    out = twins.drain(twins.calibration_buckets(e.where("p is not null")), "complete")
    return out.select("bin", "n", F.round("mean_prob", 6).alias("mean_prob"), "hits", F.round("drift", 6).alias("drift"))


@register("st6_stream_atr", f"with z as ({_ATR_SQL}) select ticker, cast(max(date) as varchar) as date, count(*) as seen, round(arg_max(atr_14, date), 3) as atr from z group by ticker having count(*) >= 14")
def stream_atr(spark, folder):
    """ATR kept as streaming state; equal to the batch recursion."""
    path = scratch(spark, "bars")
    bars_segment(spark, folder).write.parquet(f"{path}/bars")
    stream = spark.readStream.schema(spark.read.parquet(f"{path}/bars").schema).parquet(f"{path}/bars")
    out = twins.drain(twins.incremental_atr(stream), "update")
    return out.where("atr is not null").select("ticker", F.date_format("date", "yyyy-MM-dd").alias("date"), "seen", F.round("atr", 3).alias("atr"))


@register(
    "ts4_drift_report",
    """with recursive b as (select avg(value) as m, stddev_pop(value) as s from events), l as (select (value - m) / s as z, ts, event_id from events, b where value is not null),
x as (select 'mean' as moment, z as v, row_number() over (order by ts, event_id) as i from l union all select 'variance', (z * z - 1) / sqrt(2), row_number() over (order by ts, event_id) from l),
c as (select moment, cast(0 as bigint) as i, cast(0 as double) as up, cast(0 as double) as down, 0 as alerts from (select distinct moment from x)
union all select x.moment, x.i, greatest(0, c.up + x.v - 0.5), greatest(0, c.down - x.v - 0.5), c.alerts + cast(greatest(0, c.up + x.v - 0.5) > 5 or greatest(0, c.down - x.v - 0.5) > 5 as integer) from c join x on x.moment = c.moment and x.i = c.i + 1)
select 'value' as feature, moment, max(i) as n, round(arg_max(up, i), 4) as up, round(arg_max(down, i), 4) as down, arg_max(alerts, i) as alerts, arg_max(alerts, i) > 0 as drifted from c group by moment""",
)
def drift(spark, folder):
    """Drift of a feature's mean and variance against its baseline."""
    from chronoloom.operators.ordered import drift_report

    e = table(spark, folder, "events").select("ts", "event_id", "value")
    b = e.agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s")).first()
    out = drift_report(e, ["value"], ["ts", "event_id"], {"value": (b.m or 0.0, b.s or 1.0)})
    return out.select("feature", "moment", "n", F.round("up", 4).alias("up"), F.round("down", 4).alias("down"), "alerts", "drifted")


def _simulated_sql():
    scaled = ", ".join(f"(x.{c} - st.m_{c}) / st.s_{c}" for c in R8)
    stats = ", ".join(f"avg({c}) as m_{c}, case when stddev_pop({c}) = 0 then 1 else stddev_pop({c}) end as s_{c}" for c in R8)
    return f"""with {COMPLETE}, st as (select {stats} from rows where {_TRAIN}),
z as (select x.*, [{scaled}] as z from rows x, st), d as (select q.id as qid, t.id as tid, q.ticker as qt, t.ticker as tt, t.label, t.fwd_return, list_distance(q.z, t.z) as dist from z q join z t on q.id % 10 = 0 and t.id % 10 <> 0),
p as (select *, row_number() over (partition by qid order by dist, tid) as r from d), k as (select *, row_number() over (partition by qid order by dist, tid) as r2 from p where r <= 60 and dist <= 2.5 and qt <> tt),
w as (select qid, avg(label) as raw_prob, avg(fwd_return) as mean_return, count(*) as n_matches from k where r2 <= 20 group by 1),
o as (select rows.id, rows.date, rows.ticker, rows.sector, coalesce(raw_prob, 0.5) as raw_prob, coalesce(mean_return, 0) as mean_return, coalesce(n_matches, 0) as n_matches from rows left join w on w.qid = rows.id where rows.id % 10 = 0)
select id, cast(date as varchar) as date, ticker, sector, case when n_matches < 5 or abs(raw_prob - 0.5) * 2 < 0.05 then 'HOLD' when raw_prob >= 0.55 then 'BUY' when raw_prob <= cast(1 as double) - cast(0.55 as double) then 'SELL' else 'HOLD' end as signal,
round(raw_prob, 6) as confidence, 'KNN' as signal_source, n_matches, round(mean_return, 6) as mean_7d_return from o"""


@register("g36_simulated_signals", _simulated_sql())
def simulated(spark, folder):
    """Fit, ask and put the answers into the form of the signals table."""
    train, asked = _sides(spark, folder)
    out = model.fit(train, R8, _MODEL).predict(asked).join(asked.select(F.col("id").alias("qid"), "date", "ticker", "sector"), "qid")
    return out.select(
        F.col("qid").alias("id"), F.date_format("date", "yyyy-MM-dd").alias("date"), "ticker", "sector", "signal", F.round("prob", 6).alias("confidence"), F.lit("KNN").alias("signal_source"), "n_matches", F.round("mean_return", 6).alias("mean_7d_return")
    )


@register("s12_saved_signals", "select signal_id, upper(trim(ticker)) as ticker, cast(date as varchar) as date, round(confidence, 6) as confidence, n_matches, cast(null as varchar) as note from signals where ticker is not null")
def saved_signals(spark, folder):
    """Signals saved as text and loaded again with a check of the columns they must have; a column the file lacks is NULL."""
    path = scratch(spark, "signals")
    s = table(spark, folder, "signals").where("ticker is not null").select("signal_id", F.upper(F.trim("ticker")).alias("ticker"), "date", "confidence", "n_matches")
    files.write_csv(s, path, "\t")
    back = files.read_required(spark, path, "signal_id long, ticker string, date date, confidence double, n_matches int, note string", ["signal_id", "ticker", "date", "confidence"], "\t")
    return back.select("signal_id", "ticker", F.date_format("date", "yyyy-MM-dd").alias("date"), F.round("confidence", 6).alias("confidence"), "n_matches", "note")


@register("s13_atomic_write", "select 'second' as version, count(*) as n, count(distinct ticker) as tickers from trades")
def atomic_write(spark, folder):
    """A table replaced as a whole beside its readers, found under the first of several paths that exists."""
    path = scratch(spark, "atomic")
    t = table(spark, folder, "trades").select("ticker")
    for version, rows in (("first", t.limit(0)), ("second", t)):
        files.write_atomic(rows.withColumn("version", F.lit(version)), path)
    back = spark.read.parquet(files.first_existing(spark, [f"{path}-none", path]))
    return back.groupBy("version").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ticker").alias("tickers"))


@register(
    "e10_report",
    f"""with {SCORED}, x as (select * from s where signal is not null), b as (select fold, greatest(1, least(10, ceil(p * 10))) as bin, count(*) as n, avg(p) as mp, avg(y) as my from x group by 1, 2),
t as (select fold, sum(n) as total, sum(n * my) / sum(n) as base from b group by 1), d as (select fold, sum(n / total * power(mp - my, 2)) as reliability, sum(n / total * power(my - base, 2)) as resolution from b join t using (fold) group by 1)
select fold, count(*) as n, round(avg(power(p - y, 2)), 6) as brier, round(1 - avg(power(p - y, 2)) / (avg(y) * (1 - avg(y))), 6) as bss, round(avg(p), 6) as mean_prob, round(stddev_pop(p), 6) as deviation, round(max(d.reliability), 6) as reliability, round(max(d.resolution), 6) as resolution,
round(avg(cast((p > 0.5) = (y = 1) as double)), 6) as accuracy, round(coalesce(count(*) filter (signal = 'BUY' and y = 1) / nullif(count(*) filter (signal = 'BUY'), 0), 0), 6) as "precision" from x join d using (fold) group by fold""",
)
def whole_report(spark, folder):
    from chronoloom.operators.metrics import report

    out = report(scored(spark, folder).where("signal is not null"), ["fold"])
    return out.select("fold", "n", *[F.round(c, 6).alias(c) for c in ("brier", "bss", "mean_prob", "deviation", "reliability", "resolution", "accuracy", "precision")])


@register("e16_isolated_folds", f"with {COMPLETE} select f.fold, 'ok' as status, count(*) as n_total from folds f join rows on rows.date between f.val_start and f.val_end where exists (select 1 from rows x where x.date <= f.train_end) group by f.fold union all select 99, 'failed: ValueError', null union all select 100, 'late', null")
def isolated_folds(spark, folder):
    """Folds that run one after another: a broken one is reported, the others go on, and what begins too late is left."""
    from chronoloom.plans import walkforward as wf

    folds = [r.asDict() for r in table(spark, folder, "folds").orderBy("fold").collect()]
    rows = complete_rows(spark, folder)
    broken = {**folds[0], "fold": 99, "train_end": folds[0]["val_end"]}
    got = wf.run_each(rows, [broken, *folds], R8, _MODEL) + wf.run_each(rows, [{**folds[0], "fold": 100}], R8, _MODEL, deadline=-1)
    kept = [(g["fold"], g["status"], g.get("n_total")) for g in got if g["status"] != "ok" or g.get("n_total")]
    return spark.createDataFrame(kept, "fold int, status string, n_total long")


@register(
    "s14_four_way_build",
    f"""with {BARS_N}, k as (select ticker, date, row_number() {_OVER} as k, count(*) over (partition by ticker) as n from bars), t as (select * from k where k >= 92 and k <= n - 7),
s as (select *, ntile(10) over (partition by ticker order by date) as part from t)
select 'all' as name, count(*) as n from s union all select 'test', count(*) from s where part = 10 union all select 'train', count(*) from s where part <= 8 union all select 'val', count(*) from s where part = 9""",
)
def four_way_build(spark, folder):
    """Bars to features to four tables, written side by side: the first eight tenths of each ticker, the ninth, the last, and all."""
    from pyspark.sql import Window

    t = f.feature_table(bars_nation(spark, folder)).withColumn("part", F.ntile(10).over(Window.partitionBy("ticker").orderBy("date")))
    n = files.save_results({"all": t, "train": t.where("part <= 8"), "val": t.where("part = 9"), "test": t.where("part = 10")}, scratch(spark, "build"))
    return spark.createDataFrame(sorted(n.items()), "name string, n long")


@register(
    "s15_journal_round_trip",
    f"""with {VECTORS}, w as (select qid, avg(label) as raw_prob, count(*) as n_matches from kept group by qid), s as (select *, {_SIGNAL} as signal from w)
select s.qid, s.signal, k.tid, cast(k.rank as integer) as analogue_rank, round(k.distance, 5) as distance, k.label from s join kept k using (qid) where s.signal in ('BUY', 'SELL') and k.rank <= 5""",
)
def journal_round_trip(spark, folder):
    """The signal journal written as text and read again with its declared types."""
    train, query = sides(spark, folder)
    probed = analogue.probe(train, query, CONFIG)
    out = vt.journal(analogue.query(train, query, CONFIG, probed).select("qid", "signal"), analogue.matched(probed, CONFIG), 5)
    path = scratch(spark, "journal")
    files.write_csv(out.select("qid", "signal", "tid", "analogue_rank", "distance", "label"), path, "\t")
    back = files.read_csv(spark, path, "qid long, signal string, tid long, analogue_rank int, distance double, label double", "\t")
    return back.withColumn("distance", F.round("distance", 5))
