"""Queries on numeric columns: percentiles (1), top items (4) and similar vectors (5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoloom.llm import digest, similar, topn
from chronoloom.llm.queries import register
from chronoloom.operators import neighbours
from chronoloom.sources.tables import table

PROBS = [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]


@register("p1_distance_percentiles")
def p1_distance_percentiles(spark, folder):
    """Percentiles of usable distances per fold; digests are built per fold and query date and merged."""
    folds = table(spark, folder, "sweep_max_distance_23d_standardized").select("fold").where("fold is not null").distinct()
    rows = table(spark, folder, "journal").select("fold", "query_date", "analogue_distance").join(folds, "fold", "left_semi")
    out = digest.percentiles(rows, ["fold"], "analogue_distance", PROBS, max_rank_error=0.005, within=["query_date"])
    return out.select("fold", "prob", "estimate", F.col("n").cast("long").alias("n"), "n_below", "n_upto", "rank_error", F.lit(0.005).alias("error_bound"))


_USABLE = "analogue_distance is not null and not isnan(analogue_distance) and not isinf(analogue_distance) and analogue_distance >= 0"


@register(
    "p1_check",
    f"""select fold, count(*) filter ({_USABLE}) as n, cast({len(PROBS)} as bigint) as certified, true as ordered from journal
where fold in (select fold from sweep_max_distance_23d_standardized where fold is not null) group by fold having count(*) filter ({_USABLE}) > 0""",
)
def p1_check(spark, folder):
    """Per fold: the number of usable distances, how many percentiles are certified within the bound, and whether they rise with their probability."""
    p = p1_distance_percentiles(spark, folder)
    rising = F.array_sort(F.collect_list(F.struct("prob", "estimate")))
    listed = p.groupBy("fold").agg(F.max("n").alias("n"), F.count_if((F.col("rank_error") <= F.col("error_bound")) & (F.col("n_below") <= F.col("n_upto"))).alias("certified"), rising.alias("e"))
    return listed.select("fold", "n", "certified", (F.transform("e", lambda x: x["estimate"]) == F.array_sort(F.transform("e", lambda x: x["estimate"]))).alias("ordered"))


@register(
    "p4_found",
    """
with latest as (select *, row_number() over (partition by date, ticker order by loaded_at desc nulls last, ranked_id desc) as k
                from ranked_signals where date is not null),
r as (select date, ranked_id, row_number() over (partition by date order by confidence desc, ticker) as rank
      from latest where k = 1 and confidence is not null and not isnan(confidence))
select cast(date as varchar) as date, cast(rank as integer) as rank, ranked_id from r where rank <= 10
""",
)
def p4_found(spark, folder):
    """Ten best candidates per date after keeping the latest revision of each date and ticker."""
    rows = table(spark, folder, "ranked_signals").where("date is not null").select("date", "ticker", "loaded_at", "ranked_id", "confidence")
    latest = topn.latest_revision(rows, ["date", "ticker"], [F.col("loaded_at"), F.col("ranked_id")])
    best = topn.top_n(latest, "date", "confidence", ["ticker", "ranked_id"], 10)
    return best.select(F.date_format("date", "yyyy-MM-dd").alias("date"), "rank", "ranked_id")


@register(
    "p4_closest_analogues",
    f"""with r as (select fold, analogue_distance, query_date, query_ticker, analogue_ticker, analogue_date,
 row_number() over (partition by fold order by analogue_distance, query_date nulls last, query_ticker nulls last, analogue_ticker nulls last, analogue_date nulls last) as k from journal where fold is not null and {_USABLE})
select fold, cast(k as integer) as rank, analogue_distance, cast(query_date as varchar) as query_date, query_ticker, analogue_ticker, cast(analogue_date as varchar) as analogue_date from r where k <= 25""",
)
def p4_closest_analogues(spark, folder):
    """The 25 closest analogues of each fold: few groups that hold the whole journal, so each goes through the range sort."""
    rows = table(spark, folder, "journal").where(digest.usable(F.col("analogue_distance"))).select("fold", "analogue_distance", "query_date", "query_ticker", "analogue_ticker", "analogue_date")
    best = topn.top_n(rows.withColumn("closeness", -F.col("analogue_distance")), "fold", "closeness", ["query_date", "query_ticker", "analogue_ticker", "analogue_date"], 25)
    return best.select("fold", "rank", "analogue_distance", F.date_format("query_date", "yyyy-MM-dd").alias("query_date"), "query_ticker", "analogue_ticker", F.date_format("analogue_date", "yyyy-MM-dd").alias("analogue_date"))


RETURNS = ["ret_1d", "ret_3d", "ret_7d", "ret_14d", "ret_30d", "ret_45d", "ret_60d", "ret_90d"]


def _returns(spark, folder):
    return similar.points(table(spark, folder, "full_db").select("row_id", "ticker", *RETURNS), F.col("row_id"), F.col("ticker"), RETURNS)


@register(
    "p5_found",
    f"""
with v as (select row_id, ticker, {', '.join(RETURNS)} from full_db where {' and '.join(c + ' is not null' for c in RETURNS)}),
d as (select a.row_id as a, b.row_id as b, sqrt({' + '.join(f'(a.{c}-b.{c})*(a.{c}-b.{c})' for c in RETURNS)}) as dist
      from v a join v b on a.ticker <> b.ticker and abs(a.ret_90d - b.ret_90d) <= 0.002),
r as (select *, row_number() over (partition by a order by dist, b) as k from d where dist <= 0.002)
select distinct least(a, b) as row_id_a, greatest(a, b) as row_id_b from r where k <= 10
""",
)
def p5_found(spark, folder):
    """Pairs within 0.002 of which one is among the other's ten nearest; the permutation index loses none."""
    near = similar.neighbours_within(_returns(spark, folder), 10, 0.002)
    return near.select(F.least("row_id", "near_id").alias("row_id_a"), F.greatest("row_id", "near_id").alias("row_id_b")).distinct()


@register("p5_neighbours")
def p5_neighbours(spark, folder):
    """The ten nearest rows of other tickers for every row whose id is divisible by 100, against all rows."""
    return similar.neighbours(_returns(spark, folder), F.col("row_id") % 100 == 0, 10)


@register("p5_recall", f"select count(*) as queries, true as enough from full_db where row_id % 100 = 0 and ticker is not null and {' and '.join(c + ' is not null' for c in RETURNS)}")
def p5_recall(spark, folder):
    """Recall at ten of the open search against an exact search of the same queries; it has to reach 0.9."""
    rows = _returns(spark, folder)
    asked = rows.where(F.col("row_id") % 100 == 0).select(F.col("row_id").alias("qid"), "vec", "label")
    exact = neighbours.knn_join(asked, rows.select(F.col("row_id").alias("tid"), "vec", "label"), 10, other="label")
    found = p5_neighbours(spark, folder).select(F.col("row_id").alias("qid"), F.col("near_id").alias("tid"), "rank")
    return neighbours.recall(exact, found, 10).select("queries", (F.col("recall") >= 0.9).alias("enough"))
