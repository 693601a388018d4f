"""Nearest-neighbour, vote and signal queries over the embedding vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoloom.operators import neighbours as nb
from chronoloom.operators import vote as vt
from chronoloom.plans import analogue
from chronoloom.queries import register
from chronoloom.sources.tables import table

DIM = 64
CONFIG = analogue.AnalogueConfig(top_k=20, max_distance=11.0, min_matches=3)
BREAKS = [-0.67, 0.0, 0.67]  # quartile points of the standard normal distribution

VECTORS = """v as (select vec_id as id, list_transform(embedding, lambda x: cast(x as double)) as e, cast(label >= 5 as double) as up, vec_id % 7 as ticker, label as sector, label % 2 as regime,
 (label - 4.5) / 10.0 + (vec_id % 13) / 100.0 as fwd from embeddings),
flat as (select id, unnest(e) as x, unnest(range(1, 65)) as i from v),
st as (select i, avg(x) as m, case when stddev_pop(x) = 0 then 1 else stddev_pop(x) end as s from flat where id % 5 <> 0 group by i),
z as (select id, list((x - m) / s order by i) as z from flat join st using (i) group by id),
pairs as (select q.id as qid, t.id as tid, list_distance(q.z, t.z) as distance from z q join z t on q.id % 5 = 0 and t.id % 5 <> 0),
probe as (select * from (select *, row_number() over (partition by qid order by distance, tid) as rank from pairs) where rank <= 60),
att as (select p.qid, p.tid, p.distance, t.up as label, t.fwd as fwd_return, t.ticker as t_ticker, q.ticker as q_ticker, t.sector = q.sector as same_sector from probe p join v t on t.id = p.tid join v q on q.id = p.qid),
kept as (select * from (select *, row_number() over (partition by qid order by distance, tid) as rank from att where distance <= 11.0 and t_ticker <> q_ticker) where rank <= 20)"""
_SIGNAL = """case when n_matches < 3 then 'HOLD' when abs(raw_prob - 0.5) * 2 < 0.05 then 'HOLD' when raw_prob >= 0.55 then 'BUY' when raw_prob <= cast(1 as double) - cast(0.55 as double) then 'SELL' else 'HOLD' end"""


def vectors(spark, folder):
    e = table(spark, folder, "embeddings")
    label = F.col("label")
    return e.select(
        F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("raw"), (label >= 5).cast("double").alias("label"), (F.col("vec_id") % 7).alias("ticker"),
        label.alias("sector"), (label % 2).alias("regime"), ((label - 4.5) / 10.0 + (F.col("vec_id") % 13) / 100.0).alias("fwd_return"),
    )


def sides(spark, folder):
    """Training and query side, standardised by the training side."""
    v = vectors(spark, folder)
    train = v.where("id % 5 <> 0")
    mean, scale = nb.standardise_array(train, "raw")
    v = v.withColumn("vec", nb.scaled_array("raw", mean, scale)).drop("raw")
    return v.where("id % 5 <> 0").withColumnRenamed("id", "tid"), v.where("id % 5 = 0").withColumnRenamed("id", "qid")


@register("j01_exact_knn", f"with {VECTORS} select qid, tid, rank, round(distance, 6) as distance from probe where rank <= 10")
def knn(spark, folder):
    train, query = sides(spark, folder)
    return nb.knn_join(query, train, 10).select("qid", "tid", "rank", F.round("distance", 6).alias("distance"))


@register(
    "j05_cosine_knn",
    f"""with {VECTORS}, c as (select q.id as qid, t.id as tid, 1 - list_cosine_similarity(q.e, t.e) as distance from v q join v t on q.id % 5 = 0 and t.id % 5 <> 0)
select qid, round(sum(distance), 5) as total, count(*) as n from (select *, row_number() over (partition by qid order by distance, tid) as rank from c) where rank <= 10 group by qid""",
)
def cosine(spark, folder):
    v = vectors(spark, folder).withColumnRenamed("raw", "vec")
    near = nb.knn_join(v.where("id % 5 = 0").withColumnRenamed("id", "qid"), v.where("id % 5 <> 0").withColumnRenamed("id", "tid"), 10, "cosine")
    return near.groupBy("qid").agg(F.round(F.sum("distance"), 5).alias("total"), F.count(F.lit(1)).alias("n"))


@register("j07_probe_then_filter", f"with {VECTORS} select qid, tid, rank, round(distance, 6) as distance, label from kept")
def filtered(spark, folder):
    train, query = sides(spark, folder)
    out = analogue.matched(analogue.probe(train, query, CONFIG), CONFIG)
    return out.select("qid", "tid", "rank", F.round("distance", 6).alias("distance"), "label")


@register(
    "g01_vote_signals",
    f"""with {VECTORS}, q as (select id as qid from v where id % 5 = 0), w as (select qid, avg(label) as p, avg(fwd_return) as r, count(*) as n from kept group by qid),
o as (select q.qid, coalesce(p, 0.5) as raw_prob, coalesce(r, 0) as mean_return, coalesce(n, 0) as n_matches from q left join w using (qid))
select qid, round(raw_prob, 6) as raw_prob, round(mean_return, 6) as mean_return, n_matches, {_SIGNAL} as signal,
case when n_matches < 3 then 'insufficient_matches' when abs(raw_prob - 0.5) * 2 < 0.05 then 'low_agreement' else 'matched' end as reason from o""",
)
def votes(spark, folder):
    train, query = sides(spark, folder)
    out = analogue.query(train, query, CONFIG)
    return out.select("qid", F.round("raw_prob", 6).alias("raw_prob"), F.round("mean_return", 6).alias("mean_return"), "n_matches", "signal", F.when(F.col("reason").startswith("prob="), "matched").otherwise(F.col("reason")).alias("reason"))


@register(
    "g02_inverse_vote_boost",
    f"""with {VECTORS}, q as (select id as qid from v where id % 5 = 0), k as (select *, 1 / (distance + 0.01) * case when same_sector then 1.5 else 1 end as w from kept),
w as (select qid, sum(w * label) / greatest(sum(w), 1e-9) as p, sum(w * fwd_return) / greatest(sum(w), 1e-9) as r, count(*) as n from k group by qid)
select q.qid, round(coalesce(p, 0.5), 6) as raw_prob, round(coalesce(r, 0), 6) as mean_return, coalesce(n, 0) as n_matches, round(0.5 + (coalesce(p, 0.5) - 0.5) * 0.6, 6) as damped from q left join w using (qid)""",
)
def inverse(spark, folder):
    train, query = sides(spark, folder)
    near = analogue.matched(analogue.probe(train, query, CONFIG), CONFIG)
    out = vt.vote(query.select("qid"), near, "inverse", 1.5)
    return out.select("qid", F.round("raw_prob", 6).alias("raw_prob"), F.round("mean_return", 6).alias("mean_return"), "n_matches", F.round(vt.damp(F.col("raw_prob"), F.lit(0.6)), 6).alias("damped"))


@register(
    "g18_journal",
    f"""with {VECTORS}, w as (select qid, avg(label) as raw_prob, count(*) as n_matches from kept group by qid), s as (select *, {_SIGNAL} as signal from w)
select s.qid, s.signal, k.tid, k.rank as analogue_rank, round(k.distance, 6) as distance, k.label, round(k.fwd_return, 6) as fwd_return from s join kept k using (qid) where s.signal in ('BUY', 'SELL') and k.rank <= 5""",
)
def journal(spark, folder):
    train, query = sides(spark, folder)
    probed = analogue.probe(train, query, CONFIG)
    near = analogue.matched(probed, CONFIG)
    out = vt.journal(analogue.query(train, query, CONFIG, probed).select("qid", "signal"), near, 5)
    return out.select("qid", "signal", "tid", "analogue_rank", F.round("distance", 6).alias("distance"), "label", F.round("fwd_return", 6).alias("fwd_return"))


@register(
    "o01_distance_sweep",
    f"""with {VECTORS}, g as (select unnest([9.0, 10.0, 10.5, 11.0]) as max_distance, 0 as one), q as (select id as qid, up as y from v where id % 5 = 0),
kk as (select * from (select g.max_distance, att.*, row_number() over (partition by g.max_distance, qid order by distance, tid) as rank from att join g on att.distance <= g.max_distance where t_ticker <> q_ticker) where rank <= 20),
w as (select max_distance, qid, avg(label) as p, count(*) as n from kk group by 1, 2),
a as (select g.max_distance, q.qid, q.y, coalesce(w.p, 0.5) as p, coalesce(w.n, 0) as n from g join q on true left join w on w.max_distance = g.max_distance and w.qid = q.qid)
select cast(max_distance as double) as max_distance, count(*) as n_scored, round(avg(n), 6) as avg_k, round(1 - avg(power(p - y, 2)) / (avg(y) * (1 - avg(y))), 6) as bss from a group by 1""",
)
def sweep(spark, folder):
    from chronoloom.plans.sweep import distance_sweep

    train, query = sides(spark, folder)
    out = distance_sweep(analogue.probe(train, query, CONFIG), query, [9.0, 10.0, 10.5, 11.0], CONFIG)
    return out.select("max_distance", "n_scored", F.round("avg_k", 6).alias("avg_k"), F.round("bss", 6).alias("bss"))


_PAA = "[" + ", ".join(f"(select avg(u) from (select unnest(z[{8 * s + 1}:{8 * s + 8}]) as u))" for s in range(8)) + "]"


@register(
    "j10_sax_filter",
    f"""with {VECTORS}, pa as (select id, (i - 1) // 8 as seg, avg((x - m) / s) as a from flat join st using (i) group by 1, 2),
wd as (select id, list((case when a >= -0.67 then 1 else 0 end + case when a >= 0.0 then 1 else 0 end + case when a >= 0.67 then 1 else 0 end) order by seg) as w from pa group by id),
k as (select p.qid, p.tid, qw.w as a, tw.w as b from probe p join wd qw on qw.id = p.qid join wd tw on tw.id = p.tid where p.rank <= 20),
u as (select qid, tid, unnest(a) as x, unnest(b) as y from k),
d as (select qid, tid, avg(case when abs(x - y) <= 1 then 0.0 else [-0.67, 0.0, 0.67][cast(greatest(x, y) as bigint)] - [-0.67, 0.0, 0.67][cast(least(x, y) + 1 as bigint)] end) as dist from u group by 1, 2)
select qid, count(*) as kept, round(sum(dist), 6) as total from d where dist <= 0.2 group by qid""",
)
def sax(spark, folder):
    train, query = sides(spark, folder)
    near = nb.knn_join(query, train, 20)
    tw = train.select("tid", nb.sax_word(nb.paa("vec", DIM, 8), BREAKS).alias("tw"))
    qw = query.select("qid", nb.sax_word(nb.paa("vec", DIM, 8), BREAKS).alias("qw"))
    d = near.join(tw, "tid").join(qw, "qid").withColumn("dist", nb.sax_distance(F.col("qw"), F.col("tw"), BREAKS))
    return d.where("dist <= 0.2").groupBy("qid").agg(F.count(F.lit(1)).alias("kept"), F.round(F.sum("dist"), 6).alias("total"))


def _dtw_sql(n: int = 8, band: int = 2) -> str:
    """Warped distance of the lists a and b, cell by cell as columns of one SELECT."""
    cells = ["0.0 as c0_0"]
    for i in range(1, n + 1):
        for j in range(max(1, i - band), min(n, i + band) + 1):
            before = [f"c{x}_{y}" for x, y in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if (x, y) == (0, 0) or (x and y and abs(x - y) <= band)]
            cells.append(f"power(a[{i}] - b[{j}], 2) + least({', '.join(before)}) as c{i}_{j}" if len(before) > 1 else f"power(a[{i}] - b[{j}], 2) + {before[0]} as c{i}_{j}")
    return f"""with {VECTORS}, ab as (select p.qid, p.tid, t.z as a, q.z as b from probe p join z t on t.id = p.tid join z q on q.id = p.qid where p.rank <= 20), w as (select qid, tid, {', '.join(cells)} from ab),
r as (select qid, tid, sqrt(c{n}_{n}) as distance, row_number() over (partition by qid order by sqrt(c{n}_{n}), tid) as rank from w)
select qid, cast(rank as integer) as rank, round(distance, 6) as distance from r where rank <= 5"""


@register("j15_dtw_rerank", _dtw_sql())
def dtw_rerank(spark, folder):
    """The 20 nearest reranked by warped distance over the first eight dimensions, five kept."""
    train, query = sides(spark, folder)
    near = nb.knn_join(query, train, 20)
    both = near.join(train.select("tid", F.slice("vec", 1, 8).alias("a")), "tid").join(query.select("qid", F.slice("vec", 1, 8).alias("b")), "qid")
    return nb.post_filter(both.withColumn("distance", nb.dtw(F.col("a"), F.col("b"))), F.lit(True), 5).select("qid", "rank", F.round("distance", 6).alias("distance"))


@register("j16_dtw_mask", _dtw_sql().split("r as (select")[0].rstrip().rstrip(",") + " select qid, count(*) as n, count(*) filter (sqrt(c8_8) <= 2.5) as kept, round(sum(sqrt(c8_8)), 4) as total from w group by qid")
def dtw_masked(spark, folder):
    """Of the 20 nearest those whose warped distance is at most 2.5, as a mask."""
    train, query = sides(spark, folder)
    near = nb.knn_join(query, train, 20)
    both = near.join(train.select("tid", F.slice("vec", 1, 8).alias("a")), "tid").join(query.select("qid", F.slice("vec", 1, 8).alias("b")), "qid")
    return nb.dtw_mask(both, "a", "b", 2.5).groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.count_if("kept").alias("kept"), F.round(F.sum("warped"), 4).alias("total"))


@register("j19_emd_rerank")
def emd_rerank(spark, folder):
    """The 30 nearest reranked by earth mover's distance over the first eight dimensions, ten kept."""
    train, query = sides(spark, folder)
    near = nb.knn_join(query, train, 30)
    both = near.join(train.select("tid", F.slice("vec", 1, 8).alias("a")), "tid").join(query.select("qid", F.slice("vec", 1, 8).alias("b")), "qid")
    return nb.post_filter(both.withColumn("distance", nb.emd(F.col("a"), F.col("b"))), F.lit(True), 10).select("qid", "tid", "rank", "distance")
