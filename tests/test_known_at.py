import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from chronoloom.functions.timeparts import date_micros, micros
from chronoloom.operators.known_at import attributes_as_of, dyadic_nodes

EVENTS = "event_id long, ticker string, ts timestamp_ntz, row_id string"
FACTS = "row_id long, ticker string, date date, known_at timestamp_ntz, v double, extra string"


def run(events, facts, how="inner", payload=None):
    return attributes_as_of(
        events, facts, event_key=F.col("ticker"), event_time=F.col("ts"), fact_key=F.col("ticker"),
        fact_effective=F.greatest(micros(F.col("known_at")), date_micros(F.col("date"))), precedence=[F.col("date"), F.col("known_at"), F.col("row_id")],
        payload=payload or {"fact": F.col("row_id"), "v": F.col("v")}, how=how,
    )


def brute(events, facts):
    out = set()
    for e in events:
        if e[1] is None or e[2] is None:
            continue
        ok = [f for f in facts if f[1] == e[1] and None not in f[:4] and f[3] <= e[2] and f[2] <= e[2].date()]
        if ok:
            out.add((e[0], max(ok, key=lambda f: (f[2], f[3], f[0]))[0]))
    return out


@pytest.mark.parametrize("span_days", [1, 40, 4000])
def test_matches_brute_force(spark, span_days):
    rnd = random.Random(span_days)
    base = dt.datetime(2020, 1, 1)

    def when():
        return base + dt.timedelta(microseconds=rnd.randrange(span_days * 86_400_000_000))

    tickers = ["A"] * 6 + ["B", "C", None]
    facts = [(i, rnd.choice(tickers), rnd.choice([(t := when()).date(), None, when().date()]), rnd.choice([t, None, t]), 1.0, "x") for i in range(200)]
    facts += facts[:20]  # delivered again
    events = [(i, rnd.choice(tickers), rnd.choice([when(), when(), None, rnd.choice(facts)[3]]), "mine") for i in range(300)]
    got = run(spark.createDataFrame(events, EVENTS), spark.createDataFrame(facts, FACTS))
    assert {(r.event_id, r.fact) for r in got.collect()} == brute(events, facts)
    assert got.count() == len(brute(events, facts))
    left = run(spark.createDataFrame(events, EVENTS), spark.createDataFrame(facts, FACTS), "left")
    assert left.count() == len(events)
    assert {(r.event_id, r.fact) for r in left.where("fact is not null").collect()} == brute(events, facts)


def test_never_later_knowledge(spark):
    t = dt.datetime(2020, 1, 2, 12)
    facts = [(1, "A", dt.date(2020, 1, 1), t, 1.0, "x"), (2, "A", dt.date(2020, 1, 2), t + dt.timedelta(microseconds=1), 2.0, "x")]
    events = [(1, "A", t, ""), (2, "A", t - dt.timedelta(microseconds=1), ""), (3, "A", t + dt.timedelta(microseconds=1), "")]
    got = {(r.event_id, r.fact) for r in run(spark.createDataFrame(events, EVENTS), spark.createDataFrame(facts, FACTS)).collect()}
    assert got == {(1, 1), (3, 2)}


def test_empty_and_clashes(spark):
    e, f = spark.createDataFrame([], EVENTS), spark.createDataFrame([], FACTS)
    one = spark.createDataFrame([(1, "A", dt.datetime(2020, 1, 1), "")], EVENTS)
    assert run(e, f).count() == 0 and run(one, f).count() == 0 and run(one, f, "left").count() == 1 and run(e, f, "left").count() == 0
    assert run(one, f).columns == ["event_id", "ticker", "ts", "row_id", "fact", "v"]
    with pytest.raises(ValueError, match="row_id"):
        run(one, f, payload={"row_id": F.col("row_id")})


@pytest.mark.parametrize("a,b", [(0, 0), (5, 5), (3, 900), (64, 127), (1, 126), (63, 64), (7, 4000)])
def test_nodes_cover_each_leaf_once(spark, a, b):
    nodes = spark.range(1).select(dyadic_nodes(F.lit(a).cast("long"), F.lit(b).cast("long")).alias("n")).first().n
    leaves = [x for n in nodes for x in range(n.node << n.level, (n.node + 1) << n.level)]
    assert sorted(leaves) == list(range(a, b + 1))
