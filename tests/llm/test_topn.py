import random

import pytest
from pyspark.sql import functions as F

from chronoloom.llm import topn

SCHEMA = "g string, t string, c double, i long, __c string"


def rows(n, seed):
    rnd = random.Random(seed)
    return [(rnd.choice(["hot"] * 8 + ["a", "b", None]), rnd.choice(["x", "y", "z", None, f"t{i}"]), rnd.choice([0.1, 0.5, 0.5, 0.9, None, float("nan"), rnd.random()]), i, "extra") for i in range(n)]


def brute(data, n):
    out = set()
    for g in {r[0] for r in data if r[0] is not None}:
        ok = [r for r in data if r[0] == g and r[2] is not None and r[2] == r[2]]
        ok.sort(key=lambda r: (-r[2], r[1] is None, r[1] or "", r[3]))
        out |= {(g, k + 1, r[3]) for k, r in enumerate(ok[:n])}
    return out


@pytest.mark.parametrize("heavy", [10_000, 5])
@pytest.mark.parametrize("n", [1, 7, 1000])
def test_against_brute_force(spark, monkeypatch, heavy, n):
    monkeypatch.setattr(topn, "HEAVY_ROWS", heavy)
    data = rows(400, n)
    df = spark.createDataFrame(data, SCHEMA).repartition(6)
    got = topn.top_n(df, "g", "c", ["t", "i"], n)
    assert got.columns == [*df.columns, "rank"]
    assert {(r.g, r["rank"], r.i) for r in got.collect()} == brute(data, n) and got.count() == len(brute(data, n))


def test_latest_revision(spark):
    data = [("d", "x", 1.0, 1, None), ("d", "x", 2.0, 2, None), ("d", "x", 3.0, 2, "z"), ("d", None, 4.0, 1, None), ("d", None, 4.0, 1, None)]
    got = topn.latest_revision(spark.createDataFrame(data, SCHEMA), ["g", "t"], [F.col("__c"), F.col("i")])
    assert sorted((r.t or "", r.c) for r in got.collect()) == [("", 4.0), ("x", 3.0)]


def test_empty_and_clash(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert topn.top_n(df, "g", "c", ["t"], 3).count() == 0
    with pytest.raises(ValueError):
        topn.top_n(df.withColumn("rank", F.lit(1)), "g", "c", ["t"], 3)
