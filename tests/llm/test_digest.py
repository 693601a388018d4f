import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.llm import digest

PROBS = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]


def rank_error(values, q, v):
    below, upto = (values < v).sum(), (values <= v).sum()
    return max(below - q * len(values), q * len(values) - upto, 0) / len(values)


@pytest.mark.parametrize("kind", ["normal", "heavy", "ties", "one"])
def test_cluster_and_quantile(kind):
    rng = np.random.default_rng(0)
    v = {"normal": rng.normal(size=20000), "heavy": np.exp(3 * rng.normal(size=20000)), "ties": rng.choice([1.0, 2.5, 2.5, 4.0], 20000), "one": np.full(5000, 0.1)}[kind]
    m, w = digest.cluster(v, np.ones(v.size), 200)
    assert w.sum() == v.size and (np.diff(m) > 0).all() and m.size <= 900
    for q in PROBS:
        assert rank_error(v, q, digest.quantile(m, w, v.min(), v.max(), q, 200)) <= 1 / 200


def test_merging_parts_equals_the_whole_within_the_bound():
    rng = np.random.default_rng(1)
    parts = [rng.gamma(2, size=int(rng.integers(1, 3000))) for _ in range(60)]
    ds = [digest.cluster(p, np.ones(p.size), 200) for p in parts]
    m, w = digest.cluster(np.concatenate([d[0] for d in ds]), np.concatenate([d[1] for d in ds]), 200)
    v = np.concatenate(parts)
    assert w.sum() == v.size
    assert max(rank_error(v, q, digest.quantile(m, w, v.min(), v.max(), q, 200)) for q in PROBS) <= 0.01


def table(spark, rows):
    return spark.createDataFrame(rows, "fold int, day date, d double, prob string, n string")


@pytest.mark.parametrize("within", [None, ["day"]])
@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_percentiles_against_brute_force(spark, monkeypatch, within, broadcast):
    monkeypatch.setattr(digest, "MAX_BROADCAST_ESTIMATES", broadcast)
    rng = np.random.default_rng(2)
    values = {0: rng.normal(3, 1, 4000).clip(0), 1: np.round(rng.random(300), 1), None: rng.random(50)}
    rows = [(k, dt.date(2020, 1, 1 + i % 5), float(x), "a", None) for k, v in values.items() for i, x in enumerate(v)]
    bad = [(0, None, x, None, None) for x in (float("nan"), float("inf"), -1.0, None, float("-inf"))] + [(7, None, None, "x", "y")]
    got = digest.percentiles(table(spark, rows + bad), ["fold"], "d", PROBS, max_rank_error=0.01, within=within).collect()
    assert len(got) == 3 * len(PROBS)
    for r in got:
        v = values[r.fold]
        assert r.n == len(v) and r.n_below == (v < r.estimate).sum() and r.n_upto == (v <= r.estimate).sum()
        assert r.rank_error == pytest.approx(rank_error(v, r.prob, r.estimate)) and r.rank_error <= 0.01


def test_a_coarse_digest_is_refined_until_it_holds(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(float(x),) for x in rng.random(3000)], "d double")
    got = digest.percentiles(df, [], "d", [0.3, 0.5], max_rank_error=1e-4, compression=4).collect()
    assert len(got) == 2 and max(r.rank_error for r in got) <= 1e-3


def test_kept_digests_combine(spark):
    rng = np.random.default_rng(4)
    v = rng.random(6000)
    df = spark.createDataFrame([(int(i % 3), float(x)) for i, x in enumerate(v)], "file int, d double").repartition(5)
    kept = digest.merge(digest.build(df, ["file"], "d"), ["file"])
    assert kept.count() == 3
    est = digest.estimates(digest.merge(kept, []), [], [0.5]).first()
    assert est.n == 6000 and rank_error(v, 0.5, est.estimate) <= 0.005


def test_flushing_many_groups(spark, monkeypatch):
    df = spark.range(1000).select((F.col("id") % 100).alias("g"), F.col("id").cast("double").alias("d"))
    assert digest.merge(digest.build(df, ["g"], "d"), ["g"]).agg(F.sum("n")).first()[0] == 1000


def test_empty(spark):
    assert digest.percentiles(table(spark, []), ["fold"], "d", PROBS).count() == 0
