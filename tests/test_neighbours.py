from itertools import permutations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoloom.operators import neighbours as nb
from chronoloom.plans import analogue


def frames(spark, q, p):
    a = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "qid long, vec array<double>")
    b = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(p)], "tid long, vec array<double>")
    return a, b


@pytest.mark.parametrize("block", [16, 4096])
def test_exact_with_ties_across_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(nb, "BLOCK", block)
    monkeypatch.setattr(nb, "POINT_BLOCK", block)
    rng = np.random.default_rng(0)
    p = rng.integers(0, 3, size=(120, 3)).astype(float)
    q = rng.integers(0, 3, size=(40, 3)).astype(float)
    got = {(r.qid, r.rank): r.tid for r in nb.knn_join(*frames(spark, q, p), 7).collect()}
    for i, x in enumerate(q):
        d = np.sqrt(((p - x) ** 2).sum(1))
        assert [got[i, k + 1] for k in range(7)] == np.lexsort((np.arange(120), d))[:7].tolist()


def test_small_and_broken_inputs(spark):
    q, p = frames(spark, np.zeros((2, 2)), np.ones((3, 2)))
    assert nb.knn_join(q, p, 10).count() == 6
    bad = spark.createDataFrame([(9, None), (8, [float("nan"), 1.0])], "tid long, vec array<double>")
    assert nb.knn_join(q, p.unionByName(bad), 10).count() == 6
    assert nb.knn_join(q.where("qid < 0"), p, 3).count() == 0 and nb.knn_join(q, bad, 3).count() == 0
    with pytest.raises(ValueError):
        nb.knn_join(q, p, 3, metric="taxi")


def test_array_scaling_matches_columns(spark):
    x = np.random.default_rng(4).normal(size=(50, 3)) * [1, 5, 0]
    df = spark.createDataFrame([(r.tolist(), *map(float, r)) for r in x], "v array<double>, a double, b double, c double")
    mean, scale = nb.standardise_array(df, "v")
    np.testing.assert_allclose(scale, [*x[:, :2].std(0), 1.0])
    got = df.select(nb.scaled_array("v", mean, scale, [1.0, 2.0, 1.0]).alias("x"), nb.scaled_columns(nb.standardise(df, list("abc")), {"b": 2.0}).alias("y")).collect()
    np.testing.assert_allclose([r.x for r in got], [r.y for r in got], atol=1e-12)
    assert nb.standardise_array(df.where("a > 99"), "v") == ([], [])


def seeded(n, seed, start):
    """The seeded tables of the golden snapshot; the order of the draws matters."""
    rng = np.random.RandomState(seed)
    df = pd.DataFrame({"date": pd.date_range(start, periods=n, freq="B"), "ticker": rng.choice(["AAPL", "MSFT", "GOOGL", "AMZN", "NVDA"], size=n)})
    df["label"] = rng.randint(0, 2, size=n).astype(float)
    df["fwd_return"] = rng.randn(n) * 2.0
    for w in (1, 3, 7, 14, 30, 45, 60, 90):
        df[f"ret_{w}d"] = rng.randn(n)
    return df.assign(id=range(n), sector="x", regime=1)


def test_golden_snapshot(spark):
    features = [f"ret_{w}d" for w in (1, 3, 7, 14, 30, 45, 60, 90)]
    train, query = spark.createDataFrame(seeded(2000, 42, "2015-01-01")), spark.createDataFrame(seeded(400, 99, "2024-01-02"))
    vec = nb.scaled_columns(nb.standardise(train, features)).alias("vec")
    t = train.select(F.col("id").alias("tid"), "ticker", "sector", "regime", "label", "fwd_return", vec)
    q = query.select(F.col("id").alias("qid"), "ticker", "sector", "regime", "label", vec)
    out = analogue.query(t, q, analogue.AnalogueConfig()).join(q.select("qid", "label"), "qid").toPandas()
    assert out["signal"].value_counts().to_dict() == {"BUY": 93, "SELL": 104, "HOLD": 203}
    assert out["raw_prob"].mean() == pytest.approx(0.49765, rel=1e-9) and (out["n_matches"] == 50).all()
    bss = 1 - ((out["raw_prob"] - out["label"]) ** 2).mean() / out["label"].var(ddof=0)
    assert bss == pytest.approx(-0.0038149006956, rel=1e-5)


def test_dtw_against_plain_recursion():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(5, 6)), rng.normal(size=(5, 6))

    def plain(x, y, w=2):
        c = np.full((7, 7), np.inf)
        c[0, 0] = 0
        for i in range(1, 7):
            for j in range(1, 7):
                if abs(i - j) <= w:
                    c[i, j] = (x[i - 1] - y[j - 1]) ** 2 + min(c[i - 1, j], c[i, j - 1], c[i - 1, j - 1])
        return c[6, 6] ** 0.5

    np.testing.assert_allclose(nb.dtw_distance(a, b), [plain(x, y) for x, y in zip(a, b)])


def test_emd_against_all_assignments():
    rng = np.random.default_rng(3)
    for _ in range(5):
        a, b = rng.normal(size=5), rng.normal(size=5)
        lag = np.arange(5) * 0.5
        cost = np.sqrt((lag[:, None] - lag) ** 2 + (a[:, None] - b) ** 2)
        best = min(sum(cost[i, p[i]] for i in range(5)) for p in permutations(range(5))) / 5
        assert nb.emd_distance(a, b) == pytest.approx(best)


def test_sax(spark):
    row = spark.range(1).select(nb.paa(F.array(*[F.lit(float(x)) for x in range(7)]), 7, 3).alias("m")).first()
    assert row.m == [1.0, 3.5, 5.5]  # the first piece is longer
    breaks = [-0.5, 0.5]
    d = spark.range(1).select(
        nb.sax_word(F.array(F.lit(-1.0), F.lit(0.5), F.lit(2.0)), breaks).alias("w"),
        nb.sax_distance(F.array(F.lit(0), F.lit(1)), F.array(F.lit(2), F.lit(2)), breaks).alias("d"),
    ).first()
    assert d.w == [0, 2, 2] and d.d == pytest.approx(0.5)


def test_other_and_within_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nb, "BLOCK", 7)
    monkeypatch.setattr(nb, "POINT_BLOCK", 9)
    rng = np.random.default_rng(21)
    pts = [(i, [float(x) for x in rng.integers(4, size=3)], int(rng.integers(3)) if i % 11 else None, i % 2) for i in range(60)]
    p = spark.createDataFrame(pts, "tid long, vec array<double>, g int, f int")
    q = p.withColumnRenamed("tid", "qid")
    got = {}
    for r in nb.knn_join(q, p, 4, other="g", within="f").collect():
        got.setdefault(r.qid, []).append((r.rank, r.tid, r.distance))
    for i, v, g, f in pts:
        near = sorted((float(np.linalg.norm(np.subtract(v, w))), j) for j, w, h, e in pts if e == f and (g is None or h is None or g != h))[:4]
        assert [(t, pytest.approx(d)) for _, t, d in sorted(got[i])] == [(j, pytest.approx(d)) for d, j in near]
    assert nb.knn_join(q.limit(0), p, 3, within="f").count() == 0


def test_cell_search_finds_most(spark):
    rng = np.random.default_rng(22)
    x = rng.normal(size=(1500, 6))
    p = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())] + [(9000, None)], "tid long, vec array<double>")
    q = p.where("tid < 100").withColumnRenamed("tid", "qid")
    exact = nb.knn_join(q, p, 10)
    r = nb.recall(exact, nb.cell_search(q, p, 10), 10).first()
    assert r.queries == 100 and r.recall >= 0.8
    assert nb.recall(exact, nb.cell_search(q, p, 10, cells=20, probes=20), 10).first().recall == 1.0
    assert nb.cell_search(q, p.limit(0), 10).count() == 0
