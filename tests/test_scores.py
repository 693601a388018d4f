import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.operators import calibrate as cal
from chronoloom.operators import metrics as m
from chronoloom.operators import ordered as o
from chronoloom.operators import vectors as v
from chronoloom.operators import vote as vt


@pytest.mark.parametrize(
    "p,n,want",
    [(0.9, 2, ("HOLD", "insufficient_matches")), (0.51, 9, ("HOLD", "low_agreement")), (0.6, 9, ("BUY", "prob=0.600_agree=0.200")), (0.3, 9, ("SELL", "prob=0.300_agree=0.400")), (0.47, 9, ("HOLD", "prob=0.470_agree=0.060"))],
)
def test_signal_order(spark, p, n, want):
    side, why = vt.signal(F.lit(p), F.lit(n), 0.55, 0.05, 5)
    assert tuple(spark.range(1).select(side, why).first()) == want


def test_vote_without_neighbours(spark):
    q = spark.createDataFrame([(1,), (2,)], "qid long")
    near = spark.createDataFrame([(1, 7, 0.0, 1, 1.0, 0.2), (1, 8, 1.0, 2, 0.0, -0.1)], "qid long, tid long, distance double, rank int, label double, fwd_return double")
    got = {r.qid: r for r in vt.vote(q, near).collect()}
    assert got[1].raw_prob == 0.5 and got[1].ensemble == [0.2, -0.1]
    assert (got[2].raw_prob, got[2].mean_return, got[2].n_matches, got[2].ensemble) == (0.5, 0.0, 0, [])
    inv = vt.vote(q, near, "inverse").where("qid = 1").first()
    assert inv.raw_prob == pytest.approx(100 / (100 + 1 / 1.01))


def test_murphy_identity_and_skill(spark):
    rng = np.random.default_rng(0)
    rows = [(float(p), float(rng.random() < p)) for p in rng.choice([0.2, 0.5, 0.7], size=500)]
    df = spark.createDataFrame(rows, "p double, y double").withColumn("g", F.lit(1))
    r = m.murphy(df, ["g"], None).first()
    assert abs(r.identity_gap) < 1e-12
    a = np.array(rows)
    assert df.agg(m.brier_skill(F.col("p"), F.col("y"))).first()[0] == pytest.approx(1 - ((a[:, 0] - a[:, 1]) ** 2).mean() / a[:, 1].var())
    assert spark.createDataFrame([(0.4, 1.0)], "p double, y double").agg(m.brier_skill(F.col("p"), F.col("y"))).first()[0] == 0.0


def test_crps_against_pairs(spark):
    x, y = [0.3, -1.0, 2.0, 0.3], 0.1
    want = np.mean(np.abs(np.array(x) - y)) - 0.5 * np.mean(np.abs(np.subtract.outer(x, x)))
    got = spark.createDataFrame([(x,), ([1.0],)], "x array<double>").select(m.crps(F.col("x"), F.lit(y)).alias("c")).collect()
    assert got[0].c == pytest.approx(want) and got[1].c is None


def test_wilcoxon():
    assert m.wilcoxon_greater([1, 2, 3, 4, 5, 6]) == pytest.approx(1 / 64)
    assert m.wilcoxon_greater([1, 2, 0, 0, 3]) is None


def test_bootstrap_covers_the_estimate(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, float(p), float(rng.random() < p)) for i, p in enumerate(rng.random(800))], "key long, p double, y double").withColumn("g", F.lit(1))
    r = m.bootstrap_skill(df.repartition(5), ["g"]).first()
    est = df.agg(m.brier_skill(F.col("p"), F.col("y"))).first()[0]
    assert r.bss_point == pytest.approx(est) and r.ci_lower < est < r.ci_upper and abs(r.bss_cv - est) < 0.02 and 0 <= r.variance_reduction <= 1
    again = m.bootstrap_skill(df.repartition(2), ["g"]).first()
    assert (again.ci_lower, again.beta) == pytest.approx((r.ci_lower, r.beta))  # the draws belong to the rows
    sums = m.bootstrap_sums(df, ["g"], 1000, 42).agg(F.avg("n"), F.stddev("n")).first()
    assert abs(sums[0] - 800) < 4 and abs(sums[1] - 800**0.5) < 3


def test_control_variate_against_numpy(spark):
    """Beta, estimate and reduction from the same resamples, computed by NumPy."""
    rng = np.random.default_rng(11)
    df = spark.createDataFrame([(i, i % 2, float(p), float(rng.random() < 0.4)) for i, p in enumerate(rng.random(300))], "key long, g int, p double, y double")
    got = {r.g: r for r in m.bootstrap_skill(df, ["g"], 200).collect()}
    for g in (0, 1):
        r = m.bootstrap_sums(df.where(f"g = {g}"), ["g"], 200, 42).toPandas()
        model, clim = (r.se / r.n).to_numpy(), (r.sy / r.n * (1 - r.sy / r.n)).to_numpy()
        beta = np.cov(model, clim)[0, 1] / np.var(clim, ddof=1)
        bss = 1 - (model - beta * (clim - clim.mean())) / clim
        assert got[g].beta == pytest.approx(beta) and got[g].bss_cv == pytest.approx(bss.mean()) and got[g].variance_reduction == pytest.approx(1 - np.corrcoef(model, clim)[0, 1] ** 2)
        assert (got[g].ci_lower, got[g].ci_upper) == pytest.approx(tuple(np.percentile(bss, [2.5, 97.5])))


def test_exact_percentiles(spark):
    rng = np.random.default_rng(12)
    rows = [(int(g), float(x)) for g, x in zip(rng.integers(3, size=500), np.round(rng.normal(size=500), 1))] + [(7, 2.0), (8, None), (9, float("nan"))]
    got = {r.g: r for r in m.percentiles(spark.createDataFrame(rows, "g int, x double"), ["g"], "x", {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.95, "e": 1.0}).collect()}
    assert set(got) == {0, 1, 2, 7}
    for g in got:
        assert got[g][1:] == pytest.approx(tuple(np.percentile([x for h, x in rows if h == g], [0, 5, 50, 95, 100])))


def test_calibrators(spark):
    rng = np.random.default_rng(2)
    p = rng.random(3000)
    df = spark.createDataFrame([(float(x), float(rng.random() < x**2)) for x in p], "raw_prob double, y double")
    a, b = cal.fit_platt(df)
    beta, (knots, values) = cal.fit_beta(df), cal.fit_isotonic(df)
    assert a > 0 and min(beta[:2]) >= 0 and (np.diff(values) >= 0).all()
    grid = spark.createDataFrame([(x,) for x in (0.0, 0.2, 0.5, 0.8, 1.0)] + [(None,)], "p double")
    got = grid.select(cal.platt(F.col("p"), a, b), cal.beta(F.col("p"), *beta), cal.isotonic(F.col("p"), knots, values)).collect()
    assert got[5] == (None, None, None)
    for k in range(3):
        col = [r[k] for r in got[:5]]
        assert col == sorted(col) and 0 <= col[0] and col[-1] <= 1 and abs(col[2] - 0.25) < 0.08
    base = df.agg(m.brier(F.col("raw_prob"), F.col("y"))).first()[0]
    assert df.select(m.brier(cal.isotonic(F.col("raw_prob"), knots, values), F.col("y"))).first()[0] < base


def test_platt_is_the_minimum(spark):
    """The gradient of the penalised loss is zero, over more distinct inputs than fit a driver's table of old."""
    df = spark.range(150_000).select((F.col("id") / 150_000).alias("raw_prob"), (F.rand(3) < F.col("id") / 150_000).cast("double").alias("y"))
    a, b = cal.fit_platt(df)
    gap = cal.platt(F.col("raw_prob"), a, b) - F.col("y")
    g = df.agg(F.sum(gap), F.sum(gap * F.col("raw_prob")) + a).first()
    assert abs(g[0]) < 1e-3 and abs(g[1]) < 1e-3


def test_isotonic_equals_pooling_in_one_go(spark):
    rng = np.random.default_rng(13)
    x, y = np.round(rng.random(2000), 3), rng.random(2000)
    knots, values = cal.fit_isotonic(spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "raw_prob double, y double").repartition(7))
    u, inv = np.unique(x, return_inverse=True)
    blocks = cal.pooled(u, np.bincount(inv).astype(float), np.bincount(inv, weights=y))
    assert np.interp(u, knots, values) == pytest.approx(np.concatenate([[t / k] * int(((u >= lo) & (u <= hi)).sum()) for lo, hi, k, t in blocks]))


def test_calibrator_factory(spark):
    df = spark.createDataFrame([(0.1, 0.0), (0.4, 1.0), (0.6, 0.0), (0.9, 1.0)], "raw_prob double, y double")
    for kind in ("platt", "beta", "isotonic", "none"):
        c = cal.calibrator(kind, df)
        assert c["kind"] == kind and 0 <= df.select(cal.apply(c, F.col("raw_prob"))).first()[0] <= 1
    with pytest.raises(ValueError, match="isotonic"):
        cal.calibrator("magic", df)


def test_mixture_prefers_the_better_member(spark):
    rng = np.random.default_rng(3)
    y = rng.normal(size=500)
    rows = [([float(a), float(b)], float(t)) for a, b, t in zip(y + 0.1 * rng.normal(size=500), y + 2 * rng.normal(size=500), y)]
    w, var = cal.fit_mixture(spark.createDataFrame(rows, "x array<double>, y double").repartition(3), "x", "y")
    assert w[0] > 0.8 and (var >= 1e-6).all() and w.sum() == pytest.approx(1)


def test_conformal_threshold(spark):
    df = spark.createDataFrame([(1, float(x)) for x in range(1, 20)], "g int, s double")
    assert cal.conformal_threshold(df, ["g"], "s", 0.1).first().threshold == 18.0
    assert cal.conformal_threshold(df.limit(3), ["g"], "s", 0.1).first().threshold == 3.0


@pytest.mark.parametrize("parts", [1, 4])
def test_monitors_against_python(spark, parts):
    """Blocks of any size give what one pass over the ordered values gives."""
    rng = np.random.default_rng(4)
    vals = {k: rng.normal(m, 1, size=n).tolist() for k, m, n in (("a", 0.4, 90), ("b", -0.6, 40), ("c", 0.0, 1))}
    rows = [(k, i, x) for k, v in vals.items() for i, x in enumerate(v)][::-1] + [("a", 500, None), ("d", 1, None)]
    df = spark.createDataFrame(rows, "k string, i int, v double")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        c = {r.k: r for r in o.cusum(df, ["k"], ["i"], "v", 0.0, 0.0).collect()}
        e = {r.k: r for r in o.ewma(df, ["k"], ["i"], "v", 1.0, 0.2).collect()}
        a = {r.k: r for r in o.adaptive_coverage(df.withColumn("v", (F.col("v") > 0.5).cast("double")), ["k"], ["i"], "v", 0.1, 0.05).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert set(c) == set(e) == set(a) == {"a", "b", "c"}
    for k, v in vals.items():
        up = down = 0.0
        alerts, first, ew, level = 0, 0, 1.0, 0.1
        for i, x in enumerate(v):
            up, down = max(0, up + x - 0.5), max(0, down - x - 0.5)
            hit = up > 5 or down > 5
            alerts, first = alerts + hit, first or (i + 1 if hit else 0)
            ew = 0.2 * x + 0.8 * ew
            level = max(0.01, min(0.5, level + 0.05 * (0.1 - float(x > 0.5))))
        assert (c[k].n, c[k].alerts, c[k].first_alert) == (len(v), alerts, first) and (c[k].up, c[k].down) == pytest.approx((up, down))
        assert (e[k].ewma, a[k].level) == pytest.approx((ew, level))
    assert o.cusum(df.limit(0), ["k"], ["i"], "v", 0.0, 1.0).count() == 0


def test_capped_selection_equals_greedy(spark):
    rng = np.random.default_rng(5)
    rows = [(1, i, int(rng.integers(3)), float(rng.integers(5))) for i in range(40)]
    got = [r.i for r in o.capped_selection(spark.createDataFrame(rows, "d int, i int, g int, c double"), "d", "g", [F.desc("c"), F.col("i")], 7, 3).orderBy("rank").collect()]
    want, held = [], {}
    for r in sorted(rows, key=lambda r: (-r[3], r[1])):
        if held.get(r[2], 0) < 3 and len(want) < 7:
            want.append(r[1])
            held[r[2]] = held.get(r[2], 0) + 1
    assert got == want


def test_compression_and_weights(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 4))
    y = (x[:, 0] + 0.1 * rng.normal(size=400) > 0).astype(float)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, d double, y double")
    importance, p = v.fit_compression(df, list("abcd"), "y", 2)
    assert max(importance, key=importance.get) == "a" and p.shape == (4, 2) and abs(p[0, 0]) > 0.95
    with pytest.raises(ValueError):
        v.fit_compression(df, list("abcd"), "y", 4)
    mi = {r.feature: r.mi for r in v.mutual_information(df, list("abcd"), "y").collect()}
    assert max(mi, key=mi.get) == "a"
    assert sum(v.rank_weights(list("abcd"), 4).values()) == pytest.approx(4)
    with pytest.raises(KeyError, match="returns_only"):
        v.feature_set("none")


def test_search_resumes_and_survives_failures():
    from chronoloom.plans import search

    assert search.grid({"a": [1, 2], "b": ["x", "y"]})[1] == {"a": 1, "b": "y"}
    calls = []

    def objective(p):
        calls.append(p)
        if p["n"] == 3:
            raise ValueError
        return p["x"]

    space = {"n": (1, 4), "x": (0.0, 1.0), "c": ["u", "v"]}
    log = search.run(search.proposals(space, 5), objective)
    assert len(calls) == 5 and all(1 <= c["n"] <= 4 and 0 <= c["x"] <= 1 for c in calls)
    search.run(search.proposals(space, 8), objective, gate=lambda p: p["c"] == "u", log=log)
    assert len(calls) == 8 and len(log) == 8
    assert all(x["value"] == search.FLOOR for x in log if x["params"]["n"] == 3) and search.best(log)["value"] == max(x["value"] for x in log)


def test_regimes(spark):
    import datetime as dt

    from chronoloom.operators import regimes

    series = spark.createDataFrame([(dt.date(2020, 1, 1) + dt.timedelta(i), float(i - 6), float(i % 3)) for i in range(12)], "date date, v double, vol double")
    rows = spark.createDataFrame([(1, dt.date(2019, 1, 1)), (2, dt.date(2020, 1, 12))], "i int, d date")
    assert {r.i: r.regime for r in regimes.nearest_regime(rows, "d", series).collect()} == {1: 0, 2: 1}
    assert {r.i: r.regime for r in regimes.backward_regimes(rows, "d", series).collect()} == {1: 0, 2: 3}
    assert {r.regime for r in regimes.backward_regimes(rows, "d", series.limit(5)).collect()} == {0}


def test_octet_and_overrides(spark):
    import datetime as dt

    from chronoloom.operators import regimes

    days = [dt.date(2020, 1, 1) + dt.timedelta(i) for i in range(12)]
    series = spark.createDataFrame([(d, float(i - 3), float(i % 3)) for i, d in enumerate(days)], "date date, v double, vol double")
    rows = spark.createDataFrame([(1, days[11], 30.0), (2, days[11], 20.0), (3, days[0], None)], "i int, d date, adx double")
    assert {r.i: r.regime for r in regimes.octet_regimes(rows, "d", series, "adx").collect()} == {1: 7, 2: 6, 3: 0}
    assert {r.regime for r in regimes.octet_regimes(rows, "d", series.limit(5), "adx").collect()} == {0}
    fear = spark.createDataFrame([(days[11], 2.0)], "date date, v double")
    assert {r.i: r.regime for r in regimes.overridden_regime(rows, "d", series, fear).collect()} == {1: 0, 2: 0, 3: 0}
    assert {r.i: r.regime for r in regimes.overridden_regime(rows, "d", series, None, fear).collect()} == {1: 1, 2: 1, 3: 0}


def test_pipeline_keeps_what_no_filter_changes(spark):
    s = spark.createDataFrame([(1, "BUY", -0.5), (2, "BUY", None), (3, "SELL", -0.9)], "i int, signal string, score double")
    out = vt.pipeline(s, [lambda x: x.withColumn("filtered", vt.veto(F.col("signal"), F.col("score"))), lambda x: x.withColumn("filtered", F.col("signal"))])
    assert {(r.i, r.signal, r.changed) for r in out.collect()} == {(1, "HOLD", True), (2, "BUY", False), (3, "SELL", False)} and out.columns == ["i", "signal", "score", "changed"]
