import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.llm import similar

FEATURES = ["a", "b", "c"]
SCHEMA = "row_id long, ticker string, a double, b double, c double, vec string, distance double"


def brute(ids, tickers, x, k, radius=np.inf):
    out = set()
    for i in range(len(ids)):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        ok = [j for j in np.lexsort((ids, d)) if tickers[j] != tickers[i]][:k]
        out |= {(int(ids[i]), int(ids[j])) for j in ok if d[j] <= radius}
    return out


def data(seed, n=260):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 3))
    x = centres[rng.integers(12, size=n)] + rng.normal(scale=0.004, size=(n, 3))
    x[: n // 3] = x[0]  # a third of all rows are copies
    x[5] = -0.0
    ids = rng.permutation(n * 3)[:n]
    return ids, np.array(["T%d" % t for t in rng.integers(5, size=n)]), x


def frame(spark, ids, tickers, x):
    return spark.createDataFrame([(int(i), str(t), *map(float, v), "s", 0.0) for i, t, v in zip(ids, tickers, x)], SCHEMA)


@pytest.mark.parametrize("block", [4096, 32])
@pytest.mark.parametrize("radius", [0.004, 0.02])
def test_within_radius_loses_nothing(spark, monkeypatch, block, radius):
    monkeypatch.setattr(similar, "BLOCK", block)
    ids, tickers, x = data(1)
    rows = similar.points(frame(spark, ids, tickers, x), F.col("row_id"), F.col("ticker"), FEATURES)
    got = similar.neighbours_within(rows, 4, radius).collect()
    assert {(r.row_id, r.near_id) for r in got} == brute(ids, tickers, x, 4, radius)
    assert len(got) == len({(r.row_id, r["rank"]) for r in got})


def test_recall_of_the_open_search(spark):
    rng = np.random.default_rng(2)
    n = 3000
    x, ids = rng.normal(size=(n, 3)), np.arange(n)
    tickers = np.array(["T%d" % t for t in rng.integers(20, size=n)])
    rows = similar.points(frame(spark, ids, tickers, x), F.col("row_id"), F.col("ticker"), FEATURES)
    got = {(r.row_id, r.near_id) for r in similar.neighbours(rows, F.col("row_id") % 20 == 0, 10).collect()}
    want = {p for p in brute(ids, tickers, x, 10) if p[0] % 20 == 0}
    assert len(got) == len(want) and len(got & want) / len(want) >= 0.9


def test_nulls_and_empty(spark):
    bad = [(1, "A", 0.0, None, 0.0, "", 0.0), (2, "A", 0.0, float("nan"), 0.0, "", 0.0), (None, "A", 0.0, 0.0, 0.0, "", 0.0), (3, None, 0.0, 0.0, 0.0, "", 0.0), (4, "A", float("inf"), 0.0, 0.0, "", 0.0)]
    ok = [(5, "A", 0.0, 0.0, 0.0, "", 0.0), (6, "B", 0.0, 0.0, -0.0, "", 0.0)]
    rows = similar.points(spark.createDataFrame(bad + ok, SCHEMA), F.col("row_id"), F.col("ticker"), FEATURES)
    assert {(r.row_id, r.near_id) for r in similar.neighbours_within(rows, 3, 0.1).collect()} == {(5, 6), (6, 5)}
    none = similar.points(spark.createDataFrame([], SCHEMA), F.col("row_id"), F.col("ticker"), FEATURES)
    assert similar.neighbours_within(none, 3, 0.1).count() == 0 and similar.neighbours(none, F.lit(True), 3).count() == 0


def test_footrule_by_dot_product():
    rng = np.random.default_rng(3)
    m = 4
    perms = np.stack([rng.permutation(9)[:m] for _ in range(20)]).astype(np.int32)
    names = np.unique(perms)
    u = similar._unary(perms, names)
    got = m * (m + 1) - 2 * (u @ u.T)
    for i in range(20):
        for j in range(20):
            ra, rb = ({p: r for r, p in enumerate(perms[k])} for k in (i, j))
            assert got[i, j] == sum(abs(ra.get(p, m) - rb.get(p, m)) for p in set(ra) | set(rb))
