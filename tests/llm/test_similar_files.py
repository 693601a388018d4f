"""The open search in files of many points."""

import numpy as np
from pyspark.sql import functions as F

from chronoloom.llm import similar
from tests.llm.test_similar import FEATURES, brute, frame


def test_large_files_are_searched_whole(spark, monkeypatch):
    monkeypatch.setattr(similar, "MAX_PIVOTS", 4)  # files of all points, which must then all be found
    rng = np.random.default_rng(4)
    n = 2500
    x, ids = rng.normal(size=(n, 3)), np.arange(n)
    tickers = np.array(["T%d" % t for t in rng.integers(20, size=n)])
    rows = similar.points(frame(spark, ids, tickers, x), F.col("row_id"), F.col("ticker"), FEATURES)
    got = {(r.row_id, r.near_id) for r in similar.neighbours(rows, F.col("row_id") % 25 == 0, 10, posts=4).collect()}
    assert got == {p for p in brute(ids, tickers, x, 10) if p[0] % 25 == 0}
