from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.operators import neighbours as nb
from chronoloom.operators import scan
from chronoloom.operators import vote as vt
from chronoloom.plans import analogue, model
from chronoloom.plans import walkforward as wf
from chronoloom.session import staged


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(31)
    rows = [(i, rng.integers(0, 5, size=3).astype(float).tolist(), f"T{i % 7}", f"S{i % 3}", i % 2, float(rng.integers(2)), float(rng.normal()), int(i % 10)) for i in range(900)]
    return spark.createDataFrame([*rows, (9000, None, "T1", "S1", 0, 1.0, 0.5, 1), (9001, [1.0, None, 2.0], "T1", "S1", 0, 1.0, 0.5, 1)], "tid long, vec array<double>, ticker string, sector string, regime int, label double, fwd_return double, day int").repartition(3)


def asked(table):
    return table.where("tid % 9 = 0 or tid > 8000").select(F.col("tid").alias("qid"), "ticker", "sector", "regime", "vec")


def expected(rows, q, k, ok=lambda q, p: True, scale=lambda v: np.array(v)):
    return sorted((float(np.linalg.norm(scale(q.vec) - scale(p.vec))), p.tid) for p in rows if ok(q, p))[:k]


@pytest.mark.parametrize("text", [False, True])
def test_scan_with_ties_against_brute_force(table, monkeypatch, text):
    monkeypatch.setattr(scan, "LEAF", 16)
    monkeypatch.setattr(scan, "FLUSH", 50)
    monkeypatch.setattr(scan, "QUERIES", 64)
    df = table.withColumn("tid", F.format_string("%05d", "tid")) if text else table
    rows = [r for r in df.collect() if r.vec and None not in r.vec]
    got = scan.near(asked(df), scan.filed(df), 9, ["label", "ticker"]).collect()
    assert len(got) == 102 and {len(r.near) for r in got if int(r.qid) > 8000} == {0}
    by = {r.tid: r for r in rows}
    for r in got:
        if int(r.qid) < 8000:
            want = expected(rows, by[r.qid], 9)
            assert [(x.tid, pytest.approx(x.distance), x.label, x.ticker) for x in r.near] == [(t, d, by[t].label, by[t].ticker) for d, t in want]
    assert all(r.near == [] for r in scan.near(asked(df), scan.filed(df.limit(0)), 9, ["label"]).collect())


def test_scan_in_views_and_cells(table, monkeypatch):
    monkeypatch.setattr(scan, "LEAF", 16)
    rows = [r for r in table.collect() if r.vec and None not in r.vec]
    by, points, q = {r.tid: r for r in rows}, scan.filed(table), asked(table).where(scan.usable())
    views = {f: (np.array([1.0, 0.5, 2.0]) * f, np.array([1.0, 2.0, 0.25]), 3 + f) for f in (0, 1)}
    for r in scan.near(q.withColumn("fold", F.pmod("qid", F.lit(3)).cast("int")), points, 5, [], views, "fold", "day").collect():
        mean, factor, last = views.get(r.fold, (0, 0, -1))
        want = expected(rows, by[r.qid], 5, lambda q, p: p.day <= last, lambda v: (np.array(v) - mean) * factor)
        assert [(x.tid, pytest.approx(x.distance)) for x in r.near] == [(t, d) for d, t in want]
    celled = scan.filed(table.withColumn("cell", F.col("day")))
    for r in scan.near(q.withColumn("cells", F.array(F.lit(2), F.lit(7))), celled, 5, [], cells=True).collect():
        want = expected(rows, by[r.qid], 5, lambda q, p: p.day in (2, 7))
        assert [x.tid for x in r.near] == [t for _, t in want]


@pytest.mark.parametrize("options", [{}, {"weighting": "inverse", "sector_boost": 2.0}, {"same_sector_only": True, "regime_only": True, "exclude_same_ticker": False}])
def test_answers_like_the_join(table, options):
    """The array of each query gives what joins and windows over all neighbours give."""
    config = analogue.AnalogueConfig(top_k=8, max_distance=1.8, **options)
    a = {r.qid: r for r in analogue.answered(asked(table), scan.filed(table), config).collect()}
    b = {r.qid: r for r in analogue.query(table, asked(table), config).collect()}
    assert set(a) == set(b) and len(a) == 102
    for k, r in b.items():
        assert (a[k].raw_prob, a[k].mean_return, a[k].n_matches, a[k].ensemble) == (pytest.approx(r.raw_prob), pytest.approx(r.mean_return), r.n_matches, r.ensemble)
    with pytest.raises(ValueError):
        vt.vote_listed(table, "vec", "magic")


def test_no_neighbour_is_shuffled(table):
    """A prediction deals its queries to tasks and moves nothing else: on disk neighbours and repeated points outgrew the input."""
    rows = staged(table.where(scan.usable())).select(F.col("tid").alias("id"), "ticker", "sector", "regime", "label", "fwd_return", *[F.col("vec")[i].alias(f"x{i}") for i in range(3)])
    fitted = model.fit(rows, ["x0", "x1", "x2"], analogue.AnalogueConfig(top_k=5))
    plan = fitted.predict(rows.where("id % 9 = 0"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and "Aggregate" not in plan and plan.count("Repartition") == 1


def test_calibrators_are_fitted_to_all_rows(spark, monkeypatch):
    """1,500 rows train the model and all of them its calibrator, not a part of them."""
    seen, fitted = [], model.cal.calibrator
    monkeypatch.setattr(model.cal, "calibrator", lambda kind, rows: seen.extend(r.qid for r in rows.collect()) or fitted(kind, rows))
    rows = staged(spark.range(1500).selectExpr("id", "concat('t', id % 7) as ticker", "'s' as sector", "1 as regime", "cast(id % 3 = 0 as double) as label", "0.01 as fwd_return", "sin(id) as x0", "cos(3 * id) as x1"))
    got = model.fit(rows, ["x0", "x1"], analogue.AnalogueConfig(top_k=5), "platt")
    assert sorted(seen) == list(range(1500)) and len(got.calibrator["params"]) == 2


def fold_rows(table):
    return staged(table.where(scan.usable())).select(F.col("tid").alias("id"), "ticker", "sector", F.date_add(F.lit("2020-01-01").cast("date"), "day").alias("date"), "label", "fwd_return", *[F.col("vec")[i].alias(f"x{i}") for i in range(3)])


FOLDS = [{"fold": i, "train_end": date(2020, 1, 3 + i), "val_start": date(2020, 1, 4 + i), "val_end": date(2020, 1, 5 + i)} for i in range(3)]


def test_folds_are_scored_without_a_join(table):
    plan = wf.scored(fold_rows(table), FOLDS, ["x0", "x1", "x2"], analogue.AnalogueConfig(top_k=5))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and plan.count("Repartition") == 1


def test_isolated_folds_share_what_is_written(table, monkeypatch):
    wrote, write = [], wf.training
    monkeypatch.setattr(wf, "training", lambda *a: wrote.append(a) or write(*a))
    got = wf.run_each(fold_rows(table), FOLDS[:2], ["x0", "x1", "x2"], analogue.AnalogueConfig(top_k=5))
    assert [g["status"] for g in got] == ["ok", "ok"] and len(wrote) == 1
    assert wf.run_each(fold_rows(table), FOLDS[:1], ["x0"], analogue.AnalogueConfig(), deadline=-1) == [{"fold": 0, "status": "late"}] and len(wrote) == 1
