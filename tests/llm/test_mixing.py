import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.llm import mixing

ITEM = "id long, source string, tokens long, copies string, block string"
TARGET = "source string, target_share double, max_repeats int"


def test_temperature_law():
    p, t = np.array([0.7, 0.2, 0.1]), np.array([0.2, 0.3, 0.5])
    np.testing.assert_allclose(mixing.weights(p, t, 0), t)
    np.testing.assert_allclose(mixing.weights(p, t, 1), p)
    a = mixing.exponent_for_entropy(p, 1.0)
    assert mixing.entropy(mixing.weights(p, np.full(3, 1 / 3), a)) == pytest.approx(1.0, abs=1e-9)
    tokens, reps = p * 1000, np.array([1.0, 2, 3])
    free = mixing.largest_total(t, tokens, reps)
    assert free == pytest.approx(600) and mixing.exponent_for_total(p, t, tokens, reps, free) == 0
    e = mixing.exponent_for_total(p, t, tokens, reps, 800)
    assert 0 < e < 1 and mixing.largest_total(mixing.weights(p, t, e), tokens, reps) == pytest.approx(800, rel=1e-6)


def frames(spark, seed=0, hot=2000):
    rnd = random.Random(seed)
    items = [(i, "hot", rnd.choice([3, 20, 200, 5000 if i % 97 == 0 else 50]), "x", "y") for i in range(hot)]
    items += [(10_000 + i, "small", rnd.randint(1, 60), "x", "y") for i in range(40)] + [(20_000 + i, "mid", rnd.randint(1, 90), None, None) for i in range(300)]
    items += [(1, None, 5, "", ""), (2, "unlisted", 9, "", ""), (3, "mid", None, "", ""), (4, "mid", 0, "", ""), (20_000, "mid", 30, "", "")]
    targets = [("hot", 0.5, 1), ("small", 0.2, 3), ("mid", 0.25, 2), ("absent", 0.05, 4)]
    return spark.createDataFrame(items, ITEM), spark.createDataFrame(targets, TARGET)


def test_shares_and_limits(spark):
    items, targets = frames(spark)
    used = mixing.mix(items, targets)
    rows = used.collect()
    assert {r.source for r in rows} == {"hot", "small", "mid"} and all(1 <= r.copies <= r.max_repeats for r in rows)
    total = sum(r.tokens * r.copies for r in rows)
    for source, want in (("hot", 0.5), ("small", 0.2), ("mid", 0.25)):
        got = sum(r.tokens * r.copies for r in rows if r.source == source) / total
        assert got == pytest.approx(want / 0.95, abs=0.003)
        assert {round(r.reached_share, 12) for r in rows if r.source == source} == {round(got, 12)}
    again = mixing.mix(items.repartition(7), targets)
    assert sorted((r.id, r.copies) for r in again.collect()) == sorted((r.id, r.copies) for r in rows)
    share = {r.source: r for r in mixing.shares(used, targets).collect()}
    assert share["absent"].reached_share == 0 and share["absent"].records == 0 and share["small"].most_copies == 3


def test_demanded_total_bends_the_shares(spark):
    items, targets = frames(spark)
    base = sum(p["budget"] for p in mixing.plan(items.where("tokens > 0 and source is not null").select("source", "tokens"), targets))
    more = mixing.mix(items, targets, total=base * 2)
    assert more.agg(F.sum(F.col("tokens") * F.col("copies"))).first()[0] == pytest.approx(base * 2, rel=0.01)
    assert more.where("copies > max_repeats").count() == 0


def test_entropy_plan(spark):
    items, targets = frames(spark)
    plans = mixing.plan(items.where("tokens > 0").select("source", "tokens"), targets, mode="entropy")
    assert mixing.entropy(np.array([p["weight"] for p in plans])) == pytest.approx(min(np.log(3), mixing.entropy(np.array([0.5, 0.2, 0.25, 0.05]))), abs=1e-6)


def test_empty(spark):
    items, targets = frames(spark)
    assert mixing.mix(items.limit(0), targets).count() == 0 and mixing.mix(items, targets.limit(0)).count() == 0
