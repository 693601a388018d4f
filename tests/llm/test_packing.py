import random
from collections import defaultdict

import numpy as np
import pytest

from chronoloom.llm import packing


def optimum(sizes, capacity):
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for room in set(bins):
            if room + sizes[i] <= capacity:
                k = bins.index(room)
                go(i + 1, bins[:k] + bins[k + 1 :] + [room + sizes[i]])
        go(i + 1, bins + [sizes[i]])

    go(0, [])
    return best[0]


def test_bounds_bracket_the_optimum():
    rnd = random.Random(0)
    for _ in range(60):
        cap = rnd.choice([10, 30, 100])
        s = np.array([rnd.randint(1, cap) for _ in range(rnd.randint(1, 9))])
        where = packing.best_fit_decreasing(s, cap)
        assert np.bincount(where, weights=s).max() <= cap
        assert packing.lower_bound(s, cap) <= optimum(s.tolist(), cap) <= where.max() + 1


def test_dual_feasible_functions_beat_the_total():
    assert packing.lower_bound(np.array([6, 6, 6]), 10) == 3 and packing.lower_bound(np.array([4, 4, 4, 4, 4]), 10) == 3


def check(rows, items, kinds):
    by_kind = defaultdict(lambda: defaultdict(list))
    for r in rows:
        by_kind[r.pack_kind][r.bin_id].append(r)
    for kind, cap in kinds:
        bins = by_kind[kind]
        assert all(sum(r.tokens for r in b) <= cap and {r.bin_tokens for r in b} == {sum(r.tokens for r in b)} for b in bins.values())
        held = sorted((r.doc_id, r.tokens, r.piece) for b in bins.values() for r in b)
        want = []
        for d, s in items:
            s = max(s or 0, 0)
            if s <= cap:
                want.append((d, s, 0))
            else:
                want += [(d, cap, p) for p in range(s // cap)] + ([(d, s % cap, s // cap)] if s % cap else [])
        assert held == sorted(want)
        assert all(r.start_token == r.piece * cap for b in bins.values() for r in b)


@pytest.mark.parametrize("per_partition", [20_000, 25])
def test_whole_packing(spark, per_partition):
    rnd = random.Random(1)
    items = [(i, rnd.choice([rnd.randint(0, 40), rnd.randint(30, 70), rnd.randint(100, 450)])) for i in range(300)] + [(7, 20), (7, 20), (900, None), (901, 0), (902, 64), (903, 128)]
    kinds = [("a", 64), ("b", 100)]
    df = spark.createDataFrame([(*x, "x") for x in items], "doc_id long, tokens long, part string")
    out = packing.pack(df, kinds, per_partition=per_partition)
    rows = out.collect()
    check(rows, items, kinds)
    for r in packing.report(out).collect():
        assert r.containers <= r.least_containers * 1.05 + 2 and 0 < r.fill <= 1


def test_exchange_saves_containers(spark):
    # each partition alone leaves a container almost empty
    items = [(i, 26) for i in range(202)]
    df = spark.createDataFrame(items, "doc_id long, tokens long")
    out = packing.pack(df, [("a", 52)], per_partition=10).collect()
    check(out, items, [("a", 52)])
    assert len({r.bin_id for r in out}) == 101


def test_empty_and_errors(spark):
    df = spark.createDataFrame([], "doc_id long, tokens long")
    assert packing.pack(df, [("a", 5)]).count() == 0 and packing.pack(df, []).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, [("a", 0)])
