import datetime as dt
import random

from pyspark.sql import functions as F

from chronoloom.operators.periods import periods_and_gaps

SCHEMA = "ticker string, a date, b date, key string, kind int"
DAY = dt.date(2020, 1, 1)


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    out = periods_and_gaps(df, F.col("ticker"), F.col("a"), F.col("b"))
    return sorted((r.key, r.kind, (r.start_date - DAY).days, (r.end_date - DAY).days) for r in out.collect())


def brute(rows):
    out = []
    for t in {r[0] for r in rows if r[0] is not None}:
        days = set()
        for r in rows:
            if r[0] == t and r[1] and r[2] and r[2] >= r[1]:
                days |= set(range((r[1] - DAY).days, (r[2] - DAY).days + 1))
        spans = []
        for d in sorted(days):
            if spans and spans[-1][1] == d - 1:
                spans[-1][1] = d
            else:
                spans.append([d, d])
        out += [(t, "period", *s) for s in spans] + [(t, "gap", x[1] + 1, y[0] - 1) for x, y in zip(spans, spans[1:])]
    return sorted(out)


def test_matches_brute_force(spark):
    rnd = random.Random(1)
    rows = []
    for _ in range(400):
        a = rnd.randrange(600)
        rows.append((rnd.choice(["A", "A", "B", "C", None]), DAY + dt.timedelta(a), DAY + dt.timedelta(a + rnd.choice([-2, 0, 0, 1, 3, 40])), "x", 1))
    rows += rows[:50] + [("A", None, DAY, "x", 1), ("A", DAY, None, "x", 1)]
    assert run(spark, rows) == brute(rows)


def test_touching_nested_and_repeated(spark):
    d = lambda n: DAY + dt.timedelta(n)
    rows = [("A", d(0), d(10), "", 1), ("A", d(2), d(3), "", 1), ("A", d(11), d(12), "", 1), ("A", d(14), d(14), "", 1), ("A", d(14), d(14), "", 1)]
    assert run(spark, rows) == [("A", "gap", 13, 13), ("A", "period", 0, 12), ("A", "period", 14, 14)]


def test_empty(spark):
    assert run(spark, []) == []
