import pytest

from chronoloom import queries as core
from tests.sqlcheck import assert_same

core.load_all()


def rising(rows, key):
    return all(a[key] <= b[key] for a, b in zip(rows, rows[1:]))


# What holds for the queries that SQL cannot express
PROPERTIES = {
    "e13_control_variate": lambda rows: rows and all(r.ci_lower <= r.bss_cv <= r.ci_upper and 0 <= r.variance_reduction <= 1 for r in rows),
    "g09_calibrators": lambda rows: rows and all(0 <= r[c] <= 1 for r in rows for c in ("raw_prob", "platt", "beta", "isotonic")),
    "g13_mixture_weights": lambda rows: len(rows) == 20 and abs(sum(r.weight for r in rows) - 1) < 1e-4 and all(r.variance > 0 for r in rows),
    "j19_emd_rerank": lambda rows: rows and all(r.distance >= 0 and r["rank"] <= 10 for r in rows),
    "o03_resumed_search": lambda rows: [r.trial for r in rows] == list(range(6)) and all(r.status == "ok" for r in rows),
    "s29_manifest": lambda rows: len(rows) == 5 and all(r.bytes > 0 and len(r.sha256) == 64 for r in rows),
    "v04_mutual_information": lambda rows: len(rows) == 8 and all(r.mi >= 0 for r in rows) and abs(sum(r.weight for r in rows) - 8) < 1e-4 and rising(sorted(rows, key=lambda r: r.mi), "weight"),
    "v08_compression": lambda rows: [r.axis for r in sorted(rows, key=lambda r: r.axis)] == [0, 1, 2, 3] and all(r.variance > 0 for r in rows),
}


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, folder, name):
    df = core.QUERIES[name](spark, folder)
    if name in core.SQL:
        assert_same(df, core.SQL[name], folder)
    else:
        assert PROPERTIES[name](df.collect())


def test_entry(spark, folder):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_spearman_without_spread(spark, tmp_path):
    """Queries whose analogues share one return or one rank have no correlation and do not count."""
    from datetime import date

    rows = []
    for q, (r, rank) in enumerate([(lambda i: i * i % 7, lambda i: i), (lambda i: 2, lambda i: i), (lambda i: i, lambda i: 3)]):
        rows += [(0, 0.5, 1, "BUY", f"Q{q}", date(2020, 1, 2), f"A{i}", date(2019, 1, 2 + i), rank(i), float(r(i)), 0.5) for i in range(6)]
    columns = "fold int, calibrated_prob double, analogue_label int, signal string, query_ticker string, query_date date, analogue_ticker string, analogue_date date, analogue_rank int, analogue_fwd_return double, raw_prob double"
    spark.createDataFrame(rows, columns).toPandas().to_parquet(tmp_path / "journal.parquet")
    got = core.QUERIES["e24_spearman"](spark, str(tmp_path))
    assert got.first().n == 1
    assert_same(got, core.SQL["e24_spearman"], tmp_path)
