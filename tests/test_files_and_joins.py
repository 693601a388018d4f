import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoloom.operators import contracts, temporal
from chronoloom.plans import walkforward as wf
from chronoloom.sources import files

D = dt.date


def test_nearest_and_backward(spark):
    series = spark.createDataFrame([(D(2020, 1, 2), 1.0), (D(2020, 1, 6), 2.0), (D(2020, 1, 7), None)], "date date, v double")
    rows = spark.createDataFrame([(1, D(2020, 1, 1)), (2, D(2020, 1, 4)), (3, D(2020, 1, 3)), (4, D(2020, 2, 1)), (5, None)], "i int, d date")
    near = {r.i: r.x for r in temporal.nearest_date(rows, "d", series, "v", "x").collect()}
    assert near == {1: 1.0, 2: 2.0, 3: 1.0, 4: 2.0, 5: None}  # a tie takes the later date
    back = {r.i: r.x for r in temporal.backward(rows, "d", series, "v", "x").collect()}
    assert back == {1: None, 2: 1.0, 3: 1.0, 4: 2.0, 5: None}
    assert temporal.backward(rows, "d", series, "v", "x", clip=True).where("i = 1").first().x == 1.0
    assert temporal.nearest_date(rows, "d", series.where("v > 9"), "v", "x").where("x is not null").count() == 0


def test_business_days_and_reconcile(spark):
    days = spark.range(1).select(temporal.business_days(F.lit(D(2024, 1, 5)), F.lit(D(2024, 1, 9))).alias("d")).first().d
    assert days == [D(2024, 1, 5), D(2024, 1, 8), D(2024, 1, 9)]
    a = spark.createDataFrame([("x", 1.0), ("y", 1.0), ("z", 1.0)], "k string, q double")
    b = spark.createDataFrame([("x", 1.04), ("y", 2.0), ("w", 1.0)], "k string, q double")
    assert {r.key: r.status for r in temporal.reconcile(a, b, "k", "q").collect()} == {"x": "ok", "y": "mismatch", "z": "missing", "w": "unexpected"}


def test_atomic_write_and_paths(spark, tmp_path):
    target = str(tmp_path / "t")
    files.write_atomic(spark.range(3), target)
    files.write_atomic(spark.range(5), target)
    assert spark.read.parquet(target).count() == 5 and [p.name for p in tmp_path.iterdir()] == ["t"]
    assert files.first_existing(spark, [str(tmp_path / "no"), target]) == target
    with pytest.raises(FileNotFoundError):
        files.first_existing(spark, [str(tmp_path / "no")])


def test_csv_with_comments(spark, tmp_path):
    (tmp_path / "r.tsv").write_text("a\tb\n# resumed\n1\t2020-01-02\nx\t\n")
    got = files.read_csv(spark, str(tmp_path / "r.tsv"), "a int, b date", sep="\t", comment="#").collect()
    assert [tuple(r) for r in got] == [(1, D(2020, 1, 2)), (None, None)]


def test_logs_manifests_state(spark, tmp_path):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (None, "c"), (None, "c")], "k int, v string")
    assert {(r.k, r.v) for r in files.keep_first(df, ["k"], [F.col("v")]).collect()} == {(1, "a"), (None, "c")}
    assert files.append_new(df.where("k is null"), df, ["k"]).count() == 2
    for n, text in (("a", "1"), ("b", "2")):
        (tmp_path / n).write_text(text)
    was = files.manifest(spark, str(tmp_path / "*")).collect()
    was = spark.createDataFrame(was, "file string, bytes long, sha256 string")
    (tmp_path / "b").write_text("3")
    (tmp_path / "c").write_text("4")
    got = {r.file: r.status for r in files.verify_manifest(was, files.manifest(spark, str(tmp_path / "*"))).collect()}
    assert got == {"a": "ok", "b": "changed", "c": "unexpected"}
    state = files.to_state(df, 2)
    assert files.from_state(state, T.StructType(df.schema.fields), 2).count() == 4
    with pytest.raises(Exception, match="state has version 2"):
        files.from_state(state, T.StructType(df.schema.fields), 3).collect()
    assert files.config_hash({"b": 1, "a": 2}) == files.config_hash({"a": 2, "b": 1})


def test_contracts_report_everything_at_once(spark):
    df = spark.createDataFrame([(1.0, 1), (-1.0, 2), (None, 0)], "close double, up int")
    with pytest.raises(contracts.ContractError) as e:
        contracts.require(df, {"close above 0": "close > 0", "label": "up in (0, 1)"}, least_rows=5)
    assert str(e.value) == "close above 0: 2 rows; label: 1 rows; fewer than 5 rows"
    with pytest.raises(contracts.ContractError, match="column x"):
        contracts.require(df, {}, columns={"x": "int"})
    assert contracts.require(df, {"any": "true"}) is df


def test_split_guards(spark):
    df = spark.createDataFrame([(D(2020, 1, i),) for i in range(1, 10)], "date date")
    train, val = wf.split(df, D(2020, 1, 3), D(2020, 1, 4), D(2020, 1, 6))
    assert train.count() == 3 and val.count() == 3
    with pytest.raises(ValueError, match="training ends"):
        wf.split(df, D(2020, 1, 4), D(2020, 1, 4), D(2020, 1, 6))


def test_coerced_and_rules(spark):
    rows = spark.createDataFrame([("2020-01-02", "1.5"), ("02.01.2020", "1"), (None, "1"), ("2020-01-03", "x"), ("2020-01-04", "Infinity")], "d string, n string")
    got = contracts.coerced(rows, {"d": "yyyy-MM-dd"}, ["n"]).collect()
    assert [(str(r.d), r.n) for r in got] == [("2020-01-02", 1.5)]
    bars = spark.createDataFrame([("a", 1.0, 2.0, 3.0, 1.0, 5.0)], "ticker string, open double, high double, low double, close double, volume double").withColumn("date", F.current_date())
    assert {r.rule for r in contracts.violations(bars, contracts.bar_rules()).where("broken > 0").collect()} == {"high not below low"}


def test_append_log_lineage_and_staleness(spark, tmp_path):
    path = str(tmp_path / "log")
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    assert [files.append_log(spark, path, df, ["k"]), files.append_log(spark, path, df, ["k"])] == [2, 0] and spark.read.parquet(path).count() == 2
    marked = files.with_lineage(df, "k", {"rows": 3})
    marked.write.parquet(str(tmp_path / "m"))
    assert files.read_lineage(spark.read.parquet(str(tmp_path / "m")), "k") == {"rows": 3} and files.read_lineage(df, "k") is None
    assert files.stale({"facts": {"a": 1, "b": 2}}, {"a": 1, "b": 3, "c": 4}) == ["b", "c"] and len(files.data_version({"a": 1})) == 12
    lines = [r.line for r in files.text_lines(spark.createDataFrame([(1, -0.5), (None, None)], "a int, b double"), {"x": "y"}).collect()]
    assert lines == ["# x: y", "a\tb", "1\t-0.500000", "\t"]


def test_model_of_another_version(spark, tmp_path):
    from chronoloom.plans import model

    spark.createDataFrame([('{"version": 0}',)], "doc string").write.text(str(tmp_path / "model"))
    with pytest.raises(ValueError, match="version 0"):
        model.load(spark, str(tmp_path))


def test_shared_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace as N

    from chronoloom import session

    none = N(isDefined=lambda: False)
    context = N(master="spark://host:7077", _jsc=N(sc=lambda: N(getCheckpointDir=lambda: none)))
    with pytest.raises(RuntimeError, match="checkpoint"):
        session.shared_dir(N(conf=N(get=lambda *_: None), sparkContext=context))
    assert session.shared_dir(N(conf=N(get=lambda *_: "s3://x/"), sparkContext=context)) == "s3://x"


def test_staged_files_can_be_swept(spark):
    from pathlib import Path

    from chronoloom import session

    path = session.staged(spark.range(3), "sweeping").inputFiles()[0].removeprefix("file://")
    assert Path(path).exists() and session.sweep(spark) >= 1 and not Path(path).exists()
