"""Readers and writers: typed CSV and TSV, globs with file-derived columns, logs, manifests and state."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ",", comment: str | None = None, header: bool = True) -> DataFrame:
    """Delimited text with a declared schema; unreadable cells are NULL, lines that begin with ``comment`` are skipped."""
    reader = spark.read.schema(schema).option("header", header).option("sep", sep).option("mode", "PERMISSIVE").option("timestampFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]")
    return (reader.option("comment", comment) if comment else reader).csv(path)


def read_required(spark: SparkSession, path: str, schema: T.StructType | str, required: list[str], sep: str = ",") -> DataFrame:
    """A delimited file whose header must name the required columns; the others of the schema are NULL where it lacks them. Order does not matter."""
    names = spark.read.option("header", True).option("sep", sep).csv(path).columns
    missing = [c for c in required if c not in names]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    raw = spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in names])).option("header", True).option("sep", sep).csv(path)
    return raw.select(*[(F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in names else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted.fields])


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.option("header", True).option("sep", sep).option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").mode("overwrite").csv(path)


def read_glob(spark: SparkSession, pattern: str, column: str, regex: str) -> DataFrame:
    """All Parquet files of a pattern with a column taken from the file name by the regex's first group."""
    df = spark.read.parquet(pattern)
    return df.withColumn(column, F.regexp_extract(F.col("_metadata.file_path"), regex, 1))


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """The first of several paths that exists (local, HDFS or object store)."""
    jvm = spark._jvm
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        if hp.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hp):
            return p
    raise FileNotFoundError(", ".join(paths))


def write_atomic(df: DataFrame, path: str) -> None:
    """Write beside the target, then swap directories, so that readers never see a partial table."""
    spark = df.sparkSession
    staging, old = f"{path}.__new_{uuid.uuid4().hex}", f"{path}.__old_{uuid.uuid4().hex}"
    df.write.parquet(staging)
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    had = fs.exists(target)
    if had and not fs.rename(target, jvm.org.apache.hadoop.fs.Path(old)):
        raise OSError(f"cannot move {path}")
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(staging), target):
        raise OSError(f"cannot move the new table to {path}")
    if had:
        fs.delete(jvm.org.apache.hadoop.fs.Path(old), True)


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per key in a stated order (a window, not dropDuplicates, which has no order)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def append_new(log: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of a batch whose keys the log does not hold (null keys are compared as values)."""
    on = F.lit(True)
    known = log.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return batch.join(known, on, "left_anti")


def manifest(spark: SparkSession, pattern: str) -> DataFrame:
    """``file, bytes, sha256`` of every file of a pattern."""
    files = spark.read.format("binaryFile").load(pattern)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_manifest(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Full outer comparison of two manifests: ``file, status`` (ok, changed, missing, unexpected)."""
    a = actual.select(F.col("file").alias("f2"), F.col("sha256").alias("h2"))
    both = expected.select("file", "sha256").join(a, F.col("file") == F.col("f2"), "full_outer")
    status = F.when(F.col("f2").isNull(), "missing").when(F.col("file").isNull(), "unexpected").when(F.col("sha256") == F.col("h2"), "ok").otherwise("changed")
    return both.select(F.coalesce("file", "f2").alias("file"), status.alias("status"))


def lineage(df: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys, rows, and a short fingerprint of both."""
    n = df.agg(F.count_distinct(key).alias("keys"), F.count(F.lit(1)).alias("rows"))
    return n.withColumn("fingerprint", F.substring(F.sha2(F.concat_ws(":", "keys", "rows"), 256), 1, 16))


def config_hash(config: dict) -> str:
    """sha-256 of a configuration as JSON with sorted keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


def to_state(df: DataFrame, version: int) -> DataFrame:
    """Each row as one JSON document that carries its schema version."""
    return df.select(F.to_json(F.struct(F.lit(version).alias("_schema_version"), *df.columns)).alias("state"))


def from_state(df: DataFrame, schema: T.StructType, version: int) -> DataFrame:
    """Documents back to rows; another version or a malformed document is an error."""
    full = T.StructType([T.StructField("_schema_version", T.IntegerType()), *schema.fields])
    doc = df.select(F.from_json("state", full, {"mode": "FAILFAST"}).alias("d")).select("d.*")
    checked = F.when(F.col("_schema_version") == version, F.col("_schema_version")).otherwise(F.raise_error(F.concat(F.lit("state has version "), F.coalesce(F.col("_schema_version").cast("string"), F.lit("none")))).cast("int"))
    return doc.withColumn("_schema_version", checked).where("_schema_version is not null").drop("_schema_version")


def append_log(spark: SparkSession, path: str, rows: DataFrame, keys: list[str]) -> int:
    """Append to a Parquet log the rows whose keys it does not hold; returns how many. A log that does not exist is begun."""
    hp = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hp.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hp):
        rows = append_new(spark.read.schema(rows.schema).parquet(path), rows, keys)
    fresh = keep_first(rows, keys, [F.lit(1)])
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    return n


def text_lines(df: DataFrame, header: dict[str, str] | None = None, places: int = 6) -> DataFrame:
    """``line``: a table as tab-separated text under ``#`` comments, with signed fixed-point numbers and empty cells for null."""
    cells = [
        F.when(F.col(f"`{f.name}`").isNull(), "").otherwise(F.format_string(f"%+.{places}f", F.col(f"`{f.name}`").cast("double")) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`").cast("string"))
        for f in df.schema.fields
    ]
    top = [f"# {k}: {v}" for k, v in (header or {}).items()] + ["\t".join(df.columns)]
    body = df.select(F.concat_ws("\t", *cells).alias("line"))
    return df.sparkSession.createDataFrame([(x,) for x in top], "line string").unionByName(body)


def with_lineage(df: DataFrame, column: str, facts: dict) -> DataFrame:
    """The table with facts about its origin in the metadata of a column (kept by Parquet)."""
    return df.withMetadata(column, {**df.schema[column].metadata, "lineage": facts})


def read_lineage(df: DataFrame, column: str) -> dict | None:
    return df.schema[column].metadata.get("lineage")


def data_version(facts: dict) -> str:
    """Short fingerprint of what a result was computed from: the first 12 digits of its configuration hash."""
    return config_hash(facts)[:12]


def stale(manifest_: dict, facts: dict) -> list[str]:
    """The names of facts that differ from those a manifest was written for (missing ones too)."""
    old = manifest_.get("facts", {})
    return sorted(k for k in {*old, *facts} if old.get(k) != facts.get(k))


def run_manifests(runs: DataFrame, newest: int) -> DataFrame:
    """The newest runs of ``run_id, finished_at, facts, score`` with the best score before each (null for the first)."""
    before = Window.orderBy("finished_at", "run_id").rowsBetween(Window.unboundedPreceding, -1)  # one row per run
    return runs.withColumn("best_before", F.max("score").over(before)).orderBy(F.desc("finished_at"), F.desc("run_id")).limit(newest)


def save_results(tables: dict[str, DataFrame], path: str) -> dict[str, int]:
    """Write several result tables beside each other, each swapped in whole; rows per table."""
    out = {}
    for name, df in tables.items():
        write_atomic(df, f"{path}/{name}")
        out[name] = df.sparkSession.read.parquet(f"{path}/{name}").count()
    return out
