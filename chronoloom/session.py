"""Session helpers: building a session for tests, and cutting lineage safely."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[str] = []
_WATCHED: list[bool] = []
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks (clusters bring their own)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("chronoloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session that names none (tests, a laptop) gets a temporary folder, removed at exit; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jdir.isDefined():
        return str(jdir.get()).rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="chronoloom-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(own)
    return own


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when the session's process ends (see ``sweep``)."""
    path = f"{shared_dir(spark)}/chronoloom-{label}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def sweep(spark: SparkSession) -> int:
    """Delete everything ``staged`` and ``scratch`` wrote so far; results that still read it must be written first. Returns how many paths."""
    n, jvm = 0, spark._jvm
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return n


def staged(df: DataFrame, label: str = "stage", tidy: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    The result has no lineage: executors can be lost without recomputing what lies before
    it, and columns and predicates of later steps are pushed into the written table. The files go when the
    session stops, or with ``sweep`` or ``dropped``. With ``tidy`` the shuffle files of the write go when it ends, not when the driver happens
    to collect its garbage.
    """
    spark = df.sparkSession
    _watch(spark)
    path = scratch(spark, label)
    before = spark.conf.get(_TIDY)
    try:
        if tidy:
            spark.conf.set(_TIDY, "true")
        df.write.parquet(path)
    finally:
        spark.conf.set(_TIDY, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete the files of tables that ``staged`` returned; nothing may read them any more."""
    for t in tables:
        if t._written in _WRITTEN:
            _WRITTEN.remove(t._written)
            path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._written)
            path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def _watch(spark: SparkSession) -> None:
    """Sweep once when the process ends while its session still lives."""
    if not _WATCHED:
        _WATCHED.append(True)

        def end() -> None:
            try:
                if spark.sparkContext._jsc is not None:
                    sweep(spark)
            except Exception:  # the session may be gone
                pass

        atexit.register(end)
