"""The N best items of every group, with heavy groups handled apart.

Method. Exact group counts split the groups: light ones (the many) go to one ordinary window
per group, heavy ones to a salted range sort, where the rows of a heavy group are spread by
score over many partitions, each keeps its first N, and a last window ranks these few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAVY_ROWS = 500
HEAVY_SHARE = 10_000


def latest_revision(df: DataFrame, keys: list[str], newest: list[Column]) -> DataFrame:
    """One row per key: the one with the greatest ``newest`` values, nulls lowest.

    An aggregation of structs with map-side combining, not a window, so a key with very many
    revisions is reduced where its rows lie. Null keys are keys.
    """
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(*[c.alias(f"__o{i}") for i, c in enumerate(newest)], F.struct(*[F.col(f"`{c}`") for c in rest]).alias("__row"))
    best = df.groupBy(*keys).agg(F.max(order).alias("__best"))
    return best.select(*keys, *[F.col(f"__best.__row.`{c}`").alias(c) for c in rest])


def top_n(df: DataFrame, group: str, score: str, ties: list[str], n: int, rank: str = "rank") -> DataFrame:
    """The ``n`` rows of highest ``score`` per group, as the input rows plus ``rank`` 1..n.

    Equal scores are ordered by the ``ties`` columns ascending (nulls last); rows equal in all
    of these follow each other in an order that does not matter, as they rank alike. Rows with
    a null group, or a null or NaN score, are not ranked. Groups with fewer rows come out whole. Empty in, empty out.

    A group is heavy with more than max(HEAVY_ROWS, rows / HEAVY_SHARE) rows; there can be at
    most HEAVY_SHARE such groups, so their list is safe to broadcast.
    """
    if rank in df.columns:
        raise ValueError(f"column {rank} exists already")
    s = F.col(f"`{score}`").cast("double")
    rows = df.where(F.col(group).isNotNull() & s.isNotNull() & ~F.isnan(s))
    order = [F.col(f"`{score}`").desc(), *[F.col(f"`{t}`").asc_nulls_last() for t in ties]]
    counts = rows.groupBy(group).agg(F.count(F.lit(1)).alias("__c"))
    stats = counts.agg(F.sum("__c"), F.max("__c")).first()
    limit = max(HEAVY_ROWS, (stats[0] or 0) // HEAVY_SHARE)
    w = Window.partitionBy(group).orderBy(*order)
    if (stats[1] or 0) <= limit:
        return rows.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)
    heavy = counts.where(F.col("__c") > F.lit(limit)).select(F.col(group).alias("__g"))
    hot = F.broadcast(heavy)
    light = rows.join(hot, rows[group] == hot["__g"], "left_anti")
    dense = rows.join(hot, rows[group] == hot["__g"], "left_semi")
    # range sort: a heavy group's rows go to many partitions by score; each keeps its own first n
    salted = dense.repartitionByRange(F.col(group), *order).withColumn("__part", F.spark_partition_id())
    local = Window.partitionBy(group, "__part").orderBy(*order)
    few = salted.withColumn("__k", F.row_number().over(local)).where(F.col("__k") <= n).drop("__k", "__part")
    return light.unionByName(few).withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)
