"""Sweeps that filter one probe table again for every parameter value."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.metrics import brier_skill
from chronoloom.plans.analogue import AnalogueConfig


def distance_sweep(probed: DataFrame, queries: DataFrame, limits: list[float], config: AnalogueConfig) -> DataFrame:
    """``max_distance, n_scored, avg_k, bss`` per limit, from one probe (neighbours are searched once).

    ``queries`` needs qid and label. The grid is exploded onto the probe rows (no join).
    """
    grid = F.array(*[F.lit(float(x)) for x in limits])
    rows = probed.where(F.col("t_ticker") != F.col("q_ticker")) if config.exclude_same_ticker else probed
    each = rows.withColumn("max_distance", F.explode(grid)).where(F.col("distance") <= F.col("max_distance"))
    w = Window.partitionBy("max_distance", "qid").orderBy("distance", "tid")
    top = each.withColumn("r", F.row_number().over(w)).where(F.col("r") <= config.top_k)
    won = top.groupBy("max_distance", "qid").agg(F.avg("label").alias("p"), F.count(F.lit(1)).alias("n"))
    asked = queries.select("qid", F.col("label").alias("y"), F.explode(grid).alias("max_distance"))
    scored = asked.join(won, ["max_distance", "qid"], "left").withColumn("p", F.coalesce("p", F.lit(0.5))).withColumn("n", F.coalesce("n", F.lit(0)))
    return scored.groupBy("max_distance").agg(F.count(F.lit(1)).alias("n_scored"), F.avg("n").alias("avg_k"), brier_skill(F.col("p"), F.col("y")).alias("bss"))
