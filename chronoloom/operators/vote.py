"""Voting over neighbours, signals, ensembles and the signal journal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def vote(queries: DataFrame, neighbours: DataFrame, weighting: str = "uniform", boost: float = 1.0, by: list[str] = ("qid",)) -> DataFrame:
    """``by..., raw_prob, mean_return, n_matches, ensemble`` for every query.

    ``neighbours``: qid, tid, distance, rank, label, fwd_return and, for a boost above 1, a boolean ``same_sector``.
    "uniform": plain means. "inverse": weights 1 / (distance + 0.01), times ``boost`` within the
    sector, normalised. A query without neighbours has probability 0.5, return 0 and an empty ensemble.
    """
    if weighting == "inverse":
        w = 1.0 / (F.col("distance") + 0.01)
        if boost != 1.0:
            w = w * F.when(F.col("same_sector"), F.lit(float(boost))).otherwise(1.0)
    elif weighting == "uniform":
        w = F.lit(1.0)
    else:
        raise ValueError("weighting must be 'uniform' or 'inverse'")
    total = F.greatest(F.sum("w"), F.lit(1e-9))
    won = neighbours.withColumn("w", w).groupBy(*by).agg(
        (F.sum(F.col("w") * F.col("label")) / total).alias("raw_prob"), (F.sum(F.col("w") * F.col("fwd_return")) / total).alias("mean_return"),
        F.count(F.lit(1)).alias("n_matches"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "fwd_return"))), lambda x: x["fwd_return"]).alias("ensemble"),
    )
    out = queries.join(won, list(by), "left")
    return out.withColumns(
        {
            "raw_prob": F.coalesce("raw_prob", F.lit(0.5)), "mean_return": F.coalesce("mean_return", F.lit(0.0)), "n_matches": F.coalesce("n_matches", F.lit(0)),
            "ensemble": F.coalesce("ensemble", F.array().cast("array<double>")),
        }
    )


def vote_listed(rows: DataFrame, near: str, weighting: str = "uniform", boost: float = 1.0) -> DataFrame:
    """Adds ``raw_prob, mean_return, n_matches, ensemble`` as ``vote`` does, from an array of neighbours in rank order on each row; no shuffle.

    The array holds structs of distance, label, fwd_return and, for a boost above 1, sector (compared with the row's).
    """
    if weighting not in ("uniform", "inverse"):
        raise ValueError("weighting must be 'uniform' or 'inverse'")

    def weight(x: Column) -> Column:
        if weighting == "uniform":
            return F.lit(1.0)
        w = 1.0 / (x["distance"] + 0.01)
        return w if boost == 1.0 else w * F.when(F.coalesce(x["sector"] == F.col("sector"), F.lit(False)), F.lit(float(boost))).otherwise(1.0)

    total = F.greatest(F.aggregate(near, F.lit(0.0), lambda a, x: a + weight(x)), F.lit(1e-9))

    def mean(c: str, none: float) -> Column:
        got = F.aggregate(near, F.lit(0.0), lambda a, x: a + F.coalesce(weight(x) * x[c].cast("double"), F.lit(0.0))) / total
        return F.when(F.exists(near, lambda x: x[c].isNotNull()), got).otherwise(F.lit(none))

    return rows.withColumns(
        {"raw_prob": mean("label", 0.5), "mean_return": mean("fwd_return", 0.0), "n_matches": F.size(near).cast("long"), "ensemble": F.transform(near, lambda x: x["fwd_return"].cast("double"))}
    )


def damp(prob: Column, multiplier: Column) -> Column:
    """A probability drawn towards one half by an overlay multiplier in [0, 1]."""
    return 0.5 + (prob - 0.5) * multiplier


def signal(prob: Column, n: Column, threshold: float, spread: float, least: int) -> tuple[Column, Column]:
    """Signal and reason. Too few matches and low agreement are checked first and give HOLD."""
    agreement = F.abs(prob - 0.5) * 2
    reason = F.format_string("prob=%.3f_agree=%.3f", prob, agreement)
    side = F.when(n < least, "HOLD").when(agreement < spread, "HOLD").when(prob >= threshold, "BUY").when(prob <= 1 - threshold, "SELL").otherwise("HOLD")
    why = F.when(n < least, "insufficient_matches").when(agreement < spread, "low_agreement").otherwise(reason)
    return side, why


def journal(signals: DataFrame, neighbours: DataFrame, top: int) -> DataFrame:
    """One row per BUY or SELL query and each of its ``top`` nearest neighbours, ranked from 1."""
    w = Window.partitionBy("qid").orderBy("distance", "tid")
    kept = neighbours.withColumn("analogue_rank", F.row_number().over(w)).where(F.col("analogue_rank") <= top)
    return signals.where(F.col("signal").isin("BUY", "SELL")).join(kept.select("qid", "tid", "distance", "label", "fwd_return", "analogue_rank"), "qid")


def uncertain_confidence(mean: Column, deviation: Column) -> Column:
    """A model's mean scaled down by its deviation: mean * (1 - min(2 sd, 0.5)), within [0, 1]."""
    return F.least(F.greatest(mean * (1 - F.least(2 * deviation, F.lit(0.5))), F.lit(0.0)), F.lit(1.0))


def sector_lift(signals: DataFrame, base_rates: DataFrame, least: float) -> DataFrame:
    """Hold BUY and SELL signals of sectors whose mean probability exceeds their base rate by less than ``least``.

    The lift is a mean over the batch of signals at hand; an unknown sector has base rate 0.5.
    """
    rows = signals.join(base_rates.select("sector", "base_rate"), "sector", "left")
    lift = F.avg("prob").over(Window.partitionBy("sector")) - F.coalesce("base_rate", F.lit(0.5))
    rows = rows.withColumn("lift", lift)
    changed = (F.col("lift") < least) & F.col("signal").isin("BUY", "SELL")
    return rows.withColumn("filtered", F.when(changed, "HOLD").otherwise(F.col("signal"))).withColumn("changed", changed)


def momentum(signals: DataFrame, averages: DataFrame, margin: float = 0.015) -> DataFrame:
    """Hold BUY without return above, and SELL without return below, the sector's average by ``margin``.

    A missing return counts as the average, an unknown sector as average 0.
    """
    rows = signals.join(averages.select("sector", "avg_return"), "sector", "left")
    mean = F.coalesce("avg_return", F.lit(0.0))
    gap = F.coalesce(F.col("ret") - mean, F.lit(0.0))
    keep = F.when(F.col("signal") == "BUY", gap >= margin).when(F.col("signal") == "SELL", -gap >= margin).otherwise(True)
    return rows.withColumn("filtered", F.when(keep, F.col("signal")).otherwise("HOLD")).withColumn("changed", ~keep)


def veto(signal_: Column, score: Column, limit: float = -0.20) -> Column:
    """BUY with a score below the limit becomes HOLD; a missing score counts as 0."""
    return F.when((signal_ == "BUY") & (F.coalesce(score, F.lit(0.0)) < limit), "HOLD").otherwise(signal_)


def consensus(votes: DataFrame) -> DataFrame:
    """Per item of ``item, config_order, signal, prob``: majority signal (more than half) or HOLD, ratio, mean and spread.

    Of equally frequent signals the one first seen in config order leads.
    """
    n = votes.groupBy("item", "signal").agg(F.count(F.lit(1)).alias("c"), F.min("config_order").alias("o"))
    lead = n.groupBy("item").agg(F.max_by("signal", F.struct("c", -F.col("o"))).alias("lead"), F.max("c").alias("c"), F.sum("c").alias("n"))
    stats = votes.groupBy("item").agg(F.avg("prob").alias("avg_prob"), (F.max("prob") - F.min("prob")).alias("spread"))
    out = lead.join(stats, "item")
    return out.select("item", F.when(F.col("c") >= F.floor(F.col("n") / 2) + 1, F.col("lead")).otherwise("HOLD").alias("consensus"), (F.col("c") / F.col("n")).alias("ratio"), "avg_prob", "spread")


def pipeline(signals: DataFrame, filters: list) -> DataFrame:
    """Filters in turn, each a function of a table with ``signal`` that returns it with ``filtered``; adds ``signal, changed`` (by any of them)."""
    out = signals.withColumn("__changed", F.lit(False))
    for f in filters:
        out = f(out).withColumn("__changed", F.col("__changed") | ~F.col("filtered").eqNullSafe(F.col("signal")))
        out = out.withColumn("signal", F.col("filtered")).select(*signals.columns, "__changed")
    return out.withColumnRenamed("__changed", "changed")


def unified(signals: DataFrame, source: str, confidence: Column, metadata: dict[str, Column]) -> DataFrame:
    """Signals of one model in the common form: ``date, ticker, signal, confidence, signal_source, metadata`` (a string map without nulls)."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in metadata.items()])
    return signals.select("date", "ticker", "signal", confidence.alias("confidence"), F.lit(source).alias("signal_source"), F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("metadata"))


def leaderboard(signals: DataFrame, neighbours: DataFrame, top: int, analogues: int = 5) -> DataFrame:
    """The ``top`` BUY and SELL queries by how sure they are, with their nearest analogues and those' mean distance."""
    w = Window.partitionBy("signal").orderBy(F.desc(F.abs(F.col("raw_prob") - 0.5)), "qid")
    best = signals.where(F.col("signal").isin("BUY", "SELL")).withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)
    near = neighbours.where(F.col("rank") <= analogues).join(best.select("qid"), "qid", "left_semi")
    held = near.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "tid"))), lambda x: x["tid"]).alias("analogues"), F.avg("distance").alias("avg_distance"))
    return best.join(held, "qid").select("signal", "place", "qid", "raw_prob", "analogues", "avg_distance")
