"""The analogue query as one lazy plan: scale, probe, filter, vote, signal."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.operators import neighbours as nb
from chronoloom.operators import scan
from chronoloom.operators.vote import signal, vote, vote_listed


@dataclass(frozen=True)
class AnalogueConfig:
    """Parameters of a query; the probe sees ``probe * top_k`` neighbours before the filters.

    ``cells`` above 0 searches approximately, in the ``cell_probes`` nearest of so many cells; 0 searches exactly.
    """

    top_k: int = 50
    max_distance: float = 4.5
    probe: int = 3
    weighting: str = "uniform"
    exclude_same_ticker: bool = True
    same_sector_only: bool = False
    regime_only: bool = False
    sector_boost: float = 1.0
    threshold: float = 0.55
    spread: float = 0.05
    min_matches: int = 5
    cells: int = 0
    cell_probes: int = 8
    feature_weights: dict = field(default_factory=dict)


def probe(train: DataFrame, query: DataFrame, config: AnalogueConfig) -> DataFrame:
    """The probe set with both sides' attributes: the table that sweeps can filter again and again.

    ``train``: tid, vec, ticker, sector, regime, label, fwd_return; ``query``: qid, vec, ticker, sector, regime.
    """
    q, t, k = query.select("qid", "vec"), train.select("tid", "vec"), config.probe * config.top_k
    near = nb.cell_search(q, t, k, config.cells, config.cell_probes) if config.cells else nb.knn_join(q, t, k)
    t = train.select("tid", F.col("ticker").alias("t_ticker"), F.col("sector").alias("t_sector"), F.col("regime").alias("t_regime"), "label", "fwd_return")
    q = query.select("qid", F.col("ticker").alias("q_ticker"), F.col("sector").alias("q_sector"), F.col("regime").alias("q_regime"))
    both = near.join(t, "tid").join(q, "qid")
    return both.withColumn("same_sector", F.coalesce(F.col("t_sector") == F.col("q_sector"), F.lit(False)))


def keep_rule(config: AnalogueConfig) -> Column:
    """Which probed neighbours count."""
    keep = F.col("distance") <= config.max_distance
    if config.exclude_same_ticker:
        keep = keep & (F.col("t_ticker") != F.col("q_ticker"))
    if config.same_sector_only:
        keep = keep & F.col("same_sector")
    if config.regime_only:
        keep = keep & (F.col("t_regime") == F.col("q_regime"))
    return keep


def matched(probed: DataFrame, config: AnalogueConfig) -> DataFrame:
    """The neighbours that pass the filters, the top_k nearest of each query."""
    return nb.post_filter(probed, keep_rule(config), config.top_k)


PAYLOAD = ["ticker", "sector", "regime", "label", "fwd_return"]


def answered(queries: DataFrame, points: DataFrame, config: AnalogueConfig, **options) -> DataFrame:
    """The queries' columns but the vector, with ``raw_prob, mean_return, n_matches, ensemble``: probe, filters and vote on one row per query.

    ``queries``: ticker, sector, regime, vec and any others; ``points``: a table written by ``scan.filed`` (tid, vec and PAYLOAD). Answers as ``query`` does, without a join.
    """
    near = scan.near(queries, points, config.probe * config.top_k, PAYLOAD, **options)

    def keep(x: Column) -> Column:
        rule = x["distance"] <= config.max_distance
        if config.exclude_same_ticker:
            rule = rule & (x["ticker"] != F.col("ticker"))
        if config.same_sector_only:
            rule = rule & (x["sector"] == F.col("sector"))
        if config.regime_only:
            rule = rule & (x["regime"] == F.col("regime"))
        return rule

    kept = near.withColumn("near", F.slice(F.filter("near", keep), 1, config.top_k))
    return vote_listed(kept, "near", config.weighting, config.sector_boost).drop("near")


def query(train: DataFrame, queries: DataFrame, config: AnalogueConfig, probed: DataFrame | None = None) -> DataFrame:
    """``qid, raw_prob, mean_return, n_matches, ensemble, signal, reason`` of every query."""
    near = matched(probed if probed is not None else probe(train, queries, config), config)
    won = vote(queries.select("qid"), near, config.weighting, config.sector_boost)
    side, why = signal(F.col("raw_prob"), F.col("n_matches"), config.threshold, config.spread, config.min_matches)
    return won.withColumns({"signal": side, "reason": why})
