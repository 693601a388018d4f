"""Mixing sources to target weights with capped repetition.

Method. Shares follow a temperature law: the weight of a source is its wanted share times
(natural token share / wanted share) ** exponent, normalised. Exponent 0 gives the wanted
shares, 1 the natural ones; with equal wanted shares this is the usual p ** exponent. The
exponent is bisected to meet a target entropy, or to become the smallest with which a
demanded total can be supplied under the repetition limits. The weights are then realised
as budgets: a source gives whole passes over its records and one part of a pass, taken from
a seeded permutation of blocks, of which only the last block is filled record by record.

Scale. Prefix sums run over blocks (about sqrt(n) per source), not records, so a source with
a third of all rows is never sorted or held in one task; one block per source (about sqrt(n)
records) is filled in Python. Only one row per wanted source reaches the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.session import staged

MAX_SOURCES = 10_000
CLOSE = 0.0005


def weights(natural: np.ndarray, wanted: np.ndarray, exponent: float) -> np.ndarray:
    """Normalised ``wanted * (natural / wanted) ** exponent``; sources without tokens or share get 0."""
    ok = (natural > 0) & (wanted > 0)
    w = np.zeros(len(natural))
    w[ok] = np.exp((1.0 - exponent) * np.log(wanted[ok]) + exponent * np.log(natural[ok]))
    return w / w.sum() if ok.any() else w


def entropy(w: np.ndarray) -> float:
    w = w[w > 0]
    return float(-(w * np.log(w)).sum())


def largest_total(w: np.ndarray, tokens: np.ndarray, repeats: np.ndarray) -> float:
    """Tokens that can be drawn at shares ``w`` before a source exceeds its repetition limit."""
    ok = w > 0
    return float((repeats[ok] * tokens[ok] / w[ok]).min()) if ok.any() else 0.0


def exponent_for_total(natural, wanted, tokens, repeats, total: float) -> float:
    """Smallest exponent in [0, 1] with which ``total`` can be supplied; 1 if none can."""
    lo, hi = 0.0, 1.0
    if largest_total(weights(natural, wanted, 0.0), tokens, repeats) >= total:
        return 0.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if largest_total(weights(natural, wanted, mid), tokens, repeats) >= total else (mid, hi)
    return hi


def exponent_for_entropy(natural: np.ndarray, target: float) -> float:
    """Exponent of ``natural ** exponent`` whose entropy is ``target`` (clipped to [0, 16])."""
    flat = np.where(natural > 0, 1.0, 0.0)
    flat = flat / max(flat.sum(), 1.0)
    lo, hi = 0.0, 16.0  # entropy falls as the exponent grows
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if entropy(weights(natural, flat, mid)) > target else (lo, mid)
    return (lo + hi) / 2


def plan(sizes: DataFrame, targets: DataFrame, total: float | None = None, mode: str = "repetition") -> list[dict]:
    """One dict per wanted source: source, target_share, max_repeats, tokens, n, weight, budget, exponent.

    ``sizes``: source, tokens. ``targets``: source, target_share, max_repeats, at most
    MAX_SOURCES distinct sources (checked). mode="repetition": wanted shares, bent only as far as ``total``
    demands (None: the largest total at exactly the wanted shares). mode="entropy": p ** exponent
    with the entropy of the wanted shares. Sources without tokens get weight 0 and the rest
    is scaled up. A null or negative share counts as 0, a null limit as 1.
    """
    have = sizes.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    want = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    rows = [r.asDict() for r in want.join(have, "source", "left").orderBy("source").limit(MAX_SOURCES + 1).collect()]
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    tokens = np.array([float(r["tokens"] or 0) for r in rows])
    share = np.array([max(float(r["target_share"] or 0.0), 0.0) for r in rows])
    repeats = np.array([float(r["max_repeats"] if r["max_repeats"] is not None else 1) for r in rows])
    natural = tokens / tokens.sum() if tokens.sum() else tokens
    if mode == "entropy":
        flat = (natural > 0) / max(1, (natural > 0).sum())
        exponent = exponent_for_entropy(natural, entropy(share / share.sum() if share.sum() else share))
        w = weights(natural, flat, exponent)
    elif mode == "repetition":
        exponent = 0.0 if total is None else exponent_for_total(natural, share, tokens, repeats, total)
        w = weights(natural, share, exponent)
    else:
        raise ValueError("mode must be 'repetition' or 'entropy'")
    limit = largest_total(w, tokens, repeats)
    budget = w * min(limit, total if total is not None else math.inf) if limit else w * 0
    for r, wi, b in zip(rows, w, budget):
        r |= {"tokens": int(r["tokens"] or 0), "n": int(r["n"] or 0), "weight": float(wi), "budget": float(b), "exponent": float(exponent)}
    return rows


def mix(items: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 7, mode: str = "repetition") -> DataFrame:
    """Which records are used how often, with the shares really reached.

    ``items``: id, source, tokens. Rows: ``id, source, tokens, copies, target_share, reached_share,
    max_repeats``; one row per record used. Records of unlisted or null sources, and records
    without tokens, are not used. Ids may repeat (each row is a record). Budgets are met from
    below: what a block permutation leaves open, because a long record did not fit, is drawn again
    from the records that do fit, until every source is within CLOSE of its budget or nothing fits. Empty in, empty out. ``total`` and ``mode`` as for ``plan``.
    """
    spark = items.sparkSession
    clean = items.select("id", "source", F.col("tokens").cast("long").alias("tokens")).where("source is not null and tokens > 0")
    base = staged(clean, "mixbase")
    plans = plan(base.select("source", "tokens"), targets, total, mode)
    rows, rest, whole = [], {}, {r["source"]: r["budget"] for r in plans}
    for r in plans:
        if r["budget"] <= 0:
            continue
        most = int(r["max_repeats"] if r["max_repeats"] is not None else 1)
        passes = min(int(math.floor(r["budget"] / r["tokens"] + 1e-9)), most)
        rest[r["source"]] = int(r["budget"] - passes * r["tokens"] + 1e-6) if passes < most else 0
        rows.append((r["source"], float(r["target_share"] or 0), most, passes))
    limits = F.broadcast(spark.createDataFrame(rows, "source string, target_share double, max_repeats int, passes int"))  # MAX_SOURCES rows at most
    state = base.join(limits, "source").withColumn("taken", F.lit(False))
    id_type = items.schema["id"].dataType.simpleString()
    columns = ["id", "source", "tokens", "target_share", "max_repeats", "passes", "taken"]
    schema = f"id {id_type}, source string, tokens long, target_share double, max_repeats int, passes int, taken boolean"
    turn = -1
    while True:  # every round takes a record of each source for which one fits, or ends
        turn += 1
        room = spark.createDataFrame([(k, v) for k, v in rest.items() if v > 0], "source string, room long")
        can = state.join(F.broadcast(room), "source", "left").withColumn("can", F.coalesce(~F.col("taken") & (F.col("tokens") <= F.col("room")), F.lit(False)))
        counts = can.where("can").groupBy("source").agg(F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES).collect()
        if not counts:
            break
        blocks = spark.createDataFrame([(r["source"], math.ceil(math.sqrt(r["n"]))) for r in counts], "source string, blocks long")
        keyed = can.join(F.broadcast(blocks), "source", "left").withColumn(
            "block", F.when(F.col("can"), F.pmod(F.xxhash64("id", F.lit(seed + turn)), F.col("blocks"))).otherwise(-1)
        )
        spans = _spans(keyed.where("can"), seed + turn)
        placed = keyed.join(spans, ["source", "block"], "left").withColumn("edge", F.col("can") & ~F.col("inside") & (F.col("space") > 0))
        sure = placed.where("not edge").withColumn("taken", F.col("taken") | (F.col("can") & F.col("inside"))).select(columns)
        cut = placed.where("edge").withColumn("key", F.xxhash64("id", "tokens", F.lit(seed + turn + 1))).groupBy("source", "block").applyInPandas(_fill, schema)
        state = staged(sure.unionByName(cut), "mixing")
        given = {r["source"]: r["g"] for r in state.where("taken").groupBy("source").agg(F.sum("tokens").alias("g")).limit(MAX_SOURCES).collect()}
        if turn == 0:
            wanted = dict(rest)
        rest = {k: v - given.get(k, 0) for k, v in wanted.items()}
        if all(v <= CLOSE * whole[k] for k, v in rest.items()):
            break
    used = state.withColumn("copies", F.col("passes") + F.col("taken").cast("int")).where("copies > 0").drop("passes", "taken")
    reached = used.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("given"))
    share = F.broadcast(reached.withColumn("reached_share", F.col("given") / F.sum("given").over(Window.partitionBy())).select("source", "reached_share"))
    return used.join(share, "source").select("id", "source", "tokens", "copies", "target_share", "reached_share", "max_repeats")


def _spans(rows: DataFrame, seed: int) -> DataFrame:
    """Per (source, block): the space left before it in the permutation of blocks, and whether it fits whole."""
    blocks = rows.groupBy("source", "block").agg(F.sum("tokens").alias("held"), F.first("room").alias("most"))
    order = Window.partitionBy("source").orderBy(F.xxhash64("block", F.lit(seed)), "block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.withColumn("before", F.coalesce(F.sum("held").over(order), F.lit(0)))
    return before.select("source", "block", (F.col("most") - F.col("before")).alias("space"), (F.col("before") + F.col("held") <= F.col("most")).alias("inside"))


def _fill(pdf: pd.DataFrame) -> pd.DataFrame:
    """The one block that does not fit whole: records in seeded order, each taken if it still fits."""
    space = int(pdf["space"].iat[0])
    ranked = pdf.sort_values(["key", "id", "tokens"], kind="stable")
    taken = np.zeros(len(ranked), dtype=bool)
    for o, t in enumerate(ranked["tokens"].tolist()):
        if t <= space:
            taken[o], space = True, space - t
    return ranked.assign(taken=taken)[["id", "source", "tokens", "target_share", "max_repeats", "passes", "taken"]]


def shares(used: DataFrame, targets: DataFrame) -> DataFrame:
    """Every wanted source with the share it reached: ``source, target_share, reached_share, records, copies, tokens``."""
    got = used.groupBy("source").agg(
        F.count(F.lit(1)).alias("records"), F.max("copies").alias("most_copies"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.first("reached_share").alias("reached_share")
    )
    want = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    out = want.join(got, "source", "left")
    return out.select(
        "source", "target_share", F.coalesce("reached_share", F.lit(0.0)).alias("reached_share"), "max_repeats", F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
    )
