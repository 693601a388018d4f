"""Filling containers of fixed capacity with items, without splitting what fits.

Method. Items are hashed into partitions of some ITEMS_PER_PARTITION; each is packed by best
fit decreasing. Dual feasible functions give a lower bound of the containers that any
packing of a partition needs; where the packing meets it, it is certified as optimal. What a
partition uses beyond its (unrounded) bound is its gap: that many of its emptiest containers,
and one more, move to new partitions that mix several old ones, where their items are packed
again; the new packing is kept where it needs fewer containers. Rounds go on until one saves nothing.
What stays behind after an exchange is certified anew, against the bound of its own items.

An item larger than the capacity is cut into pieces of the full capacity, each with a
container of its own, and a rest that is packed like any other item.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.session import staged

ITEMS_PER_PARTITION = 20_000


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item; the fullest container into which an item fits takes it."""
    order = np.argsort(-sizes, kind="stable")
    where = np.empty(len(sizes), dtype=np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, used = 0, 0
    for i, s in zip(order.tolist(), sizes[order].tolist()):
        fits = mask >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask &= ~(1 << room)
        else:
            room, b = capacity, used
            used += 1
        where[i] = b
        left = room - s
        free[left].append(b)
        mask |= 1 << left
    return where


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Whole containers that any packing needs."""
    return int(np.ceil(round(bound(sizes, capacity), 9)))


def bound(sizes: np.ndarray, capacity: int, counts: np.ndarray | None = None) -> float:
    """Containers that any packing needs, unrounded: the best of several dual feasible functions.

    With ``counts``, ``sizes`` are distinct and each occurs so many times.

    Total size; the rounding functions of order 1..30; and, for thresholds t up to half the
    capacity, the function that counts items above capacity - t as whole containers and drops
    those below t.
    """
    if not len(sizes):
        return 0.0
    size, times = np.unique(sizes, return_counts=True) if counts is None else (np.asarray(sizes), np.asarray(counts))
    size, times = size[size > 0].astype(np.int64), times[size > 0]
    if not len(size):
        return 1.0
    best = int((size * times).sum()) / capacity
    for k in range(1, 31):
        scaled = size * (k + 1)
        # in units of 1/(capacity k): whole multiples keep their size
        value = np.where(scaled % capacity == 0, size * k, (scaled // capacity) * capacity)
        best = max(best, int((value * times).sum()) / (capacity * k))
    for t in np.unique(size[size * 2 <= capacity])[:: max(1, len(size) // 200)]:
        value = np.where(size > capacity - t, capacity, np.where(size < t, 0, size))
        best = max(best, int((value * times).sum()) / capacity)
    return best


_PACKED = "pack_kind string, capacity_tokens int, part long, bin long, doc_id {id}, piece int, tokens long, used long, gap long, moves boolean"


def pack(
    items: DataFrame, containers: list[tuple[str, int]], id_col: str = "doc_id", size_col: str = "tokens", per_partition: int = ITEMS_PER_PARTITION
) -> DataFrame:
    """Assign every item to a container of each kind.

    Rows: ``pack_kind, capacity_tokens, bin_id, <id_col>, piece, start_token, tokens, bin_tokens,
    certified``. ``piece`` is 0 for the first or only piece; ``certified`` says that the
    container's partition provably needs as many containers as it has. Items of size null or
    0 take no space and go into some container; ids may repeat (each row is an item); items equal in
    size are interchangeable. Empty items or no containers give an empty result. A capacity below 1 is an error.
    """
    if any(c < 1 for _, c in containers):
        raise ValueError("capacities must be at least 1")
    spark = items.sparkSession
    id_type = items.schema[id_col].dataType.simpleString()
    schema = _PACKED.format(id=id_type)
    base = items.select(F.col(id_col).alias("doc_id"), F.greatest(F.coalesce(F.col(size_col).cast("long"), F.lit(0)), F.lit(0)).alias("size"))
    base = staged(base, "items")  # row numbers below are then the same in every attempt of a task
    if not containers:
        return spark.createDataFrame([], f"pack_kind string, capacity_tokens int, bin_id string, {id_col} {id_type}, piece int, start_token long, tokens long, bin_tokens long, certified boolean")
    kinds = F.array(*[F.struct(F.lit(k).alias("pack_kind"), F.lit(int(c)).alias("capacity_tokens")) for k, c in containers])
    each = base.withColumn("c", F.explode(kinds)).select("doc_id", "size", "c.*")
    whole = F.floor(F.col("size") / F.col("capacity_tokens")).cast("int")
    over = each.where("size > capacity_tokens").withColumn("piece", F.explode(F.sequence(F.lit(0), whole - 1)))
    alone = over.select(
        "pack_kind", "capacity_tokens", F.lit(-1).cast("long").alias("part"),
        F.monotonically_increasing_id().alias("bin"), "doc_id", "piece",
        F.col("capacity_tokens").cast("long").alias("tokens"), F.col("capacity_tokens").cast("long").alias("used"), F.lit(0).cast("long").alias("gap"), F.lit(False).alias("moves"),
    )
    rest = each.select(
        "pack_kind", "capacity_tokens", "doc_id",
        F.when(F.col("size") > F.col("capacity_tokens"), whole).otherwise(0).alias("piece"),
        F.when(F.col("size") > F.col("capacity_tokens"), F.col("size") % F.col("capacity_tokens")).otherwise(F.col("size")).alias("tokens"),
        (F.col("size") > F.col("capacity_tokens")).alias("cut"),
    ).where("tokens > 0 or not cut").drop("cut")
    n = base.count()
    parts = max(1, -(-n // per_partition))
    at = rest.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(parts)))

    def fresh(pdf: pd.DataFrame) -> pd.DataFrame:
        return _packed(pdf, int(pdf["part"].iat[0]))

    done = staged(at.groupBy("pack_kind", "capacity_tokens", "part").applyInPandas(fresh, schema), "packing")
    turn, saved = 0, 1
    while saved:
        turn += 1
        moving = F.col("moves")
        stats = done.where(moving).groupBy("pack_kind").agg(F.count(F.lit(1)).alias("c"), F.count_distinct("part").alias("p"), F.count_distinct("part", "bin").alias("b")).collect()
        if all(r["p"] < 2 for r in stats):
            break
        # whole containers move, to fewer partitions than they came from
        target = {r["pack_kind"]: max(1, min(-(-r["c"] // per_partition), r["p"] - 1)) for r in stats}
        to = F.element_at(F.create_map(*[x for k, v in target.items() for x in (F.lit(k), F.lit(v))]), F.col("pack_kind"))
        moved = done.where(moving).withColumn("to", F.pmod(F.xxhash64("part", "bin", F.lit(turn)), to))
        again = staged(moved.groupBy("pack_kind", "capacity_tokens", "to").applyInPandas(_repacked(turn * (parts + 1)), schema + ", saved long"), "repacked")
        saved = again.agg(F.sum("saved")).first()[0]  # per group, on one of its rows
        done = staged(done.where(~moving).unionByName(again.drop("saved")), "packing")
    return done.unionByName(alone).select(
        "pack_kind", "capacity_tokens", F.concat_ws("-", "part", F.hex("bin")).alias("bin_id"), F.col("doc_id").alias(id_col), "piece",
        (F.col("piece") * F.col("capacity_tokens")).cast("long").alias("start_token"), "tokens", F.col("used").alias("bin_tokens"), (F.col("gap") == 0).alias("certified"),
    )


def _repacked(base_part: int):
    """Pack moved containers again; the old packing stays where the new one needs as many containers."""

    def again(pdf: pd.DataFrame) -> pd.DataFrame:
        new = _packed(pdf, base_part + int(pdf["to"].iat[0]))
        old = len(pdf[["part", "bin"]].drop_duplicates())
        n = new["bin"].nunique()
        if n >= old:
            least = lower_bound(pdf["tokens"].to_numpy(dtype=np.int64), int(pdf["capacity_tokens"].iat[0]))
            new = pdf[new.columns].assign(gap=old - least)
        saved = np.zeros(len(new), dtype=np.int64)
        saved[0] = max(old - n, 0)
        return new.assign(saved=saved)

    return again


def _packed(pdf: pd.DataFrame, part: int) -> pd.DataFrame:
    sizes, capacity = pdf["tokens"].to_numpy(dtype=np.int64), int(pdf["capacity_tokens"].iat[0])
    where = best_fit_decreasing(sizes, capacity)
    n = int(where.max()) + 1
    used = np.bincount(where, weights=sizes, minlength=n).astype(np.int64)
    least = bound(sizes, capacity)
    spare = n - least
    moves, gap = np.zeros(n, dtype=bool), np.full(n, n - int(np.ceil(round(least, 9))))
    if spare > 1e-9:
        moves[np.argsort(used, kind="stable")[: int(np.ceil(spare)) + 1]] = True
        # if those leave, the others are judged by their own items
        stay = ~moves
        gap[stay] = min(gap[0], int(stay.sum()) - lower_bound(sizes[stay[where]], capacity))
    return pd.DataFrame(
        {
            "pack_kind": pdf["pack_kind"].to_numpy(), "capacity_tokens": capacity, "part": part, "bin": where, "doc_id": pdf["doc_id"].to_numpy(), "piece": pdf["piece"].to_numpy(),
            "tokens": sizes, "used": used[where], "gap": gap[where], "moves": moves[where],
        }
    )


def report(packed: DataFrame) -> DataFrame:
    """Per kind: containers, tokens, fill and the least number that any packing of all items needs.

    The bound is that of the dual feasible functions over the whole input: sizes are counted first, so
    one kind is at most one row per size up to its capacity.
    """
    bins = packed.groupBy("pack_kind", "capacity_tokens", "bin_id").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("c"), F.min("certified").alias("certified"))
    agg = bins.groupBy("pack_kind", "capacity_tokens").agg(
        F.count(F.lit(1)).alias("containers"), F.count_if("certified").alias("certified"), F.sum("c").alias("pieces"), F.sum("t").alias("tokens"), F.max("t").alias("fullest")
    )

    def least(pdf: pd.DataFrame) -> pd.DataFrame:
        n = bound(pdf["tokens"].to_numpy(dtype=np.int64), int(pdf["capacity_tokens"].iat[0]), pdf["count"].to_numpy(dtype=np.int64))
        return pd.DataFrame({"pack_kind": [pdf["pack_kind"].iat[0]], "least_containers": [int(np.ceil(round(n, 9)))]})

    sizes = packed.groupBy("pack_kind", "capacity_tokens", "tokens").count()
    bounds = sizes.groupBy("pack_kind").applyInPandas(least, "pack_kind string, least_containers long")
    return agg.join(bounds, "pack_kind").withColumn("fill", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))
