"""Percentiles of very large columns by merging centroid digests.

Method. The values of a group are sorted and clustered under a size function of the
quantile: a cluster around quantile q may hold at most ``4 n q (1-q) / compression`` values
(one at least), so clusters are fine at the tails. Digests are built where the rows lie, one
per input partition and group (and per any finer key the caller wants to keep, such as a
day), and merged by re-clustering the union of their centroids. Merging is salted: a
key's digests are spread over ``SALTS`` tasks, each of which folds them ``FAN_IN`` at a time.

Error. A cluster built from sorted values spans disjoint ranges, so at any value at most one
cluster per digest straddles it: that costs at most ``1/compression`` of the ranks, and each
merge level at most as much again. ``certify`` counts, in a second pass over the data, the
ranks that each estimate really has, so every reported estimate carries its true rank error.
``percentiles`` repeats groups whose certified error exceeds the stated bound with a four
times finer digest until none is left: the error falls with the compression, and a digest of as many
clusters as a group has distinct values is exact.
"""

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoloom.session import staged

FAN_IN = 64
FLUSH_VALUES = 500_000
MAX_BROADCAST_ESTIMATES = 100_000
SALTS = 32

DIGEST = "means array<double>, weights array<double>, n double, low double, high double"


def cluster(means: np.ndarray, weights: np.ndarray, compression: float) -> tuple[np.ndarray, np.ndarray]:
    """Cluster sorted weighted values; greedy from the left under the size function.

    A cluster is closed when adding the next centroid would push its weight over
    ``4 n q (1 - q) / compression`` at the quantile of its middle. Equal values may always
    share a cluster: they cost no rank error.
    """
    if means.size <= 1:
        return means, weights
    order = np.argsort(means, kind="stable")
    means, weights = means[order], weights[order]
    # equal values first: one centroid each, exact
    starts = np.flatnonzero(np.concatenate(([True], means[1:] != means[:-1])))
    weights = np.add.reduceat(weights, starts)
    means = means[starts]
    if means.size <= compression // 2:
        return means, weights
    total = weights.sum()
    upto = np.cumsum(weights)
    out_m, out_w = [], []
    i, done, k = 0, 0.0, means.size
    while i < k:
        # largest j such that the weight of i..j stays within the limit at its middle quantile
        q = min(1.0, (done + 0.5 * weights[i]) / total)
        limit = max(4.0 * total * q * (1.0 - q) / compression, 0.0)
        j = int(np.searchsorted(upto, done + limit, side="right")) - 1
        j = max(j, i)
        if j > i:  # the limit shrinks beyond the median: check it at the end as well
            q = min(1.0, upto[j] / total)
            tail = 4.0 * total * q * (1.0 - q) / compression
            if tail < limit:
                j = max(i, int(np.searchsorted(upto, done + tail, side="right")) - 1)
        if j == i:
            out_m.append(means[i])
            out_w.append(weights[i])
        else:
            w = weights[i : j + 1]
            s = w.sum()
            out_m.append(min(max(float(np.dot(means[i : j + 1] / s, w)), means[i]), means[j]))
            out_w.append(s)
        done = upto[j]
        i = j + 1
    return np.asarray(out_m), np.asarray(out_w)


def quantile(means: np.ndarray, weights: np.ndarray, low: float, high: float, q: float, compression: float = 400) -> float:
    """The value at rank ``q * n``: exact for single values, interpolated between centroids.

    A centroid heavier than the size function allows can only hold equal values: it is exact as well.
    """
    n = weights.sum()
    target = q * n
    if target <= 0:
        return float(low)
    if target >= n:
        return float(high)
    upto = np.cumsum(weights)
    i = int(np.searchsorted(upto, target, side="left"))
    share = (upto[i] - weights[i] / 2.0) / n
    edges = [(upto[i] - weights[i]) / n, share, upto[i] / n]
    if weights[i] <= 1.0 or weights[i] > 4.0 * n * max(x * (1.0 - x) for x in edges) / compression:
        return float(means[i])
    middle = upto - weights / 2.0
    if target <= middle[0]:
        a, b, x, y = 0.0, middle[0], low, means[0]
    elif target >= middle[-1]:
        a, b, x, y = middle[-1], n, means[-1], high
    else:
        j = int(np.searchsorted(middle, target, side="right"))
        a, b, x, y = middle[j - 1], middle[j], means[j - 1], means[j]
    if x == y or b <= a:
        return float(x)
    t = (target - a) / (b - a)
    return float(x * (1.0 - t) + y * t)


def usable(value: Column) -> Column:
    """True for values that count: neither null nor NaN, infinite or negative."""
    v = value.cast("double")
    return v.isNotNull() & ~F.isnan(v) & (v >= 0.0) & (v < F.lit(float("inf")))


def _digest_schema(df: DataFrame, keys: list[str]) -> T.StructType:
    fields = [df.schema[k] for k in keys]
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in fields] + list(T._parse_datatype_string(DIGEST)))


def _key_tuple(row) -> tuple:
    return tuple(None if pd.isna(v) else v for v in row)


def build(df: DataFrame, keys: list[str], value: str, compression: int = 400) -> DataFrame:
    """One digest per input partition and key: ``keys..., means, weights, n, low, high``.

    No shuffle. ``value`` must hold usable numbers only (filter with ``usable``). A task holds
    at most ``FLUSH_VALUES`` raw values; beyond that it emits the digests it has and begins
    new ones, so neither a huge group nor very many groups fill its memory. Null keys are a
    group of their own. Empty in, empty out.
    """
    schema = _digest_schema(df, keys)

    def emit(held: dict):
        rows = []
        for k, parts in held.items():
            v = np.concatenate(parts)
            m, w = cluster(v, np.ones(v.size), compression)
            rows.append((*k, m.tolist(), w.tolist(), float(v.size), float(v.min()), float(v.max())))
        return pd.DataFrame(rows, columns=[f.name for f in schema.fields])

    def run(batches):
        held: dict = {}
        size = 0
        for pdf in batches:
            if not len(pdf):
                continue
            values = pdf[value].to_numpy(dtype=float)
            for k, at in _runs(pdf, keys):
                held.setdefault(k, []).append(values[at])
            size += values.size
            if size >= FLUSH_VALUES:
                yield emit(held)
                held, size = {}, 0
        if held:
            yield emit(held)

    return df.select(*keys, F.col(value).cast("double").alias(value)).mapInPandas(run, schema)


def _runs(pdf: pd.DataFrame, keys: list[str]):
    """The distinct keys of a batch (null is a key) with the positions of their rows."""
    if not keys:
        yield (), slice(None)
        return
    codes = np.zeros(len(pdf), dtype=np.int64)
    for c in keys:
        part, names = pd.factorize(pdf[c])
        codes = codes * (len(names) + 1) + part + 1
    order = np.argsort(codes, kind="stable")
    ranked = codes[order]
    cuts = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    for a, b in zip(cuts, [*cuts[1:], len(codes)]):
        yield _key_tuple(pdf[c].iat[order[a]] for c in keys), order[a:b]


def merge(digests: DataFrame, keys: list[str], compression: int = 400, levels: int = 2) -> DataFrame:
    """Digests of the same key merged into one by re-clustering.

    ``levels`` - 1 salted rounds shrink many digests per key before the last one; each task of
    a round meets what its salt received, in batches, never all digests of a key at once.
    Works on any digests of ``build`` or ``merge``, for instance those kept per day or file.
    """
    schema = _digest_schema(digests, keys)

    def combine(key, parts):
        """Fold the digests in batches: memory stays at FAN_IN digests whatever the key holds."""
        m, w, low, high = np.empty(0), np.empty(0), np.inf, -np.inf
        for pdf in parts:
            for at in range(0, len(pdf), FAN_IN):
                chunk = pdf.iloc[at : at + FAN_IN]
                m, w = cluster(
                    np.concatenate([m, *map(np.asarray, chunk["means"])]), np.concatenate([w, *map(np.asarray, chunk["weights"])]), compression
                )
                low, high = min(low, chunk["low"].min()), max(high, chunk["high"].max())
        yield pd.DataFrame([(*_key_tuple(key[: len(keys)]), m.tolist(), w.tolist(), float(w.sum()), float(low), float(high))], columns=[f.name for f in schema.fields])

    out = digests.select(*keys, "means", "weights", "n", "low", "high")
    for _ in range(max(0, levels - 1)):
        salted = out.withColumn("__salt", F.pmod(F.xxhash64("n", "low", "high", "means"), F.lit(SALTS)).cast("int"))
        out = _grouped(salted, [*keys, "__salt"], combine, schema)
    return _grouped(out, keys, combine, schema)


def _grouped(df: DataFrame, by: list[str], combine, schema: T.StructType) -> DataFrame:
    if not by:
        df, by = df.withColumn("__all", F.lit(0)), ["__all"]

    def run(key: tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from combine(key, batches)

    return df.groupBy(*by).applyInPandas(run, schema)


def estimates(digests: DataFrame, keys: list[str], probs: list[float], compression: int = 400) -> DataFrame:
    """``keys..., prob, estimate, n`` for each probability, from merged digests."""
    fields = [digests.schema[k] for k in keys]
    schema = T.StructType([*fields, *T._parse_datatype_string("prob double, estimate double, n double")])

    def run(batches):
        for pdf in batches:
            rows = []
            for *k, m, w, n, low, high in pdf.itertuples(index=False, name=None):
                m, w = np.asarray(m), np.asarray(w)
                rows += [(*_key_tuple(k), p, quantile(m, w, low, high, p, compression), float(n)) for p in probs]
            yield pd.DataFrame(rows, columns=schema.fieldNames())

    return digests.select(*keys, "means", "weights", "n", "low", "high").mapInPandas(run, schema)


def certify(df: DataFrame, keys: list[str], value: str, est: DataFrame) -> DataFrame:
    """Count the true ranks of each estimate: adds ``n_below, n_upto, rank_error``.

    ``rank_error`` is the distance of the wanted rank ``prob * n`` from the ranks that the
    estimate really covers (values below it .. values up to it), as a share of n. The pass
    reads the key and value columns once. The estimates are broadcast if there are at most
    MAX_BROADCAST_ESTIMATES groups (counted first); beyond that rows and estimates are joined
    on key and salt, so a hot key is spread over SALTS tasks.
    """
    per = est.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("estimate", "prob", "n"))).alias("__est"))
    n_groups = per.count()
    names = {k: f"__k_{i}" for i, k in enumerate(keys)}
    per = per.withColumnsRenamed(names)
    rows = df.select(*keys, F.col(value).cast("double").alias("__v"))
    same = F.lit(True)
    for k, n in names.items():
        same = same & rows[k].eqNullSafe(per[n])
    if n_groups <= MAX_BROADCAST_ESTIMATES:
        joined = rows.join(F.broadcast(per), same) if keys else rows.crossJoin(F.broadcast(per))
    else:
        rows = rows.withColumn("__s", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
        per = per.withColumn("__s2", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        same = rows["__s"] == per["__s2"]
        for k, n in names.items():
            same = same & rows[k].eqNullSafe(per[n])
        joined = rows.join(per, same)
    # position of a value among its group's estimates: how many lie below it and how many up to it
    gt = F.aggregate("__est", F.lit(0), lambda a, e: a + (F.col("__v") > e["estimate"]).cast("int"))
    ge = F.aggregate("__est", F.lit(0), lambda a, e: a + (F.col("__v") >= e["estimate"]).cast("int"))
    counted = joined.select(*keys, gt.alias("__gt"), ge.alias("__ge")).groupBy(*keys, "__gt", "__ge").agg(F.count(F.lit(1)).alias("__c"))
    hist = counted.withColumnsRenamed(names)
    ranked = est.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("estimate", "prob", "n"))).alias("__est")).select(
        *keys, F.posexplode("__est").alias("__i", "__e")
    )
    on = F.lit(True)
    for k, n in names.items():
        on = on & ranked[k].eqNullSafe(hist[n])
    full = ranked.join(hist, on) if keys else ranked.crossJoin(F.broadcast(hist))
    n, p = F.col("n"), F.col("prob")
    out = full.groupBy(*keys, "__i", "__e").agg(
        F.coalesce(F.sum(F.when(F.col("__ge") <= F.col("__i"), F.col("__c"))), F.lit(0)).alias("n_below"),
        F.coalesce(F.sum(F.when(F.col("__gt") <= F.col("__i"), F.col("__c"))), F.lit(0)).alias("n_upto"),
    )
    return out.select(*keys, "__e.prob", "__e.estimate", "__e.n", "n_below", "n_upto").withColumn(
        "rank_error", F.greatest(F.col("n_below") - p * n, p * n - F.col("n_upto"), F.lit(0.0)) / n
    )


def percentiles(
    df: DataFrame, keys: list[str], value: str, probs: list[float], max_rank_error: float = 0.005, compression: int = 400,
    within: list[str] | None = None,
) -> DataFrame:
    """Percentiles per key with a certified rank error of at most ``max_rank_error``.

    Rows: ``keys..., prob, estimate, n, n_below, n_upto, rank_error``. Values that are not
    ``usable`` do not count; a key without usable values has no row; a null key is a group;
    every row counts, repeated ones too. ``within`` names finer columns (a day) by which the
    digests are built and could be kept before they are merged.
    """
    rows = df.where(usable(F.col(value))).select(*keys, *(within or []), F.col(value).cast("double").alias(value))
    found = None
    todo, fine = rows, compression
    while True:
        parts = build(todo, [*keys, *(within or [])], value, fine)
        if within:
            parts = merge(parts, [*keys, *within], fine, levels=1)
        est = estimates(merge(parts, keys, fine), keys, probs, fine)
        checked = staged(certify(todo, keys, value, staged(est, "estimates")), "certified")
        names = [f"__b{i}" for i in range(len(keys))]
        bad = checked.where(F.col("rank_error") > max_rank_error).select(*[F.col(k).alias(n) for k, n in zip(keys, names)]).distinct()
        if bad.isEmpty():
            return checked if found is None else found.unionByName(checked)
        on = F.lit(True)
        for k, n in zip(keys, names):
            on = on & F.col(k).eqNullSafe(F.col(n))
        good = checked.join(bad, on, "left_anti")
        found = good if found is None else found.unionByName(good)
        todo, fine = todo.join(bad, on, "left_semi"), fine * 4
