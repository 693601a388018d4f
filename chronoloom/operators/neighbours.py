"""Exact k nearest neighbours of a stated query set, in blocks.

Queries and points are hashed into blocks of at most about BLOCK and POINT_BLOCK rows; each pair of blocks is
one task that computes its distances as a matrix product and returns the k best per query,
so no task holds more than two blocks and the pairs themselves are never shuffled. A last
window merges the blocks' winners. Distances of the winners are recomputed exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.session import staged

BLOCK = 4096
POINT_BLOCK = 8192


def standardise(train: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per feature (a deviation of 0 counts as 1): one aggregate."""
    row = train.agg(*[x for c in features for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()
    return {c: (float(row[f"m_{c}"] or 0.0), float(row[f"s_{c}"] or 0.0) or 1.0) for c in features}


def standardise_array(train: DataFrame, vec: str) -> tuple[list[float], list[float]]:
    """Means and population deviations of an array column: one vector aggregate in the JVM, whatever its length."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    rows = train.where(F.col(vec).isNotNull())
    if rows.isEmpty():
        return [], []
    got = rows.select(Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(F.col(vec))).alias("s")).first()
    n = got.s["count"]
    mean, var = got.s["mean"].toArray(), got.s["variance"].toArray() * (n - 1) / n
    return mean.tolist(), [float(x) or 1.0 for x in np.sqrt(np.maximum(var, 0.0))]


def scaled_array(vec: str, mean: list[float], scale: list[float], weight: list[float] | None = None) -> Column:
    """The standardised (and weighted) array: two small higher-order functions over constant arrays."""
    factor = [(w / s) for s, w in zip(scale, weight or [1.0] * len(mean))]

    def constant(xs: list[float]) -> Column:
        return F.array(*[F.lit(float(x)) for x in xs]).cast("array<double>")

    centred = F.zip_with(F.col(vec), constant(mean), lambda x, m: x - m)
    return F.zip_with(centred, constant(factor), lambda x, w: x * w)


def scaled_columns(stats: dict[str, tuple[float, float]], weight: dict[str, float] | None = None) -> Column:
    """Feature columns as one standardised (and weighted) array."""
    w = weight or {}
    return F.array(*[(F.col(c).cast("double") - F.lit(m)) / F.lit(s) * F.lit(float(w.get(c, 1.0))) for c, (m, s) in stats.items()])


def knn_join(
    queries: DataFrame, points: DataFrame, k: int, metric: str = "l2", counts: tuple[int, int] | dict | None = None, other: str | None = None, within: str | None = None
) -> DataFrame:
    """``[within,] qid, tid, distance, rank`` of the k nearest points of each query; equal distances by lower ``tid``.

    ``queries``: qid, vec; ``points``: tid, vec (array<double>). Vectors must be equally long; rows
    with a null vector, or NaN or null in it, are left out. metric: "l2" or "cosine". ``other`` names a column
    of both sides whose values must differ (null differs from all); ``within`` one whose values must be equal: separate
    searches, such as folds, in one job. ``counts`` saves counting the two sides (with ``within`` a dict of value -> two counts).
    Fewer than k points give fewer rows; empty in, empty out.
    """
    if metric not in ("l2", "cosine"):
        raise ValueError("metric must be 'l2' or 'cosine'")
    ok = F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x))
    extra = [c for c in (within, other) if c]
    q, p = queries.select("qid", "vec", *extra).where(ok), points.select("tid", "vec", *extra).where(ok)
    if within is None:
        if counts is None:  # both sides in one job
            both = q.select(F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(p.select(F.lit(0).alias("a"), F.lit(1).alias("b")))
            counts = both.agg(F.sum("a"), F.sum("b")).first()
        q, p = (d.withColumns({"nq": F.lit(int(counts[0] or 0)), "np": F.lit(int(counts[1] or 0))}) for d in (q, p))
    else:
        if counts is None:
            sizes = q.groupBy(within).agg(F.count(F.lit(1)).alias("nq")).join(p.groupBy(within).agg(F.count(F.lit(1)).alias("np")), within)
        else:
            kind = q.schema[within].dataType.simpleString()
            sizes = q.sparkSession.createDataFrame([(v, int(a), int(b)) for v, (a, b) in counts.items()], f"{within} {kind}, nq long, np long")
        sizes = staged(sizes, "sizes")
        q, p = q.join(sizes, within), p.join(sizes, within)
    some = F.lit(8 if within is None else 2)  # some parallelism for small sides
    qb = F.greatest(F.lit(1), F.ceil(F.col("nq") / BLOCK)).cast("long")
    pb = F.greatest(F.lit(1), F.ceil(F.col("np") / POINT_BLOCK), F.least(some, F.ceil(F.col("np") / 512))).cast("long")
    qid_t, tid_t = q.schema["qid"].dataType.simpleString(), p.schema["tid"].dataType.simpleString()
    span = lambda b: F.explode(F.sequence(F.lit(0).cast("long"), b - 1))
    # a stand-in id on the side that has none
    left = q.select(*extra, F.pmod(F.xxhash64("qid"), qb).alias("i"), span(pb).alias("j"), F.lit(True).alias("asks"), F.col("qid"), F.lit(None).cast(tid_t).alias("tid"), "vec")
    right = p.select(*extra, span(qb).alias("i"), F.pmod(F.xxhash64("tid"), pb).alias("j"), F.lit(False).alias("asks"), F.lit(None).cast(qid_t).alias("qid"), "tid", "vec")
    head = [f"{within} {q.schema[within].dataType.simpleString()}"] if within else []

    def block(table: pa.Table) -> pa.Table:
        asks = table["asks"].to_numpy()
        a, b = table.filter(pa.array(asks)), table.filter(pa.array(~asks))
        x, y = _matrix(a["vec"]), _matrix(b["vec"])
        tid = b["tid"].combine_chunks()
        labels = None
        if other:
            codes = pa.concat_arrays([a[other].combine_chunks(), b[other].combine_chunks()]).dictionary_encode().indices
            codes = np.where(codes.is_valid().to_numpy(zero_copy_only=False), codes.fill_null(0).to_numpy(), -1)
            labels = codes[: len(x)], codes[len(x) :]
        qi, ti, d = _best(x, y, k, metric, tid, labels) if len(x) and len(y) else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        out = {"qid": a["qid"].combine_chunks().take(pa.array(qi)), "tid": tid.take(pa.array(ti)), "distance": pa.array(d)}
        if within:
            out = {within: table[within].combine_chunks().take(pa.array(np.zeros(len(d), dtype=np.int64)))} | out
        return pa.table(out)

    keys = [within] if within else []
    found = left.unionByName(right).groupBy(*keys, "i", "j").applyInArrow(block, ", ".join([*head, f"qid {qid_t}", f"tid {tid_t}", "distance double"]))
    w = Window.partitionBy(*keys, "qid").orderBy("distance", "tid")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Equally long vectors as the rows of a matrix, without a Python object per row."""
    lists = column.combine_chunks()
    values = lists.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(lists), -1) if len(lists) else np.empty((0, 0))


def _best(x: np.ndarray, y: np.ndarray, k: int, metric: str, tid: pa.Array, labels) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query position, point position and exact distance of the k nearest points of each query."""
    if metric == "cosine":
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        y = y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
    yy = (y * y).sum(1)
    slack = 1e-9 * (1.0 + float(yy.max()))
    order = np.argsort(pa.compute.rank(tid, "ascending", tiebreaker="first").to_numpy())  # positions by id
    y, yy = y[order], yy[order]
    found = []
    for at in range(0, len(x), 256):
        part = x[at : at + 256]
        d = part @ (-2.0 * y.T)
        d += yy
        if labels is not None:
            mine, theirs = labels[0][at : at + 256, None], labels[1][order][None, :]
            d[(mine == theirs) & (mine >= 0)] = np.inf
        n = min(k, d.shape[1])
        limit = np.partition(d, n - 1, axis=1)[:, n - 1 : n] + slack
        qi, ti = np.nonzero((d <= limit) & (d < np.inf))
        gap = part[qi] - y[ti]
        exact = np.einsum("ij,ij->i", gap, gap)
        exact = exact / 2.0 if metric == "cosine" else np.sqrt(exact)
        by = np.lexsort((ti, exact, qi))
        qi, ti, exact = qi[by], ti[by], exact[by]
        start = np.searchsorted(qi, np.arange(len(part)))
        keep = np.arange(len(qi)) - start[qi] < k
        found.append((qi[keep] + at, order[ti[keep]], exact[keep]))
    return tuple(np.concatenate(c) for c in zip(*found))


def post_filter(probe: DataFrame, keep: Column, k: int, by: list[str] = ("qid",)) -> DataFrame:
    """Of the probed neighbours those that satisfy ``keep``, the k nearest, ranked again.

    Only the probe set is seen, so fewer than k may be left although more lie farther away.
    """
    w = Window.partitionBy(*by).orderBy("distance", "tid")
    return probe.where(keep).drop("rank").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cell_search(queries: DataFrame, points: DataFrame, k: int, cells: int | None = None, probes: int = 8, sample: int = 100_000, other: str | None = None) -> DataFrame:
    """``qid, tid, distance, rank``: about the k nearest points, searched in the ``probes`` nearest of ``cells`` cells.

    Centres are ``cells`` (sqrt(n) by default) points of a sample of at most ``sample``, chosen by hash order; every
    point belongs to its nearest centre, and a query meets the points of its ``probes`` nearest ones, which are ranked exactly. What is
    lost is what lies in other cells: measure it with ``recall``. Cases as for ``knn_join``.
    """
    ok = F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x))
    extra = [other] if other else []
    p, q = staged(points.select("tid", "vec", *extra).where(ok), "points"), queries.select("qid", "vec", *extra).where(ok)
    n = p.count()
    if not n:
        return knn_join(q, p, k, counts=(0, 0))
    shared = centres(p, min(sample, cells or max(1, int(n**0.5))))
    nearest = lambda df, m: in_cells(df, shared, m).withColumn("cell", F.explode("cells")).drop("cells")
    filed, asked = staged(nearest(p, 1), "filed"), staged(nearest(q, probes), "asked")
    near = knn_join(asked, filed, k, other=other, within="cell")
    w = Window.partitionBy("qid").orderBy("distance", "tid")
    return near.drop("rank", "cell").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def centres(points: DataFrame, n: int) -> np.ndarray:
    """The vectors of n of the points (tid, vec), by hash order."""
    return _matrix(points.orderBy(F.xxhash64("tid", "vec"), "tid").limit(n).select("vec").toArrow()["vec"])


def in_cells(df: DataFrame, centre: np.ndarray, m: int) -> DataFrame:
    """Adds ``cells``, the positions of the m nearest centres of each ``vec`` (none of which may be null)."""
    shared = df.sparkSession.sparkContext.broadcast(centre)

    def run(batches):
        c = shared.value
        for b in batches:
            x = _matrix(pa.chunked_array([b.column("vec")]))
            top = min(m, len(c))
            near = np.concatenate([_nearest_centres(x[at : at + 2048], c, top) for at in range(0, len(x), 2048)]) if len(x) else np.empty((0, top), dtype=np.int64)
            cell = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * top), pa.array(near.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*b.columns, cell], names=[*b.schema.names, "cells"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, cells array<int>")


def _nearest_centres(x: np.ndarray, centres: np.ndarray, m: int) -> np.ndarray:
    d = (centres * centres).sum(1)[None, :] - 2.0 * (x @ centres.T)
    return np.argpartition(d, m - 1, axis=1)[:, :m] if m < d.shape[1] else np.tile(np.arange(d.shape[1]), (len(x), 1))


def recall(exact: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """One row: ``queries`` and ``recall``, the mean share of a query's k exact neighbours that were found."""
    want = exact.where(F.col("rank") <= k).select("qid", "tid")
    hit = want.join(found.where(F.col("rank") <= k).select("qid", "tid", F.lit(1).alias("hit")), ["qid", "tid"], "left")
    per = hit.groupBy("qid").agg((F.count("hit") / F.count(F.lit(1))).alias("share"))
    return per.agg(F.count(F.lit(1)).alias("queries"), F.avg("share").alias("recall"))


def paa(vec: str, size: int, segments: int) -> Column:
    """Means of ``segments`` pieces of an array; an uneven split makes the first pieces longer by one."""
    base, more = divmod(size, segments)
    parts, at = [], 1
    for s in range(segments):
        n = base + (s < more)
        parts.append(F.aggregate(F.slice(vec, at, n), F.lit(0.0), lambda a, x: a + x) / n)
        at += n
    return F.array(*parts)


def sax_word(means: Column, breaks: list[float]) -> Column:
    """Symbols 0..len(breaks): how many breakpoints are not above each mean."""
    return F.transform(means, lambda m: F.size(F.filter(F.array(*[F.lit(b) for b in breaks]), lambda b: b <= m)))


def sax_distance(a: Column, b: Column, breaks: list[float]) -> Column:
    """Mean breakpoint distance of two words: 0 for neighbouring symbols, else the gap between them."""
    points = F.array(*[F.lit(x) for x in breaks])

    def cell(x: Column, y: Column) -> Column:
        hi, lo = F.greatest(x, y), F.least(x, y)
        return F.when(hi - lo <= 1, 0.0).otherwise(F.element_at(points, hi) - F.element_at(points, lo + 1))

    cells = F.zip_with(a, b, cell)
    return F.aggregate(cells, F.lit(0.0), lambda s, x: s + x) / F.size(cells)


def dtw_distance(a: np.ndarray, b: np.ndarray, window: int = 2) -> np.ndarray:
    """Dynamic time warping of paired rows (Sakoe-Chiba band), vectorised over the rows.

    Squared point costs, square root at the end; the band is max(window, length difference).
    """
    n, m = a.shape[1], b.shape[1]
    w = max(window, abs(n - m))
    cost = np.full((len(a), n + 1, m + 1), np.inf)
    cost[:, 0, 0] = 0.0
    for i in range(1, n + 1):
        for j in range(max(1, i - w), min(m, i + w) + 1):
            step = np.minimum(np.minimum(cost[:, i - 1, j], cost[:, i, j - 1]), cost[:, i - 1, j - 1])
            cost[:, i, j] = (a[:, i - 1] - b[:, j - 1]) ** 2 + step
    return np.sqrt(cost[:, n, m])


def dtw(a: Column, b: Column, window: int = 2) -> Column:
    """Warped distance of two array columns (Arrow batches, vectorised over rows); NULL where either is NULL."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, index=x.index, dtype=float)
        ok = (x.notna() & y.notna()).to_numpy()
        if ok.any():
            out[ok] = dtw_distance(np.stack(x[ok].to_numpy()), np.stack(y[ok].to_numpy()), window)
        return out.astype(object).where(out.notna(), None)

    return run(a, b)


def dtw_mask(probed: DataFrame, a: str, b: str, limit: float, window: int = 2) -> DataFrame:
    """Adds ``warped`` (the warped distance of two array columns) and ``kept``, whether it is at most ``limit`` (unknown: not kept)."""
    out = probed.withColumn("warped", dtw(F.col(a), F.col(b), window))
    return out.withColumn("kept", F.coalesce(F.col("warped") <= limit, F.lit(False)))


def emd_distance(a: np.ndarray, b: np.ndarray, time_penalty: float = 0.5, price_penalty: float = 1.0) -> float:
    """Earth mover's distance of two equally long profiles as uniform point sets (lag, value).

    With equal uniform weights this is an assignment problem, solved by shortest augmenting paths.
    """
    n = len(a)
    lag = np.arange(n) * time_penalty
    cost = np.sqrt((lag[:, None] - lag[None, :]) ** 2 + ((a[:, None] - b[None, :]) * price_penalty) ** 2)
    u, v, match = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, dtype=int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        low, way, used = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int), np.zeros(n + 1, dtype=bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            free = ~used
            free[0] = False
            slack = np.full(n + 1, np.inf)
            slack[1:] = cost[i0 - 1] - u[i0] - v[1:]
            better = free & (slack < low)
            low[better], way[better] = slack[better], j0
            j1 = int(np.argmin(np.where(free, low, np.inf)))
            delta = low[j1]
            u[match[used]] += delta
            v[used] -= delta
            low[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return float(cost[match[1:] - 1, np.arange(n)].mean())


def emd(a: Column, b: Column, time_penalty: float = 0.5, price_penalty: float = 1.0) -> Column:
    """Earth mover's distance of two array columns; NULL where either is NULL."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else emd_distance(np.asarray(p, float), np.asarray(q, float), time_penalty, price_penalty) for p, q in zip(x, y)], index=x.index, dtype=object)

    return run(a, b)
