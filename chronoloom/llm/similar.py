"""Most similar vectors by a permutation index.

Method. Pivots are a bounded sample of the distinct vectors. Each vector is represented by
its ``m`` nearest pivots in order (its permutation) and posted in the inverted files of
pivots. A query is looked up in the files of its own nearest pivots; what it meets there is
ranked by the true distance, within a radius after a cut by Spearman's footrule between the two
permutations.

Two searches share the index:

* ``neighbours_within`` finds the k nearest within a radius without loss. A vector is posted
  under every pivot not farther than its nearest plus twice the radius, so by the triangle
  inequality it is met by every query within the radius; and a footrule cutoff is derived for
  each query from the pivots whose order a point within the radius could exchange.
* ``neighbours`` finds the k nearest at any distance, with a loss that depends on ``posts`` and
  ``probes``: all points that are met are ranked, however many (README: measured recall).

Equal vectors are one point of the index that keeps, per other-label rule, the 2k rows that
can still matter, so a group of copies costs one point however many rows it has. A file with
more than BLOCK points is processed in blocks of at most BLOCK x BLOCK points; no task holds
more. Nothing is collected to the driver but the pivots (at most MAX_PIVOTS vectors) and counts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.session import staged

BLOCK = 4096
PAIRS = 1 << 20
MAX_PIVOTS = 8192
ORDERED = 4
SLACK = 1e-9


def points(df: DataFrame, row_id: Column, label: Column, features: list[str]) -> DataFrame:
    """``row_id, label, vec, h, h2`` of the rows whose features are all finite numbers.

    ``h, h2`` are 128 bits that stand for the vector wherever rows are grouped or joined by it.
    """
    ok = F.lit(True)
    for c in features:
        v = F.col(f"`{c}`").cast("double")
        ok = ok & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    # adding 0.0 turns -0.0 into 0.0, so that equal vectors hash alike
    vec = F.array(*[F.col(f"`{c}`").cast("double") + F.lit(0.0) for c in features])
    rows = df.where(ok & row_id.isNotNull() & label.isNotNull()).select(row_id.alias("row_id"), label.alias("label"), vec.alias("vec"))
    return rows.withColumns({"h": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(1), "vec")})


def distinct_points(rows: DataFrame, k: int) -> DataFrame:
    """``vid, h, h2, vec, ids, labels``: each distinct vector with the rows that can be among anyone's k nearest.

    A row can only matter while fewer than k rows of its label and fewer than 2k rows in all
    precede it (by row id); window limits prune both before their shuffle.
    """
    slim = rows.select("row_id", "label", "h", "h2")
    per_label = slim.withColumn("k1", F.row_number().over(Window.partitionBy("h", "h2", "label").orderBy("row_id"))).where(F.col("k1") <= k)
    kept = per_label.withColumn("k2", F.row_number().over(Window.partitionBy("h", "h2").orderBy("row_id"))).where(F.col("k2") <= 2 * k)
    listed = kept.groupBy("h", "h2").agg(F.array_sort(F.collect_list(F.struct("row_id", "label"))).alias("held"))
    vectors = rows.groupBy("h", "h2").agg(F.first("vec").alias("vec"))
    return listed.join(vectors, ["h", "h2"]).select(F.col("held")[0]["row_id"].alias("vid"), "h", "h2", "vec", F.col("held.row_id").alias("ids"), F.col("held.label").alias("labels"))


def fit_pivots(index: DataFrame, n: int) -> np.ndarray:
    """A sample of 3 sqrt(n) of the n distinct vectors (8 at least, MAX_PIVOTS at most), by hash order."""
    size = min(MAX_PIVOTS, max(8, math.ceil(3 * math.sqrt(max(n, 1)))))
    got = index.orderBy("h", "vid").limit(size).select("vec").collect()
    return np.array([r[0] for r in got], dtype=float)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.maximum(d, 0.0, out=d)


def _permute(index: DataFrame, pivots, columns: str, posting) -> DataFrame:
    """Add ``perm`` (ordered nearest pivots), ``home`` (the nearest), ``posts`` and ``cutoff``."""
    shared = index.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        p = shared.value
        m = min(ORDERED, len(p))
        wide = min(m + 8, len(p))
        for batch in batches:
            vec, perms, posts, cuts = _matrix(batch.column("vec")), [], [], []
            for at in range(0, len(vec), 1024):
                d = _squared(vec[at : at + 1024], p)  # the root is taken of the nearest only
                near = np.argpartition(d, wide - 1, axis=1)[:, :wide] if wide < len(p) else np.tile(np.arange(len(p)), (len(d), 1))
                dn = np.sqrt(np.take_along_axis(d, near, 1))
                order = np.argsort(dn, axis=1, kind="stable")
                near, dn = np.take_along_axis(near, order, 1).astype(np.int32), np.take_along_axis(dn, order, 1)
                listed, cut = posting(d, near, dn, m)
                perms.append(near[:, :m])
                posts += listed
                cuts.append(cut)
            if not len(vec):
                continue
            perm = np.concatenate(perms)
            more = [_lists([m] * len(perm), perm.ravel()), pa.array(np.ascontiguousarray(perm[:, 0])), _lists([len(x) for x in posts], np.concatenate(posts)), pa.array(np.concatenate(cuts))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "perm", "home", "posts", "cutoff"])

    schema = f"{columns}, perm array<int>, home int, posts array<int>, cutoff int"
    return index.mapInArrow(run, schema)


def _lists(lengths: list[int], values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), pa.array(values))


def _within(radius: float):
    """Postings and footrule cutoffs that lose nothing within ``radius``."""
    reach = 2.0 * radius + SLACK + 1e-7

    def posting(d, near, dn, m):
        # how many ranks a pivot can move: the pivots that may change order with it
        moved = (np.abs(dn[:, :, None] - dn[:, None, :]) <= reach).sum(axis=2) - 1
        cut = np.where(dn <= dn[:, m - 1 : m] + reach, np.minimum(moved, m), 0).sum(axis=1).astype(np.int32)
        in_reach = (dn <= dn[:, :1] + reach).sum(axis=1)
        posts = [ids[:n] for ids, n in zip(near, in_reach)]
        if near.shape[1] < d.shape[1]:
            for i in np.flatnonzero(dn[:, -1] <= dn[:, m - 1] + 2 * reach):  # more pivots in reach than were sorted
                far = np.sqrt(d[i])
                ids = np.flatnonzero(far <= dn[i, m - 1] + 2 * reach)
                row = far[ids]
                ids, row = ids[np.argsort(row, kind="stable")], np.sort(row)
                posts[i] = ids[row <= row[0] + reach].astype(np.int32)
                moved_i = np.searchsorted(row, row + reach, side="right") - np.searchsorted(row, row - reach, side="left") - 1
                cut[i] = int(np.minimum(moved_i, m)[row <= row[m - 1] + reach].sum())
        return posts, cut

    return posting


def _nearest(posts: int):
    def posting(d, near, dn, m):
        return list(near[:, :posts]), np.zeros(len(d), dtype=np.int32)

    return posting


def _unary(perms: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Permutations as 0/1 rows such that a dot product is the sum of min(m - rank) over shared pivots."""
    m = perms.shape[1]
    out = np.zeros((len(perms), len(names) * m), dtype=np.float32)
    col = np.searchsorted(names, perms) * m
    r = np.arange(len(perms))
    for rank in range(m):
        for t in range(m - rank):
            out[r, col[:, rank] + t] = 1.0
    return out


def _keep(q, d, ids, labels, k):
    """Positions of the rows that matter per query: k per label (a code) and 2k in all, by (distance, id)."""
    order = np.lexsort((ids, d, q))
    q1, l1 = q[order], labels[order]
    by = np.lexsort((np.arange(len(order)), l1, q1))
    same = np.concatenate(([False], (q1[by][1:] == q1[by][:-1]) & (l1[by][1:] == l1[by][:-1])))
    ok = np.empty(len(order), dtype=bool)
    ok[by] = _running(same) < k
    order, q1 = order[ok], q1[ok]
    same = np.concatenate(([False], q1[1:] == q1[:-1])) if len(q1) else np.empty(0, dtype=bool)
    return order[_running(same) < 2 * k]


def _running(same: np.ndarray) -> np.ndarray:
    """0, 1, 2 ... within each run (a run begins where ``same`` is False)."""
    at = np.arange(len(same))
    return at - np.maximum.accumulate(np.where(same, 0, at)) if len(same) else at


def _array(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Equally long lists as the rows of a matrix, without a Python object per row."""
    lists = _array(column)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _search(postings: DataFrame, k: int, radius: float | None, id_type: str, label_type: str) -> DataFrame:
    """Blocks of a file's queries and points -> ``vid, near_id, near_label, distance``."""

    def block(table: pa.Table) -> pa.Table:
        asks = table["asks"].to_numpy()
        qs, xs = table.filter(pa.array(asks)).combine_chunks(), table.filter(pa.array(~asks)).combine_chunks()
        vids, held, names_ = _array(qs["vid"]), _array(xs["ids"]), _array(xs["labels"])
        ids, labels = held.flatten(), names_.flatten()
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if len(qs) and len(xs):
            qv, xv, qp, xp = (_matrix(t[c]) for t, c in ((qs, "vec"), (xs, "vec"), (qs, "perm"), (xs, "perm")))
            names = np.unique(np.concatenate([qp.ravel(), xp.ravel()]))
            m = qp.shape[1]
            counts = held.value_lengths().to_numpy()
            starts = np.concatenate(([0], np.cumsum(counts)))
            order_ids, codes = pa.compute.rank(ids, "ascending", tiebreaker="dense").to_numpy(), labels.dictionary_encode().indices.to_numpy()
            ux, cut = None if radius is None else _unary(xp, names), qs["cutoff"].to_numpy()
            # without a radius every pair is ranked: fewer queries at a time
            step = 256 if radius is not None else max(1, min(256, PAIRS // len(ids)))
            for at in range(0, len(qs), step):
                part = slice(at, at + step)
                if radius is None:
                    qi, xi = (x.ravel() for x in np.indices((len(qv[part]), len(xv))))
                else:
                    footrule = m * (m + 1) - 2.0 * (_unary(qp[part], names) @ ux.T)
                    qi, xi = np.nonzero(footrule <= cut[part][:, None])
                gap = qv[part][qi] - xv[xi]
                d = np.sqrt(np.einsum("ij,ij->i", gap, gap))
                if radius is not None:
                    ok = d <= radius
                    qi, xi, d = qi[ok], xi[ok], d[ok]
                if not len(qi):
                    continue
                times = counts[xi]
                rep = np.repeat(np.arange(len(qi)), times)
                row = np.repeat(starts[xi] - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(times.sum())
                best = _keep(qi[rep], d[rep], order_ids[row], codes[row], k)
                rep, row = rep[best], row[best]
                found.append((qi[rep] + at, row, d[rep]))
        q, row, d = (np.concatenate(c) for c in zip(*found))
        return pa.table({"vid": vids.take(pa.array(q)), "near_id": ids.take(pa.array(row)), "near_label": labels.take(pa.array(row)), "distance": pa.array(d)})

    schema = f"vid {id_type}, near_id {id_type}, near_label {label_type}, distance double"
    return postings.groupBy("cell", "i", "j").applyInArrow(block, schema)


def _blocks(index: DataFrame, queries: DataFrame) -> DataFrame:
    """Postings of points and queries cut into blocks of at most about BLOCK x BLOCK."""
    posted = index.select(F.explode("posts").alias("cell"), "vid", "vec", "perm", "cutoff", "ids", "labels", F.lit(False).alias("asks"))
    asked = queries.select(F.explode("probes").alias("cell"), "vid", "vec", "perm", "cutoff", F.lit(None).cast(index.schema["ids"].dataType).alias("ids"), F.lit(None).cast(index.schema["labels"].dataType).alias("labels"), F.lit(True).alias("asks"))
    both = posted.unionByName(asked)
    # one row per pivot, MAX_PIVOTS at most: safe to broadcast
    sizes = both.groupBy("cell").agg(
        F.ceil(F.count(F.when(F.col("asks"), 1)) / BLOCK).cast("int").alias("qn"), F.ceil(F.count(F.when(~F.col("asks"), 1)) / BLOCK).cast("int").alias("xn")
    ).where("qn > 0 and xn > 0")
    cut = both.join(F.broadcast(sizes), "cell")
    own = F.pmod(F.xxhash64("vid"), F.when(F.col("asks"), F.col("qn")).otherwise(F.col("xn"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("asks"), F.col("xn")).otherwise(F.col("qn")) - 1))
    cut = cut.withColumn("own", own).withColumn("other", other)
    return cut.select(
        "cell", F.when(F.col("asks"), F.col("own")).otherwise(F.col("other")).alias("i"), F.when(F.col("asks"), F.col("other")).otherwise(F.col("own")).alias("j"),
        "vid", "vec", "perm", "cutoff", "ids", "labels", "asks",
    )


def _rank(found: DataFrame, asking: DataFrame, k: int) -> DataFrame:
    """The k nearest rows of other labels for each asking (vid, label)."""
    both = asking.join(found, "vid").where(F.col("label") != F.col("near_label"))
    w = Window.partitionBy("vid", "label").orderBy("distance", "near_id")
    best = both.select("vid", "label", "h", "h2", "near_id", "distance").distinct()
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _columns(index: DataFrame) -> tuple[str, str, str]:
    i, lab = index.schema["vid"].dataType.simpleString(), index.schema["labels"].dataType.elementType.simpleString()
    return f"vid {i}, h long, h2 long, vec array<double>, ids array<{i}>, labels array<{lab}>", i, lab


def neighbours_within(rows: DataFrame, k: int, radius: float) -> DataFrame:
    """For every row the rows of other labels among its k nearest and within ``radius``; no loss.

    ``rows`` is a result of ``points`` (row ids must be unique). Rows: ``row_id, near_id,
    rank, distance``; equal distances by lower id. Rows with a null or non-finite feature, a null
    id or a null label are neither asked nor found; a row without such a neighbour has no row;
    repeated vectors are each asked and found; empty in, empty out.
    """
    index = staged(distinct_points(rows, k), "points")
    n = index.count()
    columns, id_type, label_type = _columns(index)
    if not n:
        return rows.sparkSession.createDataFrame([], f"row_id {id_type}, near_id {id_type}, rank int, distance double")
    placed = staged(_permute(index, fit_pivots(index, n), columns, _within(radius)), "permutations")
    found = _search(_blocks(placed, placed.withColumn("probes", F.array("home"))), k, radius, id_type, label_type)
    # labels beyond the kept rows ask as well: the answer depends on (vector, label) only
    every = rows.select("h", "h2", "label").distinct().join(index.select("h", "h2", "vid"), ["h", "h2"])
    best = _rank(found, every.select("vid", "h", "h2", "label"), k)
    return rows.join(best.drop("vid"), ["h", "h2", "label"]).select("row_id", "near_id", "rank", "distance")


def neighbours(rows: DataFrame, queries: Column, k: int, posts: int = 3, probes: int = 4) -> DataFrame:
    """For the rows that satisfy ``queries``, about their k nearest rows of other labels, at any distance.

    Every row is indexed under its ``posts`` nearest pivots; a query looks into the files of its
    ``probes`` nearest pivots, where every point is ranked by its distance. Rows and special cases as for ``neighbours_within``.
    """
    index = staged(distinct_points(rows, k), "points")
    n = index.count()
    columns, id_type, label_type = _columns(index)
    if not n:
        return rows.sparkSession.createDataFrame([], f"row_id {id_type}, near_id {id_type}, rank int, distance double")
    placed = staged(_permute(index, fit_pivots(index, n), columns, _nearest(max(posts, probes))), "permutations")
    asked = rows.where(queries)
    every = asked.select("h", "h2", "label").distinct().join(index.select("h", "h2", "vid"), ["h", "h2"])
    whom = placed.join(every.select("vid").distinct(), "vid", "left_semi").withColumn("probes", F.slice("posts", 1, probes))
    found = _search(_blocks(placed.withColumn("posts", F.slice("posts", 1, posts)), whom), k, None, id_type, label_type)
    best = _rank(found, every.select("vid", "h", "h2", "label"), k)
    return asked.join(best.drop("vid"), ["h", "h2", "label"]).select("row_id", "near_id", "rank", "distance")
