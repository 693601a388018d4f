"""Exact k nearest neighbours as one row per query: blocks of queries scan a written table of points.

Points are written once, in the order of a k-d tree (``filed``). A task holds QUERIES queries and their k best so far, and reads the
table CHUNK rows at a time: neither points nor neighbours are shuffled or repeated on disk. Rows that lie
side by side are leaves with a bounding box; a query meets a leaf only if the box comes within its k-th distance
so far. Distances are bounded from below in single precision (with the rounding error allowed for) and those that may count are
computed exactly. Attributes of the winners are read in a second pass, and votes work on the array without a join.
"""

from __future__ import annotations

import math
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.session import scratch

QUERIES = 16_384
CHUNK = 262_144
LEAF = 256
FLUSH = 1_000_000
TASKS = 12


def usable(vec: str = "vec") -> Column:
    """Whether a vector is known in all places."""
    return F.col(vec).isNotNull() & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x))


def filed(points: DataFrame, label: str = "points") -> DataFrame:
    """``points`` (with a column vec) written in the shared folder, near rows side by side; rows without a usable vector are left out."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)

    def run(batches):
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += len(b)
            if n >= CHUNK:
                yield from _ordered(held)
                held, n = [], 0
        if n:
            yield from _ordered(held)

    path = scratch(points.sparkSession, label)
    points.where(usable()).mapInArrow(run, fields).write.parquet(path)
    return points.sparkSession.read.schema(points.schema).parquet(path)


def _ordered(batches: list) -> list:
    table = pa.Table.from_batches(batches)
    return table.take(pa.array(_tree(_matrix(table["vec"])))).combine_chunks().to_batches(max_chunksize=10_000)


def _matrix(column) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1) if len(lists) else np.empty((0, 0))


def _tree(x: np.ndarray) -> np.ndarray:
    """Positions in the order of a k-d tree: halves along the axis of largest spread."""
    parts, done = [np.arange(len(x))], []
    while parts:
        o = parts.pop()
        if len(o) <= LEAF // 2:
            done.append(o)
            continue
        v = x[o]
        half = len(o) // 2
        by = np.argpartition(v[:, int(np.argmax(v.std(0)))], half)
        parts += [o[by[half:]], o[by[:half]]]
    return np.concatenate(done)


def near(
    queries: DataFrame, points: DataFrame, k: int, payload: list[str], views: dict | None = None, within: str | None = None, latest: str | None = None, cells: bool = False, n: int | None = None
) -> DataFrame:
    """Every row of ``queries`` without vec, with ``near``: its k nearest points as an array of structs (tid, distance, payload...), nearest first; equal distances by lower tid.

    ``queries``: any columns and vec; ``points``: what ``filed`` returned, with tid, vec and the payload. A query without a usable vector has an
    empty array. ``views`` (value of the queries' column ``within`` -> means, factors, last) scales both sides and, with ``latest``, admits only points of which
    that column is at most ``last``; a value without a view has no neighbours. ``cells``: a query meets the points whose ``cell`` is in its array ``cells``. ``n``: number of queries, if known.
    """
    n = queries.count() if n is None else n
    tasks = max(math.ceil(n / QUERIES), min(TASKS, math.ceil(n / 512)), 1)
    dealt = queries.repartitionByRange(tasks, within, F.xxhash64(*[c for c in queries.columns if c not in ("vec", "cells")])) if within and tasks > 1 else queries.repartition(tasks)
    files = sorted(points.inputFiles())
    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    kept = [f for f in queries.schema.fields if f.name not in ("vec", "cells")]
    inner = ", ".join(f"`{c}`: {kinds[c]}" for c in ("tid", *payload)).replace(f"`tid`: {kinds['tid']}", f"tid: {kinds['tid']}, distance: double", 1)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"near array<struct<{inner}>>"])
    names, extra = [f.name for f in kept], [*([latest] if latest else []), *(["cell"] if cells else [])]

    def block(held: list) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        lists = table["vec"].combine_chunks()
        flat = lists.flatten()
        bad = (flat.is_null().to_numpy(zero_copy_only=False) | np.isnan(flat.to_numpy(zero_copy_only=False).astype(float))) if len(flat) else np.empty(0, bool)
        size = np.diff(lists.offsets.to_numpy()) if not lists.null_count else pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy()
        sums = np.concatenate(([0], np.cumsum(bad)))
        end = np.cumsum(size)
        good = np.flatnonzero((size > 0) & (sums[end] == sums[end - size]))
        x = _matrix(lists.take(pa.array(good)))
        groups: dict = {None: np.arange(len(good))}
        if within:
            value = np.array(table[within].to_pylist(), dtype=object)[good]
            groups = {v: np.flatnonzero(value == v) for v in set(value.tolist()) if v in views}
        allowed = table["cells"].combine_chunks().take(pa.array(good)) if cells else None
        best = Best(len(good), k)
        for v, of in groups.items():
            mean, factor, last = views[v] if within else (0.0, 1.0, None)
            scaled = ((x[of] - mean) * factor) if within else x
            base = 0
            for b in _scan(files, ["tid", "vec", *extra]):
                pos = np.arange(base, base + len(b))
                base += len(b)
                if latest:
                    pos = pos[pa.compute.fill_null(pa.compute.less_equal(b.column(latest), pa.scalar(last, b.column(latest).type)), False).to_numpy(zero_copy_only=False)]
                if not len(pos) or not len(of):
                    continue
                rows = pa.array(pos - (base - len(b)))
                y, tid = _matrix(b.column("vec").take(rows)), _keys(b.column("tid").take(rows))
                y = (y - mean) * factor if within else y
                if not cells:
                    best.meet(scaled, of, y, tid, pos)
                    continue
                cell = b.column("cell").take(rows).to_numpy(zero_copy_only=False)
                who = np.repeat(np.arange(len(allowed)), np.diff(allowed.offsets.to_numpy()))
                where = allowed.flatten().to_numpy()
                for c in np.unique(cell):
                    mine, some = who[where == c], np.flatnonzero(cell == c)
                    if len(mine):
                        best.meet(x[mine], mine, y[some], tid[some], pos[some])
        counts = np.zeros(len(table), dtype=np.int64)
        counts[good] = (best.pos >= 0).sum(1)
        flat, dist = best.pos[best.pos >= 0], best.dist[best.pos >= 0]
        order, at, base, got = np.argsort(flat, kind="stable"), 0, 0, []
        wanted = flat[order]
        for b in _scan(files, ["tid", *payload]) if len(flat) else ():
            upto = np.searchsorted(wanted, base + len(b))
            if upto > at:
                got.append(b.take(pa.array(wanted[at:upto] - base)))
            at, base = upto, base + len(b)
        back = np.empty(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        won = pa.Table.from_batches(got).take(pa.array(back)).combine_chunks() if got else None
        if won is None:
            lists = pa.array([[]] * len(table), type=out_type)
        else:
            columns = [won["tid"], pa.array(dist), *[won[c] for c in payload]]
            columns = [(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c).cast(f.type) for c, f in zip(columns, out_type.value_type)]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.StructArray.from_arrays(columns, fields=list(out_type.value_type)))
        return pa.RecordBatch.from_arrays([*(table[c].combine_chunks() for c in names), lists], names=[*names, "near"])

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    out_type = to_arrow_type(_parse_datatype_string(schema)["near"].dataType)

    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += len(b)
            if size >= QUERIES:
                yield block(held)
                held, size = [], 0
        if size:
            yield block(held)

    return dealt.mapInArrow(run, schema)


def _scan(files: list[str], columns: list[str]):
    """Record batches of at most CHUNK rows, in the same order each time."""
    import pyarrow.compute  # noqa: F401
    import pyarrow.fs
    import pyarrow.parquet as pq

    for uri in files:
        parts = urlparse(uri)
        if parts.scheme in ("", "file"):
            fs, path = pyarrow.fs.LocalFileSystem(), unquote(parts.path)
        else:
            fs, path = pyarrow.fs.FileSystem.from_uri(uri)
        with fs.open_input_file(path) as f:
            for b in pq.ParquetFile(f).iter_batches(batch_size=CHUNK, columns=columns, use_threads=False):
                if len(b):
                    yield b.select(columns)


def _keys(tid) -> np.ndarray:
    out = tid.to_numpy(zero_copy_only=False)
    return out.astype(str) if out.dtype == object else out


class Best:
    """The k nearest points so far of each of n queries: distances, ids (for ties) and positions in the table."""

    def __init__(self, n: int, k: int):
        self.k, self.tid = k, None
        self.dist, self.pos = np.full((n, k), np.inf), np.full((n, k), -1, dtype=np.int64)

    def meet(self, x: np.ndarray, of: np.ndarray, y: np.ndarray, tid: np.ndarray, pos: np.ndarray) -> None:
        """Let the queries ``of`` (vectors x) meet the points y; near rows of y should lie side by side."""
        if self.tid is None:
            self.tid = np.zeros(self.pos.shape, dtype=tid.dtype)
        elif tid.dtype.kind == "U" and tid.dtype.itemsize > self.tid.dtype.itemsize:
            self.tid = self.tid.astype(tid.dtype)
        edges = np.linspace(0, len(y), max(1, len(y) // max(LEAF, 2 * self.k)) + 1).astype(np.int64)
        lo, hi = np.minimum.reduceat(y, edges[:-1]), np.maximum.reduceat(y, edges[:-1])
        gap = np.zeros((len(lo), len(x)), dtype=np.float32)  # lower bounds of squared distances to the boxes
        xt = np.ascontiguousarray(x.T)
        for leaf in range(len(lo)):
            for j in range(len(xt)):
                g = np.maximum(np.maximum(lo[leaf, j] - xt[j], xt[j] - hi[leaf, j]), 0.0)
                gap[leaf] += g * g * (1 - 1e-6)
        gap *= 1 - 1e-5
        if len(lo) == 1:
            self._leaves(x, of, y, tid, pos, edges, np.ones(gap.shape, dtype=bool))
            return
        met = np.zeros(gap.shape, dtype=bool)
        fresh = np.flatnonzero(np.isinf(self.dist[of, -1]))
        if len(fresh):
            for m in (1, 8, 48):  # the nearest leaf gives a first bound, the next ones a good one
                if m < len(lo):
                    want = np.zeros(gap.shape, dtype=bool)
                    want[np.argpartition(gap[:, fresh], m - 1, axis=0)[:m], fresh] = True
                    self._leaves(x, of, y, tid, pos, edges, want & ~met & (gap <= self._limit(of)))
                    met |= want
        self._leaves(x, of, y, tid, pos, edges, ~met & (gap <= self._limit(of)), gap)

    def _limit(self, of: np.ndarray) -> np.ndarray:
        return self.dist[of, -1] ** 2 * (1 + 1e-12)

    def _leaves(self, x, of, y, tid, pos, edges, want, gap=None) -> None:
        held, n = [], 0
        limit = self._limit(of)
        for leaf in np.flatnonzero(want.any(1)):
            who = np.flatnonzero(want[leaf] & (gap[leaf] <= limit) if gap is not None else want[leaf])
            a, b = edges[leaf], edges[leaf + 1]
            for at in range(0, len(who), 4096):
                mine = who[at : at + 4096]
                qi, ti = self._able(x[mine], y[a:b], limit[mine])
                if not len(qi):
                    continue
                qi, ti = mine[qi], ti + a
                apart = x[qi] - y[ti]
                d = np.sqrt(np.einsum("ij,ij->i", apart, apart))
                ok = d <= self.dist[of[qi], -1]
                held.append((qi[ok], d[ok], ti[ok]))
                n += int(ok.sum())
                if n >= FLUSH:
                    self._merge(held, of, tid, pos)
                    held, n, limit = [], 0, self._limit(of)
        if held:
            self._merge(held, of, tid, pos)

    def _able(self, x: np.ndarray, y: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs whose distance may be within the limit, and of queries without one those that may be among the k nearest here."""
        centre = y.mean(0)
        x, y = x - centre, y - centre
        xx, yy = (x * x).sum(1), (y * y).sum(1)
        single = max(xx.max(), yy.max()) < 1e30
        kind, eps = (np.float32, 1.2e-7) if single else (np.float64, 2.3e-16)
        slack = 4 * (x.shape[1] + 8) * eps  # of rounding, relative to the two squared norms
        left = np.column_stack([x, np.ones(len(x))]).astype(kind)
        right = np.column_stack([-2.0 * y, yy * (1 - slack)]).astype(kind)
        d = left @ right.T
        room = limit - xx * (1 - slack)
        new = np.flatnonzero(np.isinf(limit))
        if len(new):
            m = min(self.k, len(y)) - 1
            room[new] = np.partition(d[new], m, axis=1)[:, m].astype(float) + 2 * slack * (xx[new] + yy.max())
        room = room + slack * np.abs(room) + 1e-300
        return np.divmod(np.flatnonzero(d <= room.astype(kind)[:, None]), len(y))

    def _merge(self, held, of, tid, pos) -> None:
        qi, d, ti = (np.concatenate(c) for c in zip(*held))
        who, row = np.unique(qi, return_inverse=True)
        mine = of[who]
        rows = np.concatenate([row, np.repeat(np.arange(len(who)), self.k)])
        dist, ids, at = np.concatenate([d, self.dist[mine].ravel()]), np.concatenate([tid[ti], self.tid[mine].ravel()]), np.concatenate([pos[ti], self.pos[mine].ravel()])
        by = np.argsort(dist)
        by = by[np.argsort(rows[by].astype(np.uint16 if len(who) < 1 << 16 else np.int64), kind="stable")]  # 16 bits are sorted by radix
        rows = rows[by]
        tied = (rows[1:] == rows[:-1]) & (dist[by[1:]] == dist[by[:-1]])
        if tied.any():  # equal distances by id
            run = np.concatenate(([0], np.cumsum(~tied)))
            some = np.flatnonzero(np.concatenate(([False], tied)) | np.concatenate((tied, [False])))
            by[some] = by[some[np.lexsort((ids[by[some]], run[some]))]]
        by = by[np.arange(len(rows)) - np.searchsorted(rows, np.arange(len(who)))[rows] < self.k]
        self.dist[mine], self.tid[mine], self.pos[mine] = (c[by].reshape(len(who), self.k) for c in (dist, ids, at))
