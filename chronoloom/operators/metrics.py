"""Proper scores, decompositions, calibration tables and gates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def brier(p: Column, y: Column) -> Column:
    return F.avg((p - y) * (p - y))


def brier_skill(p: Column, y: Column) -> Column:
    """1 - Brier score / (b (1 - b)) with the base rate b; 0 where that is below 1e-10."""
    floor = F.avg(y) * (1 - F.avg(y))
    return F.when(floor < 1e-10, 0.0).otherwise(1 - brier(p, y) / floor)


def murphy(rows: DataFrame, by: list[str], bins: int | None = 10) -> DataFrame:
    """Reliability, resolution and uncertainty per group of ``by``; ``p`` and ``y`` are columns of rows.

    With ``bins``, right-closed bins of equal width (the first takes 0); without, one bin per
    distinct probability, for which reliability - resolution + uncertainty is the Brier score.
    """
    key = F.col("p") if bins is None else F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil(F.col("p") * bins)))
    per = rows.withColumn("bin", key).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mp"), F.avg("y").alias("my"), F.sum((F.col("p") - F.col("y")) ** 2).alias("se"))
    total = per.groupBy(*by).agg(F.sum("n").alias("total"), (F.sum(F.col("n") * F.col("my")) / F.sum("n")).alias("base"), (F.sum("se") / F.sum("n")).alias("brier"))
    both = per.join(total, by)
    weight = F.col("n") / F.col("total")
    out = both.groupBy(*by).agg(
        F.first("total").alias("n"), F.first("brier").alias("brier"), F.sum(weight * (F.col("mp") - F.col("my")) ** 2).alias("reliability"),
        F.sum(weight * (F.col("my") - F.col("base")) ** 2).alias("resolution"), F.first(F.col("base") * (1 - F.col("base"))).alias("uncertainty"),
    )
    return out.withColumn("identity_gap", F.col("brier") - (F.col("reliability") - F.col("resolution") + F.col("uncertainty")))


def calibration_table(rows: DataFrame, by: list[str], bins: int = 5) -> DataFrame:
    """Equal bins of ``p``, the last one closed: count, mean probability, hit rate and their gap; empty bins are left out."""
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    out = rows.withColumn("bin", b).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_prob"), F.avg("y").alias("hit_rate"))
    return out.withColumn("gap", F.col("mean_prob") - F.col("hit_rate"))


def classification(rows: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy (all and signalled rows), precision, recall and F1 of BUY for ``signal`` and ``y``; 0 where undefined."""
    buy, up = F.col("signal") == "BUY", F.col("y") == 1
    sure = F.col("signal").isin("BUY", "SELL")
    right = (buy & up) | ((F.col("signal") == "SELL") & ~up)
    tp, fp, fn = F.count_if(buy & up), F.count_if(buy & ~up), F.count_if(~buy & up)

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(sure).alias("n_signalled"), ratio(F.count_if((F.col("p") > 0.5) == up), F.count(F.lit(1))).alias("accuracy"),
        ratio(F.count_if(right), F.count_if(sure)).alias("signal_accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def report(rows: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """All scores of ``p, y, signal`` in one row per group: counts, Brier score and skill, decomposition, mean and deviation of p, classification."""
    p, y = F.col("p"), F.col("y")
    base = rows.groupBy(*by).agg(brier(p, y).alias("brier"), brier_skill(p, y).alias("bss"), F.avg(p).alias("mean_prob"), F.stddev_pop(p).alias("deviation"))
    parts = murphy(rows, by, bins).select(*by, "reliability", "resolution", "uncertainty")
    return classification(rows, by).join(base, by).join(parts, by)


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation of the rows where both are known; NULL without spread (``corr`` divides by zero there in ANSI mode)."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def crps(ensemble: Column, y: Column) -> Column:
    """Continuous ranked probability score of an ensemble: E|X - y| - E|X - X'| / 2; NULL below two members.

    The pair term uses the sorted ensemble, so it costs n log n, not n squared.
    """
    x = F.array_sort(ensemble)
    n = F.size(ensemble).cast("double")
    near = F.aggregate(ensemble, F.lit(0.0), lambda a, v: a + F.abs(v - y)) / n
    pairs = F.aggregate(F.transform(x, lambda v, i: v * (2 * (i + 1) - n - 1)), F.lit(0.0), lambda a, v: a + v) / (n * n)
    return F.when(F.size(ensemble) >= 2, near - pairs)


_LIVES = np.searchsorted(
    np.cumsum([np.exp(-1) / np.prod(np.arange(1, k + 1), initial=1.0) for k in range(12)]), (np.arange(1 << 16) + 0.5) / (1 << 16)
).astype(np.float32)  # Poisson(1) by a 16-bit draw


def _weights(keys: np.ndarray, resamples: int, seed: int) -> np.ndarray:
    """Poisson(1) weights, rows x resamples, from the row keys alone; one hash gives four draws."""
    words = -(-resamples // 4)
    with np.errstate(over="ignore"):
        h = keys.view(np.uint64)[:, None] + np.arange(1, words + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return _LIVES[h.view(np.uint16)[:, :resamples]]


def bootstrap_sums(rows: DataFrame, by: list[str], resamples: int, seed: int) -> DataFrame:
    """``by..., b, n, se, sy``: weighted count, squared error and labels of each resample.

    Each task multiplies its batches' weights with (1, e, y) and emits one row per group; resamples x groups rows cross the shuffle.
    """
    schema = T.StructType([rows.schema[c] for c in by] + list(T._parse_datatype_string("n array<double>, se array<double>, sy array<double>")))

    def run(batches):
        held: dict = {}
        for pdf in batches:
            for at in range(0, len(pdf), 2048):
                part = pdf.iloc[at : at + 2048]
                w = _weights(part["key"].to_numpy(dtype=np.int64), resamples, seed)
                p, y = part["p"].to_numpy(float), part["y"].to_numpy(float)
                moments = np.column_stack([np.ones(len(part)), (p - y) ** 2, y])
                for group, rows_ in part.groupby(by, sort=False, dropna=False).indices.items():
                    group = group if isinstance(group, tuple) else (group,)
                    held[group] = held.get(group, 0.0) + w[rows_].T.astype(float) @ moments[rows_]
        if held:
            yield pd.DataFrame([(*g, *m.T) for g, m in held.items()], columns=schema.fieldNames())

    part = rows.where("p is not null and y is not null").select(*by, "key", F.col("p").cast("double").alias("p"), F.col("y").cast("double").alias("y")).mapInPandas(run, schema)
    each = part.select(*by, F.posexplode(F.arrays_zip("n", "se", "sy")).alias("b", "x"))
    return each.groupBy(*by, "b").agg(*[F.sum(f"x.{c}").alias(c) for c in ("n", "se", "sy")])


def bootstrap_skill(rows: DataFrame, by: list[str], resamples: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """Control-variate bootstrap of the Brier skill score per group of ``by`` (at least one column).

    Rows: ``by..., n, bss_point, bss_cv, ci_lower, ci_upper, beta, variance_reduction``. Resamples are Poisson(1) weights
    drawn from a hash of ``key``, which must identify a row, so a retried task draws the same. The score of the base rate
    in the same resample is the control: its deviation from its mean, times beta = cov / var (0 below a variance of 1e-15),
    is taken from the model's score. Rows with a null ``p`` or ``y`` do not count; empty in, empty out.
    """
    sums = bootstrap_sums(rows, by, resamples, seed).where("n > 0")
    base = F.col("sy") / F.col("n")
    each = sums.select(*by, (F.col("se") / F.col("n")).alias("model"), (base * (1 - base)).alias("clim"))
    stats = each.groupBy(*by).agg(F.covar_samp("model", "clim").alias("cov"), F.var_samp("clim").alias("var"), F.avg("clim").alias("mean_clim"), F.corr("model", "clim").alias("rho"))
    stats = stats.withColumn("beta", F.when(F.col("var") >= 1e-15, F.col("cov") / F.col("var")).otherwise(0.0))
    model = F.col("model") - F.col("beta") * (F.col("clim") - F.col("mean_clim"))
    drawn = each.join(stats, by).withColumn("bss", F.when(F.col("clim") < 1e-10, 0.0).otherwise(1 - model / F.col("clim")))
    out = drawn.groupBy(*by).agg(
        F.avg("bss").alias("bss_cv"), F.percentile("bss", F.lit((1 - level) / 2)).alias("ci_lower"), F.percentile("bss", F.lit((1 + level) / 2)).alias("ci_upper"),
        F.first("beta").alias("beta"), F.first(F.greatest(F.lit(0.0), 1 - F.coalesce("rho", F.lit(0.0)) ** 2)).alias("variance_reduction"),
    )
    point = rows.where("p is not null and y is not null").groupBy(*by).agg(F.count(F.lit(1)).alias("n"), brier_skill(F.col("p"), F.col("y")).alias("bss_point"))
    return point.join(out, by).select(*by, "n", "bss_point", "bss_cv", "ci_lower", "ci_upper", "beta", "variance_reduction")


def wilcoxon_greater(values: list[float]) -> float | None:
    """Exact one-sided signed-rank test that values lie above 0; None below six non-zero values (driver; folds only)."""
    v = [x for x in values if x]
    if len(v) < 6:
        return None
    if len(v) > 20:
        raise ValueError("meant for a handful of folds")
    order = sorted(abs(x) for x in v)
    rank = {a: (order.index(a) + 1 + len(order) - order[::-1].index(a)) / 2 for a in order}
    ranks = [rank[abs(x)] for x in v]
    got = sum(r for r, x in zip(ranks, v) if x > 0)
    sums = np.zeros(1)
    for r in ranks:
        sums = np.concatenate([sums, sums + r])
    return float((sums >= got - 1e-9).mean())


def fold_summary(folds: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, mean without the worst fold, positive folds, slope over folds, the best fold (first on ties) and the exact Wilcoxon p."""
    w = Window.partitionBy(*by) if by else Window.partitionBy()
    rows = folds.where(F.col(value).isNotNull()).withColumn("__worst", F.row_number().over(w.orderBy(value, "fold")))

    @F.pandas_udf("double")
    def exact(values: pd.Series) -> pd.Series:
        return pd.Series([wilcoxon_greater(list(v)) for v in values], dtype=object)

    agg = [
        F.count(F.lit(1)).alias("n_folds"), F.avg(value).alias("mean"), F.avg(F.when(F.col("__worst") > 1, F.col(value))).alias("trimmed_mean"), F.count_if(F.col(value) > 0).alias("positive"),
        F.regr_slope(F.col(value), F.col("fold").cast("double")).alias("slope"), F.max_by("fold", F.struct(F.col(value), -F.col("fold"))).alias("best_fold"), F.collect_list(value).alias("__v"),
    ]
    return rows.groupBy(*by).agg(*agg).withColumn("wilcoxon_p", exact("__v")).drop("__v")  # a handful of folds


def percentiles(rows: DataFrame, by: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact interpolated percentiles per group, one column per name in ``probs``.

    Values are counted first and ranked by a running sum over the distinct ones, which can spill; no group is
    gathered in a hash map. Null and NaN values do not count; a group without values has no row.
    """
    per = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*by, F.col(value).cast("double").alias("__x")).agg(F.count(F.lit(1)).alias("__c"))
    order = Window.partitionBy(*by).orderBy("__x")
    run = per.withColumns(
        {"__upto": F.sum("__c").over(order.rowsBetween(Window.unboundedPreceding, 0)), "__n": F.sum("__c").over(Window.partitionBy(*by)), "__next": F.lead("__x").over(order)}
    )
    out = []
    for name, p in probs.items():
        at = F.lit(p) * (F.col("__n") - 1)  # between ranks floor and floor + 1, counted from 0
        low, part = F.floor(at), at - F.floor(at)
        holds = (F.col("__upto") > low) & (F.col("__upto") - F.col("__c") <= low)
        above = F.when(F.col("__upto") > low + 1, F.col("__x")).otherwise(F.coalesce("__next", F.col("__x")))
        out.append(F.max(F.when(holds, F.col("__x") + part * (above - F.col("__x")))).alias(name))
    return run.groupBy(*by).agg(*out)


def winner(rows: DataFrame, limit: float = 20.0) -> DataFrame:
    """The smallest ``max_distance`` of which every fold has ``avgk`` of at least ``limit``."""
    ok = rows.groupBy("max_distance").agg(F.every(F.coalesce(F.col("avgk") >= limit, F.lit(False))).alias("all"))
    return ok.where("all").agg(F.min("max_distance").alias("max_distance"))
