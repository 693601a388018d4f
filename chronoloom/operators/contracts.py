"""Schema contracts: every violation of a table counted in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A table breaks its contract; the message lists every violation."""


def violations(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """One row per rule, ``rule, broken``: how many rows do not satisfy it (unknown counts as broken). One aggregate."""
    sums = df.agg(*[F.count_if(~F.coalesce(F.expr(sql).cast("boolean"), F.lit(False))).alias(f"r{i}") for i, sql in enumerate(rules.values())])
    each = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"r{i}").alias("broken")) for i, n in enumerate(rules)])
    return sums.select(F.explode(each).alias("x")).select("x.*")


def require(df: DataFrame, rules: dict[str, str], columns: dict[str, str] | None = None, least_rows: int = 0) -> DataFrame:
    """The table itself if it meets the contract; otherwise one error with all failures."""
    have = dict(df.dtypes)
    bad = [f"column {c}: expected {t}, found {have.get(c, 'none')}" for c, t in (columns or {}).items() if have.get(c) != t]
    if bad:
        raise ContractError("; ".join(bad))
    bad = [f"{r.rule}: {r.broken} rows" for r in violations(df, rules).where("broken > 0").collect()]
    if least_rows and len(df.limit(least_rows).take(least_rows)) < least_rows:
        bad.append(f"fewer than {least_rows} rows")
    if bad:
        raise ContractError("; ".join(bad))
    return df


def _finite(c: str) -> str:
    return f"`{c}` is not null and not isnan(`{c}`) and abs(`{c}`) < double('infinity')"


def query_rules(features: list[str], key: str = "ticker", date: str = "date") -> dict[str, str]:
    """What a table to be asked must meet: its keys and every feature known and finite (no label needed)."""
    return {f"{key} known": f"{key} is not null", f"{date} known": f"{date} is not null"} | {f"{c} finite": _finite(c) for c in features}


def target_rules(target: str) -> dict[str, str]:
    """A label is known and 0 or 1."""
    return {f"{target} known": f"{target} is not null", f"{target} binary": f"{target} is null or {target} in (0, 1)"}


def train_rules(features: list[str], target: str, key: str = "ticker", date: str = "date") -> dict[str, str]:
    return query_rules(features, key, date) | target_rules(target)


def bar_rules() -> dict[str, str]:
    """Daily bars: keys known, prices finite and above 0, high not below low, volume known and not negative."""
    prices = {f"{c} above 0": f"{_finite(c)} and {c} > 0" for c in ("open", "high", "low", "close")}
    return {"ticker known": "ticker is not null", "date known": "date is not null"} | prices | {"high not below low": "high >= low", "volume not negative": "volume >= 0"}


def coerced(df: DataFrame, dates: dict[str, str] | None = None, numbers: list[str] | None = None, drop: list[str] | None = None) -> DataFrame:
    """Unreadable cells as NULL instead of an error, then without the rows that lack a needed column.

    ``dates``: column -> format, read as dates; ``numbers`` are read as doubles (NaN and infinite become NULL);
    ``drop`` names the columns a row must have (all coerced ones by default).
    """
    def number(c: str) -> Column:
        v = F.col(c).try_cast("double")
        return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)

    out = df.withColumns({c: F.to_date(F.try_to_timestamp(F.col(c).cast("string"), F.lit(f))) for c, f in (dates or {}).items()} | {c: number(c) for c in numbers or []})
    return out.na.drop(subset=drop if drop is not None else [*(dates or {}), *(numbers or [])])
