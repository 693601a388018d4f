"""Parameter search: grids and seeded quasi-random proposals, with resumption from a log of trials."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from itertools import product

from pyspark.sql import SparkSession

FLOOR = -0.10
PENALTY = 0.05


def grid(space: dict[str, list]) -> list[dict]:
    """All combinations in the order of the keys; the last key varies fastest."""
    return [dict(zip(space, values)) for values in product(*space.values())]


def _radical_inverse(i: int, base: int) -> float:
    out, f = 0.0, 1.0 / base
    while i:
        out, i, f = out + f * (i % base), i // base, f / base
    return out


def proposals(space: dict[str, list | tuple], n: int, start: int = 1) -> list[dict]:
    """Halton points of a space: a list is a choice, a pair of ints an integer range, a pair of floats a range (both ends included)."""
    primes = [2, 3, 5, 7, 11, 13, 17, 19, 23, 29]
    if len(space) > len(primes):
        raise ValueError(f"at most {len(primes)} parameters")
    out = []
    for i in range(start, start + n):
        trial = {}
        for (name, spec), base in zip(space.items(), primes):
            u = _radical_inverse(i, base)
            if isinstance(spec, list):
                trial[name] = spec[min(int(u * len(spec)), len(spec) - 1)]
            elif isinstance(spec[0], int) and isinstance(spec[1], int):
                trial[name] = spec[0] + min(int(u * (spec[1] - spec[0] + 1)), spec[1] - spec[0])
            else:
                trial[name] = spec[0] + u * (spec[1] - spec[0])
        out.append(trial)
    return out


def run(trials: Iterable[dict], objective: Callable[[dict], float], gate: Callable[[dict], bool] | None = None, log: list[dict] | None = None) -> list[dict]:
    """Evaluate trials that the log does not hold; each log entry has the parameters, ``value`` and ``status``.

    A trial that fails its gate is penalised, one that raises gets the floor; the log is extended in place, so a run
    can be stopped and resumed.
    """
    log = log if log is not None else []
    known = [x["params"] for x in log]
    for params in trials:
        if params in known:
            continue
        try:
            value, status = float(objective(params)), "ok"
            if gate is not None and not gate(params):
                value, status = value - PENALTY, "gated"
        except Exception as e:  # an impossible parameter set must not end the search
            value, status = FLOOR, f"failed: {type(e).__name__}"
        log.append({"params": params, "value": value, "status": status})
        known.append(params)
    return log


def best(log: list[dict]) -> dict | None:
    """The entry of greatest value, the first one on ties."""
    return max(log, key=lambda x: x["value"], default=None)


def save_log(spark: SparkSession, log: list[dict], path: str) -> None:
    """The log as Parquet, one row per trial in order; replaces what was there."""
    rows = [(i, json.dumps(x["params"]), float(x["value"]), x["status"]) for i, x in enumerate(log)]
    spark.createDataFrame(rows, "trial int, params string, value double, status string").coalesce(1).write.mode("overwrite").parquet(path)


def load_log(spark: SparkSession, path: str) -> list[dict]:
    """A saved log, ready to be resumed (as long as the number of trials)."""
    return [{"params": json.loads(r.params), "value": r.value, "status": r.status} for r in spark.read.parquet(path).orderBy("trial").collect()]
