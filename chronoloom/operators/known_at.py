"""Attributes as they were known at the time of an event.

Method. The facts of a key form, over time, a step function: at each moment the winner is
the fact of highest precedence among those already effective. The moments at which the
winner changes cut the time line into half-open validity intervals. Each interval is
decomposed into dyadic time nodes (aligned powers of two of a leaf of 2**36 microseconds,
some 19 hours, up to 2**40, some 13 days); an event lies in one node of each size, so a
plain equi-join on (key, node size, node) finds its interval and the exact half-open test
removes what shares only a leaf. No range join, no per-key sort of events.

Scale. A key may hold a third of all facts or events: facts are first reduced to one row
per (key, moment) with map-side combining, running maxima are taken inside blocks of
2**41 microseconds (some 25 days) and carried across blocks by a second window over one row
per block, and a key's events are spread over nodes of at most 13 days. Only (key, time) pairs
are filed under their nodes, each once; whole event rows are joined to the answer by key and time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions.timeparts import micros

LEAF_SHIFT = 36
TOP_LEVEL = 4
BLOCK_SHIFT = 41


def validity(facts: DataFrame, key: Column, effective: Column, precedence: list[Column], payload: dict[str, Column]) -> DataFrame:
    """Half-open validity intervals of the winning facts.

    Returns ``__key, __from, __until`` (microseconds; ``__until`` is null for the fact that is
    still valid) and the payload columns. Facts with a null key, effective time or precedence
    value never win. Equal facts are one fact. Empty in, empty out.
    """
    names = [f"__p{i}" for i in range(len(precedence))]
    rows = facts.select(
        key.alias("__key"),
        effective.alias("__from"),
        F.struct(
            *[c.alias(n) for n, c in zip(names, precedence)],
            F.struct(*[c.alias(n) for n, c in payload.items()]).alias("__row"),
        ).alias("__best"),
    )
    for i in range(len(precedence)):
        rows = rows.where(F.col(f"__best.__p{i}").isNotNull())
    rows = rows.where("__key is not null and __from is not null")
    # one row per moment: the struct orders by precedence first
    rows = rows.groupBy("__key", "__from").agg(F.max("__best").alias("__best"))
    rows = rows.withColumn("__block", F.shiftright("__from", BLOCK_SHIFT))

    in_block = Window.partitionBy("__key", "__block").orderBy("__from")
    before = Window.partitionBy("__key").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        rows.groupBy("__key", "__block").agg(F.max("__best").alias("__top"))
        .select("__key", "__block", F.max("__top").over(before).alias("__carry"))
    )
    records = (
        rows.withColumn("__run", F.max("__best").over(in_block))
        .where(F.col("__best") == F.col("__run"))
        .join(carry, ["__key", "__block"])
        .where(F.col("__carry").isNull() | (F.col("__best") > F.col("__carry")))
        .select("__key", "__block", "__from", "__best")
    )
    following = (
        records.groupBy("__key", "__block").agg(F.min("__from").alias("__first"))
        .select("__key", "__block", F.lead("__first").over(Window.partitionBy("__key").orderBy("__block")).alias("__next"))
    )
    return (
        records.withColumn("__lead", F.lead("__from").over(in_block))
        .join(following, ["__key", "__block"])
        .select("__key", "__from", F.coalesce("__lead", "__next").alias("__until"), "__best.__row.*")
    )


def dyadic_nodes(first: Column, last: Column, top: int = TOP_LEVEL) -> Column:
    """Fewest aligned nodes that cover the leaves first..last (both included): array<struct<level,node>>."""

    def span(level: int) -> tuple[Column, Column]:
        lo = F.shiftright(first + F.lit((1 << level) - 1), level)
        hi = F.shiftright(last + F.lit(1), level) - F.lit(1)
        return lo, hi

    def node(level: int, c: Column) -> Column:
        return F.struct(F.lit(level).alias("level"), c.alias("node"))

    def tagged(level: int):
        return lambda x: node(level, x)  # one argument: a second would receive the index

    none = F.array().cast("array<struct<level:int,node:bigint>>")
    parts = []
    for level in range(top + 1):
        lo, hi = span(level)
        every = F.transform(F.sequence(lo, hi), tagged(level))
        if level == top:
            parts.append(F.when(lo <= hi, every).otherwise(none))
            continue
        up_lo, up_hi = span(level + 1)
        left = F.when(lo < up_lo * 2, F.array(node(level, lo))).otherwise(none)
        right = F.when(hi > up_hi * 2 + 1, F.array(node(level, hi))).otherwise(none)
        parts.append(F.when(lo > hi, none).when(up_lo > up_hi, every).otherwise(F.concat(left, right)))
    return F.concat(*parts)


def attributes_as_of(
    events: DataFrame,
    facts: DataFrame,
    *,
    event_key: Column,
    event_time: Column,
    fact_key: Column,
    fact_effective: Column,
    precedence: list[Column],
    payload: dict[str, Column],
    how: str = "inner",
) -> DataFrame:
    """Each event with the fact that won at the event's time.

    ``event_time`` is a zone-less timestamp, ``fact_effective`` microseconds from which the fact
    counts. Of several effective facts the one with the highest precedence list wins.
    ``payload`` names the fact columns to add; a name that the events already have is an error.

    how="inner" keeps events with a match, how="left" all events (nulls without a match).
    Events with a null key or time never match; repeated events each come out; ties are
    settled by the precedence list. Empty events or facts give no matches. One scalar (the
    latest event time) is gathered before the plan is built.
    """
    clash = set(payload) & set(events.columns)
    if clash:
        raise ValueError(f"payload names already in events: {sorted(clash)}")
    ev = events.withColumn("__key", event_key).withColumn("__at", micros(event_time))
    usable = ev.where("__key is not null and __at is not null")
    latest = usable.agg(F.max("__at")).first()[0]
    spans = validity(facts, fact_key, fact_effective, precedence, payload)
    horizon = latest if latest is not None else 0
    spans = (
        spans.where(F.col("__from") <= F.lit(horizon))
        .withColumn("__end", F.least(F.coalesce("__until", F.lit(horizon + 1)), F.lit(horizon + 1)))
        .withColumn(
            "__n",
            F.explode(dyadic_nodes(F.shiftright("__from", LEAF_SHIFT), F.shiftright(F.col("__end") - 1, LEAF_SHIFT))),
        )
        .withColumnsRenamed({"__key": "__skey"})
    )

    def keyed(df: DataFrame) -> DataFrame:
        leaf = F.shiftright("__at", LEAF_SHIFT)
        nodes = F.array(*[F.struct(F.lit(v).alias("level"), F.shiftright(leaf, v).alias("node")) for v in range(TOP_LEVEL + 1)])
        return df.withColumn("__m", F.explode(nodes))

    def matched(df: DataFrame) -> DataFrame:
        on = (
            (F.col("__key") == F.col("__skey"))
            & (F.col("__m.level") == F.col("__n.level"))
            & (F.col("__m.node") == F.col("__n.node"))
            & (F.col("__at") >= F.col("__from"))
            & (F.col("__at") < F.col("__end"))
        )
        return keyed(df).join(spans, on)

    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    # the match depends on (key, time) only: slim rows are exploded, and repeated events share one look-up
    moments = matched(usable.select("__key", "__at").distinct()).select(
        F.col("__key").alias("__k2"), F.col("__at").alias("__t2"), *payload
    )
    return (usable if how == "inner" else ev).join(moments, (F.col("__key") == F.col("__k2")) & (F.col("__at") == F.col("__t2")), how).select(
        *[ev[f"`{c}`"] for c in events.columns], *payload
    )
