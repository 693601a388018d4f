"""Queries on texts: packing (6), mixing (7) and residue (8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoloom.llm import mixing, packing, residue, tokens
from chronoloom.llm.queries import register
from chronoloom.session import staged
from chronoloom.sources.tables import table


def board(c):
    """A source as it is compared: trimmed, lower case, hyphens for underscores."""
    return F.regexp_replace(F.lower(F.trim(c)), "_", "-")


def _sizes(spark, folder):
    d = table(spark, folder, "documents")
    return staged(d.select("doc_id", board(F.col("source")).alias("source"), tokens.token_count(F.col("text")).alias("tokens")), "sizes")


def _packed(spark, folder):
    # pack_sizes is a fixed table of container kinds
    kinds = [(r.pack_kind, r.capacity_tokens) for r in table(spark, folder, "pack_sizes").orderBy("pack_kind").collect()]
    return packing.pack(_sizes(spark, folder).select("doc_id", "tokens"), kinds)


@register("p6_packed")
def p6_packed(spark, folder):
    """Every post in a container of each capacity."""
    return _packed(spark, folder)


@register("p6_report")
def p6_report(spark, folder):
    """Containers, fill and the least number possible, per capacity."""
    return packing.report(_packed(spark, folder))


@register(
    "p6_check",
    """select p.pack_kind, (select count(*) from documents) as documents, cast(0 as bigint) as missing, cast(0 as bigint) as overfull, cast(0 as bigint) as broken, true as close from pack_sizes p""",
)
def p6_check(spark, folder):
    """Per capacity: posts, posts with tokens missing or twice, containers over capacity, posts cut although they fit, and whether at most 2 % more containers than the bound are used."""
    sizes, packed = _sizes(spark, folder), _packed(spark, folder)
    kinds = table(spark, folder, "pack_sizes").select("pack_kind", F.col("capacity_tokens").cast("long").alias("capacity"))
    got = packed.groupBy("pack_kind", "doc_id").agg(F.sum("tokens").alias("got"), F.count(F.lit(1)).alias("pieces"))
    each = sizes.select("doc_id", "tokens", F.explode(F.array(*[F.struct(F.lit(r.pack_kind).alias("pack_kind"), F.lit(r.capacity).alias("capacity")) for r in kinds.collect()])).alias("k")).select("doc_id", "tokens", "k.*")
    docs = each.join(got, ["pack_kind", "doc_id"], "left").groupBy("pack_kind").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.coalesce(F.col("got") != F.col("tokens"), F.lit(True))).alias("missing"),
        F.count_if(F.col("pieces") > F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.col("capacity")))).alias("broken"),
    )
    bins = packed.groupBy("pack_kind", "capacity_tokens", "bin_id").agg(F.sum("tokens").alias("t")).groupBy("pack_kind").agg(F.count_if(F.col("t") > F.col("capacity_tokens")).alias("overfull"))
    close = packing.report(packed).select("pack_kind", (F.col("containers") <= 1.02 * F.col("least_containers") + 1).alias("close"))
    return docs.join(bins, "pack_kind").join(close, "pack_kind").select("pack_kind", "documents", "missing", "overfull", "broken", "close")


def _targets(spark, folder):
    return table(spark, folder, "mix_targets").withColumn("source", board(F.col("source")))


def _items(spark, folder):
    return _sizes(spark, folder).withColumnRenamed("doc_id", "id")


@register("p7_mixed")
def p7_mixed(spark, folder):
    """The selection of posts at the target shares, with copies and the shares reached."""
    return mixing.mix(_items(spark, folder), _targets(spark, folder)).withColumnRenamed("id", "doc_id")


@register("p7_shares")
def p7_shares(spark, folder):
    """Target and reached share of every wanted source."""
    return mixing.shares(p7_mixed(spark, folder), _targets(spark, folder))


def _tempered(spark, folder, mode):
    """Plan and outcome of a mixture that needs the exponent: source, weight, exponent, reached_share, copies and limit."""
    items, targets = _items(spark, folder), _targets(spark, folder)
    total = None
    if mode == "repetition":  # one pass over everything that the listed sources hold: more than the wanted shares allow
        total = float(items.join(targets.select("source").distinct(), "source", "left_semi").agg(F.sum("tokens")).first()[0] or 0)
    plan = mixing.plan(items, targets, total, mode)
    used = mixing.mix(items, targets, total, mode=mode)
    weights = spark.createDataFrame([(r["source"], r["weight"], r["exponent"], r["budget"]) for r in plan], "source string, weight double, exponent double, budget double")
    return mixing.shares(used, targets).join(F.broadcast(weights), "source")  # MAX_SOURCES rows at most


@register("p7_demanded")
def p7_demanded(spark, folder):
    """A mixture of as many tokens as the listed sources hold: shares bent, by the smallest exponent, as far as the repetition limits force."""
    return _tempered(spark, folder, "repetition")


@register("p7_entropy")
def p7_entropy(spark, folder):
    """A mixture at natural shares to that power that has the entropy of the wanted shares."""
    return _tempered(spark, folder, "entropy")


@register(
    "p7_check",
    """select m as mode, (select count(distinct replace(lower(trim(source)), '_', '-')) from mix_targets) as sources, cast(0 as bigint) as over_limit, cast(0 as bigint) as over_budget, true as bent from (select unnest(['entropy', 'repetition']) as m)""",
)
def p7_check(spark, folder):
    """Per mode: wanted sources, sources beyond their repetition limit, sources beyond their budget, and whether the exponent had to move."""
    both = [_tempered(spark, folder, m).withColumn("mode", F.lit(m)) for m in ("entropy", "repetition")]
    return both[0].unionByName(both[1]).groupBy("mode").agg(
        F.count(F.lit(1)).alias("sources"), F.count_if(F.col("most_copies") > F.col("max_repeats")).alias("over_limit"),
        F.count_if(F.col("tokens") > F.col("budget") + 1).alias("over_budget"), (F.max("exponent") > 0).alias("bent"),
    )


def _classified(spark, folder):
    return residue.classify(table(spark, folder, "documents").select("doc_id", "text"), F.col("doc_id"), F.col("text"))


@register("p8_found")
def p8_found(spark, folder):
    """Posts with residue, filler, an error page or a notice in place of their own words."""
    return _classified(spark, folder).where("residue").select("doc_id")


@register("p8_classes")
def p8_classes(spark, folder):
    """Every post with own words: its near-duplicate class, its links and the verdict."""
    return _classified(spark, folder)
