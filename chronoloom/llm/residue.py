"""Posts that hold template residue, filler, error pages or script notices instead of content.

Method. The own words of each post are fingerprinted: posts with equal own words (case, digits
and spacing aside) are one class; each class has a 64-bit SimHash of its five-word
shingles. Partitioned tables bring together classes whose hashes agree on a part of their bits: permutations
of the 64 bits are cut into keys, one table each. In each table a class is linked to the least class of like length within
HAMMING bits in its bucket, and the link is verified by the Jaccard similarity of their five-word shingles (SIMILAR or
more). The tables are probabilistic (README: measured recall); a prefix join adds, exactly, the pairs whose ends the
tables left in different components: with shingles in one order for all texts (rare first), two sets of similarity 0.8 share
one among the first fifth of each.

Labels. ``residue_rules`` trusts what its shape alone tells (a template part, a status code with its
phrase, Latin filler). From these seeds labels travel in two ways until nothing changes:

* over sentences: classes that hold the same sentence are linked by it. A sentence that occurs in
  LEAST classes or more beside trusted sentences or page furniture, and so in at least COMPANY of the
  classes in which it has any company at all, is trusted as well; a class is residue if all its sentences are;
* over the verified links, through connected components: a class that is only linked is accepted by an
  exact check on the words in which it differs from the residue of its component: each of its sentences says
  what a sentence of those classes says (no own sentence added), or it has one of their template slots
  at the same place, in whatever symbols.

Scale. Texts are read where they lie and reduced to fingerprints; copies collapse before any
join; shingles are larger than the texts and are made again where they are needed, not kept. What a step wrote or shuffled is deleted when it has
been used, and joins of lists (tables, prefixes) run in passes, so that little lies on disk at a time. The order of the prefix join comes from a
table of ORDER counters (the only thing collected). Sentences, links and components stay distributed (alternating
large-star and small-star rounds over written tables, until one task can hold the links that are left). Rounds join by
merging only, as does every other join: what is broadcast passes through the driver, and Spark sizes a table too low after an explode or a Python step. A family of classes that resemble each other becomes a star
in each table, not all its pairs; the prefix join meets no two members of one component. Candidates are first tested by
an upper bound of their overlap (a bitmap of shingles each), so that whole shingle sets travel for few.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.llm import residue_rules as rules
from chronoloom.llm.ownwords import own_words
from chronoloom.llm.residue_rules import holds_slot, says_the_same, sentences, slots
from chronoloom.llm.textprint import fingerprint, shingle_sets
from chronoloom.session import dropped
from chronoloom.session import staged as written

SIMILAR = 0.8
HAMMING = 13
USUAL = 10
MISSED = 0.05
BUCKET = 16
ORDER = 1 << 20
LEAST = 2
COMPANY = 0.5
CHUNK = 400_000
LOCAL = 1 << 20
ROWS = 4_000_000
PASSES = 8
TABLES = 8


def staged(df: DataFrame, label: str) -> DataFrame:
    """A written table; what was shuffled for it is deleted at once."""
    return written(df, label, tidy=True)


def fingerprints(docs: DataFrame, doc_id: Column, text: Column, counted: bool = False) -> DataFrame:
    """``doc_id, h1, h2, sim, template, said, lit, pieces, n, g, s`` of posts that have own words. No shuffle.

    ``said`` are the hashes of the sentences, ``lit`` whether each is a seed, ``pieces`` the number of
    pieces of furniture, ``s`` the shingles, ``n`` their number, ``g`` the bits they set (``bits_of``).
    With ``counted`` each task adds a row without doc_id: ``hits``, how many shingles fall to each of ORDER counters.
    """
    rows = docs.select(doc_id.alias("doc_id"), text.alias("text")).where("text is not null and doc_id is not null")
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def chunk(ids: list, own: list[str], vocabularies) -> pd.DataFrame:
        joined = _joined(own)
        p = fingerprint(joined, vocabularies)
        seeds, furniture = rules.kinds(p, joined)
        cuts = np.searchsorted(p.owner, np.arange(len(p.texts) + 1))
        said, lit, pieces = [], [], []
        for a, b in zip(cuts, cuts[1:]):
            real = ~furniture[a:b]
            h, first = np.unique(p.sentence[a:b][real], return_index=True)
            said.append(h.view(np.int64))
            lit.append(seeds[a:b][real][first])
            pieces.append(int(b - a - real.sum()))
        return pd.DataFrame(
            {
                "doc_id": [ids[i] for i in p.texts], "h1": p.h1.view(np.int64), "h2": p.h2.view(np.int64), "sim": p.sim, "template": [rules.template_part(own[i]) for i in p.texts],
                "said": said, "lit": lit, "pieces": np.array(pieces, dtype=np.int32), "n": np.array([len(x) for x in p.shingles], dtype=np.int32), "g": [bits_of(x) for x in p.shingles], "s": [x.view(np.int64) for x in p.shingles],
            }
        )

    def run(batches):
        vocabularies, total = rules.vocabularies(), np.zeros(ORDER, dtype=np.int32)
        for ids, own in _chunks(batches):
            part = chunk(ids, own, vocabularies)
            if len(part):
                if counted:
                    total += np.bincount(np.concatenate(part["s"].tolist()) & (ORDER - 1), minlength=ORDER).astype(np.int32)
                    part["hits"] = None
                yield part
        if counted and total.any():
            yield pd.DataFrame({c: [None] for c in columns} | {"hits": [total]}, dtype=object)

    columns = {"doc_id": id_type, "h1": "long", "h2": "long", "sim": "long", "template": "boolean", "said": "array<long>", "lit": "array<boolean>", "pieces": "int", "n": "int", "g": "array<long>", "s": "array<long>"}
    return rows.mapInPandas(run, ", ".join(f"{c} {t}" for c, t in (columns | ({"hits": "array<int>"} if counted else {})).items()))


def bits_of(s: np.ndarray) -> np.ndarray:
    """A bitmap of 64 bits or more, two to four times as many as there are shingles, as longs: the last bits of each shingle number a bit. Halves laid on each other are a bitmap of half the size."""
    m = 1 << max(6, (2 * len(s) - 1).bit_length())
    out = np.zeros(m, dtype=np.uint8)
    out[(s & np.uint64(m - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").view(np.int64)


def shingled(docs: DataFrame, doc_id: Column, text: Column) -> DataFrame:
    """``doc_id, s`` of ``fingerprints``: shingles take three times the disk of the texts, so they are made again where they are needed. No shuffle."""
    rows = docs.select(doc_id.alias("doc_id"), text.alias("text")).where("text is not null and doc_id is not null")
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for ids, own in _chunks(batches):
            texts, sets = shingle_sets(_joined(own))
            if len(texts):
                yield pd.DataFrame({"doc_id": [ids[i] for i in texts], "s": [x.view(np.int64) for x in sets]})

    return rows.mapInPandas(run, f"doc_id {id_type}, s array<long>")


def _joined(own: list[str]) -> str:
    return "\0".join(t.lower().replace("\0", " ") for t in own) + "\0"


def _chunks(batches):
    """Ids and own words of posts, some CHUNK characters at a time."""
    for pdf in batches:
        ids, own, size = [], [], 0
        for d, t in zip(pdf["doc_id"], pdf["text"]):
            ids.append(d)
            own.append(own_words(t))
            size += len(own[-1])
            if size >= CHUNK:
                yield ids, own
                ids, own, size = [], [], 0
        if any(t.strip() for t in own):  # a batch without a token has no rows
            yield ids, own


def table_masks(n: int) -> list[int]:
    """Bit masks of the tables for n classes, as signed longs.

    A key has so many bits that a table's bucket holds some BUCKET of n evenly spread classes; there are as many
    tables as leave two hashes that differ in USUAL bits apart with a probability of MISSED.
    """
    bits = min(40, max(8, math.ceil(math.log2(max(n, 1) / BUCKET)) if n > BUCKET else 8))
    tables = math.ceil(math.log(MISSED) / math.log(1 - (1 - USUAL / 64) ** bits))
    masks, rng = [], np.random.default_rng(64)
    while len(masks) < tables:
        order = rng.permutation(64)
        for at in range(0, 64 - bits + 1, bits):
            masks.append(sum(1 << int(b) for b in order[at : at + bits]))
    return [int(np.array([m], dtype=np.uint64).view(np.int64)[0]) for m in masks[:tables]]


def near_pairs(classes: DataFrame, every: bool = False) -> DataFrame:
    """Pairs ``a < b`` of ``vid`` that share a table's key, whose ``sim`` differ in at most HAMMING bits and whose numbers ``n`` of shingles allow the similarity.

    Of the partners a class has in a bucket only the least is named, so that a family is a star; with ``every`` all are.
    A pass files the classes in so many tables as make ROWS rows, at least TABLES, so that what is shuffled at a time does not grow with the number of tables.
    """
    n = classes.count()
    masks = list(enumerate(table_masks(n)))
    each = max(TABLES, ROWS // max(n, 1))
    on = (
        (F.col("a.t") == F.col("b.t")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.vid") < F.col("b.vid"))
        & (F.bit_count(F.col("a.sim").bitwiseXOR(F.col("b.sim"))) <= HAMMING)
        & (F.least("a.n", "b.n") >= F.lit(SIMILAR) * F.greatest("a.n", "b.n") - F.lit(1e-6))
    )
    found = []
    for at in range(0, len(masks), each):
        tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("sim").bitwiseAND(F.lit(m).cast("long")).alias("key")) for t, m in masks[at : at + each]])
        filed = classes.select("vid", "sim", "n", F.explode(tables).alias("f")).select("vid", "sim", "n", "f.t", "f.key")
        met = filed.alias("a").hint("merge").join(filed.alias("b"), on).select(F.col("a.t").alias("t"), F.col("a.key").alias("key"), F.col("a.vid").alias("a"), F.col("b.vid").alias("b"))
        found.append((met if every else met.groupBy("t", "key", "b").agg(F.min("a").alias("a"))).select("a", "b").distinct())
    return _together(found, "met")


def _together(found: list[DataFrame], label: str) -> DataFrame:
    """The distinct pairs of several passes, each run after the other."""
    if len(found) == 1:
        return found[0]
    parts = [staged(x, label) for x in found]
    whole = staged(reduce(DataFrame.unionByName, parts).distinct(), label)
    dropped(*parts)
    return whole


def prefix_pairs(sets: DataFrame, classes: DataFrame, placed: DataFrame | None = None, hits: DataFrame | None = None) -> DataFrame:
    """Pairs ``a < b`` of ``vid``, all of Jaccard similarity SIMILAR or more among them but those of one component in ``placed`` (node, root).

    ``sets``: doc_id, s; ``hits``: the counters, if they are known. Shingles are ordered by how often their counter is hit (any order common to all texts is exact;
    this one keeps the lists short). The larger set is at most 1 / SIMILAR times the smaller, and
    the first shingle in common leaves room for the overlap that is needed (length and position filters). Lists hold 32 bits of each
    shingle: sets of these have as much in common or more (equal ones counted apart), so no pair is lost. They are joined in up to PASSES passes.
    """

    known = hits is not None

    def count(batches):
        total = np.zeros(ORDER, dtype=np.int64)
        for b in batches:
            v = b.column(0).flatten().to_numpy()
            total += v.reshape(-1, ORDER).sum(0) if known else np.bincount(v & (ORDER - 1), minlength=ORDER)
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(total[slot])], names=["slot", "n"])

    slots = staged((hits if known else sets.select("s")).mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).where("n > 1"), "slots")
    met = slots.toArrow()
    counts = np.ones(ORDER, dtype=np.int32)
    counts[met["slot"].to_numpy()] = np.minimum(met["n"].to_numpy(), np.iinfo(np.int32).max)
    dropped(slots)
    shared = sets.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        for b in batches:
            s, size = b.column(1).flatten().to_numpy(), pa.compute.list_value_length(b.column(1)).to_numpy().astype(np.int64)
            c, x, row = shared.value[s & (ORDER - 1)], s.astype(np.int32), np.repeat(np.arange(len(size)), size)
            order = np.lexsort((x, c, row))
            c, x = c[order], x[order]
            at = np.arange(len(s)) - (np.cumsum(size) - size)[row]
            head = at < (size - np.ceil(SIMILAR * size - 1e-9).astype(np.int64) + 1)[row]
            again = np.zeros(len(s), dtype=bool)
            again[1:] = (x[1:] == x[:-1]) & (row[1:] == row[:-1])
            keep = np.flatnonzero(head & (c > 1) & ~again)  # a shingle met once joins nothing
            held = np.bincount(row[keep], minlength=len(size))
            cuts = pa.array(np.concatenate(([0], np.cumsum(held))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cuts, pa.array(v[keep].astype(np.int32))) for v in (x, at)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size.astype(np.int32)), *lists], names=["c", "n", "keys", "at"]).filter(pa.array(held > 0))

    id_type = sets.schema["doc_id"].dataType.simpleString()
    heads = staged(sets.select("doc_id", "s").mapInArrow(run, f"c {id_type}, n int, keys array<int>, at array<int>"), "heads")
    named = classes.select("vid")  # equal own words are one class, of which one post is asked
    if placed is not None:
        named = named.join(placed.hint("merge"), F.col("vid") == F.col("node"), "left").select("vid", F.coalesce("root", "vid").alias("root"))
    else:
        named = named.withColumn("root", F.col("vid"))
    filed = staged(heads.join(named.hint("merge"), F.col("c") == F.col("vid")).select("vid", "root", "n", "keys", "at"), "prefixes")
    dropped(heads)
    passes = max(1, min(PASSES, math.ceil((filed.agg(F.sum(F.size("keys"))).first()[0] or 0) / ROWS)))
    needed = F.lit(SIMILAR / (1 + SIMILAR)) * (F.col("a.n") + F.col("b.n")) - F.lit(1e-6)
    on = (
        (F.col("a.key") == F.col("b.key")) & (F.col("a.vid") < F.col("b.vid")) & (F.col("a.root") != F.col("b.root"))
        & (F.least("a.n", "b.n") >= F.lit(SIMILAR) * F.greatest("a.n", "b.n") - F.lit(1e-6))
        & (F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at")) >= needed)
    )
    found = []
    for i in range(passes):
        rows = filed.select("vid", "root", "n", F.explode(F.arrays_zip("keys", "at")).alias("x")).select("vid", "root", "n", F.col("x.keys").alias("key"), F.col("x.at").alias("at")).where(F.pmod("key", F.lit(passes)) == i)
        found.append(rows.alias("a").hint("merge").join(rows.alias("b"), on).select(F.col("a.vid").alias("a"), F.col("b.vid").alias("b")).distinct())
    return _together(found, "met")


def verified(pairs: DataFrame, prints: DataFrame, sets=None) -> DataFrame:
    """The pairs whose shingle sets have a Jaccard similarity of SIMILAR or more.

    A bit that one set has and the other has not is a shingle that they do not share, which bounds what they share; pairs that fail by this
    bound never meet their sets. Pairs go in passes by their first end, each of ROWS pairs or of twice as many as there are posts. ``sets`` gives doc_id and s of the posts of a table of doc_id (else they are in ``prints``).
    """
    sets = sets or (lambda wanted: prints.select("doc_id", "s").join(wanted.hint("merge"), "doc_id", "left_semi"))

    def passed(p: DataFrame, held: DataFrame, columns: list[str], most: int, test: Column, names: list[str], label: str) -> DataFrame:
        passes = max(1, math.ceil(p.count() / most))
        mine = lambda df, c, i: df.where(F.pmod(F.xxhash64(c), F.lit(passes)) == i) if passes > 1 else df
        side = lambda x, of: of.select(F.col("doc_id").alias(x), *[F.col(c).alias(f"{c}{x}") for c in columns])
        found = [mine(p, "a", i).join(side("a", mine(held, "doc_id", i)).hint("merge"), "a").join(side("b", held).hint("merge"), "b").where(test).select(*names) for i in range(passes)]
        return _together(found, label) if passes > 1 else staged(found[0], label)

    def wanted(p: DataFrame) -> DataFrame:
        return p.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()

    def alike(common: Column) -> Column:
        return common >= SIMILAR * (F.col("na") + F.col("nb") - common) - 1e-6

    def folded(x: Column, y: Column) -> Column:
        """x at the size of y, which is the same or half of it (or else y is folded)."""
        half = (F.size(x) / 2).cast("int")
        return F.when(F.size(x) > F.size(y), F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseOR(q))).otherwise(x)

    def apart(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda s, v: s + v)

    ga, gb = F.col("ga"), F.col("gb")
    most = F.least(F.col("na") - apart(folded(ga, gb), folded(gb, ga)), F.col("nb") - apart(folded(gb, ga), folded(ga, gb)))
    near = F.least("na", "nb") >= F.lit(SIMILAR) * F.greatest("na", "nb") - F.lit(1e-6)  # so that bitmaps differ by one fold at most
    held = staged(prints.select("doc_id", "g", "n").join(wanted(pairs).hint("merge"), "doc_id", "left_semi"), "held")
    able = passed(pairs, held, ["g", "n"], max(ROWS, 2 * held.count()), F.when(near, alike(most)), ["a", "b", "na", "nb"], "able")
    dropped(held)
    if able.isEmpty():
        return able.select("a", "b")
    held = staged(sets(wanted(able)), "held")
    kept = passed(able, held, ["s"], max(ROWS, 2 * held.count()) // 16, alike(F.size(F.array_intersect("sa", "sb"))), ["a", "b"], "kept")  # sets take some 16 times as much as bitmaps
    dropped(held, able)
    return kept


def least_nodes(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links ``u, v`` and the least node of the component of each."""
    at, nodes = pd.factorize(np.concatenate([u, v]), sort=True)
    a, b = at[: len(u)], at[len(u) :]
    least = np.arange(len(nodes))
    while (least[a] != least[b]).any():
        x, y = least[a], least[b]
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while (least[least] != least).any():
            least = least[least]
    return nodes, nodes[least]


def components(links: DataFrame) -> DataFrame:
    """``node, root`` (the least node of its component) for every node that has a link ``a, b``.

    Alternating large-star and small-star rounds; each is written, and rounds end when nothing
    changes (their number grows with the logarithm of the component size; none is cut off) or when LOCAL links
    or fewer are left, which one task joins.
    """
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    id_type = edges.schema["u"].dataType.simpleString()

    def joined(batches):
        parts = [(pdf["u"].to_numpy(), pdf["v"].to_numpy()) for pdf in batches]
        if parts:
            nodes, roots = least_nodes(*(np.concatenate(x) for x in zip(*parts)))
            for i in range(0, len(nodes), 1 << 16):
                yield pd.DataFrame({"node": nodes[i : i + (1 << 16)], "root": roots[i : i + (1 << 16)]})

    before, state = None, (edges.count(),)
    while state != before:
        if state[0] <= LOCAL:
            rooted = staged(edges.coalesce(1).mapInPandas(joined, f"node {id_type}, root {id_type}"), "rooted")
            dropped(edges)
            return rooted
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges, old = staged(small, "stars"), edges
        dropped(old)
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    rooted = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    roots = rooted.select(F.col("root").alias("node"), "root").distinct()
    return rooted.unionByName(roots.join(rooted.select("node").hint("merge"), "node", "left_anti"))


def keeps_company(prints: DataFrame) -> DataFrame:
    """``h1`` of the classes all of whose sentences are seeds or became trusted by the company they keep.

    Rounds over (class, sentence) rows: a round trusts every sentence that stands beside a trusted one (or beside
    furniture) in LEAST classes and in COMPANY of those in which it has company. Sentences that occur in
    one class only can never be trusted so; they are counted per class and leave the rounds.
    """
    lone = F.size("said") + F.col("pieces") > 1
    rows = (
        prints.where("size(said) > 0")
        .select("h1", lone.alias("company"), (F.col("pieces") > 0).alias("piece"), F.explode(F.arrays_zip("said", "lit")).alias("x"))
        .select("h1", "company", "piece", F.col("x.said").alias("k"), F.col("x.lit").alias("lit")).distinct()
    )
    rows = staged(rows, "sentences")
    counts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("classes"), F.count_if("company").alias("beside"), F.max("lit").alias("lit"))
    counts = staged(counts.where(F.col("lit") | (F.col("classes") >= LEAST)), "counts")
    shared = staged(rows.join(counts.select("k", "beside").hint("merge"), "k").select("h1", "k", F.col("piece").alias("near"), "beside"), "shared")
    trusted = new = staged(counts.where("lit").select("k"), "trusted")
    dropped(rows, counts)
    other = shared  # rows of sentences that are not trusted; ``near``: beside furniture or a trusted one
    while True:
        met = other.join(new.withColumn("met", F.lit(True)).hint("merge"), "k", "left")
        near = F.col("near") | F.coalesce(F.max("met").over(Window.partitionBy("h1")), F.lit(False))
        other, old = staged(met.withColumn("near", near).where("met is null").drop("met"), "other"), other
        if old is not shared:
            dropped(old)
        met = other.where("near").groupBy("k").agg(F.count(F.lit(1)).alias("c"), F.first("beside").alias("beside"))
        new = staged(met.where((F.col("c") >= LEAST) & (F.col("c") >= COMPANY * F.col("beside"))).select("k"), "newly")
        if new.isEmpty():
            break
        trusted = trusted.unionByName(new)
    dropped(other)
    # every sentence of the class is trusted
    wanted = prints.where("size(said) > 0").select("h1", F.size("said").alias("n")).distinct()
    has = shared.join(trusted.hint("merge"), "k", "left_semi").groupBy("h1").agg(F.count(F.lit(1)).alias("c"))
    return wanted.join(has.hint("merge"), "h1").where("n = c").select("h1")


def travelled(placed: DataFrame, docs: DataFrame, doc_id: Column, text: Column) -> DataFrame:
    """``vid`` of the classes that the exact check accepts as what the residue of their component is."""
    mixed = placed.groupBy("class_id").agg(F.max("told").alias("some"), F.min("told").alias("every")).where("some and not every")
    members = staged(placed.join(mixed.hint("merge"), "class_id", "left_semi").select("vid", "class_id", "told", "template"), "members")
    if members.isEmpty():
        return members.select("vid")
    rows = docs.select(doc_id.alias("vid"), text.alias("text")).join(members.hint("merge"), "vid")
    id_type = rows.schema["vid"].dataType.simpleString()

    def evidence(batches):
        for pdf in batches:
            out = set()
            for c, template, t in zip(pdf["class_id"], pdf["template"], pdf["text"]):
                own = own_words(t)
                # a template part may stand in a post of real sentences: those are no evidence
                out |= {(c, "slot", *s) for s in slots(own)} if template else {(c, "said", s, "", "") for s in sentences(own)}
            yield pd.DataFrame(sorted(out), columns=["class_id", "kind", "x", "y", "z"])

    def accept(key, left, right):
        said = set(left.loc[left["kind"] == "said", "x"])
        parts = set(left.loc[left["kind"] == "slot", ["x", "y", "z"]].itertuples(index=False, name=None))
        good = []
        for vid, t in zip(right["vid"], right["text"]):
            own = own_words(t)
            if (parts and holds_slot(own, parts)) or (said and all(says_the_same(s, said) for s in sentences(own))):
                good.append(vid)
        return pd.DataFrame({"vid": good})

    seen = rows.where("told").mapInPandas(evidence, f"class_id {id_type}, kind string, x string, y string, z string").distinct()
    asked = rows.where("not told").select("class_id", "vid", "text")
    return seen.groupBy("class_id").cogroup(asked.groupBy("class_id")).applyInPandas(accept, f"vid {id_type}")


def classify(docs: DataFrame, doc_id: Column, text: Column) -> DataFrame:
    """One row per post with own words: ``doc_id, class_id, links, trusted, residue, reason``.

    ``class_id`` is the least post id of the connected component, ``links`` the number of links kept
    between the post's class and classes with other words (a star in a family, not all its pairs), ``trusted`` whether the seeds alone
    decide, ``residue`` the verdict, ``reason`` how it came: "seed", "company" (sentences), "component" (links) or null.
    Null texts, and posts that only quote, have no row; post ids must
    be unique; repeated texts are posts of their own; empty in, empty out.
    """
    whole = staged(fingerprints(docs, doc_id, text, counted=True).drop("s"), "prints")
    prints, hits = whole.where("doc_id is not null").drop("hits"), whole.where("doc_id is null").select("hits")
    alone = F.col("template") | ((F.size("said") > 0) & F.forall("lit", lambda x: x))
    kept = keeps_company(prints).distinct().withColumn("kept", F.lit(True))
    classes = staged(
        prints.select("h1", "h2", "doc_id", "sim", "n", "template", alone.alias("trusted")).groupBy("h1", "h2")
        .agg(F.min("doc_id").alias("vid"), F.first("sim").alias("sim"), F.first("n").alias("n"), F.max("template").alias("template"), F.max("trusted").alias("trusted"))
        .join(kept.hint("merge"), "h1", "left").withColumn("told", F.col("trusted") | F.coalesce("kept", F.lit(False))).drop("kept"),
        "classes",
    )
    sets = lambda wanted: shingled(docs.join(wanted.select(F.col("doc_id").alias("__wanted")).hint("merge"), doc_id == F.col("__wanted"), "left_semi"), doc_id, text)
    near = staged(near_pairs(classes), "near")
    stars = verified(near, prints, sets)
    pairs = staged(prefix_pairs(shingled(docs, doc_id, text), classes, components(stars), hits), "pairs")
    rest = verified(pairs, prints, sets)
    links = staged(stars.unionByName(rest).distinct(), "verified")
    dropped(near, pairs)
    comp = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    placed = staged(
        classes.drop("sim", "n").join(comp.hint("merge"), classes["vid"] == comp["node"], "left").drop("node").join(degree.hint("merge"), F.col("vid") == F.col("node"), "left")
        .select("vid", "h1", "h2", "template", "trusted", "told", F.coalesce("root", "vid").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links")),
        "placed",
    )
    linked = travelled(placed, docs, doc_id, text).withColumn("linked", F.lit(True))
    reason = F.when(F.col("trusted"), "seed").when(F.col("told"), "company").when(F.col("linked"), "component")
    verdict = placed.join(linked.hint("merge"), "vid", "left").select("h1", "h2", "class_id", "links", "trusted", reason.isNotNull().alias("residue"), reason.alias("reason"))
    return prints.select("doc_id", "h1", "h2").join(verdict.hint("merge"), ["h1", "h2"]).select("doc_id", "class_id", "links", "trusted", "residue", "reason")
