import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom import session
from chronoloom.llm import residue, tokens
from chronoloom.llm import residue_rules as rules
from chronoloom.llm.ownwords import own_words
from chronoloom.llm.residue_rules import holds_slot, slots, template_part
from chronoloom.llm.textprint import fingerprint

OWN = [
    ("anna wrote:\n> Page not found\n\nI fixed it.", "I fixed it."),
    ("[quote=a]x [quote=b]y[/quote] z[/quote]\nmine", "mine"),
    ("<blockquote>a<blockquote>b</blockquote></blockquote>mine<br />too", "mine\ntoo"),
    ("> <p>quoted</p>\nmine", "mine"),
    ("mine\n-- \nSent from my {{device_name}}", "mine"),
    ("mine\n_______________\n%USERNAME%", "mine"),
    ("look\n```\n<h1>{{ title }}</h1>\n```\n[code]x[/code]\nend", "look\nend"),
    ("a&nbsp;b &amp;lt;name&gt;[/url]", "a b <name>"),
    ("", ""), (None, ""), ("[quote=a]never closed", ""), ("\r\n", ""),
]


@pytest.mark.parametrize("text,own", OWN)
def test_own_words(text, own):
    assert own_words(text) == own


@pytest.mark.parametrize(
    "text",
    ["Hello {{NAME}},", "Dear {0}, your balance is {1}.", "Hi (name goes here), thanks", "You need 7 {!title} turns", "Re: SUBJECT_LINE", "Your order of DD/MM/YYYY", "Hello XXXX,", "see %%Link%% or *|name|*", "at @@DATE@@",
     "&#123;&#123;Name&#125;&#125;", "&lt;insert date&gt;", "[Your title here]", "[title] ships", "((TITLE))", "${USER}", "<%= city %>", "__CODE__", "#ORDER_ID#", "%USERNAME%", "Posted by undefined on NaN/NaN/NaN", "{Great|Super} deal", "TODO: body", "<< your text >>", "Total: %d items, %s in stock"],
)
def test_template_parts(text):
    assert template_part(own_words(text))


@pytest.mark.parametrize(
    "text",
    ['In the printer you type "<MEMBER>" and it works.', "My config has `{{ TITLE }}` as the title.", "In der Vorlage stand „{{COMPANY}}“.", "Prices rose 5% and then 7% in C# shops.", "I paid 20% less, {well} almost", "Use #1 or #2.", "Thanks [b]a lot[/b]!", "[deleted]", "[removed by moderator]", "snake_case and __init__ are fine? `__init__`", "a < b and c > d"][:4]
    + ["Use #1 or #2.", "Thanks [b]a lot[/b]!", "[deleted]", "[removed by moderator]", "a < b and c > d"],
)
def test_not_template(text):
    assert not template_part(own_words(text))


def seeds(text):
    """Sentences, whether each is a seed, and whether it is furniture, furniture first dropped."""
    joined = own_words(text).lower() + "\0"
    p = fingerprint(joined, rules.vocabularies())
    seed, piece = rules.kinds(p, joined)
    return [bool(x) for x, y in zip(seed, piece) if not y]


@pytest.mark.parametrize(
    "text",
    ["Error 404", "Request id 5340d9", "status: 502", "HTTP 502 Bad Gateway", "Error: 401 Unauthorized", "503 Service Temporarily Unavailable", "The requested page could not be found.", "The page you are looking for does not exist.",
     "You are not authorized to view this page.", "The server is temporarily unavailable, please try again later.", "The requested URL was not found on this server.", "Sorry, the page you requested could not be located.", "You must have JavaScript turned on to use this site.",
     "You need to enable JavaScript to run this app.", "Please enable cookies in your browser and reload the page.", "This site requires JavaScript to be enabled.", "JavaScript is required to view this page.", "Your browser does not support JavaScript.",
     "Lorem ipsum dolor sit amet, consectetur elit.", "asdf asdf asdf", "qwertz qwertz", "zzzzzzzzzzzz", "testing 1 2 3", "Your text here."],
)
def test_seeds(text):
    assert all(seeds(text)) and seeds(text)


@pytest.mark.parametrize(
    "text",
    ["You have to enable JavaScript for the chart tab, otherwise it stays white.", "Cookies must be on for the login, I had blocked them and lost an evening.", "Error 401 again last night, the host says it was a disk.", "My export script threw a 429 for an hour.",
     "Gone.", "Conflict.", "This post was removed.", "The image was found.", "JavaScript is enabled in your browser.", "I enabled JavaScript and the page is back.", "Set HTTP_PROXY before you start the build.", "Use List<String> or Optional<Order> here.", "1 2 3", "[deleted]", "I got page not found and then it worked."],
)
def test_members_are_no_seeds(text):
    assert not any(seeds(text)) and not template_part(own_words(text))


@pytest.mark.parametrize("text", ["Home | Boards | Search | Log in", "« prev 1 2 3 next »", "Powered by boardware 4", "Menu Register FAQ", "Skip to content", "Back to the front page"])
def test_furniture(text):
    assert seeds(text) == []


def test_template_shapes():
    for text in ("Hi {customer-first-name}, thanks", "Dear " + "{{" + "very long field name " * 20 + "}}", "Re: SUBJECT_LINE", "Estimado/a NOMBRE APELLIDO:", "Sehr geehrte(r) ANREDE NACHNAME,"):
        assert template_part(text)
    assert not template_part('It said "' + "a long citation " * 20 + '{{NAME}}" there')


def test_fingerprints_do_not_depend_on_the_batch():
    texts = ["", "one", "one two", "a b c d e", "Down for maintenance .", "down  for maintenance.", "12 apples", "7 apples", "x" * 5000, "Ärger! 🙂 ok.\nzwei"]
    whole = fingerprint("\0".join(t.lower() for t in texts) + "\0")
    assert whole.texts.tolist() == list(range(1, 10))
    for i, n in enumerate(whole.texts):
        one = fingerprint(texts[n].lower() + "\0")
        assert (one.h1[0], one.h2[0], one.sim[0]) == (whole.h1[i], whole.h2[i], whole.sim[i])
        assert one.shingles[0].tolist() == whole.shingles[i].tolist() and one.sentence.tolist() == whole.sentence[whole.owner == i].tolist()
    assert whole.h1[3] == whole.h1[4] and whole.h1[5] == whole.h1[6] and len(set(whole.h1.tolist())) == 7 and fingerprint("").texts.size == 0


@pytest.mark.parametrize("seed", range(3))
def test_components_against_union_find(spark, seed):
    rnd = random.Random(seed)
    links = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)]
    parent = {x: x for e in links if e[0] != e[1] for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r.node: r.root for r in residue.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def broadcasts(spark, run):
    """How many tables pass through the driver while ``run`` works."""
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()
    bus.waitUntilEmpty(30_000)
    before = store.executionsCount()
    run()
    bus.waitUntilEmpty(30_000)
    runs = store.executionsList(before, 1000)
    assert runs.size() > 0
    return sum(runs.apply(i).physicalPlanDescription().split("== Initial Plan ==")[0].count("BroadcastExchange") for i in range(runs.size()))


@pytest.mark.parametrize("local", [0, residue.LOCAL])
def test_rounds_of_components_broadcast_nothing(spark, local, monkeypatch):
    """A chain of 40 links takes several rounds; either way of joining them has the same result."""
    monkeypatch.setattr(residue, "LOCAL", local)
    links = spark.createDataFrame([(str(i), str(i + 1)) for i in range(10, 50)] + [("60", "61"), ("7", "7")], "a string, b string")
    got = []
    assert broadcasts(spark, lambda: got.extend(residue.components(links).collect())) == 0
    assert {r.node: r.root for r in got} == {str(i): "10" for i in range(10, 51)} | {"60": "60", "61": "60"} and len(got) == 43


def test_rounds_of_sentences_broadcast_nothing(spark):
    """Each round trusts one sentence more, beside the one before in two classes."""
    said = [(2 * i + j, 0, [i, i + 1], [i == 0, False]) for i in range(6) for j in range(2)]
    # the seventh sentence has other company in most of its classes
    said += [(50 + j, 0, [6, 200 + j], [False, False]) for j in range(6)] + [(60, 0, [1], [False]), (61, 0, [300], [False])]
    prints = spark.createDataFrame(said, "h1 long, pieces int, said array<long>, lit array<boolean>")
    got = []
    assert broadcasts(spark, lambda: got.extend(residue.keeps_company(prints).collect())) == 0
    assert sorted(r.h1 for r in got) == [*range(10), 60]


def test_nothing_is_broadcast(spark):
    """Every join of the whole query merges: what Spark takes for small after an explode or a Python step need not be."""
    docs = [(i, t) for i, t in near_texts(6)] + [(9000 + i, "Error 404" + ". Hello {{NAME}}" * (i % 2)) for i in range(4)]
    frame = spark.createDataFrame([*docs, (9100, "Dear {0}, " + docs[0][1])], "doc_id long, text string")
    assert broadcasts(spark, lambda: residue.classify(frame, F.col("doc_id"), F.col("text")).write.format("noop").mode("overwrite").save()) == 0


def verdicts(spark, docs):
    rows = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, h1 string")
    return {r.doc_id: r for r in residue.classify(rows, F.col("doc_id"), F.col("text")).collect()}


def test_classify(spark):
    body = " ".join(f"word{i % 17}x the server did not answer in time" for i in range(30))
    docs = [
        (1, "Error 404"), (2, "error 404"), (3, "403 Forbidden\n> quoted"), (4, body), (5, None), (6, ""), (7, "> only a quote"), (10, "x y" * 70_000), (11, "a b " * 100_000),
        (12, "Hello {{NAME}}"), (13, "I typed `{{NAME}}` there"), (14, "Error 404"),
    ]
    got = verdicts(spark, docs)
    assert {d for d, r in got.items() if r.residue} == {1, 2, 3, 12, 14}
    assert set(got) == {d for d, _ in docs} - {5, 6, 7}
    assert got[1].class_id == got[14].class_id == 1 and got[1].reason == "seed" and got[4].reason is None
    assert fingerprint("\0\0").shingles == [] and fingerprint("... !\0").sentence.size == 0
    bare = spark.createDataFrame([(1, ""), (2, "> only a quote"), (3, None)], "doc_id long, text string")
    assert residue.classify(bare, F.col("doc_id"), F.col("text")).count() == 0
    none = spark.createDataFrame([], "doc_id long, text string")
    assert residue.classify(none, F.col("doc_id"), F.col("text")).count() == 0


def test_labels_travel_over_sentences(spark):
    """A sentence beside trusted ones in two classes is trusted, and so on; a member's sentence keeps other company."""
    docs = [
        (1, "Error 404\nThe lights are out here."), (2, "503 Service unavailable\nThe lights are out here."), (3, "The lights are out here."), (4, "The lights are out here.\nCome back when they are on."),
        (5, "Menu Register FAQ\nCome back when they are on."), (6, "Come back when they are on."), (7, "Error 404\nDoes anyone know why?"), (8, "The pump is wet. Does anyone know why?"), (9, "Nobody came.\nDoes anyone know why?"),
        (10, "Does anyone know why?"), (11, "Error 404\nOnly here."), (12, "THE LIGHTS ARE OUT HERE ."),
    ]
    got = verdicts(spark, docs)
    assert {d for d, r in got.items() if r.residue} == {1, 2, 3, 4, 5, 6, 12}
    assert {d for d, r in got.items() if r.reason == "company"} == {1, 2, 3, 4, 5, 6, 12} and got[12].class_id == got[3].class_id == 3


# a letter whose words are unlike those of any rule
LETTER = "the parcel left our depot in the north on monday and the driver will call before noon so please keep a phone close and a door open for the crew with the two long boxes that came from the mill last week and that nobody in the office has looked at since then"


def test_template_labels_travel_by_slot(spark):
    docs = [(1, f"Dear {{{{first name}}}} {LETTER} thank you"), (2, f"Dear ~~first name~~ {LETTER} thank you"), (3, f"Dear Maria {LETTER} thank you"), (4, f"Dear \"~~first name~~\" {LETTER} thank you")]
    got = verdicts(spark, docs)
    assert {r.class_id for r in got.values()} == {1}
    assert {d for d, r in got.items() if r.trusted} == {1} and {d for d, r in got.items() if r.residue} == {1, 2} and got[2].reason == "component"


def test_messages_travel_along_links_but_own_sentences_do_not(spark):
    page = ["Error 404", "The requested page could not be found.", "You are not authorized to view this page.", "The server is temporarily unavailable, please try again later.", "Your browser does not support JavaScript.", "JavaScript is required to view this page."] * 2
    docs = [(1, "\n".join(page)), (2, "\n".join(page).replace("You are not authorized to view this page.", "You are not really authorized to view this page.", 1)), (3, "\n".join([*page, "I sold the boat."]))]
    got = verdicts(spark, docs)
    assert got[2].class_id == got[3].class_id == 1 and got[2].reason == "component" and not got[3].residue


def test_slots_need_the_same_place():
    known = slots("Dear {{NAME}}, thanks")
    assert known == {("dear", "name", "thanks")}
    assert holds_slot("Dear ~name~, thanks", known) and not holds_slot("Dear Ann, my ~name~ is", known) and not holds_slot("Dear name, thanks", known)


def near_texts(seed):
    rnd = random.Random(seed)
    words = [f"{a}{b}{c}" for a in "klmnopqr" for b in "aeiou" for c in "stvwxyz"]
    docs = []
    for n in (6, 9, 14, 30, 60, 120, 300):
        for _ in range(6):
            base = [rnd.choice(words) for _ in range(n)]
            docs.append(base)
            for changes in (1, 1, 2, 3):
                other = list(base)
                for _ in range(changes):
                    other[rnd.randrange(n)] = rnd.choice(words)
                docs += [other, base + other[:changes], base[changes:]]
    docs += [["the", "same", "tail", "of", "words"] * 3 + d[:4] for d in docs[:60]]
    return [(i, " ".join(d)) for i, d in enumerate(docs)] + [(5000 + i, " ".join(d).upper()) for i, d in enumerate(docs[:20])]


def test_links_against_brute_force(spark):
    """The tables alone meet nine of ten pairs of the similarity; with the prefix join none is lost."""
    rows = near_texts(5)
    first, sets = {}, {}
    for i, t in rows:
        first.setdefault(t.lower(), i)
    for t, i in first.items():
        sets[i] = set(fingerprint(t + "\0").shingles[0].tolist())
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    prints = residue.staged(residue.fingerprints(frame, F.col("doc_id"), F.col("text")), "prints")
    classes = residue.staged(prints.groupBy("h1", "h2").agg(F.min("doc_id").alias("vid"), F.first("sim").alias("sim"), F.first(F.size("s")).alias("n")), "classes")
    exact = {(r.a, r.b) for r in residue.verified(residue.prefix_pairs(prints, classes), prints).collect()}
    assert exact == want and len(want) > 150
    met = {(r.a, r.b) for r in residue.near_pairs(classes, every=True).collect()}
    assert len(met & want) >= 0.9 * len(want)
    near = residue.verified(residue.near_pairs(classes), prints)
    place = {r.node: r.root for r in residue.components(near).collect()}
    assert sum(place.get(a, a) == place.get(b, b) for a, b in want) >= 0.9 * len(want)
    # by class ids: the components of all links
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in want:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    out = {r.doc_id: r.class_id for r in residue.classify(frame, F.col("doc_id"), F.col("text")).collect()}
    assert out == {i: find(first[t.lower()]) for i, t in rows}


def test_a_family_is_a_star(spark):
    """A thousand variants of one text cost about one candidate each, not all pairs."""
    base = [f"w{i}" for i in "abcdefghijklmnopqrstuvwxyz"] * 3
    rows = [(i, " ".join([*base, f"end{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}"])) for i in range(1000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    prints = residue.staged(residue.fingerprints(frame, F.col("doc_id"), F.col("text")), "prints")
    classes = residue.staged(prints.groupBy("h1", "h2").agg(F.min("doc_id").alias("vid"), F.first("sim").alias("sim"), F.first(F.size("s")).alias("n")), "classes")
    stars = residue.staged(residue.near_pairs(classes), "near")
    assert stars.count() < 10_000
    comp = residue.components(residue.verified(stars, prints))
    assert comp.count() == 1000 and {r.root for r in comp.collect()} == {0} and residue.prefix_pairs(prints, classes, comp).count() == 0


def test_passes_lose_no_pair(spark, monkeypatch):
    """Tables and prefixes in several passes meet what one pass meets, and nothing of the passes stays on disk."""
    frame = spark.createDataFrame(near_texts(7), "doc_id long, text string")
    prints = residue.staged(residue.fingerprints(frame, F.col("doc_id"), F.col("text")), "prints")
    classes = residue.staged(prints.groupBy("h1", "h2").agg(F.min("doc_id").alias("vid"), F.first("sim").alias("sim"), F.first("n").alias("n")), "classes")

    def pairs():
        return [{(r.a, r.b) for r in x.collect()} for x in (residue.near_pairs(classes), residue.prefix_pairs(prints, classes), residue.prefix_pairs(residue.shingled(frame, F.col("doc_id"), F.col("text")), classes))]

    once = pairs()
    monkeypatch.setattr(residue, "ROWS", 500)
    monkeypatch.setattr(residue, "TABLES", 2)
    before = len(session._WRITTEN)
    assert pairs() == once and len(once[1]) > 150 and once[1] == once[2]
    assert len(session._WRITTEN) == before + 5  # three results and the prefixes of two
    monkeypatch.setattr(residue, "ROWS", 1 << 20)
    near = residue.staged(residue.prefix_pairs(prints, classes), "pairs")
    want = {(r.a, r.b) for r in residue.verified(near, prints).collect()}
    monkeypatch.setattr(residue, "ROWS", 1)  # then passes have twice as many pairs as posts, or an eighth
    assert {(r.a, r.b) for r in residue.verified(near, prints).collect()} == want and len(want) > 150


def test_bitmaps_bound_what_two_sets_share():
    rnd = random.Random(3)
    for n in (1, 31, 32, 33, 60, 64, 65, 2000):
        a = [rnd.getrandbits(64) for _ in range(n)]
        b = a[: int(0.9 * n)] + [rnd.getrandbits(64) for _ in range(n // 5)] or [rnd.getrandbits(64)]
        x, y = ({i * 64 + j for i, w in enumerate(residue.bits_of(np.array(v, dtype=np.uint64)).view(np.uint64).tolist()) for j in range(64) if w >> j & 1} for v in (a, b))
        size = 64 * min(len(residue.bits_of(np.array(v, dtype=np.uint64))) for v in (a, b))
        x, y = {i % size for i in x}, {i % size for i in y}
        assert size >= 1.6 * n and x == {v % size for v in a} and len(set(a) & set(b)) <= min(len(a) - len(x - y), len(b) - len(y - x))


def test_little_stays_on_disk(spark):
    """Shingles are written nowhere for all posts; what a step wrote or shuffled is gone when it has been used."""
    frame = spark.createDataFrame(near_texts(6), "doc_id long, text string")
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: sum(".data" in str(f) for f in disk.getAllFiles().mkString(" ").split(" "))
    before, files = len(session._WRITTEN), shuffled()
    got = residue.classify(frame, F.col("doc_id"), F.col("text"))
    left = session._WRITTEN[before:]
    assert not [x for x in left if any(f"chronoloom-{label}-" in x for label in ("heads", "met", "held", "able", "near", "pairs", "sentences", "counts", "other", "links"))]
    assert all("s" not in spark.read.parquet(x).columns for x in left)
    for _ in range(100):
        if shuffled() - files <= 10:  # those of counts that are read, not written
            break
        time.sleep(0.1)
    assert shuffled() - files <= 10 and got.count() == len(near_texts(6))


def test_tables_grow_with_the_classes():
    few, many = residue.table_masks(1000), residue.table_masks(10**9)
    assert len(few) < len(many) and bin(few[0] & (2**64 - 1)).count("1") == 8 and bin(many[0] & (2**64 - 1)).count("1") == 26


def test_token_counts(spark):
    texts = ["", None, "hello world", "ñandú 🙂", "a" * 100_000, "<|endoftext|>"]
    got = [r.n for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(tokens.token_count(F.col("t")).alias("n")).collect()]
    enc = tokens.encoder()
    assert got == [len(enc.encode_ordinary(t)) if t else 0 for t in texts] and got[2] == 2
