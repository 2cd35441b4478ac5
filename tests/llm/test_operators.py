"""Training-data operators at their edges and against brute force."""

import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairnlake.llm import abuse, components, leaks, matching, queries, survivors, tokens


# survivors

def fields():
    return {"kind": F.col("kind").isNotNull(), "name": F.col("name") != ""}


def chosen(spark, rows):
    df = spark.createDataFrame([(*r, 1, "?") for r in rows], "g string, key string, trust int, at string, kind string, name string, members int, layers string").withColumn("at", F.col("at").cast("timestamp"))
    out = survivors.survivors(df, "g", "key", "trust", "at", fields(), ["kind", "name"])
    return {r.g: (r.key, r.kind_from, r.name_from) for r in out.collect()}


def test_survivor_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(f"g{rng.randrange(40)}", f"k{i:03}", rng.choice([1, 2, 3, None]), rng.choice(["2026-01-01", "2026-01-02", "2026-01-03", None]), rng.choice(["x", None]), rng.choice(["n", "", None])) for i in range(200)]
    want = {}
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g]
        order = lambda r: (r[2] if r[2] else 9, -int(r[3][-2:]) if r[3] else 0, r[1])
        if len(own) >= 2:
            full = lambda r: (r[4] is not None) + bool(r[5])
            first = lambda ok: min((r for r in own if ok(r)), key=order, default=(None, None))[1]
            want[g] = (min(own, key=lambda r: (-full(r), order(r)))[1], first(lambda r: r[4] is not None), first(lambda r: bool(r[5])))
    assert chosen(spark, rows) == want


def test_survivors_of_odd_groups(spark):
    assert chosen(spark, []) == {}
    assert chosen(spark, [("g", "a", 1, None, None, None)]) == {}
    assert chosen(spark, [("g", "b", None, None, None, None), ("g", "a", None, None, None, None), (None, "c", 1, None, "x", "n"), ("g", None, 1, None, "x", "n")]) == {"g": ("a", None, None)}


def test_layers(spark):
    df = spark.createDataFrame([("g", "a", 1, "2026-01-01", "x", "n"), ("g", "b", 2, "2026-01-02", "x", "n"), ("g", "c", 3, "2026-01-01", None, "n")], "g string, key string, trust int, at string, kind string, name string").withColumn("at", F.col("at").cast("timestamp"))
    r = survivors.survivors(df, "g", "key", "trust", "at", fields(), ["kind"]).first()
    assert (r.skyline, r.layers, r.key) == (2, 2, "a")


def test_fields_come_from_layers_and_order_overrules(spark):
    """``b`` is dominated by ``a`` and stands in the second layer, ``c`` in the first; only ``b`` and ``c`` have a name."""
    rows = [("g", "a", 1, "2026-01-02", "x", None), ("g", "b", 1, "2026-01-01", None, "n"), ("g", "c", 2, "2026-01-03", None, "m"), ("h", "a", 1, "2026-01-02", "x", None), ("h", "c", 2, "2026-01-03", None, "m")]
    df = spark.createDataFrame(rows, "g string, key string, trust int, at string, kind string, name string").withColumn("at", F.col("at").cast("timestamp"))
    got = {r.g: (r.layers, r.kind_from, r.name_from, r.overruled) for r in survivors.survivors(df, "g", "key", "trust", "at", fields(), ["kind"]).collect()}
    assert got == {"g": (2, "a", "b", 1), "h": (1, "a", "c", 0)}


# components


def groups(spark, pairs, **kw):
    df = spark.createDataFrame(pairs, "x string, y string")
    return {r.v: r.root for r in components.linked_groups(df, "x", "y", **kw).collect()}


def brute(pairs):
    parent = {}

    def find(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for a, b in pairs:
        if a and b and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {v: find(v) for v in list(parent)}


def test_groups_against_brute_force(spark):
    rng = random.Random(6)
    pairs = [("hub", f"h{i}") for i in range(60)] + [(f"c{i:02}", f"c{i + 1:02}") for i in range(40)] + [("a", "a"), (None, "b"), ("b", None)]
    pairs += [(f"r{rng.randrange(80)}", f"r{rng.randrange(80)}") for _ in range(50)]
    pairs += [(b, a) for a, b in pairs[:30]] + pairs[:10]
    rng.shuffle(pairs)
    assert groups(spark, pairs) == brute(pairs)


def test_a_long_chain_on_the_giant_component(spark):
    pairs = [("m", f"h{i}") for i in range(20)] + [("h1", "t00")] + [(f"t{i:02}", f"t{i + 1:02}") for i in range(25)] + [("t25", "0least"), ("q", "r")]
    assert groups(spark, pairs, rounds=2) == brute(pairs)


def test_no_links(spark):
    assert groups(spark, []) == {} and groups(spark, [("a", "a"), (None, None)]) == {}


# tokens

needs_vocabulary = pytest.mark.skipif(not os.path.exists(queries.VOCABULARY), reason="no vocabulary file")


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.binary(min_size=1, max_size=6), st.lists(st.integers(0, 2**31 - 1), min_size=1, max_size=3), min_size=1, max_size=40), st.lists(st.binary(max_size=7), max_size=20))
def test_lexicon_finds_what_it_holds(words, others):
    lexicon = tokens.Lexicon(np.frombuffer(tokens.Lexicon.compile(words), np.uint8))
    asked = [*words, *others]
    assert lexicon.find(asked) == [words.get(w) for w in asked]


def test_lexicon_shares_suffixes():
    words = {(p + "ing").encode(): [i] for i, p in enumerate(["walk", "talk", "camp", "ramp"])}
    lexicon = tokens.Lexicon(np.frombuffer(tokens.Lexicon.compile(words), np.uint8))
    assert len(lexicon.final) < 13


@needs_vocabulary
@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_encoding_equals_the_public_library(text):
    import tiktoken

    ranks = tokens.read_ranks(open(queries.VOCABULARY, "rb").read())
    public = tiktoken.Encoding("own", pat_str=tokens.SPLIT, mergeable_ranks=ranks, special_tokens={})
    lexicon = tokens.Lexicon(np.frombuffer(tokens.Lexicon.compile({w: tokens.merge(w, ranks) for w in (b" the", b"the", b" trail", b"\n")}), np.uint8))
    assert tokens.Encoder(ranks, lexicon).encode([text, None, ""]) == [public.encode_ordinary(text), [], []]


@needs_vocabulary
def test_encoded_corpus(spark):
    ranks = tokens.read_ranks(open(queries.VOCABULARY, "rb").read())
    back = {i: t for t, i in ranks.items()}
    rows = [(1, "the trail <|endoftext|> ünï 語 🥾​"), (2, None), (3, ""), (4, "the trail"), (5, "x" * 200_000 + " " * 1000), (4, "the trail")]
    df = spark.createDataFrame([(*r, 7, [1]) for r in rows], "doc_id long, text string, n int, ids array<int>")
    out = [(r.doc_id, r.ids) for r in tokens.encode_corpus(df, "doc_id", "text", queries.VOCABULARY, frequent=2).collect()]
    assert sorted((k, b"".join(back[i] for i in ids).decode()) for k, ids in out) == sorted((k, t or "") for k, t in rows)
    assert tokens.encode_corpus(df.limit(0), "doc_id", "text", queries.VOCABULARY).count() == 0


# leaks

QUESTION = "How many miles lie between Alder Gap and Birch Knob if the ledger says twelve and the sign says fourteen"


def leaked(spark, docs, items):
    d = spark.createDataFrame([(*r, 1, "p") for r in docs], "doc_id long, text string, item_id int, part string")
    i = spark.createDataFrame(items, "item_id int, question string, answer string")
    return sorted((r.doc_id, r.item_id, r.first_char, r.last_char, r.n_words) for r in leaks.leaked_passages(d, i, "doc_id", "text", "item_id", ["question", "answer"]).collect())


def test_leaks(spark):
    words = QUESTION.split()
    part = " ".join(words[3:16])
    docs = [(1, "Before. " + QUESTION.upper().replace(" ", " -- ") + "!"), (2, " ".join(words[:12])), (3, "x " + part + " y"), (4, None), (5, ""), (6, " ".join(words[:7] + ["new"] + words[7:])), (7, part.replace("lie", "l ie"))]
    got = leaked(spark, docs, [(1, QUESTION, "no"), (2, "too short", None), (3, None, None)])
    assert [(d, i, n) for d, i, _, _, n in got] == [(1, 1, len(words)), (3, 1, 13), (6, 1, len(words) - 7)] if len(words) - 7 >= 13 else [(1, 1, len(words)), (3, 1, 13)]
    assert docs[2][1][got[1][2] : got[1][3]] == part
    assert docs[0][1][got[0][2] : got[0][3]].startswith("HOW") and docs[0][1][got[0][2] : got[0][3]].endswith("FOURTEEN")


def test_leaks_of_nothing(spark):
    assert leaked(spark, [], [(1, QUESTION, "")]) == [] and leaked(spark, [(1, QUESTION)], []) == []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c"]), max_size=12), st.lists(st.sampled_from(["a", "b", "c"]), max_size=9))
def test_scan_against_brute_force(text, question):
    import json

    machine = leaks._automaton(f"t{question}", json.dumps([(1, " ".join(question))]), 3)
    grams = {tuple(question[i : i + 3]) for i in range(len(question) - 2)}
    want = any(tuple(text[i : i + 3]) in grams for i in range(len(text) - 2))
    assert bool(leaks.scan(", ".join(text), machine, 3)) == want


# matching


@pytest.mark.parametrize(
    "lat, lon, place",
    [
        (41.5, -74.25, (41.5, -74.25)),
        (-74.25, 41.5, (41.5, -74.25)),
        (41.5, 74.25, (41.5, -74.25)),
        (4.15e8, -7.425e8, (41.5, -74.25)),
        (4150000.0, -7425000.0, (41.5, -74.25)),
        (41.5, -85.9, (41.5, -85.9)),
        (0.0, -74.0, None),
        (None, -74.0, None),
        (float("nan"), -74.0, None),
        (12.0, 3.0, None),
    ],
)
def test_repaired_positions(spark, lat, lon, place):
    got = spark.createDataFrame([(lat, lon)], "lat double, lon double").select(matching.repaired(F.col("lat"), F.col("lon")).alias("p")).first()["p"]
    assert (tuple(round(v, 9) for v in got) if got else None) == place


WORDS = matching.Vocabulary({"hut": "shelter", "shelter": "shelter", "spr": "water", "spring": "water", "piped": "water"}, {"gp": "gap", "lwr": "lower", "mtn": "mountain"}, ["lower", "upper"])


def test_name_parts(spark):
    names = ["Hut, Ostlum's Creek #3", "UPPER NARBYGAP Spr.", "NarbyGap Piped Spring", None, "Lwr Dramby Mtn", "Spring Shelter"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(matching.name_parts(matching.name_words(F.coalesce("n", F.lit(""))), WORDS).alias("p"))
    assert [tuple(r.p) for r in df.collect()] == [("shelter", "ostlumcreek", "creekostlum", "3"), ("water", "narbygap", "narbygap", "upper"), ("water", "narbygap", "gapnarby", ""), (None, "", "", ""), (None, "drambymountain", "drambymountain", "lower"), ("shelter", "", "", "")]
    bare = df.sparkSession.range(1).select(matching.name_parts(matching.name_words(F.lit("Old Hut 2")), matching.Vocabulary()).alias("p")).first()["p"]
    assert tuple(bare) == (None, "oldhut", "hutold", "2")


def test_vocabulary_is_learnt(spark):
    """Hut and lean-to tell a kind; rdg is a form of ridge; upper and lower tell apart what one source lists in one place."""
    rows = []
    for i in range(40):
        lat, lon, base = 34.0 + i * 0.3, -84.0 + i * 0.3, f"B{chr(97 + i % 26)}rn{chr(97 + i // 26)}"
        rows += [("s1", f"{base} Ridge {'Hut' if i % 2 else 'Tavern'}", "shelter" if i % 2 else "resupply", lat, lon), ("s2", f"{base} Rdg {'Hut' if i % 2 else 'Tavern'}", "shelter" if i % 2 else "resupply", lat, lon)]
        rows += [("s3", f"Upper {base} Well", "water", lat, lon), ("s3", f"Lower {base} Well", "water", lat, lon), ("s4", None, None, lat, lon), ("s4", f"{base} Ridge", None, None, lon)]
    df = spark.createDataFrame(rows, "source string, name string, t string, lat double, lon double")
    df = df.select("source", "t", matching.name_words(F.coalesce("name", F.lit(""))).alias("w"), matching.repaired(F.col("lat"), F.col("lon")).alias("at"))
    v = matching.learn_vocabulary(df, "source", "w", "t", "at")
    assert v.kinds == {"hut": "shelter", "tavern": "resupply", "well": "water", "upper": "water", "lower": "water"} or {k: v.kinds[k] for k in ("hut", "tavern", "well")} == {"hut": "shelter", "tavern": "resupply", "well": "water"}
    assert v.short == {"rdg": "ridge"}
    assert matching.learn_vocabulary(df.limit(0), "source", "w", "t", "at") == matching.Vocabulary()


def test_blocking_finds_all_near_pairs(spark):
    """Bands of positions against brute force: pairs of other sources within the reach, at the edge too, whatever their names."""
    rng = np.random.default_rng(8)
    n = 700
    lat, lon = 41 + rng.random(n) * 0.01, -75 + rng.random(n) * 0.01
    df = spark.createDataFrame([(f"k{i:03}", f"s{i % 3}", "water", "", "", "", float(a), float(o)) for i, (a, o) in enumerate(zip(lat, lon))], "key string, source string, kind string, base string, sorted string, part string, lat double, lon double")
    got = {(r.id_l, r.id_r) for r in matching.candidates(df, hot=64).collect()}
    h = np.sin((np.radians(lat)[:, None] - np.radians(lat)[None, :]) / 2) ** 2 + np.cos(np.radians(lat))[:, None] * np.cos(np.radians(lat))[None, :] * np.sin((np.radians(lon)[:, None] - np.radians(lon)[None, :]) / 2) ** 2
    near = np.argwhere(2 * 6371008.8 * np.arcsin(np.sqrt(h)) <= matching.REACH_M)
    want = {(f"k{i:03}", f"k{j:03}") for i, j in near if i < j and i % 3 != j % 3}
    assert got <= want and len(want) > 5_000 and len(got) >= 0.999 * len(want)


def places(spark, rows):
    df = spark.createDataFrame([(*r, 1.0, "z") for r in rows], "k string, source string, name string, t string, c string, lat double, lon double, metres double, part string")
    return matching.described(df, "k", "source", "name", "t", "c", "lat", "lon", WORDS)


def test_candidates_and_matches(spark):
    rows = [
        ("a", "s1", "Narby Gap Hut", "shelter", "high", 41.0, -75.0),
        ("b", "s2", "Narby Gp Shelter", None, None, 41.0001, -75.0001),
        ("c", "s2", "Narby Gap Spring", "water", "high", 41.0001, -75.0001),
        ("d", "s1", None, None, None, -75.0, 41.0),
        ("e", "s2", "Narby Gap Hut", "shelter", "high", 41.0025, -75.0),
        ("f", "s2", None, None, None, None, -75.0),
        ("g", "s3", "Narby Gap Hut", "shelter", "high", 0.0, 0.0),
    ]
    pairs = {(r.id_l, r.id_r) for r in matching.candidates(places(spark, rows)).collect()}
    assert {("a", "b"), ("b", "d")} <= pairs and ("a", "e") in pairs  # near, nameless (the kind is its source's usual one), and alike in name
    assert not any("f" in p or "g" in p or p == ("a", "c") for p in pairs)
    groups_ = spark.createDataFrame([], "g string, k string")
    found = {(r.id_l, r.id_r) for r in matching.matched(places(spark, rows), groups_, "g", "k").where("confidence >= 0.5").collect()}
    assert ("a", "b") in found and ("a", "e") not in found
    assert matching.matched(places(spark, []), groups_, "g", "k").count() == 0


def test_logistic_fit():
    rng = np.random.default_rng(0)
    x = np.column_stack([rng.normal(size=2000), np.ones(2000)])
    y = (rng.random(2000) < 1 / (1 + np.exp(-(2 * x[:, 0] - 1)))).astype(float)
    assert np.allclose(matching.fit_logistic(x, y, 0.0), [2, -1], atol=0.3)


# abuse


def test_spellings_come_to_one_form():
    terms = abuse.Terms()
    word = lambda s: set(terms.of(s)[0].tolist())
    assert abuse.segments("You are a n.a.k.e.d f​ool. Second!  Third") == ["you are a naked fool.", "second!", "third"]
    assert word("you іdіot") == word("you idiot") and word("you I D I O T") == word("you idiot")
    assert len(word("you idiiiot") & word("you idiot")) >= 3


def test_machine_learns_pairs_of_terms():
    """Neither term alone is bad, both together are: additive weights can't tell, the machine can."""
    rng = random.Random(1)
    rows, y = [], []
    for _ in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append(np.array([t for t, on in ((3, a), (5, b), (rng.randrange(10, 200), True)) if on], np.int32))
        y.append(float(a != b))
    machine = abuse.Machine(8, 8).fit(rows, np.array(y, np.float32), np.ones(len(y), np.float32), epochs=30)
    flat, starts = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])[:-1]])
    assert ((machine.margin(flat, starts) > 0) == np.array(y, bool)).mean() > 0.9


def corpus():
    rng = random.Random(2)
    calm = ["the spring runs well", "we slept at the gap", "the climb kicked us hard", "bring food for two days", "the bridge has a rotten board"]
    bad = ["you are a worthless fool", "everyone here hates you fool", "get out you worthless pig"]
    docs, labels = [], []
    for i in range(300):
        own = [f"{rng.choice(calm)} near place{rng.randrange(60)}" for _ in range(5)]
        if i % 5 == 0:
            own[rng.randrange(5)] = rng.choice(bad)
        docs.append((i, ". ".join(own)))
        if i < 200:
            wrong = rng.random() < 0.03
            labels.append((i, ("abuse" if (i % 5 == 0) != wrong else " OK")))
    return docs, labels


def test_held_out_documents(spark):
    docs, labels = corpus()
    d = spark.createDataFrame([*docs, (900, None), (901, ""), (902, "   "), (903, "the spring " * 30_000)], "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (1, None), (2, " "), (None, "abuse")], "doc_id long, label string")
    got = {r.doc_id: r.score for r in abuse.scored(d, lab, "doc_id", "text", "label").collect()}
    held = [i for i in range(200, 300)]
    assert sum((got[i] >= 0.3) == (i % 5 == 0) for i in held) >= 97
    assert got[900] == got[901] == got[902] == 0.0 and got[903] < 0.3


def test_without_labels(spark):
    d = spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, label string")
    assert [r.score < 0.3 for r in abuse.scored(d, none, "doc_id", "text", "label").collect()] == [True, True]
    assert abuse.scored(d.limit(0), none, "doc_id", "text", "label").count() == 0
