import itertools
import random

import pytest
from pyspark.sql import functions as F

from keyloom.functions import phonetic as ph
from keyloom.functions import text as tx
from keyloom.operators import ngrams as ng
from keyloom.operators.abbreviations import candidates as cand
from keyloom.operators.abbreviations import contexts as ctx
from keyloom.operators.abbreviations import rewriting as rw
from keyloom.operators.abbreviations import selection as sel

T, R = "\x01", "\x02"


def one(spark, column, **values):
    types = {str: "string", int: "int", float: "double"}
    schema = ", ".join(f"{k} {types[type(v)]}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def test_streams(spark):
    c = F.col
    assert one(spark, tx.with_repeat_key(c("w")), w="letter") == f"let{R}er"
    assert one(spark, tx.with_repeat_key(c("w")), w="aaab") == f"a{R}{R}b"
    for form, want in (("trg", f"t{T}"), ("doubletap", "tt"), ("rpt_trg", f"t{R}{T}")):
        assert one(spark, tx.key_stream(c("a"), c("f"), True), a="t", f=form) == want
    assert one(spark, tx.key_stream(c("a"), c("f"), True), a="cc", f="trg") == f"c{R}{T}"
    assert one(spark, tx.key_stream(c("a"), c("f"), False), a="cc", f="trg") == f"cc{T}"
    assert one(spark, tx.shown(c("a")), a=f"x{R}{T}") == "x↻★"
    assert one(spark, tx.like_capital(c("a"), c("b")), a="The", b="tx") == "Tx" and one(spark, tx.like_capital(c("a"), c("b")), a="the", b="tx") == "tx"


def test_one_shot(spark):
    f = lambda t: one(spark, tx.one_shot(F.col("t")), t=t)
    assert f("The NASA Cat") == f"{R}the NASA {R}cat" and f("NASA") == "NASA" and f("A") == f"{R}a" and f("aB cD") == f"a{R}b c{R}d" and f("É A") == f"É {R}a"


def test_cleaning(spark):
    good = ["hello there", "it's 42 days, right", "a b"]
    bad = ["one", "ab", "naïve words here", "aaaa bbb", "x" * 80, "the unk word", "1 2 3 four", "semi; colon here"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([". ".join(good + bad), None, "see http://x.y/z?q=1. www.a.b words  many here"])], "i int, t string")
    got = [r.sentence for r in tx.clean_sentences(df, "t", "i").orderBy("i", "idx").collect()]
    assert got == ["hello there", "it's 42 days, right", "a b", "see words many here"]
    spam = spark.createDataFrame([("Beep Boop!",), ("fine",), (None,)], "t string")
    assert [r.x for r in spam.select(tx.is_spam(F.col("t")).alias("x")).collect()] == [True, False, True]


def test_vocabulary(spark):
    df = spark.createDataFrame([("Don't stop, don't STOP it's",), ("running singing ring",)], "t string")
    words = {r.word: r.n for r in ng.word_counts(df, "t").collect()}
    assert words == {"don't": 2, "stop": 2, "it's": 1, "running": 1, "singing": 1, "ring": 1}
    found = {r.suffix: (r.n, r.n_words) for r in ng.suffix_counts(ng.word_counts(df, "t")).collect()}
    assert found["ing"] == (3, 3) and found["ring"] == (1, 1) and "singing" not in found and found["op"] == (2, 1)
    kept = ng.suffixes(ng.word_counts(df, "t"), min_words=2, exclude=spark.createDataFrame([("ing",)], "word string"))
    assert {r.suffix for r in kept.collect()} == {"ng"}


def test_zipf_of_counts(spark):
    df = spark.createDataFrame([("a", 90), ("b", 10), ("c", 4)], "gram string, n long")
    got = {r.gram: r.zipf for r in ng.zipf(df).collect()}
    assert got == {"a": pytest.approx(8.954242509), "b": pytest.approx(8.0)}


def test_ngrams_across_texts_are_those_of_the_joined_text(spark):
    texts = ["ab", " ", "c", "", "de  f"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    joined = "ab c de f"
    for n in (2, 3):
        both = ng.ngrams(df, "t", n, collapse=True)
        got = sorted(r.gram for r in both.unionByName(ng.crossing(df, "t", n, "i")).collect())
        if n == 2:
            assert got == sorted(joined[i : i + n] for i in range(len(joined) - n + 1))


def test_candidates():
    for word in ("typewriter", "the", "see", "without", "information", "aaa"):
        got = cand.candidates(word, n=500)
        assert got == cand.candidates(word, n=500) and len(set(got)) == len(got) and word not in got
        assert all(cand.is_valid(c, word) for c in got)
    assert "c" in cand.candidates("see", 500) and {"ss", "ee"} <= set(cand.candidates("see", 500))
    assert {"th", "he", "te"} <= cand.deletions("the") and cand.deletions("the", least=2) == {"th", "he", "te"}
    assert len(cand.deletions("abcdefghijklmnopqrst", limit=100)) == 100
    assert len(cand.candidates("information", 7)) == 7


def test_validity_in_sql_is_that_in_python(spark):
    pairs = [(a, w) for a in ("", "a", "aa", "bb", "abc", "abcd") for w in ("a", "abc", "abcd", "abcdef", "xyz")]
    df = spark.createDataFrame(pairs, "a string, w string")
    got = [r.v for r in df.select(cand.is_valid_column(F.col("a"), F.col("w")).alias("v")).collect()]
    assert got == [cand.is_valid(a, w) for a, w in pairs]


def test_trigger_forms_are_cheaper(spark):
    df = spark.createDataFrame([("see", "ee"), ("see", "s"), ("abc", "xx"), ("it", "t")], "text string, abbr string")
    on = {(r.text, r.abbr, r.trigger_form) for r in cand.with_triggers(df, True).collect()}
    assert on == {("see", "ee", "doubletap"), ("see", "ee", "rpt_trg"), ("see", "s", "trg"), ("abc", "xx", "trg"), ("it", "t", "trg")}
    assert {r.trigger_form for r in cand.with_triggers(df, False).collect()} == {"trg"}


def test_intuitiveness():
    f = ph.intuitiveness
    assert f("you", "u") == 0.95 and f("see", "") == 0.0
    assert f("information", "info") > f("information", "ifm") > f("information", "xqz")
    assert f("people", "ppl") > f("people", "lpp") and f("cat", "k") > f("cat", "z")
    for w, a in itertools.product(["the", "classification", "phone"], ["t", "ph", "class", "zzz", "fone"]):
        assert 0 <= f(w, a) <= 1
    assert ph.sound("phone") == "fone" and ph.sound("check") == "chek" and ph.likeness("c", "k") == 0.95 and ph.likeness("a", "u") == 0.35
    assert ph.levenshtein("kitten", "sitting") == 3 and ph.contiguity("ppl", "people") == pytest.approx(0.9**2)


def test_contexts(spark):
    df = spark.createDataFrame([(0, "Running, he was running on"), (1, "a run")], "i int, text string")
    places = {(r.i, r.at): (r.body, r.start) for r in ctx.positions(df, "text", "i").collect()}
    assert places[0, 0] == ("Running", 0) and places[0, 3] == ("running", 16) and places[1, 1] == ("run", 2)
    items = spark.createDataFrame([("running", "singleword"), ("ing", "suffix"), ("run", "suffix")], "item string, type string")
    got = sorted((r.item, r.i, r.start) for r in ctx.occurrences(df, "text", "i", items, 5).collect())
    assert got == [("ing", 0, 0), ("ing", 0, 16), ("running", 0, 0), ("running", 0, 16)]
    row = spark.createDataFrame([("ab Running on", 3, "Running", "running", "singleword", "rn", "trg"), ("x eating", 2, "eating", "ing", "suffix", "g", "trg")], "text string, start int, body string, item string, type string, abbr string, trigger_form string")
    a, b = ctx.strips(row, "text", 5, 3, True).collect()
    assert (a.word_ks, a.abbr_ks, a.word_len, a.abbr_len) == (f"  ab Run{R}ing on", f"  ab Rn{T} on", 7, 3)
    assert (b.word_ks, b.abbr_ks, b.host_word) == ("   x eating   ", f"   x eatg{T}   ", "eating")
    assert ctx.word_index(df, "text", "i", per_word=1).count() == 6


def test_rewriting(spark):
    entries = spark.createDataFrame([("the", "t", "trg", "singleword"), ("ing", "gg", "doubletap", "suffix"), ("ning", "n", "trg", "suffix")], "text string, abbr string, trigger_form string, type string")
    df = spark.createDataFrame([(0, "The (running) letter, ing the"), (1, "")], "i int, text string")
    got = {r.i: r for r in rw.rewritten(df, "text", "i", entries).collect()}
    r = got[0]
    assert set(got) == {0} and r.normal == "The (running) letter, ing the"
    assert r.abbr == f"T{T}(runn{T})let{R}er, ing t{T}" and (r.n_words, r.n_suffixes, r.n_tokens) == (2, 1, 5) and r["keys"] == ["the", "ning", "the"]
    assert [(o.start, o.end, o.word) for o in r.overrides] == [(0, 2, "the"), (2, 9, "running"), (9, 15, "letter"), (17, 20, "ing"), (21, 23, "the")]


def test_linking_and_overlaps(spark):
    df = spark.createDataFrame([(1, "day", "d", "trg", 5, "suffix"), (2, "day", "d", "trg", 7, "singleword"), (3, "today", "td", "trg", 1, "singleword")], "k int, text string, abbr string, trigger_form string, frequency long, type string")
    got = {r.text: (r.frequency, r.types, r.is_linked, r.type) for r in sel.linked(df, "k").collect()}
    assert got == {"day": (12, ["suffix", "singleword"], True, "suffix"), "today": (1, ["singleword"], False, "singleword")}
    assert [(r.i, r.j) for r in sel.overlaps(df, "k").collect()] == [(3, 1)]


def test_selection_is_valid_and_near_the_best():
    rng = random.Random(8)
    for _ in range(30):
        entries = [sel.Entry(f"w{rng.randrange(8)}", f"a{rng.randrange(6)}", "trg", rng.randrange(1, 100)) for _ in range(12)]
        pairs = {(rng.randrange(12), rng.randrange(12)): rng.randrange(1, 40) for _ in range(8)}
        pairs = {k: v for k, v in pairs.items() if k[0] != k[1]}
        got, top = sel.choose(entries, pairs, 4), sel.best(entries, pairs, 4)
        for chosen in (got, top):
            assert len(chosen) <= 4 and len({entries[i].text for i in chosen}) == len(chosen) == len({entries[i].abbr for i in chosen})
        best = max(
            (sel.value(set(c), entries, pairs) for n in range(5) for c in itertools.combinations(range(12), n) if len({entries[i].text for i in c}) == n == len({entries[i].abbr for i in c})), default=0
        )
        assert sel.value(top, entries, pairs) == best and sel.value(got, entries, pairs) >= 0.85 * best
    assert sel.reward(3, 0.123456, 0.5, 0.5) == int(0.5 * int(3 * 0.123456 * 100000) + 0.5 * int(0.5 * 3 * 10 * 100000))


def test_optimised_dictionary(spark):
    rows = [("today", "singleword", 90, "td", "trg", 0.6, 2.0, 0.1, 2.0), ("today", "singleword", 90, "t", "trg", 0.9, 1.0, 0.1, 1.0), ("day", "suffix", 50, "d", "trg", 0.8, 1.5, 0.1, 1.5),
            ("play", "singleword", 10, "p", "trg", 0.1, 3.0, 0.1, 3.0), ("way", "singleword", 10, "w", "trg", 0.9, 0.1, 0.2, 0.1), ("dog", "singleword", 5, "d", "trg", 0.9, 1.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "text string, type string, frequency long, abbr string, trigger_form string, intuitiveness double, savings_z_lgbm double, savings_z_lgbm_std double, savings_z_mean double")
    got = {(r.text, r.abbr) for r in sel.optimise(df).collect()}
    assert got == {("today", "t"), ("day", "d")}
    assert {(r.text, r.abbr) for r in sel.optimise(df, lambda_=0.0, size=1).collect()} == {("today", "td")}
    assert [r["size"] for r in sel.sweep(df, [0.0, 1.0]).collect()] == [2, 2]


def test_patched_pairs_and_overrides(spark):
    chars = spark.createDataFrame([("s", i, c, -1.0) for i, c in enumerate(f"le{R}{R}t{T}")], "id string, pos int, key string, bigram_frequency double")
    special = spark.createDataFrame([(f"t{T}", 9.0)], "gram string, zipf double")
    plain = spark.createDataFrame([("ee", 4.0), ("et", 5.0), ("le", 6.0)], "gram string, zipf double")
    got = [r.bigram_frequency for r in rw.patched_pairs(chars, "id", special, plain).orderBy("pos").collect()]
    assert got == [-1.0, -1.0, 4.0, 4.0, 5.0, 9.0]
    wf = chars.withColumn("word_frequency", F.lit(0.5))
    spans = spark.createDataFrame([("s", 1, 3, "x"), ("s", 5, 5, "y")], "id string, start int, end int, word string")
    over = rw.overridden(wf, spans, spark.createDataFrame([("x", 3.0)], "word string, zipf double"), "id")
    assert [r.word_frequency for r in over.orderBy("pos").collect()] == [0.5, 3.0, 3.0, 0.5, 0.5, 0.5]


def test_large_selections_use_the_same_sums(monkeypatch):
    rng = random.Random(4)
    entries = [sel.Entry(f"w{rng.randrange(60)}", f"a{rng.randrange(50)}", "trg", rng.randrange(1, 100)) for _ in range(120)]
    pairs = {(a, b): rng.randrange(1, 40) for a, b in ((rng.randrange(120), rng.randrange(120)) for _ in range(300)) if a != b}
    thorough = sel.value(sel.choose(entries, pairs, 25), entries, pairs)
    monkeypatch.setattr(sel, "THOROUGH", 0)
    quick = sel.choose(entries, pairs, 25)
    assert len(quick) <= 25 and len({entries[i].text for i in quick}) == len(quick) and sel.value(quick, entries, pairs) >= 0.9 * thorough


def test_dictionary_from_a_small_vocabulary(spark):
    """Candidates, selection and sweep as the registered queries put them together."""
    from keyloom.plans import abbreviations as plan

    items = spark.createDataFrame([("because", "singleword", 900), ("people", "singleword", 500), ("ation", "suffix", 300), ("ab", "singleword", 50)], "text string, type string, frequency long")
    rows = plan.with_savings(plan.scored(items, tried=40, kept=10)).cache()
    by = {}
    for r in rows.collect():
        assert len(r.abbr) <= len(r.text) and 0 <= r.intuitiveness <= 1
        by.setdefault(r.text, []).append(r)
    assert {"because", "people", "ation"} <= set(by) and all(sum(r.trigger_form == "trg" for r in rs) <= 10 for rs in by.values())
    chosen = sel.optimise(rows, size=2, per_text=3).collect()
    assert len(chosen) == 2 and len({r.text for r in chosen}) == 2 and len({(r.abbr, r.trigger_form) for r in chosen}) == 2
    swept = {r["lambda"]: r for r in sel.sweep(rows, [0.0, 1.0], size=2, per_text=3).collect()}
    assert all(0 <= r.gap < 1 for r in swept.values())
    assert swept[0.0].saving >= swept[1.0].saving and swept[1.0].intuitiveness >= swept[0.0].intuitiveness


def test_exchanges_come_near_the_bound():
    rng = random.Random(8)
    for _ in range(30):
        entries = [sel.Entry(f"t{rng.randrange(9)}", rng.choice("abcdefgh"), "trg", rng.randrange(1, 1000)) for _ in range(16)]
        penalties = {(i, j): rng.randrange(200) for i, j in itertools.combinations(range(16), 2) if rng.random() < 0.2}
        exact, found = (sel.value(f(entries, penalties, 4), entries, penalties) for f in (sel.best, sel.choose))
        assert found >= 0.95 * exact and exact <= sel.bound(entries, 4)
