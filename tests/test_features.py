"""Texts in, one digit a character out: P for a missing value."""

import pytest
from pyspark.sql import functions as F

from keyloom.functions import syllables
from keyloom.operators import features as feat
from keyloom.operators import layout
from keyloom.operators.sequences import characters

GOLDEN = [
    ("finger", "asdfg", "01233", "qwerty"),
    ("finger", "hjkl", "6678", "qwerty"),
    ("finger_type", "hjkl", "3321", "qwerty"),
    ("hand", "meow", "1010", "qwerty"),
    ("hand", "a a", "020", "qwerty"),
    ("hand", "cat", "101", "dvorak"),
    ("shift", "A Bc", "1010", "qwerty"),
    ("shift", "1!", "01", "qwerty"),
    ("same_finger", "rt", "P1", "qwerty"),
    ("same_finger", "rt", "P0", "dvorak"),
    ("same_finger", "call", "P000", "qwerty"),
    ("same_hand", "Meow", "P000", "qwerty"),
    ("same_hand", "Meow", "P010", "dvorak"),
    ("same_finger_trigram", "dec", "PP1", "qwerty"),
    ("same_finger_trigram", "dad", "PP0", "qwerty"),
    ("same_finger_skipgram", "f t", "PP1", "qwerty"),
    ("same_finger_skipgram", "iki", "PP0", "qwerty"),
    ("repetition", "poppy", "P0010", "qwerty"),
    ("skipgram_repetition", "level", "PP010", "qwerty"),
    ("in_roll", "as", "P1", "qwerty"),
    ("out_roll", "sa", "P1", "qwerty"),
    ("in_triroll", "asd", "PP1", "qwerty"),
    ("out_triroll", "dsa", "PP1", "qwerty"),
    ("redirects", "fact", "PP10", "qwerty"),
    ("double_row_jump", "taxonomy", "P0001111", "qwerty"),
    ("scissors", "ex", "P1", "qwerty"),
    ("scissors", "ce", "P0", "qwerty"),
    ("word_index", "a bc", "0P01", "qwerty"),
    ("word_length", "a bc", "1P22", "qwerty"),
    ("is_word_start", "a bc", "1010", "qwerty"),
    ("is_word_end", "a bc", "1001", "qwerty"),
    ("is_syllable_start", "tomorrow", "10100100", "qwerty"),
    ("is_syllable_end", "tomorrow", "01001001", "qwerty"),
]


@pytest.fixture(scope="module")
def enriched(spark):
    """All golden texts at once, and neighbours that must not leak into them."""
    out = {}
    for name in ("qwerty", "dvorak"):
        texts = [(f"{i}", t) for i, (_, t, _, lay) in enumerate(GOLDEN) if lay == name] + [("x1", "jjj"), ("x2", "")]
        df = characters(spark.createDataFrame(texts, "id string, text string"), "text", "id")
        keys = layout.key_dim(*layout.dimensions(spark, name))
        rows = feat.with_previous(feat.with_keys(df, keys), "id")
        rows = feat.triple_features(feat.pair_features(rows))
        rows = feat.word_position(feat.word_runs(rows, "id"), "id")
        rows = feat.movement(feat.sequence_position(syllables.positions(rows, "id"), "id"), layout.movement_dim(layout.dimensions(spark, name)[1]))
        for r in rows.orderBy("id", "pos").collect():
            out.setdefault((name, r.id), []).append(r)
    return out


@pytest.mark.parametrize(("feature", "text", "want", "name"), GOLDEN)
def test_golden(enriched, feature, text, want, name):
    at = GOLDEN.index((feature, text, want, name))
    rows = enriched[name, str(at)]
    assert "".join("P" if r[feature] is None else str(int(r[feature])) for r in rows) == want


def test_places(enriched, spark):
    keys = {r.key_id: (r.x, r.y) for r in layout.key_dim(*layout.dimensions(spark)).collect()}
    assert [keys[ord(c)] for c in "cat"] == [(2.5, -1), (0, 0), (3.75, 1)]
    assert keys[ord("A")] == keys[ord("a")] and keys[ord("?")] == keys[ord("/")] and keys[ord(" ")] == (3.5, -2)


def test_movement(spark):
    ways = {(r.slot_1, r.slot_2): r for r in layout.movement_dim(layout.dimensions(spark)[1]).collect()}
    assert (ways["a", "a"].move_dist, ways["a", "a"].move_sin) == (0.0, None)
    up = ways["f", "r"]
    assert up.move_dist == pytest.approx((0.25**2 + 1) ** 0.5) and up.move_sin == pytest.approx(1 / up.move_dist) and up.move_cos == pytest.approx(-0.25 / up.move_dist)
    assert ways["q", "l"].move_dist == 0.0 and ways["l", "r"].move_dist == up.move_dist
    assert len(ways) == 46 * 46


def test_repeat_layout(spark):
    rows = {r.key_id: r for r in layout.key_dim(*layout.dimensions(spark, "qwerty", repeat_key=True)).collect()}
    assert rows[2].finger == 9 and rows[1].finger == 4 and ord(";") not in rows
    assert layout.movement_dim(layout.dimensions(spark, "qwerty", repeat_key=True)[1]).where("slot_2 = 'p' AND slot_1 = 'a'").first().move_dist > 0


@pytest.mark.parametrize(("drop", "want"), [("", [None, 0.0, 0.0, 0.0, 0.0]), ("\x02", [None, 5.5, 5.5, 5.5, 5.5])])
def test_word_frequency_without_the_one_shot_key(spark, drop, want):
    df = characters(spark.createDataFrame([("s", " \x02cat")], "id string, text string"), "text", "id")
    words = spark.createDataFrame([("cat", 5.5)], "word string, zipf double")
    got = feat.word_frequency(df, "id", words, drop=drop).orderBy("pos").collect()
    assert [r.word_frequency for r in got] == want


def test_sequence_position(spark):
    df = characters(spark.createDataFrame([("a", "xyz"), ("b", "q")], "id string, text string"), "text", "id")
    got = {(r.id, r.pos): (r.sequence_pos, r.sequence_length, r.sequence_relative_pos) for r in feat.sequence_position(df, "id").collect()}
    assert got == {("a", 0): (0, 3, 0), ("a", 1): (1, 3, 0.5), ("a", 2): (2, 3, 1), ("b", 0): (0, 1, 0)}


def test_syllables_join_to_the_word():
    for w in ("tomorrow", "a", "strength", "table", "make", "information", "rhythm", "queue"):
        assert "".join(syllables.syllables(w)) == w
    assert syllables.syllables("tomorrow") == ["to", "mor", "row"]
    assert syllables.first_syllable("information") == "in" and syllables.first_syllable("computer") == "com" and syllables.first_syllable("it") is None


def test_triples_are_counted_like_rows(spark):
    from keyloom.plans import keys

    docs = spark.createDataFrame([("a", "the fact is, asd"), ("b", "dsa fact")], "lang string, text string")
    dim = layout.key_dim(*layout.dimensions(spark))
    chars = feat.with_previous(feat.with_keys(characters(docs, "text", "lang"), dim), "lang")
    rows = feat.triple_features(feat.pair_features(chars)).where(F.col("redirects").isNotNull())
    want = {r.lang: (r.n, r.s) for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.avg("redirects").alias("s")).collect()}
    assert {r.lang: (r.n, pytest.approx(r.redirects_rate)) for r in keys.layout_rates(docs, keys.pair_table(spark), "lang").collect()} == want
