import math

import pytest

from keyloom.functions import edits
from keyloom.operators import folds, windows
from keyloom.operators import sequences as seq
from pyspark.sql import functions as F


def ops(target, typed):
    return "".join(o for o, _, _ in edits.edit_script(target, typed))


@pytest.mark.parametrize(
    ("target", "typed", "want"),
    [("cat", "cat", "MMM"), ("cat", "cut", "MSM"), ("cat", "caat", None), ("cat", "ct", "MDM"), ("cat", "act", "TM"), ("", "ab", "II"), ("ab", "", "DD"), ("ab", "ba", "T"), ("aa", "aa", "MM"), ("abcd", "acbd", "MTM")],
)
def test_edit_script(target, typed, want):
    got = ops(target, typed)
    assert got == want if want else sorted(got) == list("IMMM")


def plain_distance(a, b):
    d = {(i, j): i or j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j - 1] + (a[i - 1] != b[j - 1]), d[i - 1, j] + 1, d[i, j - 1] + 1)
            if i > 1 and j > 1 and a[i - 2] == b[j - 1] and a[i - 1] == b[j - 2]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_edit_script_is_shortest():
    import random

    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choices("abc", k=rng.randrange(8))) for _ in "xy")
        script = edits.edit_script(a, b)
        assert sum(o != "M" for o, _, _ in script) == plain_distance(a, b)
        assert [i for o, i, _ in script if i is not None] == sorted(i for _, i, _ in script if i is not None)


def test_labels():
    def label(target, typed, corrected=()):
        return edits.label(edits.edit_script(target, typed), len(typed), [i in corrected for i in range(len(typed))])

    assert label("abc", "abxc") == [None, None, "Insertion", None]
    assert label("abc", "ac") == ["Deletion", "Deletion"]
    assert label("abc", "ab") == [None, "Deletion"] and label("abc", "bc") == ["Deletion", None]
    assert label("abc", "bac") == ["Transposition", "Transposition", None]
    assert label("abc", "axc", (1,)) == [None, "Proofreading", None]


def test_annotate(spark):
    rows = [("p", "1", "abd", t * 10, k) for t, k in enumerate(["a", "b", "c", "BKSP", "d"], 1)] + [("p", "2.0", "ab", 5, "SHIFT"), ("p", "2.0", "ab", 6, "x"), ("p", None, "ab", 7, "x")]
    df = spark.createDataFrame(rows, "PARTICIPANT_ID string, TEST_SECTION_ID string, SENTENCE string, PRESS_TIME long, LETTER string")
    got = {r.sequence_id: [] for r in edits.annotate(df).collect()}
    for r in edits.annotate(df).orderBy("sequence_id", "time").collect():
        got[r.sequence_id].append((r.key, r.time, r.typo_type))
    assert got == {"p_1": [("a", 0, None), ("b", 10, None), ("d", 40, "Proofreading")], "p_2": [("x", 0, "Substitution")]}


def test_backspace_on_nothing_marks_nothing(spark):
    df = spark.createDataFrame([("s", i, k) for i, k in enumerate(["BKSP", "a", "BKSP", "BKSP", "b", "SHIFT", "c"])], "g string, t long, key string")
    got = edits.replay(df, ["g"], ["t"], "key", "t").orderBy("pos").collect()
    assert [(r.key, r.corrected) for r in got] == [("b", True), ("c", False)]


KEEP = dict.fromkeys(seq.TYPO_TYPES, False) | {"Deletion": True}


def split(spark, rows, keep):
    df = spark.createDataFrame([("s", i, t, k) for i, (t, k) in enumerate(rows)], "sequence_id string, i int, time long, typo_type string")
    out = seq.split_at_typos(df, "sequence_id", ["time", "i"], F.col("typo_type"), keep)
    return [(r.part, r.time) for r in out.orderBy("i").collect()]


def test_typo_split(spark):
    assert split(spark, [(0, None), (100, "Insertion"), (200, None)], KEEP) == [(0, 0), (1, 0)]
    assert split(spark, [(0, "Deletion"), (90, "Deletion"), (200, None)], KEEP) == [(0, 0), (1, 0), (1, 110)]
    assert split(spark, [(0, None), (50, "Insertion"), (100, "Substitution"), (190, None), (300, None)], KEEP) == [(0, 0), (2, 0), (2, 110)]
    assert split(spark, [(0, None), (5, "Deletion")], dict.fromkeys(seq.TYPO_TYPES, False)) == [(0, 0)]
    assert split(spark, [(0, None), (5, "Insertion")], {}) == [(0, 0), (0, 5)]


def test_normalise(spark):
    rows, t = [], 0
    for step in [90, 110] * 50 + [10_000] + [90, 110] * 50:
        t += step
        rows.append(("P1", "P1_1", "é" if len(rows) == 3 else "a", t))
    t = 0
    for step in [115, 125] * 100:
        t += step
        rows.append(("P2", "P2_1", "b", t))
    rows.append(("P3", "P3_1", "b", 1))
    df = spark.createDataFrame(rows, "participant_id string, sequence_id string, key string, time long")
    got = seq.normalise(df).collect()
    ids = {r.sequence_id for r in got}
    assert ids == {"P1_1_0", "P1_1_1", "P2_1_0"}
    for p in ("P1", "P2"):
        for c in ("iki_z", "iki_log_z"):
            z = [r[c] for r in got if r.participant_id == p and r[c] is not None]
            assert math.isclose(sum(z), 0, abs_tol=1e-6) and math.isclose(sum(x * x for x in z) / len(z), 1, rel_tol=1e-6)
    assert sum(r.key_id == 0 for r in got) == 1 and all((r.iki is None) == (r.iki_z is None) for r in got)


def test_folds_keep_words_and_pairs_apart(spark):
    from keyloom.operators import features as feat

    texts = [(f"s{i}", t) for i, t in enumerate(["the cat, the dog", "That cat!", "dog's the", "...lead"])]
    df = seq.characters(spark.createDataFrame(texts, "sequence_id string, text string"), "text", "sequence_id")
    df = feat.word_position(feat.word_runs(df, "sequence_id"), "sequence_id")
    words = spark.createDataFrame([("the", 3), ("cat", 7)], "item string, fold int")
    pairs = spark.createDataFrame([("th", 1)], "item string, fold int")
    got = folds.assign(df, words, pairs).orderBy("sequence_id", "pos").collect()
    first = [r for r in got if r.sequence_id == "s0"]
    assert [r.fold_word for r in first][:9] == [3, 3, 3, 3, 7, 7, 7, 7, 7]
    assert first[1].fold_bigram == 1 and first[0].fold_bigram == sum(map(ord, "[PAD]t")) % 10
    assert all(0 <= r.fold_word <= 9 and 0 <= r.fold_bigram <= 9 for r in got)
    lead = [r for r in got if r.sequence_id == "s3"]
    assert [r.fold_word for r in lead][:3] == [0, 0, 0] and lead[3].fold_word == sum(map(ord, "lead")) % 10


def test_balanced():
    items = [(f"w{i}", 1000 / (i + 1)) for i in range(400)] + [("x", 5.0), ("y", 5.0)]
    fold, totals = folds.balanced(items)
    assert set(fold) == {i for i, _ in items} and max(totals) - min(totals) < 0.1 * sum(totals)
    assert [fold[f"w{i}"] for i in range(10)] == list(range(10))


def test_masks(spark):
    df = spark.createDataFrame([(3, 3), (3, 1), (1, 3), (1, 1)], "fold_word int, fold_bigram int")
    one = [(r.is_train, r.is_val) for r in folds.masks(df, 3).collect()]
    assert one == [(False, True), (False, True), (False, False), (True, False)]
    assert [r.is_val for r in folds.masks(df, 3, either=True).collect()] == [True, True, True, False]


def test_feature_lists():
    assert len(windows.all_features()) == 51 and len(windows.all_features(categorical=True)) == 36
    assert {k: len(v) for k, v in windows.MODELS.items()} == {"mlp": 35, "mlp_dl": 11, "lgbm": 23, "linreg": 41}
    assert windows.united(windows.MODELS["mlp"], windows.MODELS["lgbm"])[-3:] == ["word_index", "finger", "hand"]
    names = windows.all_features(categorical=True)
    assert windows.categorical_places(names, 1, 0) == [33, 34, 35, 69, 70, 71]


def test_window_vectors(spark):
    df = spark.createDataFrame([("s", i, float(i), None if i == 1 else 1.0) for i in range(3)], "id string, pos int, x double, shift double")
    got = windows.to_vector(df, ["x", "shift", "is_pad", "unknown"], "id", "pos", back=1, ahead=1).orderBy("pos").collect()
    assert got[0]["window"] == [-5, -1, 1, -1, 0, 1, 1, -99, 1, -1, 1, -99] and len(got[2]["window"]) == 12
