import random

from keyloom.operators import etl, layout
from keyloom.operators.windows import ENRICHED, MODELS, targets, to_vector


def test_raw_keys_to_training_rows(spark):
    rng = random.Random(2)
    rows, want = [], 0
    for p in ("p1", "p2"):
        for s, text in enumerate(["the cat sat on the mat", "a dog, a cat"], 1):
            t = 0
            typed = list(text)
            if s == 1:
                typed[5:5] = ["x", "BKSP"]
            for k in typed:
                t += rng.randrange(80, 200)
                rows.append((p, str(s), text, t, k))
            want += len(text)
    raw = spark.createDataFrame(rows, "PARTICIPANT_ID string, TEST_SECTION_ID string, SENTENCE string, PRESS_TIME long, LETTER string")
    words = spark.createDataFrame([("cat", 5.5), ("the", 7.0)], "word string, zipf double")
    folds = spark.createDataFrame([("cat", 3)], "item string, fold int"), spark.createDataFrame([("ca", 4)], "item string, fold int")
    out = etl.run(raw, layout.dimensions(spark), *folds, words=words)
    assert out.columns == [*ENRICHED, "fold_word", "fold_bigram"]
    got = out.collect()
    # The key typed after the correction is a proofreading one and falls out; it parts its sequence in two.
    assert len(got) == want - 2
    assert {r.sequence_id for r in got} == {f"{p}_{s}" for p in ("p1", "p2") for s in ("1_0_0", "1_1_0", "2_0_0")}
    assert {r.original_sequence_id for r in got} == {f"{p}_{s}" for p in ("p1", "p2") for s in "12"}
    dog = sorted((r for r in got if r.sequence_id == "p1_2_0_0"), key=lambda r: r.sequence_pos)
    assert "".join(r.key for r in dog) == "a dog, a cat" and [r.word_frequency for r in dog][-3:] == [5.5] * 3
    assert [r.fold_word for r in dog][-3:] == [3] * 3 and dog[-2].fold_bigram == 4
    assert dog[0].iki is None and dog[0].same_finger is None and dog[1].iki > 0 and dog[-1].reach_dist > 0
    vectors = to_vector(targets(out, "iki_z"), MODELS["lgbm"], "sequence_id", "sequence_pos", 3, 1)
    assert all(len(r["window"]) == 23 * 5 for r in vectors.collect())
