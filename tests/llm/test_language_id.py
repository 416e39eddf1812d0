import random

import numpy as np

from keyloom.llm import language_id as lid

SF = "/root/testdata/sf0.01"


def plain_subwords(text):
    words = " " + " ".join("".join(c.lower() if c.isascii() and c.isalpha() else c if not c.isascii() else " " for c in text).split()) + " "
    b = words.encode()
    return sorted(b[i : i + n] for n in (2, 3, 4) for i in range(len(b) - n + 1) if b" " not in b[i + 1 : i + n - 1])


def test_subwords_in_blocks(monkeypatch):
    text = "Thé quick, brown-fox! x 42 " * 20
    whole = sorted(np.concatenate(list(lid.subwords(text.encode()))).tolist())
    assert len(whole) == len(plain_subwords(text))
    monkeypatch.setattr(lid, "BLOCK", 37)
    assert sorted(np.concatenate(list(lid.subwords(text.encode()))).tolist()) == whole


def test_logits_match_counts():
    rng = random.Random(2)
    rows = [(" ".join(rng.choices(["ba", "bo", "bu"] if i % 2 else ["ka", "ko", "ku"], k=9)).encode(), "b" if i % 2 else "k") for i in range(60)]
    model = lid.train(rows)
    for text, lang in rows:
        at, share = lid.counts(text)
        assert np.allclose(model.logits(text), share @ model.table[at] + model.bias, atol=1e-4)
        assert model.languages[int(model.logits(text).argmax())] == lang


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in lid.query(spark, SF).collect() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_rows_of_every_kind(spark):
    docs = spark.createDataFrame(
        [(1, "la la le", "x", 1), (2, "zo zu za", "y", 2), (3, None, "x", 3), (4, " 12 ²!", "y", 4), (None, "lo la", None, 5), (6, "la " * 100_000, None, 6)],
        "doc_id long, text string, lang string, lang_pred int",
    )
    got = [r.lang_pred for r in lid.predict(docs, lid.fit(docs)).collect()]
    assert got[2:4] == ["und", "und"] and set(got) <= {"x", "y", "und"} and got[5] != "und"
    nothing = lid.fit(docs.where("lang IS NULL"))
    assert nothing is None and {r.lang_pred for r in lid.predict(docs, nothing).collect()} == {"und"}
    assert lid.predict(spark.createDataFrame([], docs.schema), None).count() == 0
