import random

import numpy as np
from pyspark.sql import functions as F

from keyloom.llm import toxicity as t

SF = "/root/testdata/sf0.01"


def sample(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(n):
        bad = rng.random() < 0.3
        text = rng.choices(words, k=rng.randrange(5, 60))
        if bad:
            text[rng.randrange(len(text))] = rng.choice(["scum!", "Idiot"])
        rows.append((i, " ".join(text), int(bad)))
    return rows


def plain_step(state, at, y):
    """One FTRL-proximal step, coordinate by coordinate."""
    weight = lambda z, n: 0.0 if abs(z) <= t.L1 else -(z - np.sign(z) * t.L1) / ((t.BETA + n**0.5) / t.ALPHA + t.L2)
    w = {i: weight(*state.get(i, (0.0, 0.0))) for i in at}
    zb, nb = state.get("bias", (0.0, 0.0))
    b = -zb / ((t.BETA + nb**0.5) / t.ALPHA)
    g = 1 / (1 + np.exp(-(sum(w.values()) + b))) - y
    for i in at:
        z, n = state.get(i, (0.0, 0.0))
        state[i] = (z + g - ((n + g * g) ** 0.5 - n**0.5) / t.ALPHA * w[i], n + g * g)
    state["bias"] = (zb + g - ((nb + g * g) ** 0.5 - nb**0.5) / t.ALPHA * b, nb + g * g)


def test_steps_match_the_formula():
    model, state = t.Ftrl(), {}
    for _, text, y in sample(80):
        at = t.features(text.encode())
        model.learn(at, y)
        plain_step(state, at.tolist(), y)
    assert np.isclose(model.bias_z, state["bias"][0])
    for i in state:
        if i != "bias":
            assert np.isclose(model.z[i], state[i][0]) and np.isclose(model.n[i], state[i][1])


def test_learns_and_stays_sparse(spark):
    rows = sample(900)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] < 600], "doc_id long, toxic int")
    model = t.fit(docs, labels)
    assert len(model[1]) < 200
    got = {r.doc_id: r.score for r in t.score(docs, model).collect()}
    right = sum((got[i] >= 0.5) == bool(y) for i, _, y in rows if i >= 600)
    assert right >= 290


def test_held_out_on_the_given_tables(spark):
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in t.query(spark, SF).collect() if r.held_out and r.doc_id in toxic]
    good, bad = [r.score for r in rows if not toxic[r.doc_id]], [r.score for r in rows if toxic[r.doc_id]]
    wins = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(good) * len(bad))
    assert wins > 0.85


def test_rows_of_every_kind(spark):
    docs = spark.createDataFrame([(1, None, 0.1), (None, "scum", 0.2), (2, "", 0.3), (2, "", 0.3), (3, "fine day " * 50_000, None)], "doc_id long, text string, score double")
    none = spark.createDataFrame([(None, 1), (5, None)], "doc_id long, toxic int")
    assert [r.score for r in t.score(docs, t.fit(docs, none)).collect()] == [0.5] * 5
    model = (0.0, t.features(b"scum"), np.full(len(t.features(b"scum")), 9.0))
    left = t.drop_toxic(docs, model)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [1, 2, 2, 3]
    empty = spark.createDataFrame([], docs.schema)
    assert t.drop_toxic(empty, t.fit(empty, none)).count() == 0


def test_query_is_that_of_plain_steps(spark):
    """Every document's score against steps taken one coordinate at a time over the labelled documents in their order."""
    path = "/root/testdata/sf0.001"
    docs, labels = t.training(spark, path)
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").select(F.col("doc_id").alias("i"), F.xxhash64("doc_id").alias("h"), F.col("toxic").cast("int").alias("y"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = [(t.features(texts[r.i].encode()).tolist(), r.y) for r in sorted(known.collect(), key=lambda r: (r.h, r.i, r.y)) if r.i in texts]
    state = {}
    for _ in range(t.EPOCHS):
        for at, y in rows:
            plain_step(state, at, y)
    weight = lambda z, n: 0.0 if abs(z) <= t.L1 else -(z - np.sign(z) * t.L1) / ((t.BETA + n**0.5) / t.ALPHA + t.L2)
    bias = -state["bias"][0] / ((t.BETA + state["bias"][1] ** 0.5) / t.ALPHA)
    got = t.query(spark, path).collect()
    assert len(got) == len(texts)
    for r in got:
        want = 1 / (1 + np.exp(-(bias + sum(weight(*state.get(i, (0.0, 0.0))) for i in t.features(texts[r.doc_id].encode()).tolist()))))
        assert abs(r.score - want) < 1e-4 and (r.predicted == 1) == (r.score >= 0.7)


def test_an_id_of_many_documents_is_bounded(spark):
    docs = spark.range(500).selectExpr("id % 2 AS doc_id", "concat('text ', id) AS text")
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int")
    whole, part = t.fit(docs, labels), t.fit(docs, labels, max_fit=40)
    few = docs.join(labels, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "toxic", F.xxhash64("text")).limit(40).select("doc_id", "text")
    again = t.fit(few, labels)
    assert part[0] == again[0] != whole[0] and (part[1] == again[1]).all()
