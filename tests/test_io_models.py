import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom import schema
from keyloom.operators import metrics, models, oneshot, sampling
from keyloom.sources import sinks, tables
from keyloom.streaming import events as st


def test_key_logs(spark, tmp_path):
    head = "TEST_SECTION_ID\tSENTENCE\tPRESS_TIME\tLETTER\n"
    (tmp_path / "7_keystrokes.txt").write_text(head + '1\tsay "hi"\t10\t"\n1\tsay "hi"\tbad\tx\n1\tsay "hi"\t20\ta\n')
    (tmp_path / "8_keystrokes.txt").write_text(head + "1\tb\t5\tb\n")
    (tmp_path / "other.txt").write_text("no")
    rows = tables.keystrokes(spark, str(tmp_path)).orderBy("PARTICIPANT_ID", "PRESS_TIME").collect()
    assert [(r.PARTICIPANT_ID, r.PRESS_TIME, r.LETTER) for r in rows] == [("7", 10, '"'), ("7", 20, "a"), ("8", 5, "b")]
    wanted = spark.createDataFrame([("8",), ("9",)], "PARTICIPANT_ID string")
    assert [r.PARTICIPANT_ID for r in tables.keystrokes(spark, str(tmp_path), wanted).collect()] == ["8"]
    assert sorted(r.PARTICIPANT_ID for r in tables.participants_from_files(spark, str(tmp_path)).collect()) == ["7", "8"]


def test_json_sources(spark, tmp_path):
    (tmp_path / "layout.json").write_text('[{"slot": "q", "keycode": "a"}, {"slot": "w", "keycode": "b"}]')
    assert tables.dimension(spark, str(tmp_path / "layout.json"), schema.LAYOUT).count() == 2
    (tmp_path / "m.json").write_text('{"a": 1.5,\n "b": 2}')
    assert {r.item: r.value for r in tables.frequency_map(spark, str(tmp_path / "m.json")).collect()} == {"a": 1.5, "b": 2.0}
    (tmp_path / "broken.json").write_text("{")
    for name in ("none.json", "broken.json"):
        assert tables.frequency_map(spark, str(tmp_path / name)).count() == 0
    (tmp_path / "c.json").write_text('{"items": [{"text": "the", "type": "singleword", "frequency": 3, "candidates": [{"abbr": "t", "trigger_form": "trg", "intuitiveness": 0.5, "savings": {"dl": {"mean": 1.0}}}]}]}')
    from keyloom.operators.abbreviations.selection import flattened

    r = flattened(tables.nested_candidates(spark, str(tmp_path / "c.json"))).first()
    assert (r.text, r.savings_z_dl, r.savings_z_lgbm, r.savings_z_mean) == ("the", 1.0, 0.0, 0.5)
    for x in ("0.5", "0.25"):
        (tmp_path / f"dict_lambda_{x}.json").write_text('{"a": 1}\n')
    got = tables.numbered_files(spark.read.json(str(tmp_path / "dict_lambda_*.json")), r"dict_lambda_([0-9.]+)\.json$")
    assert sorted(r["lambda"] for r in got.collect()) == [0.25, 0.5]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 2.0), ("b", 5.0), ("c", 1.0)], "k string, v double")
    sinks.tsv(df, str(tmp_path / "t"))
    assert tables.participants(spark, str(tmp_path / "t"), "k string, v double").count() == 3
    sinks.parquet(df.coalesce(1), str(tmp_path / "p"), rows_a_file=2)
    assert len(list((tmp_path / "p").glob("*.parquet"))) == 2
    sinks.json_lines(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3
    assert sinks.as_map(df, "k", "v").first().json == '{"b":5.0,"a":2.0,"c":1.0}'
    doc = sinks.document(spark.createDataFrame([(0.5,)], "lambda double"), df).first()
    assert doc.metadata["lambda"] == 0.5 and len(doc.dictionary) == 3
    assert sinks.nested(df.withColumn("g", F.lit(1)), ["g"], ["k", "v"], "x").first().x[0].k == "a"
    parts = {str(tmp_path / "p"): df, str(tmp_path / "new"): df}
    assert sinks.resume(spark, parts) == [str(tmp_path / "new")] and sinks.resume(spark, parts) == []


def test_conform(spark):
    df = spark.createDataFrame([("1", 2)], "time string, more int")
    got = schema.conform(df, schema.SEQUENCE)
    assert got.columns == schema.SEQUENCE.names and got.first().time == 1 and got.first().key is None


def test_filters(spark):
    df = spark.createDataFrame([("a", 80.0), ("a", 80.5), ("b", 99.0), (None, 90.0)], "lay string, wpm double")
    f = lambda **k: [r.wpm for r in tables.filtered_participants(df, **k).collect()]
    assert f(equal={"lay": "a"}, above=("wpm", 80)) == [80.5] and f(equal={"lay": "any"}, required=("lay",)) == [80.0, 80.5, 99.0] and f(n=2, order="wpm") == [80.0, 80.5]
    posts = spark.createDataFrame([("f", 1, "fine words here. more fine words", datetime.datetime(2024, 1, 1)), ("f", 2, "click here now", datetime.datetime(2024, 1, 1)), ("f", 3, "old words here", datetime.datetime(2020, 1, 1))], "file string, id int, body string, at timestamp")
    got = tables.recent_sentences(posts, "body", "at", F.lit("2023-01-01").cast("timestamp"), "file", 1, "id").collect()
    assert [r.sentence for r in got] == ["fine words here"]
    articles = spark.createDataFrame([(1, " = Head = "), (2, "some words here")], "id int, t string")
    assert [r.id for r in tables.article_sentences(articles, "t", "id").collect()] == [2]


def test_errors_and_intervals(spark):
    df = spark.createDataFrame([(0.0, 1.0), (0.0, -1.0), (0.0, 2.0), (0.0, -2.0)], "y double, p double")
    r = metrics.errors(df, "y", "p").first()
    assert (r.mae, r.r2, r.bias) == (1.5, None, 0.0)
    i = metrics.mae_interval(df, "y", "p").first()
    assert i.low < i.mae < i.high and i.high - i.mae == pytest.approx(1.959963984540054 * np.std([1, 1, 2, 2], ddof=1) / 2)
    c = metrics.correlations(df, "y", "p").first()
    assert (c.pearson, c.spearman) == (0.0, 0.0)


def test_bootstrap(spark):
    df = spark.createDataFrame([(i % 20, float(i)) for i in range(200)], "c int, v double")
    parts = metrics.clusters(df, "c", F.col("v"))
    means = metrics.bootstrap_means(parts, 200, 5)
    assert means.count() == 200
    r = metrics.interval(means, "m").first()
    assert r.low < 99.5 < r.high and abs(r.mean - 99.5) < 2
    p = metrics.p_value(spark.createDataFrame([(x / 100,) for x in range(-2, 98)], "v double"), "v").first()
    assert p.p == pytest.approx(0.06)


def test_models(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    y = 2 * x[:, 0] - x[:, 1] + 0.5
    df = spark.createDataFrame([(i, i % 4, x[i].tolist(), float(y[i])) for i in range(400)], "id int, fold int, v array<double>, y double")
    w, b = models.fit_linear(df, "v", "y")
    assert w == pytest.approx([2, -1, 0], abs=0.01) and b == pytest.approx(0.5, abs=0.01)
    path = models.l1_path(df, "v", "y", ["a", "b", "c"], [0.5])
    assert path == [(0.5, ["a", "b"])]
    mean, std = models.ensemble("v", [([1.0, 0, 0], 0.0), ([0.0, 0, 0], 1.0)])
    r = df.select(mean.alias("m"), std.alias("s")).first()
    assert r.m == pytest.approx((x[0, 0] + 1) / 2) and r.s == pytest.approx(abs(x[0, 0] - 1) / 2)
    net = df.join(models.cross_validated_network(df, "v", "y", "fold", "id", 4, epochs=60), "id")
    assert metrics.errors(net, "y", "prediction").first().mae < 0.3
    trees = models.fit_trees(df.withColumn("held", F.col("fold") == 0), "v", "y", val="held", rounds=5)
    assert metrics.errors(models.predict_trees(trees, df, "v"), "y", "prediction").first().r2 > 0.3


def test_costs(spark):
    chars = spark.createDataFrame([("a", i, 1.0, 2.0) for i in range(5)] + [("b", 0, 9.0, 9.0)], "id string, pos int, m double, s double")
    texts = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    got = {r.id: (r.cost, r.std) for r in models.costs(chars, texts, "id", "m", "s").collect()}
    assert got == {"a": (4.0, 4.0), "b": (0.0, 0.0), "c": (0.0, 0.0)}
    assert {r.id: r.cost for r in models.costs(chars, texts, "id", "m", "s", first=2, last=F.lit(4)).collect()} == {"a": 2.0, "b": 0.0, "c": 0.0}


def test_one_shot_report(spark):
    df = oneshot.transformed(spark.createDataFrame([("Ab cD", 0.0, 0.0)], "text string, z_base double, z_oss double"), "text")
    r = oneshot.report(df).first()
    assert (r.n_oss, r.starts_oss) == (2, True) and r.base_mean == pytest.approx(4 * 110.66) and r.oss_mean == pytest.approx(5 * 110.66) and r.oss_motion == pytest.approx(3 * 110.66)
    dim = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert {tuple(r) for r in oneshot.patched(dim, spark.createDataFrame([("b", 9), ("c", 3)], "k string, v int"), "k").collect()} == {("a", 1), ("b", 9), ("c", 3)}


def test_samples_repeat(spark):
    df = spark.range(100)
    one = [r.id for r in sampling.take(df, 10, 1, "id").collect()]
    assert one == [r.id for r in sampling.take(df.repartition(7), 10, 1, "id").collect()] and one != [r.id for r in sampling.take(df, 10, 2, "id").collect()]


@pytest.fixture
def stream_dir(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    for b, minutes in enumerate([[0, 5, 10], [12, 200, 205], [206, 5000]]):
        rows = [(b * 10 + i, t0 + datetime.timedelta(minutes=m), 1, "view", 1.0, "{}") for i, m in enumerate(minutes)]
        spark.createDataFrame(rows, st.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return tmp_path


def test_streams(spark, stream_dir):
    src = st.read(spark, str(stream_dir / "in"))

    def run(df, name):
        st.drain(df, str(stream_dir / name / "state"), st.to_parquet(str(stream_dir / name / "out")))
        return spark.read.parquet(str(stream_dir / name / "out" / "batch=*")).collect()

    iki = {r.event_id: r.iki for r in run(st.live_intervals(src), "iki")}
    assert sum(v is None for v in iki.values()) == 1 and sorted(v for v in iki.values() if v is not None)[:2] == [60_000_000, 120_000_000]
    assert sorted(r.n for r in run(st.sessions(src, "30 minutes"), "sessions")) == [3, 4]
    assert sum(r.n for r in run(st.windows(src, "1 hour"), "windows")) == 7


def test_inference_with_a_constant_model(spark, tmp_path):
    from keyloom.operators import features as feat
    from keyloom.operators import inference, layout

    dims = layout.dimensions(spark)
    pairs = feat.pair_table(spark, layout.key_dim(*dims), layout.movement_dim(dims[1]))
    texts = spark.createDataFrame([("a", "The cat sat.", 12), ("b", "x", 1), ("c", "", 0)], "id string, text string, n int")
    words = spark.createDataFrame([("cat", 5.0)], "word string, zipf double")
    grams = spark.createDataFrame([("ca", 4.0)], "gram string, zipf double")
    rows = inference.linguistic_frame(texts, "text", "id", unigrams=grams, bigrams=grams, words=words)
    full = inference.with_layout(rows, "id", pairs)
    from keyloom.operators.windows import all_features

    assert set(all_features()) <= set(full.columns)
    inference.LinearModel(["x"], [([0.0, 0.0], 1.0), ([0.0, 0.0], 3.0)], back=1, ahead=0).save(spark, str(tmp_path / "m"))
    model = inference.load_model(spark, str(tmp_path / "m"), 2)
    got = {r.id: (r.cost, r.std, r.mean_z) for r in inference.predict_texts(texts, "id", "n", rows, model, pairs).collect()}
    assert got == {"a": (22.0, pytest.approx(11**0.5), 2.0), "b": (0.0, 0.0, 0.0), "c": (0.0, 0.0, 0.0)}
    with pytest.raises(FileNotFoundError):
        spark.createDataFrame([], "fold int, weights array<double>, bias double, spec string").write.json(str(tmp_path / "none"))
        inference.load_model(spark, str(tmp_path / "none"))


def test_strip_savings(spark):
    from keyloom.operators import inference
    from keyloom.operators.sequences import characters

    strips = spark.createDataFrame([(1, "   word  ", "   w\x01  ", 4, 2), (2, "abc", "ab", 3, 2)], "k int, word_ks string, abbr_ks string, word_len int, abbr_len int")
    one = lambda t: characters(t, "text", "k").withColumn("pred_mean", F.lit(1.0)).withColumn("pred_std", F.lit(0.0))
    assert {r.k: r.saving for r in inference.strip_savings(strips.where("k = 1"), "k", 3, one).collect()} == {1: 2.0}
    assert {r.k: r.saving for r in inference.strip_savings(strips.where("k = 2"), "k", 0, one).collect()} == {2: 1.0}


def test_pairs_give_the_features_of_windows(spark):
    from keyloom.operators import features as feat
    from keyloom.operators import layout
    from keyloom.operators.sequences import characters

    dims = layout.dimensions(spark)
    keys = layout.key_dim(*dims)
    df = spark.createDataFrame([("a", "Fast asdf redé dsa, poppy level!"), ("b", ""), ("c", "z")], "id string, text string")
    columns = ["id", "pos", "key_id", "finger", "x", *feat.BIGRAM, *feat.TRIGRAM]
    slow = feat.triple_features(feat.pair_features(feat.with_previous(feat.with_keys(characters(df, "text", "id"), keys), "id"))).select(columns)
    fast = feat.layout_features(df, "text", feat.pair_table(spark, keys, layout.movement_dim(dims[1])), "id").select(columns)
    order = lambda rows: sorted(map(tuple, rows), key=lambda r: r[:2])
    assert order(slow.collect()) == order(fast.collect())


def test_reach(spark):
    from keyloom.operators import layout

    reach = {r.slot: r.move_dist for r in layout.reach_dim(layout.dimensions(spark)[1]).collect()}
    assert len(reach) == 46 and reach["f"] == 0 and reach["r"] == pytest.approx((0.25**2 + 1) ** 0.5)


def test_search_prunes(spark, tmp_path):
    from keyloom.operators.tuning import Paths, parameters, search, study_name

    errors = {1: 0.5, 2: 0.4, 3: 0.6, 9: 5.0}
    trials = search(spark, study_name("s_w", 3, 1), {"p": [1, 2, 3, 9]}, lambda p, fold: errors[p["p"]], 3)
    got = {r.trial: (r.state, round(r.value, 3)) for r in trials.collect()}
    assert got == {0: ("COMPLETE", 0.5), 1: ("COMPLETE", 0.4), 2: ("COMPLETE", 0.6), 3: ("PRUNED", 5.0)}
    assert metrics.best_trials(trials).first().trial == 1
    with pytest.raises(FileNotFoundError):
        parameters(str(tmp_path / "no.json"))
    (tmp_path / "p.json").write_text('{"w_back": 3}')
    assert parameters(str(tmp_path / "p.json")) == {"w_back": 3}
    assert Paths("/d", repeat_key=False).abbreviations("a.json") == "/d/abbr_dict/a_rptoff.json" and Paths("/d").models("x") == "/d/models/x/ensemble"
