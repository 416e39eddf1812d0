"""Tree files, Shapley values, absolute loss, deep networks, the Parzen search, and features made within a text's own row."""

import itertools
import math
import random
import sqlite3

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from keyloom import __main__ as cli
from keyloom.operators import enrichment, folds, models, sampling, trees, tuning
from keyloom.operators import features as feat
from keyloom.operators import layout
from keyloom.plans import ORACLES, QUERIES, modelling
from keyloom.sources import drawings, tables

CATEGORICAL = """tree
feature_names=kind size
Tree=0
num_leaves=3
num_cat=1
split_feature=0 1
threshold=0 1.5
decision_type=1 10
left_child=-1 -2
right_child=1 -3
leaf_value=10 20 30
leaf_count=5 3 2
cat_boundaries=0 2
cat_threshold=5 1
end of trees
"""


def test_tree_file():
    names, (tree,) = trees.parse(CATEGORICAL)
    assert names == ["kind", "size"] and tree.categories == [frozenset({0, 2, 32})]
    x = np.array([[0, 9], [2, 9], [32, 9], [1, 1.5], [1, 1.6], [np.nan, 1], [1, np.nan], [-1, 0]])
    # decision 10: default left, NaN is missing.
    assert tree.predict(x).tolist() == [10, 10, 10, 20, 30, 20, 20, 20]
    with pytest.raises(ValueError):
        trees.parse("nothing")


def test_missing_zero_and_no_missing():
    one = lambda kind: trees.Tree(*map(np.array, ([0], [0.5], [kind], [-1], [-2], [1.0, 2.0], [1.0, 1.0])))
    x = np.array([[0.0], [np.nan], [0.6], [0.4]])
    assert one(4).predict(x).tolist() == [2, 2, 2, 1]
    assert one(6).predict(x).tolist() == [1, 1, 2, 1]
    assert one(0).predict(x).tolist() == [1, 1, 2, 1]


def test_shapley_values_are_those_of_all_coalitions():
    rng = random.Random(4)

    def grow(depth):
        """Arrays of a random tree of one depth; a feature may come twice on a path."""
        nodes, leaves = [], []

        def make(d):
            if d == 0:
                leaves.append((rng.uniform(-3, 3), rng.randrange(1, 9)))
                return ~(len(leaves) - 1)
            at = len(nodes)
            nodes.append(None)
            f, t = rng.randrange(3), rng.random()
            left, right = make(d - 1), make(d - 1)
            nodes[at] = (f, t, left, right)
            return at

        make(depth)
        f, t, lo, hi = map(np.array, zip(*nodes, strict=True))
        return trees.Tree(f, t, np.zeros(len(f), int), lo, hi, np.array([v for v, _ in leaves]), np.array([n for _, n in leaves], float))

    def value(tree, x, known, node=0):
        if node < 0:
            return tree.value[~node]
        f, children = tree.feature[node], (int(tree.left[node]), int(tree.right[node]))
        if f in known:
            return value(tree, x, known, children[0 if x[f] <= tree.threshold[node] else 1])
        n = [tree.rows(c) for c in children]
        return sum(value(tree, x, known, c) * m for c, m in zip(children, n, strict=True)) / sum(n)

    for depth in (1, 2, 3):
        tree, x = grow(depth), np.array([rng.random() for _ in range(3)])
        got = tree.shapley(x, 3)
        for f in range(3):
            want, others = 0.0, [g for g in range(3) if g != f]
            for k in range(3):
                for some in itertools.combinations(others, k):
                    weight = math.factorial(k) * math.factorial(2 - k) / math.factorial(3)
                    want += weight * (value(tree, x, {*some, f}) - value(tree, x, set(some)))
            assert got[f] == pytest.approx(want, abs=1e-9)
        assert got.sum() == pytest.approx(tree.predict(x[None])[0] - value(tree, x, set()))


def test_tree_and_network_models(spark, tmp_path):
    (tmp_path / "fold_0.txt").write_text(modelling._MODEL)
    (tmp_path / "fold_1.txt").write_text(modelling._MODEL.replace("leaf_value=-1 0.5", "leaf_value=1 2.5"))
    model = trees.load_trees(spark, str(tmp_path / "fold_*.txt"), 0, 0)
    df = spark.createDataFrame([([0.0, 0.0, 0.0, 0.0],), ([1.0, 1.0, -1.0, 0.0],)], "v array<double>")
    mean, std = model.predict("v")
    assert [tuple(r) for r in df.select(mean, std).collect()] == [(2.5, 1.0), (4.0, 1.0)]
    layers = models.train_network(np.random.default_rng(1).normal(size=(50, 4)), np.arange(50.0), (3, 2), epochs=2)
    trees.NetworkModel(["a"], [layers], 3, 0).save(spark, str(tmp_path / "net"))
    loaded = trees.load_network(spark, str(tmp_path / "net"))
    mean, _ = loaded.predict("v")
    assert [r[0] for r in df.select(mean).collect()] == pytest.approx(models.network(layers, np.array([[0.0] * 4, [1, 1, -1, 0]])).tolist())
    values = trees.tree_importance(df, "v", trees.parse(modelling._MODEL)[1], 4, 4).collect()
    assert {r.feature for r in values} == {0, 1, 2, 3} and next(r.importance for r in values if r.feature == 3) == 0


def test_absolute_loss_is_least(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4))
    y = x @ [1.0, -2.0, 0.5, 0.0] + 0.3 + rng.laplace(size=300)
    df = spark.createDataFrame([(row.tolist(), float(t)) for row, t in zip(x, y, strict=True)], "v array<double>, y double").repartition(3)
    for l1, l2 in ((0.0, 0.0), (0.1, 0.1)):
        loss = lambda w, b, l1=l1, l2=l2: np.abs(x @ w + b - y).mean() + l1 * np.abs(w).sum() + l2 / 2 * (w @ w)
        w, b = models.fit_absolute(df, "v", "y", 4, l1=l1, l2=l2)
        w, found = np.array(w), loss(np.array(w), b)
        for scale in (1e-1, 1e-2, 1e-3):
            for _ in range(60):
                assert loss(w + rng.normal(size=4) * scale, b + rng.normal() * scale) > found - 1e-4
    assert models.fit_absolute(df.where("false"), "v", "y", 4) == ([0.0] * 4, 0.0)


def test_deep_network_stops_early():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 3))
    y = np.abs(x[:, 0]) - x[:, 1]
    layers = models.train_network(x, y, (16, 8, 4), epochs=40, held=0.2, decay=0.0001)
    assert [w.shape for w, _ in layers] == [(3, 16), (16, 8), (8, 4), (4, 1)]
    assert np.abs(models.network(layers, x) - y).mean() < 0.2


def test_parzen_search_finds_the_best_region(spark):
    space = {"rate": (1e-4, 1.0, "log"), "depth": [2, 4, 8], "share": (0.0, 1.0)}

    def error(p, fold):
        return abs(math.log10(p["rate"]) + 2) + abs(p["share"] - 0.7) + (p["depth"] != 4) + fold * 0.01

    tables_ = [tuning.search(spark, "s", tuning.Parzen(space, 40, seed=7), error, 2).collect() for _ in range(2)]
    assert [r.value for r in tables_[0]] == [r.value for r in tables_[1]] and len(tables_[0]) == 40
    best, late, early = [], [], []
    for seed in range(9):
        sampler, seen = tuning.Parzen(space, 40, seed=seed), []
        for _ in range(len(sampler)):
            point = sampler.next(seen)
            seen.append((point, error(point, 0)))
        values = [v for _, v in seen]
        best.append(min(values))
        late.append(np.mean(values[20:]))
        early.append(np.mean(values[:10]))
    assert np.median(best) < 0.2 and np.median(late) < 0.5 * np.median(early)


def test_study_store(spark, tmp_path):
    store = sqlite3.connect(tmp_path / "s.db")
    store.executescript("""
        CREATE TABLE studies (study_id INTEGER, study_name TEXT);
        CREATE TABLE trials (trial_id INTEGER, number INTEGER, study_id INTEGER, state TEXT, datetime_start TEXT);
        CREATE TABLE trial_values (trial_id INTEGER, objective INTEGER, value REAL);
        INSERT INTO studies VALUES (1, 'a'), (2, 'b');
        INSERT INTO trials VALUES (1, 0, 1, 'COMPLETE', '2024-01-01 00:00:00'), (2, 1, 1, 'PRUNED', NULL), (3, 0, 2, 'COMPLETE', '2024-01-02 00:00:00');
        INSERT INTO trial_values VALUES (1, 0, 0.5), (3, 0, 0.25);""")
    store.close()
    rows = tables.trials_sqlite(spark, str(tmp_path / "s.db"))
    assert {(r.study, r.trial, r.state, r.value) for r in rows.collect()} == {("a", 0, "COMPLETE", 0.5), ("a", 1, "PRUNED", None), ("b", 0, "COMPLETE", 0.25)}
    assert tables.trials_sqlite(spark, str(tmp_path / "s.db"), ("b",)).count() == 1


def test_fold_packing_streams(spark):
    rng = random.Random(1)
    items = [(f"i{i}", float(rng.choice([1, 2, 3, 50, 7.5]))) for i in range(500)]
    want, _ = folds.balanced(sorted(items))
    got = {r.item: r.fold for r in folds.balanced_table(spark.createDataFrame(items, "item string, weight double").repartition(5)).collect()}
    assert got == want


def test_running_total(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([0.0, 1.0, rng.random(), rng.random() * 100]), rng.randrange(5)) for i in range(700)]
    got = {r.i: r.upto for r in sampling.running_total(spark.createDataFrame(rows, "i int, v double, n int"), "v", "n", "i").collect()}
    total = 0
    for i, _, n in sorted(rows, key=lambda r: (r[1], r[0])):
        total += n
        assert got[i] == total
    assert sampling.running_total(spark.createDataFrame([], "i int, v double, n int"), "v", "n").count() == 0


TEXTS = [(1, "Fast asdf redé dsa, poppy level! yes eye style people"), (2, ""), (3, "z"), (4, None), (5, "a  b\t(c) — naïve 'quote'.  "), (6, "rhythm queue the EYE yonder"), (7, "\U0001f600 ok \U0001f600\U0001f600ok")]


def _tables(spark):
    grams = lambda rows: spark.createDataFrame(rows, "gram string, zipf double")
    words = spark.createDataFrame([("poppy", 3.5), ("ok", 2.0), ("the", 7.0), ("level!", 1.0)], "word string, zipf double")
    return {"unigrams": grams([("a", 5.0), ("é", 1.0), ("\U0001f600", 0.5)]), "bigrams": grams([("as", 4.0), ("\U0001f600o", 1.5), ("pp", 2.5)]), "vocabulary": words}


def test_features_within_rows_are_those_of_windows(spark):
    df = spark.createDataFrame(TEXTS, "id int, text string")
    columns = ["id", "pos", "key_id", *enrichment.LINGUISTIC]
    rows = lambda limit: enrichment.linguistic_rows(df, "text", "id", **_tables(spark), limit=limit).select(columns).orderBy("id", "pos").collect()
    fast, slow = rows(100), rows(2)
    assert len(fast) == sum(len(t or "") for _, t in TEXTS)
    for a, b in zip(fast, slow, strict=True):
        assert a == b, [(c, x, y) for c, x, y in zip(columns, a, b, strict=True) if x != y]


def test_large_tables_shuffle_distinct_words_and_no_characters(spark):
    """Tables beyond the limit: the same rows, a text's rarer words and grams joined to its row, no window over its characters."""
    texts = ["the cat", "the cat", "", None, "Zoë's ΩΩ cat. the-dog?", "don't DON'T " * 30, "\U0001f600\U0001f600 the\x00cat"]
    df = spark.createDataFrame([(i % 5, t) for i, t in enumerate(texts)], "id long, text string")
    gram = [("the"[i : i + 1], 1.0 + i) for i in range(3)] + [("Ω", 0.25), ("\U0001f600", 2.5)]
    pairs = [("th", 3.0), ("ca", 2.0), ("ΩΩ", 0.5), ("\U0001f600\U0001f600", 0.0), ("'t", 1.0)]
    words = [("the", 4.0), ("cat", 3.0), ("don't", 2.0), ("dog", 1.0), ("s", 0.0)]
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} string, zipf double")
    tables = {"unigrams": frame(gram, "gram"), "bigrams": frame(pairs, "gram"), "vocabulary": frame(words, "word")}
    give = lambda limit: enrichment.linguistic_rows(df, "text", "id", **tables, limit=limit)
    want = sorted(map(repr, give(100).collect()))
    assert len(want) == sum(len(t or "") for t in texts)
    for limit in (0, 1, 3):
        rows = give(limit)
        assert sorted(map(repr, rows.collect())) == want
        assert "Window" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_blocks_do_not_matter(spark, monkeypatch):
    df = spark.createDataFrame(TEXTS, "id int, text string").coalesce(1)
    rows = lambda: enrichment.linguistic_rows(df, "text", "id", **_tables(spark)).orderBy("id", "pos").collect()
    whole = rows()
    monkeypatch.setattr(enrichment, "BLOCK", 3)
    assert rows() == whole


ODD = [
    ("en", "The cat's hat, the EYE of the yonder queue! don't 'tis rock''n'roll x1y; (the) [cat]\tthe\ncat a.b-c"),
    ("en", "İstanbul KELVIN \u212aelvin İİ istanbul i\u0307s kelvin"),
    ("en", "aaa bbbb aa"),
    ("de", "Zoë grüßt naïve Ωmega \U0001f600\U0001f600 漢字漢字 ÿþÿ die Öl"),
    (None, "no language, the cat"),
    ("dots", "., !"),
    ("one", "z"),
    ("rare", "q\u4e00"),
    ("empty", ""),
    ("null", None),
]


def _odd_documents(tmp_path, times=7):
    rows = [(i, text, lang) for i, (lang, text) in enumerate(r for n, r in itertools.product(range(times), ODD) if r[0] != "rare" or n < 2)]
    columns = list(zip(*rows, strict=True))
    pq.write_table(pa.table({"doc_id": pa.array(columns[0], pa.int64()), "text": pa.array(columns[1], pa.string()), "lang": pa.array(columns[2], pa.string())}), tmp_path / "documents.parquet")
    return str(tmp_path)


def _close(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 1.5e-4


def test_sums_of_odd_texts_are_those_of_sql_without_a_row_for_each_character(spark, tmp_path, monkeypatch):
    def no_rows(*_, **__):
        raise AssertionError("a row for each character")

    monkeypatch.setattr(enrichment, "_rows", no_rows)
    folder = _odd_documents(tmp_path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    cursor = con.execute(ORACLES["enrich_linguistic"])
    names = [c[0] for c in cursor.description]
    want = {r[0]: dict(zip(names, r, strict=True)) for r in cursor.fetchall()}
    for held, block in ((enrichment.HELD, enrichment.BLOCK), (1, 5)):
        monkeypatch.setattr(enrichment, "HELD", held)
        monkeypatch.setattr(enrichment, "BLOCK", block)
        got = {r.lang: r.asDict() for r in QUERIES["enrich_linguistic"](spark, folder).collect()}
        assert got.keys() == want.keys()
        for lang, row in want.items():
            assert all(_close(got[lang][c], v) for c, v in row.items()), (lang, [(c, got[lang][c], v) for c, v in row.items() if not _close(got[lang][c], v)])


def test_sums_are_those_of_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{_odd_documents(tmp_path)}/documents.parquet").where("NOT text LIKE '%\u0130%'")
    unigrams, bigrams, words = enrichment.frequency_tables(enrichment.counts(docs, "text"))
    rows = enrichment.linguistic_rows(docs, "text", "lang", unigrams=unigrams, bigrams=bigrams, vocabulary=words.withColumnRenamed("gram", "word"))
    want = {r.lang: r.asDict() for r in rows.groupBy("lang").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in enrichment.LINGUISTIC)).collect()}
    got = {r.lang: r.asDict() for r in enrichment.linguistic_sums(docs, "text", "lang").collect()}
    assert got.keys() == want.keys() and all(_close(got[lang][c], v) for lang, row in want.items() for c, v in row.items())


def test_layout_rows_are_those_of_joins(spark):
    df = spark.createDataFrame(TEXTS, "id int, text string")
    dims = layout.dimensions(spark)
    pairs = feat.pair_table(spark, layout.key_dim(*dims), layout.movement_dim(dims[1]))
    columns = ["id", "pos", "key_id", *(c for c in enrichment.LAYOUT if c.rsplit("_", 1)[0] not in enrichment.ONE_HOT)]
    slow = feat.layout_features(df, "text", pairs, "id").select(columns).orderBy("id", "pos").collect()
    rows = enrichment.layout_rows(df, "text", pairs, "id")
    fast = rows.select(columns).orderBy("id", "pos").collect()
    for a, b in zip(fast, slow, strict=True):
        assert tuple(a) == tuple(b), [(c, x, y) for c, x, y in zip(columns, a, b, strict=True) if x != y]
    hot = rows.selectExpr("finger", "hand", "finger_type", *(f"finger_{i}" for i in range(10)), *(f"hand_{i}" for i in range(3)), *(f"finger_type_{i}" for i in range(5))).collect()
    for r in hot:
        assert [r[f"finger_{i}"] for i in range(10)] == [float(r.finger == i) for i in range(10)] and [r[f"hand_{i}"] for i in range(3)] == [float(r.hand == i) for i in range(3)]


def test_drawings_and_reports(spark):
    dims = layout.dimensions(spark)
    svg = drawings.keyboard(layout.drawing(dims[1]))
    assert svg.startswith("<svg") and svg.count("<rect") == layout.drawing(dims[1]).count()
    points = spark.createDataFrame([(0.0, 1.0, "a<b"), (1.0, 2.0, "c"), (None, 1.0, "d")], "x double, y double, l string")
    assert drawings.curve(points, "x", "y", "l").count("<circle") == 2 and "a&lt;b" in drawings.curve(points, "x", "y", "l")
    assert drawings.curve(points.limit(0), "x", "y").startswith("<svg")
    text = drawings.report("Totals", spark.createDataFrame([("a", 1.5), ("bb", None)], "k string, v double"))
    assert text.splitlines()[0] == "Totals" and "1.5000" in text and text.splitlines()[-1].endswith("-")
    with pytest.raises(ValueError):
        drawings.curve(spark.range(2000).select(F.col("id").alias("x"), F.col("id").alias("y")), "x", "y")


def test_command_line(spark, tmp_path, capsys):
    assert cli.main(["list"]) == 0 and "enrich_layout" in capsys.readouterr().out.split()
    assert cli.main(["sql", "json_map"]) == 0 and "SELECT" in capsys.readouterr().out
    assert cli.main(["run", "json_dimension", "--data", "/root/testdata/sf0.001", "--to", str(tmp_path / "out")]) == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    with pytest.raises(SystemExit):
        cli.main(["run", "no_such_query", "--data", "x"])
