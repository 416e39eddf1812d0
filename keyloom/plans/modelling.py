"""Models on vectors, streams over events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session
from ..operators import metrics, models, trees
from ..operators.sampling import draw
from ..sources.tables import table
from ..streaming import events as st
from .base import query

DIM = 64
FOLD_WEIGHTS = [([((i * 7 + f * 3) % 11 - 5) / 10 for i in range(DIM)], f / 10) for f in range(3)]


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))


def _dot(f: int) -> str:
    w, b = FOLD_WEIGHTS[f]
    return f"(list_dot_product(embedding::DOUBLE[], {w}::DOUBLE[]) + {b}::DOUBLE)"


@query(f"SELECT vec_id, round({_dot(1)}, 6) AS score FROM embeddings")
def linear_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("vec_id", F.round(models.linear("v", *FOLD_WEIGHTS[1]), 6).alias("score"))


@query(f"WITH p AS (SELECT vec_id, unnest([{_dot(0)}, {_dot(1)}, {_dot(2)}]) AS g FROM embeddings) SELECT vec_id, round(avg(g), 6) AS mean, round(stddev_pop(g), 6) AS std FROM p GROUP BY vec_id")
def ensemble_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean, std = models.ensemble("v", FOLD_WEIGHTS)
    return vectors(spark, sf_dir).select("vec_id", F.round(mean, 6).alias("mean"), F.round(std, 6).alias("std"))


@query(f"""WITH p AS (SELECT label, unnest([0, 1, 2]) AS fold, unnest([{_dot(0)}, {_dot(1)}, {_dot(2)}]) AS g FROM embeddings), s AS (SELECT label, fold, stddev_pop(g) AS sd, avg(g) AS m FROM p GROUP BY label, fold)
SELECT label, round(avg(sd), 6) AS mean_std, round(avg(sd * sd), 6) AS mean_var FROM s GROUP BY label""")
def variance_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    guesses = F.array(*(models.linear("v", w, b) for w, b in FOLD_WEIGHTS))
    rows = vectors(spark, sf_dir).select("label", F.posexplode(guesses).alias("fold", "g")).groupBy("label", "fold").agg(F.stddev_pop("g").alias("sd"))
    return rows.groupBy("label").agg(F.round(F.avg("sd"), 6).alias("mean_std"), F.round(F.avg(F.col("sd") * F.col("sd")), 6).alias("mean_var"))


@query(f"""WITH p AS (SELECT vec_id, unnest([0, 1, 2]) AS fold, unnest([{_dot(0)}, {_dot(1)}, {_dot(2)}]) AS g FROM embeddings) SELECT vec_id, round(avg(g), 6) AS prediction FROM p WHERE fold <> vec_id % 3 GROUP BY vec_id""")
def oof_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over the folds that did not see a row."""
    guesses = F.array(*(models.linear("v", w, b) for w, b in FOLD_WEIGHTS))
    rows = vectors(spark, sf_dir).select("vec_id", F.posexplode(guesses).alias("fold", "prediction")).where(F.col("fold") != F.col("vec_id") % 3)
    return models.out_of_fold(rows, "vec_id", "prediction").select("vec_id", F.round("prediction", 6).alias("prediction"))


@query(f"""WITH e AS (SELECT vec_id, unnest(range({DIM})) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), s AS (SELECT i, avg(x) AS m, stddev_pop(x) AS sd FROM e GROUP BY i)
SELECT vec_id, i::INT AS i, round(CASE WHEN sd > 0 THEN (x - m) / sd ELSE 0.0 END, 5) AS z FROM e JOIN s USING (i) WHERE i < 4""")
def standard_scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = models.standardised(vectors(spark, sf_dir).select("vec_id", "v"), "v", DIM)
    return rows.select("vec_id", F.posexplode(F.slice("v", 1, 4)).alias("i", "z")).select("vec_id", "i", F.round("z", 5).alias("z"))


@query(f"""WITH e AS (SELECT vec_id, unnest(range({DIM})) AS i, unnest(embedding)::DOUBLE AS x, unnest({FOLD_WEIGHTS[0][0]}::DOUBLE[]) AS w FROM embeddings), s AS (SELECT i, avg(x) AS m FROM e GROUP BY i),
a AS (SELECT i, avg(abs((x - m) * w)) AS a FROM e JOIN s USING (i) GROUP BY i) SELECT (i % 16)::INT AS feature, round(sum(a), 6) AS importance FROM a GROUP BY 1""")
def importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.importance(vectors(spark, sf_dir).select("v"), "v", FOLD_WEIGHTS[0][0], 16)
    return rows.select("feature", F.round("importance", 6).alias("importance"))


def _target(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return rows.withColumn("y", models.linear("v", *FOLD_WEIGHTS[0])).withColumn("fold", (F.col("vec_id") % 3).cast("int"))


#: A row in four is off by 5 times a draw: noise with median 0 that squared loss would follow.
_NOISE = "CASE WHEN vec_id % 4 = 0 THEN 5.0::DOUBLE * (('0x' || substring(md5('9:' || vec_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE - 0.5::DOUBLE) ELSE 0.0::DOUBLE END"


def _noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    noise = F.when(F.col("vec_id") % 4 == 0, 5.0 * (draw(9, "vec_id") / 4294967296.0 - 0.5)).otherwise(0.0)
    return _target(spark, sf_dir).withColumn("y", F.col("y") + noise)


@query(f"""WITH t AS (SELECT vec_id, {_dot(0)} AS y FROM embeddings WHERE vec_id % 3 = 0)
SELECT count(*) AS n, 0.0::DOUBLE AS mae, CASE WHEN var_pop(y) > 0 THEN 1.0::DOUBLE END AS r2, 0.0::DOUBLE AS bias, round(avg(y), 3) AS mean_pred FROM t""")
def fit_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The robust linear model's error on the fold held out; the target is linear, so there is none."""
    rows = _target(spark, sf_dir)
    w, b = models.fit_linear(rows.where("fold <> 0"), "v", "y")
    found = metrics.errors(rows.where("fold = 0").withColumn("guess", models.linear("v", w, b)), "y", "guess")
    return found.select("n", *(F.abs(F.round(c, 3)).alias(c) if c in ("mae", "bias") else F.round(c, 3).alias(c) for c in ("mae", "r2", "bias", "mean_pred")))


@query(f"SELECT unnest(range({DIM}))::INT AS place, round(unnest({FOLD_WEIGHTS[0][0]}::DOUBLE[]), 3) AS weight UNION ALL SELECT {DIM}, round({FOLD_WEIGHTS[0][1]}::DOUBLE, 3)")
def fit_absolute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights under absolute loss of a target with gross errors in a quarter of its rows: those without the errors."""
    w, b = models.fit_absolute(_noisy(spark, sf_dir), "v", "y", DIM)
    return spark.createDataFrame([(i, round(x, 3) + 0.0) for i, x in enumerate([*w, b])], "place int, weight double")


@query()
def fit_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _noisy(spark, sf_dir).withColumn("held", F.col("fold") == 1)
    model = models.fit_trees(rows.where("fold <> 0"), "v", "y", val="held", rounds=20, depth=4)
    return metrics.errors(models.predict_trees(model, rows.where("fold = 0"), "v"), "y", "prediction")


@query()
def fit_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hidden layers with early stopping, a network for each fold."""
    rows = _noisy(spark, sf_dir)
    guessed = models.cross_validated_network(rows, "v", "y", "fold", "vec_id", 3, hidden=(32, 16, 8), decay=0.001, held=0.1, epochs=60)
    return metrics.errors(rows.join(guessed, "vec_id"), "y", "prediction")


@query("SELECT s AS strength, CASE WHEN s > 1000 THEN 0 ELSE 16 END AS features FROM (SELECT unnest([0.000001, 100000.0]::DOUBLE[]) AS s)")
def l1_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features with a weight at both ends of a path of L1 strengths: all at next to none, none at more than the target varies."""
    path = models.l1_path(_target(spark, sf_dir), "v", "y", [f"f{i}" for i in range(16)], [0.000001, 100000.0])
    return spark.createDataFrame([(s, len(kept)) for s, kept in path], "strength double, features int")


def _small_trees() -> list[trees.Tree]:
    return trees.parse(_MODEL)[1]


#: A model file of two trees over four places.
_MODEL = """tree
feature_names=a b c d

Tree=0
num_leaves=3
split_feature=0 1
threshold=0 0.1
decision_type=2 2
left_child=-1 -2
right_child=1 -3
leaf_value=1 2 4
leaf_count=30 20 50

Tree=1
num_leaves=2
split_feature=2
threshold=-0.05
decision_type=2
left_child=-1
right_child=-2
leaf_value=-1 0.5
leaf_count=40 60

end of trees
"""
_SQL_TREES = """t AS (SELECT vec_id, embedding[1]::DOUBLE <= 0 AS a, embedding[2]::DOUBLE <= 0.1::DOUBLE AS b, embedding[3]::DOUBLE <= -0.05::DOUBLE AS c FROM embeddings)"""


@query(f"WITH {_SQL_TREES} SELECT vec_id, CASE WHEN a THEN 1.0 WHEN b THEN 2.0 ELSE 4.0 END::DOUBLE + CASE WHEN c THEN -1.0 ELSE 0.5 END::DOUBLE AS mean, 0.0::DOUBLE AS std FROM t")
def tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of a tree model read from its text format."""
    mean, std = trees.TreeModel(["a", "b", "c", "d"], [_small_trees()], 0, 0).predict("v4")
    rows = vectors(spark, sf_dir).withColumn("v4", F.slice("v", 1, 4))
    return rows.select("vec_id", mean.alias("mean"), std.alias("std"))


# The values of the coalitions {}, {a}, {b}, {a, b} of the first tree follow from its leaf counts: 30 to the left of a, then 20 of 70 to the left of b.
@query(f"""WITH {_SQL_TREES}, g AS (SELECT *, CASE WHEN b THEN 2.0 ELSE 4.0 END::DOUBLE AS leaf_b, (2.0 * 20 + 4.0 * 50)::DOUBLE / 70 AS below FROM t),
v AS (SELECT *, (0.3::DOUBLE * 1 + 0.7::DOUBLE * below) AS v0, CASE WHEN a THEN 1.0::DOUBLE ELSE below END AS va, 0.3::DOUBLE * 1 + 0.7::DOUBLE * leaf_b AS vb, CASE WHEN a THEN 1.0::DOUBLE ELSE leaf_b END AS vab FROM g)
SELECT vec_id, round(((va - v0) + (vab - vb)) / 2, 9) AS a, round(((vb - v0) + (vab - va)) / 2, 9) AS b, round(CASE WHEN c THEN -1.0 ELSE 0.5 END::DOUBLE - (0.4::DOUBLE * -1 + 0.6::DOUBLE * 0.5), 9) AS c, 0.0::DOUBLE AS d FROM v""")
def tree_shapley(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact Shapley values of the same model's predictions."""
    rows = vectors(spark, sf_dir).withColumn("v4", F.slice("v", 1, 4))
    values = trees.shapley_values(rows, "v4", _small_trees(), 4)
    return values.select("vec_id", *(F.round(F.get("shapley", F.lit(i)), 9).alias(n) for i, n in enumerate("abcd")))


def _drained(spark: SparkSession, sf_dir: str, make, name: str) -> DataFrame:
    """A stream's rows once it has processed what is there, by way of a table in the shared folder."""
    path = f"{session.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    stream = make(st.read(spark, sf_dir, glob="events.parquet"))
    st.drain(stream, f"{path}/state", st.to_parquet(f"{path}/out"))
    return spark.read.schema(stream.schema).parquet(f"{path}/out/batch=*")


@query("SELECT event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY event_type")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _drained(spark, sf_dir, lambda s: s.select("event_id", "event_type", "value"), "ingest")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events) SELECT user_id, event_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS iki FROM e")
def stream_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(spark, sf_dir, st.live_intervals, "intervals")


def stream_windows_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(spark, sf_dir, lambda s: st.windows(s, "1 day"), "windows")


@query("""WITH w AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2) SELECT epoch_us(start) AS start, event_type, n, total FROM w WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily windows that the watermark has closed."""
    return stream_windows_of(spark, sf_dir).select(F.unix_micros("start").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("""WITH e AS (SELECT user_id, epoch_us(ts) AS t, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)) AS d FROM events),
s AS (SELECT *, sum(CASE WHEN d IS NULL OR d >= 86400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM e),
g AS (SELECT user_id, min(t) AS start, max(t) + 86400000000 AS "end", count(*) AS n FROM s GROUP BY user_id, k)
SELECT user_id, start, n FROM g WHERE "end" <= (SELECT max(epoch_us(ts)) FROM events) - 600000000""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that the watermark has closed."""
    return _drained(spark, sf_dir, lambda s: st.sessions(s, "1 day"), "sessions").select("user_id", F.unix_micros("start").alias("start"), "n")


def _corpus_costs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """What the benchmark texts cost under two layouts and a small linear model."""
    from ..operators import features as feat
    from ..operators import inference, layout

    texts = table(spark, sf_dir, "benchmark").select("item_id", "text", F.length("text").alias("n"))
    rows = inference.linguistic_frame(texts, "text", "item_id")
    model = inference.LinearModel(["same_finger", "in_roll", "shift", "word_index"], [([0.0] * 4 + [0.5, -0.25, 0.125, 0.0625], 0.0), ([0.0] * 4 + [0.25, -0.25, 0.125, 0.03125], 0.5)], back=1, ahead=0)
    out = {}
    for name in ("qwerty", "dvorak"):
        dims = layout.dimensions(spark, name)
        out[name] = inference.predict_texts(texts, "item_id", "n", rows, model, feat.pair_table(spark, layout.key_dim(*dims), layout.movement_dim(dims[1])))
    return out


def _sql_costs(name: str) -> str:
    from ..operators.features import DELIMITERS
    from .keys import SQL_LAGS, SQL_PAIRS, sql_chars, sql_keys

    flag = lambda c: f"CASE WHEN key_id > 0 AND p_k > 0 THEN coalesce(({SQL_PAIRS[c]})::INT, 0) ELSE -1 END"
    return f"""WITH {sql_keys(name)}, {sql_chars("benchmark", "item_id")}, {SQL_LAGS},
dl AS (SELECT *, key_id IN {DELIMITERS} AS d FROM lg), rn AS (SELECT *, sum(d::INT) OVER (PARTITION BY item_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM dl),
ix AS (SELECT *, CASE WHEN d THEN -1 ELSE row_number() OVER (PARTITION BY item_id, run, d ORDER BY pos) - 1 END AS wi FROM rn),
fx AS (SELECT item_id, pos, {flag("same_finger")} AS sf, {flag("in_roll")} AS ir, coalesce(shift, -1) AS sh, wi FROM ix),
pr AS (SELECT *, 0.5 * sf - 0.25 * ir + 0.125 * sh + 0.0625 * wi AS a, 0.25 * sf - 0.25 * ir + 0.125 * sh + 0.03125 * wi + 0.5 AS b FROM fx WHERE pos >= 1),
su AS (SELECT item_id, sum((a + b) / 2)::DOUBLE AS cost, sqrt(sum(((a - b) / 2) * ((a - b) / 2)))::DOUBLE AS std FROM pr GROUP BY item_id),
ct AS (SELECT item_id, length(text) AS n, coalesce(cost, 0.0) AS cost, coalesce(std, 0.0) AS std FROM benchmark LEFT JOIN su USING (item_id))
SELECT item_id, round(cost, 6) AS cost, round(std, 6) AS std, round(cost / greatest(n - 1, 1), 8) AS mean_z, round(std / sqrt(greatest(n - 1, 1)), 8) AS std_z FROM ct"""


@query(_sql_costs("qwerty"))
def predict_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts to features to windows to an ensemble's predictions to costs by text."""
    rows = _corpus_costs(spark, sf_dir)["qwerty"]
    return rows.select("item_id", F.round("cost", 6).alias("cost"), F.round("std", 6).alias("std"), F.round("mean_z", 8).alias("mean_z"), F.round("std_z", 8).alias("std_z"))


@query(f"WITH q AS ({_sql_costs('qwerty')}), v AS ({_sql_costs('dvorak')}) SELECT item_id, round(q.mean_z - v.mean_z, 6) AS diff FROM q JOIN v USING (item_id)")
def compare_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.inference import compare

    both = _corpus_costs(spark, sf_dir)
    return compare(both["qwerty"], both["dvorak"], "item_id").select("item_id", F.round("diff", 6).alias("diff"))


@query()
def hpo_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Penalties for the linear model by a Parzen estimator, poor ones pruned; best first in the phase table."""
    from ..operators.tuning import Parzen, search, study_name

    rows = _target(spark, sf_dir)

    def evaluate(params: dict, fold: int) -> float:
        w, b = models.fit_linear(rows.where(F.col("fold") != fold), "v", "y", reg=params["reg"], l1_share=params["l1"])
        return metrics.errors(rows.where(F.col("fold") == fold).withColumn("g", models.linear("v", w, b)), "y", "g").first().mae

    trials = search(spark, study_name("linreg_w", 0, 0), Parzen({"reg": (0.01, 10.0, "log"), "l1": [0.0, 0.5]}, 6, start=3), evaluate, 3, warm=2)
    return metrics.phase_table(trials, 10)


@query("SELECT p_partkey FROM part WHERE starts_with(p_name, 'small') OR starts_with(p_name, 'red')")
def prefix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from functools import reduce
    from operator import or_

    names = F.col("p_name")
    return table(spark, sf_dir, "part").where(reduce(or_, (names.startswith(p) for p in ("small", "red")))).select("p_partkey")
