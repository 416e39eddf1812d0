"""Timed sequences: ``events`` as a key log. A participant is a user, an interval the microseconds between events, an error event a typing error."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import edits
from ..operators import folds, metrics, sampling
from ..operators import sequences as seq
from ..operators.windows import to_vector
from ..sources import tables as src
from ..sources.tables import table
from .base import query

ORDER = ["time", "event_id"]
SQL_EV = """
ev AS (SELECT event_id, user_id, event_type, value, props, epoch_us(ts) AS time FROM events),
ik AS (SELECT *, time - lag(time) OVER (PARTITION BY user_id ORDER BY time, event_id) AS iki FROM ev),
st AS (SELECT *, avg(iki) OVER (PARTITION BY user_id) AS m, stddev_samp(iki) OVER (PARTITION BY user_id) AS sd FROM ik),
sg AS (SELECT *, sum(CASE WHEN iki > m + 2 * sd THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY time, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM st),
rb AS (SELECT event_id, user_id, segment, time - min(time) OVER (PARTITION BY user_id, segment) AS time FROM sg),
r2 AS (SELECT *, time - lag(time) OVER (PARTITION BY user_id, segment ORDER BY time, event_id) AS iki FROM rb),
pz AS (SELECT *, CASE WHEN iki > 0 THEN iki::DOUBLE END AS v FROM r2),
zs AS (SELECT *, count(v) OVER u AS n, (v - avg(v) OVER u) / nullif(stddev_pop(v) OVER u, 0) AS iki_z, (ln(v) - avg(ln(v)) OVER u) / nullif(stddev_pop(ln(v)) OVER u, 0) AS iki_log_z FROM pz WINDOW u AS (PARTITION BY user_id))"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("time", F.unix_micros(F.col("ts").cast("timestamp")))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = seq.intervals(log(spark, sf_dir), "user_id", ORDER)
    return seq.split_at_outliers(timed, "user_id", "user_id", ORDER, sds=2.0)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    based = seq.rebase(segments(spark, sf_dir).drop("iki"), ["user_id", "segment"])
    named = based.withColumn("sequence_id", F.concat_ws("_", "user_id", "segment"))
    return seq.z_scores(seq.intervals(named, "sequence_id", ORDER), "user_id")


@query(f"WITH {SQL_EV} SELECT event_id, iki FROM ik")
def iki_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.intervals(log(spark, sf_dir), "user_id", ORDER).select("event_id", "iki")


@query(f"WITH {SQL_EV} SELECT event_id, segment FROM sg")
def outlier_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).select("event_id", "segment")


@query(f"WITH {SQL_EV} SELECT event_id, time FROM rb")
def time_rebase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.rebase(segments(spark, sf_dir), ["user_id", "segment"]).select("event_id", "time")


@query(f"WITH {SQL_EV} SELECT event_id, round(iki_z, 8) AS iki_z, round(iki_log_z, 8) AS iki_log_z FROM zs WHERE n > 1")
def zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("event_id", F.round("iki_z", 8).alias("iki_z"), F.round("iki_log_z", 8).alias("iki_log_z"))


KEEP = {"error": False, "view": True}


@query("""WITH b AS (SELECT event_id, user_id, epoch_us(ts) AS t, (event_type = 'error')::INT AS dr FROM events),
x AS (SELECT *, sum(dr) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS part FROM b)
SELECT event_id, part, concat_ws('_', user_id, part) AS sequence_id, t - min(t) OVER (PARTITION BY user_id, part) AS time FROM x WHERE dr = 0""")
def typo_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = seq.split_at_typos(log(spark, sf_dir), "user_id", ORDER, F.col("event_type"), KEEP)
    return rows.select("event_id", "part", F.concat_ws("_", "user_id", "part").alias("sequence_id"), "time")


@query("""WITH b AS (SELECT event_id, user_id, epoch_us(ts) AS t, CASE event_type WHEN 'click' THEN 'Deletion' WHEN 'error' THEN 'Insertion' END AS ty FROM events),
l AS (SELECT *, lag(ty) OVER (PARTITION BY user_id ORDER BY t, event_id) AS pt FROM b),
x AS (SELECT *, sum(CASE WHEN ty = 'Insertion' OR (ty = 'Deletion' AND pt = 'Deletion') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS part FROM l)
SELECT event_id, part, t - min(t) OVER (PARTITION BY user_id, part) AS time FROM x WHERE ty IS DISTINCT FROM 'Insertion'""")
def typo_split_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "Deletion").when(F.col("event_type") == "error", "Insertion")
    rows = seq.split_at_typos(log(spark, sf_dir), "user_id", ORDER, kind, {"Insertion": False, "Deletion": True})
    return rows.select("event_id", "part", "time")


@query("""WITH f AS (SELECT user_id, min(event_id) AS e FROM events GROUP BY user_id ORDER BY e, user_id LIMIT 50) SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM f)""")
def first_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.first_sequences(table(spark, sf_dir, "events"), "user_id", "event_id", 50).select("event_id")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal IS NOT NULL AND c_mktsegment = 'BUILDING' AND c_acctbal > 1000 ORDER BY c_custkey LIMIT 200")
def participants_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.filtered_participants(
        table(spark, sf_dir, "customer"), equal={"c_mktsegment": "BUILDING", "c_nationkey": "any"}, above=("c_acctbal", 1000), required=("c_acctbal",), n=200, order="c_custkey"
    )
    return rows.select("c_custkey", "c_mktsegment")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def participants_with_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def participants_without_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""WITH e AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_id, event_type AS key, epoch_us(ts) AS time, CASE event_type WHEN 'error' THEN -1 ELSE 1 END AS d FROM events WHERE event_type <> 'signup'),
s AS (SELECT *, sum(d) OVER w AS s, sum((d = 1)::INT) OVER w AS n FROM e WINDOW w AS (PARTITION BY user_id, day ORDER BY time, event_id ROWS UNBOUNDED PRECEDING)),
h AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY user_id, day ORDER BY time, event_id ROWS UNBOUNDED PRECEDING)) AS h FROM s),
f AS (SELECT *, d = -1 AND h < coalesce(lag(h) OVER w, 0) AS popped, min(h) OVER (PARTITION BY user_id, day ORDER BY time, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS low FROM h WINDOW w AS (PARTITION BY user_id, day ORDER BY time, event_id)),
p AS (SELECT DISTINCT user_id, day, n + 1 AS n, true AS corrected FROM f WHERE popped)
SELECT user_id, day, row_number() OVER (PARTITION BY user_id, day ORDER BY time, event_id) - 1 AS pos, key, time, coalesce(corrected, false) AS corrected FROM f LEFT JOIN p USING (user_id, day, n) WHERE d = 1 AND (low IS NULL OR low >= h)""")
def backspace_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user and day as typed keys, errors as backspaces, signups as shift keys."""
    rows = log(spark, sf_dir).withColumn("day", F.to_date("ts").cast("string"))
    return edits.replay(rows, ["user_id", "day"], ["time", "event_id"], "event_type", "time", erase="error", ignore="signup")


@query()
def typo_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole raw step: part names typed as the next part's name."""
    w = Window.orderBy("p_partkey")
    pairs = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("SENTENCE"), F.lead("p_name").over(w).alias("typed")).where("typed IS NOT NULL")
    keys = pairs.select(
        F.col("p_partkey").cast("string").alias("PARTICIPANT_ID"), F.lit("1").alias("TEST_SECTION_ID"), "SENTENCE", F.posexplode(F.split("typed", "")).alias("i", "LETTER")
    ).withColumn("PRESS_TIME", F.col("i").cast("long") * 100)
    return edits.annotate(keys)




@query("""WITH e AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS p, epoch_us(ts) AS t FROM events)
SELECT event_id, [coalesce(lag(value, 2) OVER w, -1.0), coalesce(lag(value) OVER w, -1.0), coalesce(value, -99.0), coalesce(lead(value) OVER w, -1.0)]::FLOAT[] AS context FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)""")
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir).withColumn("order", F.struct("time", "event_id"))
    return to_vector(rows, ["value"], "user_id", "order", back=2, ahead=1, name="context").select("event_id", "context")


@query("""WITH e AS (SELECT event_id, user_id, value AS y, lag(value) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS p FROM events), g AS (SELECT * FROM e WHERE p IS NOT NULL)
SELECT count(*) AS n, round(avg(abs(p - y)), 8) AS mae, round(1 - sum((p - y) * (p - y)) / (var_pop(y) * count(y)), 8) AS r2, round(avg(p - y), 8) AS bias, round(avg(p), 8) AS mean_pred FROM g""")
def mae_r2_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.errors(guesses(spark, sf_dir), "value", "guess").select("n", *(F.round(c, 8).alias(c) for c in ("mae", "r2", "bias", "mean_pred")))


def guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's value guessed as that of the user's event before."""
    w = Window.partitionBy("user_id").orderBy("time", "event_id")
    return log(spark, sf_dir).withColumn("guess", F.lag("value").over(w)).where("guess IS NOT NULL")


SQL_GUESS = """gs AS (SELECT event_id, user_id, event_type, value, lag(value) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS guess FROM events), gu AS (SELECT * FROM gs WHERE guess IS NOT NULL)"""


@query(f"""WITH {SQL_GUESS}, s AS (SELECT avg(abs(guess - value)) AS mae, stddev_samp(abs(guess - value)) / sqrt(count(*)) * {metrics.Z_975} AS half FROM gu)
SELECT round(mae, 8) AS mae, round(mae - half, 8) AS low, round(mae + half, 8) AS high FROM s""")
def mae_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.mae_interval(guesses(spark, sf_dir), "value", "guess").select(*(F.round(c, 8).alias(c) for c in ("mae", "low", "high")))


@query("""WITH d AS (SELECT quality::DOUBLE AS x, toxic::DOUBLE AS y FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL),
r AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM d)
SELECT round(corr(x, y), 8) AS pearson, round(corr(rx, ry), 8) AS spearman FROM r""")
def correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.correlations(table(spark, sf_dir, "labels"), "quality", "toxic").select(F.round("pearson", 8).alias("pearson"), F.round("spearman", 8).alias("spearman"))


def _sql_boot(t: str, x: str, cluster: str, rounds: int, seed: int, by: tuple[str, ...] = ()) -> str:
    """CTEs cl, dr and bm: the mean by round over clusters that are taken as often as a draw says."""
    cols = "".join(f"{c}, " for c in by)
    keys = "".join(f"{c} || ':' || " for c in by)
    times = " + ".join(f"(u >= {least})::INT" for least in metrics.POISSON)
    return f"""cl AS (SELECT {cols}{cluster} AS cluster, sum({x}) AS total, count({x}) AS n FROM {t} GROUP BY {cols}{cluster}),
dr AS (SELECT cl.*, b, ('0x' || substring(md5('{seed}:' || {keys}b || ':' || cluster), 1, 8))::BIGINT AS u FROM cl, range({rounds}) AS r(b)),
bm AS (SELECT {cols}b, sum(w * total) / nullif(sum(w * n), 0) AS m FROM (SELECT *, {times} AS w FROM dr) GROUP BY {cols}b)"""


@query(f"WITH {_sql_boot('customer', 'c_acctbal::DOUBLE', 'c_custkey', 50, 1)} SELECT round(avg(m), 8) AS mean, round(quantile_cont(m, 0.025::DOUBLE), 8) AS low, round(quantile_cont(m, 0.975::DOUBLE), 8) AS high FROM bm")
def bootstrap_iid(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = metrics.clusters(table(spark, sf_dir, "customer"), "c_custkey", F.col("c_acctbal").cast("double"))
    return metrics.interval(metrics.bootstrap_means(parts, 50, 1), "m").select(*(F.round(c, 8).alias(c) for c in ("mean", "low", "high")))


@query(f"WITH {SQL_GUESS}, {_sql_boot('gu', 'abs(guess - value)', 'user_id', 100, 2)} SELECT round(avg(m), 8) AS mean, round(quantile_cont(m, 0.025::DOUBLE), 8) AS low, round(quantile_cont(m, 0.975::DOUBLE), 8) AS high FROM bm")
def bootstrap_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error of the guesses with whole users resampled."""
    parts = metrics.clusters(guesses(spark, sf_dir), "user_id", F.abs(F.col("guess") - F.col("value")))
    return metrics.interval(metrics.bootstrap_means(parts, 100, 2), "m").select(*(F.round(c, 8).alias(c) for c in ("mean", "low", "high")))


SQL_SHIFT = f"""{SQL_GUESS}, fs AS (SELECT *, (event_id % 3)::INT AS fold, (event_type = 'purchase')::INT AS side FROM gu), {_sql_boot('fs', '(guess - value)', 'user_id', 100, 3, ('fold', 'side'))},
sf AS (SELECT b, fold, sum(CASE WHEN side = 1 THEN m ELSE -m END) AS d, count(*) AS c FROM bm GROUP BY b, fold), sh AS (SELECT b, avg(d) AS shift FROM sf WHERE c = 2 GROUP BY b)"""


def shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = guesses(spark, sf_dir).withColumn("fold", (F.col("event_id") % 3).cast("int")).withColumn("side", (F.col("event_type") == "purchase").cast("int"))
    return metrics.bias_shift(rows, "value", "guess", "user_id", "side", 100, 3)


@query(f"WITH {SQL_SHIFT} SELECT round(avg(shift), 8) AS mean, round(quantile_cont(shift, 0.025::DOUBLE), 8) AS low, round(quantile_cont(shift, 0.975::DOUBLE), 8) AS high FROM sh")
def bias_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.interval(shifts(spark, sf_dir), "shift").select(*(F.round(c, 8).alias(c) for c in ("mean", "low", "high")))


@query(f"""WITH {SQL_SHIFT} SELECT round(avg(shift), 8) AS mean, round(quantile_cont(shift, 0.025::DOUBLE), 8) AS low, round(quantile_cont(shift, 0.975::DOUBLE), 8) AS high,
least(CASE WHEN avg(shift) > 0 THEN avg((shift <= 0)::INT) ELSE avg((shift >= 0)::INT) END * 2, 1.0) AS p, round(avg(shift) * 50.4::DOUBLE / 110.5::DOUBLE * 100, 8) AS percent FROM sh""")
def pvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.p_value(shifts(spark, sf_dir), "shift").select(F.round("mean", 8).alias("mean"), F.round("low", 8).alias("low"), F.round("high", 8).alias("high"), "p", F.round("percent", 8).alias("percent"))


@query("""WITH t AS (SELECT 'u' || (user_id % 7) AS study, event_id AS trial, ts AS started, CASE event_type WHEN 'error' THEN 'PRUNED' WHEN 'signup' THEN 'FAIL' ELSE 'COMPLETE' END AS state, value FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY study ORDER BY started NULLS FIRST, trial) AS rn FROM t), d AS (SELECT *, CASE WHEN state = 'COMPLETE' THEN value END AS v FROM r WHERE rn <= 60)
SELECT study, round(min(v), 8) AS best, round(avg(v), 8) AS mean, count(v) AS completed, count(*) FILTER (state = 'PRUNED') AS pruned FROM d GROUP BY study""")
def hpo_phase_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.phase_table(trials(spark, sf_dir), 60).select("study", F.round("best", 8).alias("best"), F.round("mean", 8).alias("mean"), "completed", "pruned")


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("event_type") == "error", "PRUNED").when(F.col("event_type") == "signup", "FAIL").otherwise("COMPLETE")
    study = F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string"))
    return table(spark, sf_dir, "events").select(study.alias("study"), F.col("event_id").alias("trial"), F.col("ts").alias("started"), state.alias("state"), "value")


@query("""WITH t AS (SELECT 'u' || (user_id % 7) AS study, event_id AS trial, value FROM events WHERE event_type NOT IN ('error', 'signup') AND value IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY study ORDER BY value, trial) AS rn FROM t) SELECT study, trial, value FROM r WHERE rn = 1""")
def best_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best_trials(trials(spark, sf_dir))


SQL_FOLD = "(list_sum(list_transform(string_split({w}, ''), lambda c: ascii(c))) % 10)::INT"


@query(f"SELECT p_partkey, CASE WHEN p_name IS NULL OR p_name = '' THEN 0 ELSE {SQL_FOLD.format(w='p_name')} END AS fold FROM part")
def fold_assign_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import ordinal_fold

    return table(spark, sf_dir, "part").select("p_partkey", ordinal_fold(F.col("p_name")).alias("fold"))


SQL_FD = "fd AS (SELECT l_orderkey, l_linenumber, (l_partkey % 10)::INT AS fold_word, (l_suppkey % 10)::INT AS fold_bigram, l_quantity::DOUBLE AS q FROM lineitem)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_partkey") % 10).cast("int").alias("fold_word"), (F.col("l_suppkey") % 10).cast("int").alias("fold_bigram"), F.col("l_quantity").cast("double").alias("q")
    )


@query(f"WITH {SQL_FD} SELECT l_orderkey, l_linenumber, fold_word <> 3 AND fold_bigram <> 3 AS is_train, fold_word = 3 AS is_val FROM fd")
def fold_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.masks(_lines(spark, sf_dir), 3).select("l_orderkey", "l_linenumber", "is_train", "is_val")


@query(f"WITH {SQL_FD} SELECT l_orderkey, l_linenumber, fold_word <> 3 AND fold_bigram <> 3 AS is_train, fold_word = 3 OR fold_bigram = 3 AS is_val FROM fd")
def fold_masks_either(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.masks(_lines(spark, sf_dir), 3, either=True).select("l_orderkey", "l_linenumber", "is_train", "is_val")


@query("SELECT l_partkey, count(DISTINCT l_suppkey % 10) AS folds FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey % 10) > 1")
def fold_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.leaks(_lines(spark, sf_dir), "l_partkey", "fold_bigram")


@query(f"WITH {SQL_FD}, t AS (SELECT fold_word, sum(q) AS total FROM fd GROUP BY 1) SELECT count(*) AS folds, round(avg(total), 6) AS mean, round(greatest(max(total) - avg(total), avg(total) - min(total)) / avg(total), 9) AS spread FROM t")
def fold_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.balance(_lines(spark, sf_dir), "fold_word", "q").select("folds", F.round("mean", 6).alias("mean"), F.round("spread", 9).alias("spread"))


@query("""WITH RECURSIVE w AS (SELECT p_partkey::VARCHAR AS item, p_retailprice::DOUBLE AS weight, row_number() OVER (ORDER BY p_retailprice::DOUBLE DESC, p_partkey::VARCHAR) AS i FROM part),
g AS (SELECT 0::BIGINT AS i, NULL::VARCHAR AS item, -1 AS fold, [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]::DOUBLE[] AS t
  UNION ALL SELECT w.i, w.item, (list_position(t, list_min(t)) - 1)::INT, list_transform(t, lambda x, k: CASE WHEN k = list_position(t, list_min(t)) THEN x + w.weight ELSE x END) FROM g JOIN w ON w.i = g.i + 1)
SELECT item, fold FROM g WHERE i > 0""")
def fold_pack_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("item"), F.col("p_retailprice").cast("double").alias("weight"))
    return folds.balanced_table(weights)


@query("""WITH r AS (SELECT event_id, event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts), event_id) AS rn FROM events) SELECT event_id, rn FROM r WHERE rn <= 25""")
def first_n_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.first_rows(log(spark, sf_dir), "event_type", 25, "time", "event_id").select("event_id", "rn")


@query("""SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, coalesce(json_extract(props, '$.missing.mean')::DOUBLE, 0.0) AS missing FROM events""")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path of nested documents with a default."""
    parsed = F.from_json("props", "k long, missing struct<mean:double>")
    return table(spark, sf_dir, "events").select("event_id", parsed.alias("p")).select("event_id", F.col("p.k").alias("k"), F.coalesce("p.missing.mean", F.lit(0.0)).alias("missing"))


@query("SELECT event_id, unnest(json_keys(props)) AS item, json_extract(props, '$.k')::DOUBLE AS value FROM events")
def json_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string,double>")).alias("item", "value"))
