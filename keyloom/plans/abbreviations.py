"""Abbreviations over corpora: indexes, matches, streams, savings, selection, rewriting; and one-shot shift."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session
from ..functions import edits, phonetic
from ..functions import text as tx
from ..operators import ngrams as ng
from ..operators import oneshot
from ..operators.abbreviations import candidates as cand
from ..operators.abbreviations import contexts as ctx
from ..operators.abbreviations import rewriting as rw
from ..operators.abbreviations import selection as sel
from ..operators.layout import small
from ..operators.models import costs, milliseconds, per_key
from ..operators.sequences import characters
from ..sources.tables import table
from .base import query
from .keys import SQL_WORD_ZIPF, sql_chars, sql_gram_zipf, word_zipf

# A small dictionary for the queries: text, abbreviation, trigger form, kind.
ENTRIES = [
    ("the", "t", "trg", "singleword"),
    ("and", "nn", "rpt_trg", "singleword"),
    ("that", "tt", "doubletap", "singleword"),
    ("this", "ts", "trg", "singleword"),
    ("tion", "n", "trg", "suffix"),
    ("ion", "o", "trg", "suffix"),
    ("ing", "gg", "doubletap", "suffix"),
    ("er", "r", "trg", "suffix"),
]


def entries(spark: SparkSession) -> DataFrame:
    return small(spark, ENTRIES, text=pa.string(), abbr=pa.string(), trigger_form=pa.string(), type=pa.string())


SQL_ENTRIES = "en(text, abbr, form, type) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', '{d}')" for a, b, c, d in ENTRIES) + ")"


def bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark")


SQL_TOK = r"""
tk AS (SELECT item_id, unnest(range(len(l))) AS "at", unnest(l) AS token FROM (SELECT item_id, list_filter(regexp_split_to_array(text, '[ \t\n\v\f\r]+'), lambda x: x <> '') AS l FROM benchmark)),
tb AS (SELECT *, regexp_extract(token, '^([^a-zA-Z0-9'']*)((?s:.*?))([^a-zA-Z0-9'']*)$', 1) AS pre, regexp_extract(token, '^([^a-zA-Z0-9'']*)((?s:.*?))([^a-zA-Z0-9'']*)$', 2) AS body,
  regexp_extract(token, '^([^a-zA-Z0-9'']*)((?s:.*?))([^a-zA-Z0-9'']*)$', 3) AS post FROM tk),
tl AS (SELECT *, lower(body) AS low FROM tb)"""


@query(f"""WITH {SQL_TOK} SELECT item_id, "at", pre, body, post FROM tl""")
def punctuation_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rw.tokenised(bench(spark, sf_dir), "text", "item_id").select("item_id", "at", "pre", "body", "post")


@query(f"""WITH {SQL_TOK}, {SQL_ENTRIES} SELECT item_id, "at", abbr FROM tl LEFT JOIN en ON low = text AND type <> 'suffix'""")
def exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rw.whole_matches(rw.tokenised(bench(spark, sf_dir), "text", "item_id"), entries(spark)).select("item_id", "at", "entry.abbr")


@query(f"""WITH {SQL_TOK}, {SQL_ENTRIES}, m AS (SELECT low, arg_max(text, length(text)) AS suffix FROM (SELECT DISTINCT low FROM tl) JOIN en ON type = 'suffix' AND suffix(low, text) AND length(low) > length(text) GROUP BY low)
SELECT item_id, "at", suffix FROM tl LEFT JOIN m USING (low)""")
def suffix_longest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rw.suffix_matches(rw.tokenised(bench(spark, sf_dir), "text", "item_id"), entries(spark), 6, "item_id")
    return found.select("item_id", "at", F.col("ending.text").alias("suffix"))



@query("""WITH e AS (SELECT p_partkey AS k, right(p_name, 4 + (p_partkey % 5)::INT) AS text, CASE WHEN p_partkey % 3 = 0 THEN 'suffix' ELSE 'singleword' END AS type FROM part),
s AS (SELECT text AS suf, min(k) AS j FROM e WHERE type = 'suffix' GROUP BY text)
SELECT k AS i, j FROM e JOIN s ON suffix(text, suf) AND length(text) > length(suf) WHERE k <> j""")
def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    rows = parts.select(
        F.col("p_partkey").alias("k"), F.right("p_name", (4 + F.col("p_partkey") % 5).cast("int")).alias("text"), F.when(F.col("p_partkey") % 3 == 0, "suffix").otherwise("singleword").alias("type")
    )
    return sel.overlaps(rows, "k")


SQL_WIX = """
wx AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-zA-Z'']+')) AS word FROM benchmark),
wi AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY item_id) AS rn FROM wx)"""


@query(f"WITH {SQL_WIX} SELECT word, item_id, rn FROM wi WHERE rn <= 200")
def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctx.word_index(bench(spark, sf_dir), "text", "item_id").select("word", "item_id", "rn")


@query(f"WITH {SQL_WIX}, w AS (SELECT DISTINCT word FROM wi) SELECT right(word, n) AS suffix, word FROM w, unnest(generate_series(2, least(8, length(word) - 1))) AS t(n) WHERE length(word) > 2")
def suffix_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctx.suffix_index(ctx.word_index(bench(spark, sf_dir), "text", "item_id"))


SQL_PLACES = f"""{sql_chars("benchmark", "item_id")},
wr AS (SELECT *, regexp_matches(k, '[a-zA-Z'']') AS inw, sum((NOT regexp_matches(k, '[a-zA-Z'']'))::INT) OVER (PARTITION BY item_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM chars),
pl AS (SELECT item_id, min(pos) AS start, string_agg(k, '' ORDER BY pos) AS body FROM wr WHERE inw GROUP BY item_id, run)"""
SQL_OCC = f"""{SQL_PLACES}, {SQL_ENTRIES},
oc AS (SELECT p.*, e.text AS item, e.type, e.abbr, e.form FROM pl p JOIN en e ON (e.type <> 'suffix' AND lower(body) = e.text) OR (e.type = 'suffix' AND suffix(lower(body), e.text) AND length(body) > length(e.text))),
on_ AS (SELECT *, row_number() OVER (PARTITION BY item, type ORDER BY item_id, start) AS rn FROM oc)"""


def found(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    items = entries(spark).select(F.col("text").alias("item"), "type")
    return ctx.occurrences(bench(spark, sf_dir), "text", "item_id", items, n)


@query(f"WITH {SQL_OCC} SELECT item, type, item_id, start, body, rn FROM on_ WHERE rn <= 30")
def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir, 30).select("item", "type", "item_id", "start", "body", "rn")


SQL_STRIPS = f"""{SQL_OCC},
bt AS (SELECT item_id, text FROM benchmark),
sp AS (SELECT o.*, lpad(substring(text, greatest(start - 5, 0) + 1, least(start, 5)), 5, ' ') AS lft,
  rpad(CASE WHEN start + length(body) < length(text) THEN substring(text, start + length(body) + 1, 3) ELSE ' ' END, 3, ' ') AS rgt,
  CASE form WHEN 'trg' THEN abbr || chr(1) WHEN 'doubletap' THEN abbr[1] || abbr[1] ELSE abbr[1] || chr(2) || chr(1) END AS ks FROM on_ o JOIN bt USING (item_id) WHERE rn <= 30),
sq AS (SELECT *, CASE WHEN type = 'suffix' THEN left(body, length(body) - length(item)) || ks WHEN body[1] <> lower(body[1]) THEN upper(ks[1]) || substring(ks, 2) ELSE ks END AS mid FROM sp)"""


@query(f"WITH {SQL_STRIPS} SELECT item, item_id, start, lft || body || rgt AS word_ks, lft || mid || rgt AS abbr_ks, lower(body) AS host_word, length(body) AS word_len, length(mid) AS abbr_len FROM sq")
def context_strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strips(spark, sf_dir).select("item", "item_id", "start", "word_ks", "abbr_ks", "host_word", "word_len", "abbr_len")


def strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = found(spark, sf_dir, 30).join(F.broadcast(entries(spark).withColumnRenamed("text", "item")), ["item", "type"]).join(bench(spark, sf_dir).select("item_id", "text"), "item_id")
    return ctx.strips(rows, "text", 5, 3, repeat_key=False)


@query(f"""WITH {SQL_WORD_ZIPF}, {SQL_STRIPS}, v AS (SELECT item, CASE WHEN type = 'suffix' THEN pow(10.0, coalesce(zipf, 0.0)) ELSE 1.0 END AS w, (length(body) - length(mid))::DOUBLE AS s, length(body) / 10.0::DOUBLE AS a, length(mid) / 10.0::DOUBLE AS b
  FROM sq LEFT JOIN wz ON lower(body) = word)
SELECT item, round(sum(s * w) / sum(w), 8) AS mean, round(sqrt(sum((a * a + b * b) * w * w) / (sum(w) * sum(w) + 1e-12)), 8) AS std FROM v GROUP BY item""")
def weighted_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys saved by entry over its contexts, suffixes weighted by their words' frequencies, with a deviation in quadrature."""
    rows = strips(spark, sf_dir).join(word_zipf(spark, sf_dir), F.col("host_word") == F.col("word"), "left")
    weight = F.when(F.col("type") == "suffix", F.pow(F.lit(10.0), F.coalesce("zipf", F.lit(0.0)))).otherwise(1.0)
    saving = (F.col("word_len") - F.col("abbr_len")).cast("double")
    grouped = rows.groupBy("item").agg(ctx.weighted(saving, weight).alias("mean"), ctx.quadrature(F.col("word_len") / 10, F.col("abbr_len") / 10, weight).alias("std"))
    return grouped.select("item", F.round("mean", 8).alias("mean"), F.round("std", 8).alias("std"))


SQL_ITEMS = """
it AS (SELECT l_orderkey AS k, l_linenumber AS n, 'w' || (l_partkey % 400) AS text, 'a' || (l_suppkey % 40) AS abbr, l_returnflag AS form, CASE WHEN l_linenumber % 4 = 0 THEN 'suffix' ELSE 'singleword' END AS type,
  l_quantity::BIGINT AS frequency, l_discount::DOUBLE AS intuit, l_tax::DOUBLE * 100 AS mean, l_linenumber::DOUBLE / 2 AS std, (l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey * 100 + l_quantity::BIGINT AS ord FROM lineitem)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("w"), (c("l_partkey") % 400).cast("string")).alias("text"), F.concat(F.lit("a"), (c("l_suppkey") % 40).cast("string")).alias("abbr"), c("l_returnflag").alias("trigger_form"),
        F.when(c("l_linenumber") % 4 == 0, "suffix").otherwise("singleword").alias("type"), c("l_quantity").cast("long").alias("frequency"), c("l_discount").cast("double").alias("intuitiveness"),
        (c("l_tax").cast("double") * 100).alias("mean"), (c("l_linenumber").cast("double") / 2).alias("std"), ((c("l_orderkey") * 10 + c("l_linenumber")) * 100_000_000 + c("l_partkey") * 100 + c("l_quantity").cast("long")).alias("ord"),
    )


@query(f"""WITH {SQL_ITEMS} SELECT text, abbr, form AS trigger_form, sum(frequency)::BIGINT AS frequency, arg_min(mean, ord) AS mean, list(type ORDER BY ord) AS types, count(*) > 1 AS is_linked FROM it GROUP BY text, abbr, form""")
def link_identical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.linked(items(spark, sf_dir), "ord").select("text", "abbr", "trigger_form", "frequency", "mean", "types", "is_linked")


@query(f"""WITH {SQL_ITEMS}, b AS (SELECT *, 0.5::DOUBLE * (mean - 1.0::DOUBLE * std) + 0.5::DOUBLE * 10 * intuit AS blend FROM it), r AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY blend DESC, ord) AS rn FROM b)
SELECT text, ord, round(blend, 9) AS blend FROM r WHERE rn <= 3""")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sel.short_list(items(spark, sf_dir), "mean", "std", lambda_=0.5, sigma=1.0, k=3, ties=("ord",))
    return rows.select("text", "ord", F.round("blend", 9).alias("blend"))


@query(f"""WITH {SQL_ITEMS}, r AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY intuit DESC, ord) AS rn FROM it) SELECT text, ord FROM r WHERE rn <= 5 OR form IN ('R')""")
def topk_keep_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.keep_best(items(spark, sf_dir), "text", "intuitiveness", 5, ("R",), "ord").select("text", "ord")


@query(f"""WITH {SQL_ITEMS} SELECT ord FROM it WHERE NOT (type = 'suffix' AND length(text) > 3) AND intuit >= 0.03 AND mean - std > 0""")
def eligible_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sel.eligible(items(spark, sf_dir), longest_suffix=3)
    return rows.where((F.col("intuitiveness") >= 0.03) & (sel.effective(F.col("mean"), F.col("std"), 1.0) > 0)).select("ord")


@query(f"""WITH {SQL_ITEMS} SELECT round(avg(mean), 8) AS mean_mean, round(stddev_pop(mean), 8) AS std_mean, avg((mean > 0)::INT) AS positive_mean, round(avg(std), 8) AS mean_std, round(stddev_pop(std), 8) AS std_std, avg((std > 0)::INT) AS positive_std, round(corr(mean, std), 8) AS pearson FROM it""")
def savings_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.metrics import savings_summary as summary

    rows = summary(items(spark, sf_dir), "mean", "std")
    return rows.select(*(F.round(c, 8).alias(c) if c not in ("positive_mean", "positive_std") else F.col(c) for c in rows.columns))


@query(f"""WITH {SQL_ITEMS} SELECT ord, mean * 2 + intuit * 3 AS dl, greatest(mean * 2 + intuit * 3, std) >= 10 AS kept FROM it""")
def flat_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested candidates made flat again, keys saved counted in."""
    rows = items(spark, sf_dir)
    saving = lambda m: F.struct(m.alias("mean"), F.lit(0.0).alias("std"))
    each = F.struct(
        "abbr", "trigger_form", "intuitiveness", F.struct(saving(F.col("intuitiveness") * 3).alias("dl"), saving(F.col("std") - F.col("mean") * 2).alias("lgbm"), saving(F.col("mean")).alias("keystrokes")).alias("savings")
    )
    nested = rows.select(F.array(F.struct(F.col("ord").cast("string").alias("text"), "type", "frequency", F.array(each).alias("candidates"))).alias("items"))
    everything = sel.flattened(nested, alpha=2.0, threshold=-1e9)
    return everything.select(F.col("text").cast("long").alias("ord"), F.col("savings_z_dl").alias("dl"), (F.greatest("savings_z_dl", "savings_z_lgbm") >= 10).alias("kept"))


@query(f"""WITH {SQL_WORD_ZIPF}, {SQL_ENTRIES}, z AS (SELECT en.*, zipf FROM en JOIN wz ON text = word WHERE zipf > 0),
g AS (SELECT right(abbr, 1) || chr(1) AS gram, zipf FROM z WHERE form = 'trg' UNION ALL SELECT left(abbr, 1) || chr(2), zipf FROM z WHERE form = 'rpt_trg' UNION ALL SELECT chr(2) || chr(1), zipf FROM z WHERE form = 'rpt_trg')
SELECT gram, round(log10(sum(pow(10.0, zipf))), 9) AS zipf FROM g GROUP BY gram""")
def trigger_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ng.trigger_bigrams(entries(spark), word_zipf(spark, sf_dir)).select("gram", F.round("zipf", 9).alias("zipf"))


SQL_RPT = f"""{sql_chars("benchmark", "item_id")}, rp AS (SELECT item_id, pos, CASE WHEN k = lag(k) OVER (PARTITION BY item_id ORDER BY pos) THEN chr(2) ELSE k END AS k FROM chars)"""


@query(f"WITH {SQL_RPT} SELECT item_id, string_agg(k, '' ORDER BY pos) AS encoded FROM rp GROUP BY item_id")
def rpt_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bench(spark, sf_dir).where(F.length("text") > 0).select("item_id", tx.with_repeat_key(F.col("text")).alias("encoded"))


@query(f"WITH {SQL_RPT} SELECT item_id, pos, last_value(CASE WHEN k <> chr(2) THEN k END IGNORE NULLS) OVER (PARTITION BY item_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS real FROM rp")
def last_non_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bench(spark, sf_dir).select("item_id", tx.with_repeat_key(F.col("text")).alias("t"))
    return rw.resolved(characters(encoded, "t", "item_id"), "item_id").select("item_id", "pos", "real")


@query(f"""WITH {sql_gram_zipf(2)}, {SQL_RPT}, m AS (SELECT item_id, pos, k, last_value(CASE WHEN k <> chr(2) THEN k END IGNORE NULLS) OVER (PARTITION BY item_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS real FROM rp),
l AS (SELECT *, lag(k) OVER w AS p, lag(real) OVER w AS pr FROM m WINDOW w AS (PARTITION BY item_id ORDER BY pos))
SELECT item_id, pos, round(coalesce(CASE WHEN l.p || k = 'e' || chr(2) THEN 7.5 END, CASE WHEN l.p = chr(2) OR k = chr(2) THEN zipf END, -1.0), 9) AS bigram_frequency FROM l LEFT JOIN z2 ON pr || real = gram""")
def patched_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair frequencies of repeat keys: from a table of their own, else those of the doubled letters."""
    encoded = bench(spark, sf_dir).select("item_id", tx.with_repeat_key(F.col("text")).alias("t"))
    chars = characters(encoded, "t", "item_id").withColumn("bigram_frequency", F.lit(-1.0))
    plain = ng.zipf(ng.counted(ng.ngrams(table(spark, sf_dir, "documents"), "text", 2)))
    special = spark.createDataFrame([("e\x02", 7.5)], "gram string, zipf double")
    return rw.patched_pairs(chars, "item_id", special, plain).select("item_id", "pos", F.round("bigram_frequency", 9).alias("bigram_frequency"))


@query(f"""WITH {SQL_WORD_ZIPF}, {SQL_PLACES}, o AS (SELECT item_id, start, start + length(body) AS e, coalesce(zipf, 0.0) AS z FROM pl LEFT JOIN wz ON lower(body) = word WHERE length(body) > 3)
SELECT c.item_id, c.pos, round(coalesce(z, -1.0), 9) AS word_frequency FROM chars c LEFT JOIN o ON c.item_id = o.item_id AND c.pos >= start AND c.pos < e""")
def range_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bench(spark, sf_dir)
    spans = ctx.positions(rows, "text", "item_id").where(F.length("body") > 3)
    spans = spans.select("item_id", "start", (F.col("start") + F.length("body")).alias("end"), F.lower("body").alias("word"))
    chars = characters(rows, "text", "item_id").withColumn("word_frequency", F.lit(-1.0))
    return rw.overridden(chars, spans, word_zipf(spark, sf_dir), "item_id").select("item_id", "pos", F.round("word_frequency", 9).alias("word_frequency"))


SQL_REWRITE = f"""{SQL_TOK}, {SQL_ENTRIES},
ms AS (SELECT low, arg_max(text, length(text)) AS sfx FROM (SELECT DISTINCT low FROM tl) JOIN en ON type = 'suffix' AND suffix(low, text) AND length(low) > length(text) GROUP BY low),
mt AS (SELECT tl.*, w.text AS wtext, coalesce(w.text, s.text) AS mtext, coalesce(w.abbr, s.abbr) AS abbr, coalesce(w.form, s.form) AS form, CASE WHEN w.text IS NOT NULL THEN 'singleword' WHEN s.text IS NOT NULL THEN 'suffix' END AS kind
  FROM tl LEFT JOIN en w ON w.type <> 'suffix' AND w.text = low LEFT JOIN ms USING (low) LEFT JOIN en s ON s.text = sfx),
mk AS (SELECT *, CASE WHEN kind = 'singleword' AND body[1] <> lower(body[1]) THEN upper(abbr[1]) || substring(abbr, 2) ELSE abbr END AS ab FROM mt),
st AS (SELECT *, CASE form WHEN 'trg' THEN ab || chr(1) WHEN 'doubletap' THEN ab[1] || ab[1] WHEN 'rpt_trg' THEN ab[1] || chr(2) || chr(1) END AS ks FROM mk),
sv AS (SELECT *, pre || CASE kind WHEN 'singleword' THEN ks WHEN 'suffix' THEN left(body, length(body) - length(mtext)) || ks ELSE body END || post AS stream,
  CASE WHEN kind IS NULL AND "at" < max("at") OVER (PARTITION BY item_id) THEN ' ' ELSE '' END AS blank FROM st),
rw AS (SELECT item_id, string_agg(token, ' ' ORDER BY "at") AS normal, string_agg(stream || blank, '' ORDER BY "at") AS abbr, count(*) FILTER (kind = 'singleword') AS n_words, count(*) FILTER (kind = 'suffix') AS n_suffixes, count(*) AS n_tokens,
  list(mtext ORDER BY "at") FILTER (kind IS NOT NULL) AS keys FROM sv GROUP BY item_id)"""


def rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rw.rewritten(bench(spark, sf_dir), "text", "item_id", entries(spark), repeat_key=False)


@query(f"WITH {SQL_REWRITE} SELECT item_id, normal, abbr, n_words, n_suffixes, n_tokens FROM rw")
def rewrite_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewritten(spark, sf_dir).select("item_id", "normal", "abbr", "n_words", "n_suffixes", "n_tokens")


# A model that takes 0.1 z for each key, so that costs follow from lengths.
Z = 0.1


def valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda c: F.length(c)
    return rewritten(spark, sf_dir).select(
        "*", n("normal").alias("n_normal"), n("abbr").alias("n_abbr"), ((n("normal") - 1) * Z).alias("z_normal"), ((n("abbr") - 1) * Z).alias("z_abbr")
    )


SQL_VALUED = f"""{SQL_REWRITE}, va AS (SELECT *, greatest(0, length(normal) - 1) * 110.5::DOUBLE + (length(normal) - 1) * 0.1::DOUBLE * 50.4::DOUBLE AS t0, greatest(0, length(abbr) - 1) * 110.5::DOUBLE + (length(abbr) - 1) * 0.1::DOUBLE * 50.4::DOUBLE AS t1,
 (length(normal) - 1) * 0.1::DOUBLE - (length(abbr) - 1) * 0.1::DOUBLE AS dz FROM rw)"""


@query(f"""WITH {SQL_VALUED} SELECT round(sum(t0 - t1) / greatest(1.0, sum(t0)) * 100, 6) AS speedup_pct, round(sum(t0 - t1), 4) AS ms_saved, round(avg(t0 - t1), 6) AS mean_ms, round(stddev_pop(t0 - t1), 6) AS std_ms, round(avg(dz), 8) AS z_mean,
round(sum(n_words + n_suffixes) * 100 / greatest(1, sum(n_tokens)), 8) AS coverage_pct, count(*) AS n_texts, sum(n_words)::BIGINT AS n_words, sum(n_suffixes)::BIGINT AS n_suffixes FROM va""")
def rewrite_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rw.summary(valued(spark, sf_dir))
    digits = {"speedup_pct": 6, "ms_saved": 4, "mean_ms": 6, "std_ms": 6, "z_mean": 8, "coverage_pct": 8}
    return rows.select(*(F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in rows.columns))


@query(f"""WITH {SQL_VALUED}, x AS (SELECT unnest(keys) AS text, (t0 - t1) / len(keys) AS s, t0 / len(keys) AS t FROM va WHERE len(keys) > 0)
SELECT text, count(*) AS uses, round(avg(s), 6) AS mean_ms, round(stddev_pop(s), 6) AS std_ms, round(sum(s), 4) AS total_ms, round(CASE WHEN avg(t) > 0 THEN avg(s) / avg(t) * 100 ELSE 0.0 END, 8) AS speedup_pct FROM x GROUP BY text""")
def entry_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = lambda n, z: milliseconds(F.col(n), F.col(z), 110.5, 50.4)
    rows = valued(spark, sf_dir).withColumn("t0", ms("n_normal", "z_normal")).withColumn("ms", F.col("t0") - ms("n_abbr", "z_abbr"))
    out = rw.by_entry(rows, "keys", "ms", "t0")
    return out.select("text", "uses", F.round("mean_ms", 6).alias("mean_ms"), F.round("std_ms", 6).alias("std_ms"), F.round("total_ms", 4).alias("total_ms"), F.round("speedup_pct", 8).alias("speedup_pct"))


@query(f"""WITH {SQL_VALUED} SELECT round(avg(CASE WHEN n_words > 0 THEN (t0 - t1) / (n_words + n_suffixes) END), 6) AS singleword_ms, round(avg(CASE WHEN n_suffixes > 0 THEN (t0 - t1) / (n_words + n_suffixes) END), 6) AS suffix_ms FROM va""")
def savings_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = lambda n, z: milliseconds(F.col(n), F.col(z), 110.5, 50.4)
    rows = valued(spark, sf_dir).withColumn("ms", ms("n_normal", "z_normal") - ms("n_abbr", "z_abbr")).where("n_words + n_suffixes > 0")
    return rw.by_kind(rows, "ms").select(F.round("singleword_ms", 6).alias("singleword_ms"), F.round("suffix_ms", 6).alias("suffix_ms"))


@query(f"""WITH {SQL_VALUED}, x AS (SELECT unnest(keys) AS text FROM va), c AS (SELECT text, count(*) AS uses FROM x GROUP BY text) SELECT c.text, uses, en.abbr, en.form AS trigger_form FROM c LEFT JOIN en ON en.text = c.text""")
def entry_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = rewritten(spark, sf_dir).select(F.explode("keys").alias("text")).groupBy("text").agg(F.count("*").alias("uses"))
    return rw.with_entries(uses, entries(spark))


SQL_COST = f"""{sql_chars("benchmark", "item_id")}, pc AS (SELECT item_id, pos, ((key_id % 7) - 3)::DOUBLE / 10 AS m, ((key_id % 5) + 1)::DOUBLE / 10 AS s FROM chars)"""


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = characters(bench(spark, sf_dir), "text", "item_id")
    return chars.withColumn("m", (F.col("key_id") % 7 - 3).cast("double") / 10).withColumn("s", (F.col("key_id") % 5 + 1).cast("double") / 10)


@query(f"""WITH {SQL_COST}, c AS (SELECT item_id, sum(m) AS cost, sqrt(sum(s * s)) AS std FROM pc WHERE pos >= 1 GROUP BY item_id)
SELECT item_id, round(coalesce(cost, 0.0), 8) AS cost, round(coalesce(std, 0.0), 8) AS std, round(coalesce(cost, 0.0) / greatest(length(text) - 1, 1), 8) AS mean_z, round(coalesce(std, 0.0) / sqrt(greatest(length(text) - 1, 1)), 8) AS std_z FROM benchmark LEFT JOIN c USING (item_id)""")
def cost_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = bench(spark, sf_dir).withColumn("n", F.length("text"))
    rows = per_key(costs(predicted(spark, sf_dir), texts, "item_id", "m", "s").join(texts.select("item_id", "n"), "item_id"), "n")
    return rows.select("item_id", *(F.round(c, 8).alias(c) for c in ("cost", "std", "mean_z", "std_z")))


@query(f"""WITH {SQL_COST}, c AS (SELECT item_id, sum(m) AS cost, sqrt(sum(s * s)) AS std FROM pc WHERE pos >= 4 AND pos < 12 GROUP BY item_id)
SELECT item_id, round(coalesce(cost, 0.0), 8) AS cost, round(coalesce(std, 0.0), 8) AS std FROM benchmark LEFT JOIN c USING (item_id)""")
def cost_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = costs(predicted(spark, sf_dir), bench(spark, sf_dir), "item_id", "m", "s", first=4, last=F.lit(12))
    return rows.select("item_id", F.round("cost", 8).alias("cost"), F.round("std", 8).alias("std"))


SQL_ONE = f"""{sql_chars("benchmark", "item_id")}, cp AS (SELECT item_id, pos, k, k BETWEEN 'A' AND 'Z' AND length(k) = 1 AND ascii(k) < 128 AND NOT coalesce(lag(k) OVER w BETWEEN 'A' AND 'Z', false) AND NOT coalesce(lead(k) OVER w BETWEEN 'A' AND 'Z', false) AS one
  FROM chars WINDOW w AS (PARTITION BY item_id ORDER BY pos)),
os AS (SELECT item_id, string_agg(CASE WHEN one THEN chr(2) || lower(k) ELSE k END, '' ORDER BY pos) AS oss_text, count(*) FILTER (one) AS n_oss FROM cp GROUP BY item_id)"""


@query(f"WITH {SQL_ONE} SELECT item_id, oss_text, n_oss, starts_with(oss_text, chr(2)) AS starts_oss FROM os")
def oneshot_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oneshot.transformed(bench(spark, sf_dir).where(F.length("text") > 0), "text").select("item_id", "oss_text", "n_oss", "starts_oss")


@query(f"""WITH {SQL_ONE}, cl AS (SELECT item_id AS id, trim(regexp_replace(oss_text, '[ \\t\\n\\v\\f\\r]+', ' ', 'g'), ' ') AS t FROM os),
cc AS (SELECT id, unnest(range(length(t))) AS pos, unnest(string_split(t, '')) AS k FROM cl WHERE length(t) > 0),
gr AS (SELECT k || lead(k) OVER (PARTITION BY id ORDER BY pos) AS gram FROM cc), gc AS (SELECT gram, count(*) AS n FROM gr WHERE gram IS NOT NULL GROUP BY gram HAVING count(*) >= 5)
SELECT gram, n, round(greatest(0.0, least(10.0, log10(n / (SELECT sum(n) FROM gc)) + 9)), 9) AS zipf FROM gc""")
def oneshot_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the transformed texts."""
    pairs = oneshot.frequencies(bench(spark, sf_dir), "text")[1]
    return pairs.select("gram", "n", F.round("zipf", 9).alias("zipf"))


SQL_ONE_REPORT = f"""{SQL_ONE}, rp AS (SELECT greatest(0, length(text) - 1) * {{m}}::DOUBLE + (length(text) - 1) * 0.1::DOUBLE * 52.4::DOUBLE AS b, greatest(0, length(oss_text) - starts_with(oss_text, chr(2))::INT - 1) * {{m}}::DOUBLE + (length(oss_text) - 1) * 0.1::DOUBLE * 52.4::DOUBLE AS o, n_oss FROM os JOIN benchmark USING (item_id))"""


@query(
    f"""WITH {SQL_ONE_REPORT.format(m=110.66)}, md AS (SELECT greatest(0, length(text) - 1) * 100.0::DOUBLE + (length(text) - 1) * 0.1::DOUBLE * 52.4::DOUBLE AS b, greatest(0, length(oss_text) - starts_with(oss_text, chr(2))::INT - 1) * 100.0::DOUBLE + (length(oss_text) - 1) * 0.1::DOUBLE * 52.4::DOUBLE AS o FROM os JOIN benchmark USING (item_id))
SELECT round(sum(b - o) / sum(b) * 100, 8) AS speedup_mean, (SELECT round(sum(b - o) / sum(b) * 100, 8) FROM md) AS speedup_median, round(sum(b - (o - n_oss * 110.66::DOUBLE)) / sum(b) * 100, 8) AS speedup_motion, round(sum(o - b) / nullif(sum(n_oss), 0), 6) AS ms_a_capital, sum(n_oss)::BIGINT AS n_capitals FROM rp"""
)
def oneshot_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = oneshot.transformed(bench(spark, sf_dir).where(F.length("text") > 0), "text")
    rows = rows.withColumn("z_base", (F.length("text") - 1) * Z).withColumn("z_oss", (F.length("oss_text") - 1) * Z)
    out = oneshot.totals(rows)
    return out.select(*(F.round(c, 6 if c == "ms_a_capital" else 8).alias(c) if c != "n_capitals" else F.col(c) for c in out.columns))


@query("SELECT a.p_partkey, levenshtein(a.p_name, b.p_name) AS distance FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_pairs(spark, sf_dir).select("p_partkey", F.levenshtein("p_name", "other").alias("distance"))


def part_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return parts.join(parts.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other")), "p_partkey")


@query("SELECT a.p_partkey, true AS as_few, b.p_name AS typed FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def edit_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each edit script has no more errors than without transpositions, and what was typed, made again from the script."""
    script = part_pairs(spark, sf_dir).select("p_partkey", "p_name", "other", edits.edit_ops("p_name", "other").alias("ops"))
    letter = lambda column, place: F.substring(column, place + 1, F.lit(1))
    typed = F.transform("ops", lambda o: F.when(o["op"] == "M", letter(F.col("p_name"), o["i"])).when(o["op"] == "D", "").when(o["op"] == "T", F.substring(F.col("other"), o["j"] + 1, F.lit(2))).otherwise(letter(F.col("other"), o["j"])))
    return script.select("p_partkey", (F.size(F.filter("ops", lambda o: o["op"] != "M")) <= F.levenshtein("p_name", "other")).alias("as_few"), F.array_join(typed, "").alias("typed"))


_S = "lower(p_name)"
for _a, _b in phonetic.SOUNDS:
    _S = f"replace({_S}, '{_a}', '{_b}')"


@query(f"SELECT p_partkey, {_S} AS heard, lower(regexp_replace(p_name, '[^a-zA-Z]', '', 'g')) AS core FROM part")
def phonetic_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", phonetic.sound_column(F.col("p_name")).alias("heard"), tx.core_word(F.col("p_name")).alias("core"))


#: Words and suffixes that a dictionary may shorten, candidates tried for each, and those kept; entries of a dictionary and candidates of a text that compete for it.
WORDS, SUFFIXES, TRIED, KEPT, SIZE, PER_TEXT = 4_000, 500, 1_000, 80, 160, 12


def vocabulary(spark: SparkSession, sf_dir: str, words: int = WORDS, suffixes: int = SUFFIXES) -> DataFrame:
    counts = ng.word_counts(table(spark, sf_dir, "documents"), "text")
    one = ng.top(counts, "word", words).select(F.col("word").alias("text"), F.lit("singleword").alias("type"), F.col("n").alias("frequency"))
    two = ng.suffixes(counts, top_k=suffixes, exclude=ng.top(counts, "word", words)).select(F.col("suffix").alias("text"), F.lit("suffix").alias("type"), F.col("n").alias("frequency"))
    return one.unionByName(two)


def scored(items: DataFrame, tried: int = TRIED, kept: int = KEPT) -> DataFrame:
    """The best candidates of each item with their intuitiveness."""
    made = cand.with_triggers(cand.generated(items, n=tried), repeat_key=True)
    return sel.keep_best(made.withColumn("intuitiveness", F.round(phonetic.intuitiveness_udf("text", "abbr"), 4)), "text", "intuitiveness", kept, ("doubletap", "rpt_trg"), "abbr", "trigger_form")


def with_savings(rows: DataFrame) -> DataFrame:
    """Keys saved stand for the savings that models would predict."""
    saved = (F.length("text") + 1 - F.length(tx.key_stream(F.col("abbr"), F.col("trigger_form"), True))).cast("double")
    return rows.withColumn("savings_z_lgbm", saved).withColumn("savings_z_lgbm_std", F.lit(0.1)).withColumn("savings_z_mean", saved)


def stored_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates of the corpus' vocabulary, written once, as searches read them several times."""
    path = f"{session.shared_folder(spark)}/candidates-{uuid.uuid4().hex}"
    rows = scored(vocabulary(spark, sf_dir))
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


@query()
def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(vocabulary(spark, sf_dir))


@query()
def optimize_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary from the corpus: candidates, keys saved as savings, selection under its constraints."""
    rows = with_savings(stored_candidates(spark, sf_dir))
    return sel.optimise(rows, size=SIZE, per_text=PER_TEXT).select("text", "abbr", "trigger_form", "type", "frequency", "intuitiveness", "savings_z_eff")


@query()
def lambda_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.sweep(with_savings(stored_candidates(spark, sf_dir)), [0.0, 0.5, 1.0], size=SIZE, per_text=PER_TEXT)


@query("""WITH d AS (SELECT DISTINCT unnest(string_split(lower(regexp_replace(p_name, '[^a-zA-Z]', '', 'g')), '')) AS c, lower(regexp_replace(p_name, '[^a-zA-Z]', '', 'g')) AS w FROM part),
x AS (SELECT w, c || c AS abbr FROM d WHERE c <> '' UNION SELECT w, left(w, 2) FROM d WHERE w <> '') SELECT w AS word, abbr FROM x WHERE abbr <> w""")
def distinct_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two candidate generators united, the words themselves taken out."""
    words = table(spark, sf_dir, "part").select(tx.core_word(F.col("p_name")).alias("word")).where("word <> ''").distinct()
    doubled = words.select("word", F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").select("word", F.concat("c", "c").alias("abbr"))
    heads = words.select("word", F.left("word", F.lit(2)).alias("abbr"))
    return doubled.unionByName(heads).distinct().where("abbr <> word")


@query("SELECT item_id, unnest(range(-8, length(text))) AS pos FROM benchmark")
def union_pads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences with eight pads in front."""
    rows = bench(spark, sf_dir)
    pads = rows.select("item_id", F.explode(F.sequence(F.lit(-8), F.lit(-1))).alias("pos"))
    return pads.unionByName(characters(rows, "text", "item_id").select("item_id", "pos"))
