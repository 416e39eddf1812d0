"""Corpora: sentences, cleaning, n-grams, words, suffixes, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import ngrams as ng
from ..operators import sampling
from ..sources import tables as src
from ..sources.tables import corpus, table
from .base import query
from .keys import sql_gram_zipf, sql_grams

SQL_PIECES = "SELECT doc_id, source, unnest(regexp_split_to_array({text}, '[.\\n!?]+')) AS s, generate_subscripts(regexp_split_to_array({text}, '[.\\n!?]+'), 1) - 1 AS idx FROM documents"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(f"""WITH p AS ({SQL_PIECES.format(text="text")}) SELECT doc_id, idx, trim(s, ' ') AS sentence FROM p WHERE length(trim(s, ' ')) BETWEEN 2 AND 70""")
def corpus_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.sentences(docs(spark, sf_dir), "text", "doc_id")


_REPEATS = "|".join(f"{c}{{4}}" if c.isalnum() else f"[{c}]{{4}}" for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 ,'").replace("'", "''")
SQL_CLEAN = f"""
p AS ({SQL_PIECES.format(text="regexp_replace(text, 'http[^ \\t\\n\\v\\f\\r]+|www[^ \\t\\n\\v\\f\\r]+', '', 'g')")}),
o AS (SELECT doc_id, source, idx, trim(regexp_replace(s, '[ \\t\\n\\v\\f\\r]+', ' ', 'g'), ' ') AS sentence FROM p WHERE NOT regexp_matches(s, '[^a-zA-Z0-9 ,.!?'']') AND NOT regexp_matches(s, '{_REPEATS}')),
tk AS (SELECT *, list_filter(string_split(lower(sentence), ' '), lambda t: t <> '') AS tok FROM o WHERE length(sentence) BETWEEN 3 AND 70),
cl AS (SELECT * FROM tk WHERE len(tok) >= 2 AND NOT list_contains(tok, 'unk') AND NOT list_contains(tok, '<unk>')
  AND len(list_filter(tok, lambda t: regexp_matches(t, '[a-z]'))) >= 2 AND len(list_filter(tok, lambda t: regexp_matches(t, '[a-z]'))) * 2 >= len(tok))"""


@query(f"WITH {SQL_CLEAN} SELECT doc_id, idx, sentence FROM cl")
def corpus_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.clean_sentences(corpus(spark, sf_dir, "doc_id", "text"), "text", "doc_id")


@query("SELECT doc_id, " + " OR ".join(f"contains(lower(text), '{s}')" for s in tx.SPAM) + " AS is_spam FROM documents")
def spam_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", tx.is_spam(F.col("text")).alias("is_spam"))


@query("SELECT doc_id FROM documents WHERE NOT (starts_with(trim(text, ' '), '=') AND ends_with(trim(text, ' '), '=')) AND source = 'src1'")
def header_and_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir)
    return src.preferred_source(rows.where(~tx.is_header(F.col("text"))), "source", "src1").select("doc_id")


@query(f"""WITH {SQL_CLEAN}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, idx) AS rn FROM cl)
SELECT source, doc_id, idx, sentence FROM r WHERE rn <= 20""")
def sentences_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = tx.clean_sentences(docs(spark, sf_dir), "text", "source", "doc_id")
    return sampling.first_rows(clean, "source", 20, "doc_id", "idx").drop("rn")


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def recent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cut-off by time; the bound is a literal, so it reaches the scan."""
    events = table(spark, sf_dir, "events")
    last = events.agg(F.max("ts")).first()[0]
    bound = F.lit(last).cast("timestamp_ntz") - F.expr("INTERVAL 7 DAYS")
    return events.where(F.col("ts") >= bound).select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))


def _counts(n: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ng.counted(ng.ngrams(corpus(spark, sf_dir, "text"), "text", n)).where(f"n >= {ng.MIN_COUNT}")

    return run


for _n in (1, 2, 3):
    query(
        f"SELECT gram, count(*) AS n FROM ({sql_grams(_n)}) GROUP BY 1 HAVING count(*) >= 5",
        f"ngram_counts_{_n}",
    )(_counts(_n))


@query(f"WITH {sql_gram_zipf(2)} SELECT gram, n, round(p, 12) AS p, round(zipf, 9) AS zipf FROM z2")
def ngram_zipf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ng.zipf(ng.counted(ng.ngrams(corpus(spark, sf_dir, "text"), "text", 2)))
    return rows.select("gram", "n", F.round("p", 12).alias("p"), F.round("zipf", 9).alias("zipf"))


@query("""WITH c AS (SELECT item_id, trim(regexp_replace(text, '[ \\t\\n\\v\\f\\r]+', ' ', 'g'), ' ') AS t FROM benchmark),
o AS (SELECT string_agg(t, ' ' ORDER BY item_id) AS t FROM c WHERE length(t) > 0)
SELECT substring(t, i, 2) AS gram, count(*) AS n FROM o, unnest(generate_series(1, length(t) - 1)) AS s(i) GROUP BY 1""")
def ngrams_across_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one text made of all: those inside the texts and those that cross from one to the next."""
    rows = table(spark, sf_dir, "benchmark")
    inner = ng.ngrams(rows, "text", 2, collapse=True)
    return ng.counted(inner.unionByName(ng.crossing(rows, "text", 2, "item_id")))


SQL_WORDS = "SELECT unnest(regexp_extract_all(lower(text), '[a-z]+(?:''[a-z]+)*')) AS word FROM documents"


@query(f"SELECT word, count(*) AS n FROM ({SQL_WORDS}) GROUP BY word ORDER BY n DESC, word LIMIT 400")
def word_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ng.top(ng.word_counts(corpus(spark, sf_dir, "text"), "text"), "word", 400)


SQL_SUFFIXES = f"""
w AS (SELECT word, count(*) AS n FROM ({SQL_WORDS}) GROUP BY word),
sx AS (SELECT right(word, l) AS suffix, sum(n)::BIGINT AS n, count(*) AS n_words FROM w, unnest(generate_series(2, least(6, length(word)))) AS t(l) WHERE length(word) >= 2 GROUP BY 1)"""


@query(f"WITH {SQL_SUFFIXES} SELECT * FROM sx WHERE n_words >= 50 ORDER BY n DESC, suffix LIMIT 500")
def suffix_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ng.suffixes(ng.word_counts(corpus(spark, sf_dir, "text"), "text"))


@query(f"""WITH {SQL_SUFFIXES}, tw AS (SELECT word FROM w ORDER BY n DESC, word LIMIT 400)
SELECT * FROM sx WHERE n_words >= 50 AND suffix NOT IN (SELECT word FROM tw) ORDER BY n DESC, suffix LIMIT 500""")
def suffix_minus_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = ng.word_counts(corpus(spark, sf_dir, "text"), "text")
    return ng.suffixes(words, exclude=ng.top(words, "word", 400))


@query("""WITH d AS (SELECT doc_id, ('0x' || substring(md5('42:' || doc_id), 1, 8))::BIGINT AS d FROM documents) SELECT doc_id FROM d ORDER BY d, doc_id LIMIT 100""")
def sample_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.take(docs(spark, sf_dir).select("doc_id"), 100, 42, "doc_id")


@query("""WITH s AS (SELECT source, sum(n_chars)::BIGINT AS size FROM documents GROUP BY source),
c AS (SELECT *, -ln((('0x' || substring(md5('42:' || source), 1, 8))::BIGINT + 1)::DOUBLE / 4294967297.0) / greatest(size, 1) AS cost FROM s)
SELECT source, size, row_number() OVER (ORDER BY cost, source) AS rank FROM c""")
def weighted_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources in the order of a draw by size without replacement."""
    sizes = docs(spark, sf_dir).groupBy("source").agg(F.sum("n_chars").alias("size"))
    return sampling.weighted_order(sizes, "size", 42, "source").select("source", "size", "rank")


_T = "chr(1)"
_R = "chr(2)"


@query(f"""WITH {sql_gram_zipf(1)}, {sql_gram_zipf(2)},
m AS (SELECT avg(zipf) AS m FROM z2), d AS (SELECT log10(sum(pow(10.0, zipf))) AS r FROM z2 WHERE substring(gram, 1, 1) = substring(gram, 2, 1)),
l AS (SELECT gram, greatest(0.0, zipf - 1) AS zipf FROM z1 WHERE regexp_matches(gram, '^[a-z]$')),
u AS (SELECT gram, zipf, 1 AS size FROM z1 UNION ALL SELECT {_T}, m, 1 FROM m UNION ALL SELECT {_R}, r, 1 FROM d
 UNION ALL SELECT gram, zipf, 2 FROM z2 UNION ALL SELECT gram || k, zipf, 2 FROM l, (VALUES ({_T}), ({_R})) AS v(k) UNION ALL SELECT k || gram, zipf, 2 FROM l, (VALUES ({_T}), ({_R})) AS v(k)
 UNION ALL SELECT a || b, m, 2 FROM m, (VALUES ({_T}), ({_R})) AS v(a), (VALUES ({_T}), ({_R})) AS w(b))
SELECT gram, size, round(zipf, 9) AS zipf FROM u""")
def augmented_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = ng.augmented(*(ng.zipf(ng.counted(ng.ngrams(corpus(spark, sf_dir, "text"), "text", n))) for n in (1, 2)))
    both = one.withColumn("size", F.lit(1)).unionByName(two.withColumn("size", F.lit(2)))
    return both.select("gram", "size", F.round("zipf", 9).alias("zipf"))
