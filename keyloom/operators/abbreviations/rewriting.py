"""Rewriting texts with a dictionary, and what that is worth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ...functions.text import REPEAT, key_stream, like_capital, split_punctuation, with_repeat_key


def tokenised(df: DataFrame, text: str, key: str) -> DataFrame:
    """(key, at, token, pre, body, post, low) for each token between white space."""
    tokens = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    rows = df.select(key, F.posexplode(tokens).alias("at", "token"))
    pre, body, post = split_punctuation(F.col("token"))
    return rows.select(key, "at", "token", pre.alias("pre"), body.alias("body"), post.alias("post"), F.lower(body).alias("low"))


def whole_matches(tokens: DataFrame, entries: DataFrame) -> DataFrame:
    """Tokens with their entry where the whole word has one, in column ``entry``."""
    known = entries.where("type != 'suffix'").select(F.lower("text").alias("low"), F.struct(F.lower("text").alias("text"), "abbr", "trigger_form").alias("entry"))
    return tokens.join(known, "low", "left")


def suffix_matches(tokens: DataFrame, entries: DataFrame, longest: int, key: str) -> DataFrame:
    """Tokens with the entry of their longest proper ending that has one, in ``ending``; endings meet by equality."""
    known = entries.where("type = 'suffix'").select(F.lower("text").alias("end"), F.struct(F.length("text").alias("n"), F.lower("text").alias("text"), "abbr", "trigger_form").alias("e"))
    lengths = F.sequence(F.lit(1), F.least(F.lit(longest), F.length("low") - 1))
    ends = tokens.select("low").where(F.length("low") > 1).distinct().select("low", F.explode(lengths).alias("k")).withColumn("end", F.right("low", F.col("k")))
    best = ends.join(known, "end").groupBy("low").agg(F.max_by("e", "e.n").alias("ending"))
    return tokens.join(best, "low", "left")


def rewritten(df: DataFrame, text: str, key: str, entries: DataFrame, *, repeat_key: bool = True, longest: int = 12) -> DataFrame:
    """(key, normal, abbr, overrides, keys, n_words, n_suffixes, n_tokens): a text's key streams without and with the dictionary.

    Tokens are joined by blanks; no blank follows an abbreviation, the trigger makes it. ``overrides`` are stretches of the
    abbreviated stream with the word whose frequency holds there.
    """
    found = suffix_matches(whole_matches(tokenised(df, text, key), entries), entries, longest, key)
    kind = F.when(F.col("entry").isNotNull(), "singleword").when(F.col("ending").isNotNull(), "suffix")
    entry = F.when(F.col("entry").isNotNull(), F.col("entry")).otherwise(F.col("ending").dropFields("n"))
    found = found.withColumn("kind", kind).withColumn("used", entry)
    body = F.col("body")
    keyed = with_repeat_key if repeat_key else (lambda c: c)
    capital = F.struct(F.col("used.trigger_form").alias("f"), like_capital(body, F.col("used.abbr")).alias("a"))
    whole = key_stream(capital["a"], capital["f"], repeat_key)
    stem = F.left(body, F.length(body) - F.length("used.text"))
    ending = F.concat(keyed(stem), key_stream(F.col("used.abbr"), F.col("used.trigger_form"), repeat_key))
    stream = F.when(F.col("kind") == "singleword", whole).when(F.col("kind") == "suffix", ending).otherwise(keyed(body))
    order = Window.partitionBy(key).orderBy("at")
    more = F.lead("at").over(order).isNotNull()
    rows = found.withColumn("stream", F.concat("pre", stream, "post")).withColumn("blank", F.when(more & F.col("kind").isNull(), " ").otherwise(""))
    rows = rows.withColumn("end", F.sum(F.length("stream") + F.length("blank")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.length("blank"))
    start = F.col("end") - F.length("stream")
    inner = F.col("kind").isNull()
    override = F.struct(
        F.when(inner, start + F.length("pre")).otherwise(start).cast("int").alias("start"), F.when(inner, F.col("end") - F.length("post")).otherwise(F.col("end")).cast("int").alias("end"), F.col("low").alias("word")
    )
    rows = rows.withColumn("override", F.when(F.col("low") != "", override))
    piece = F.array_sort(F.collect_list(F.struct("at", "token", "stream", "blank", "override", "kind", F.col("used.text").alias("match"))))
    out = rows.groupBy(key).agg(piece.alias("p"))
    present = lambda c: F.filter(F.transform("p", lambda x: x[c]), lambda v: v.isNotNull())
    count = lambda k: F.size(F.filter("p", lambda x: x["kind"] == k))
    return out.select(
        key,
        F.array_join(F.transform("p", lambda x: x["token"]), " ").alias("normal"),
        F.array_join(F.transform("p", lambda x: F.concat(x["stream"], x["blank"])), "").alias("abbr"),
        present("override").alias("overrides"),
        present("match").alias("keys"),
        count("singleword").alias("n_words"),
        count("suffix").alias("n_suffixes"),
        F.size("p").alias("n_tokens"),
    )


def overridden(chars: DataFrame, stretches: DataFrame, words: DataFrame, key: str, value: str = "word_frequency") -> DataFrame:
    """``value`` replaced by the frequency of its word in each of ``stretches(key, start, end, word)``; ends are exclusive.

    Stretches are taken apart into places, so they meet the characters by equality.
    """
    valued = stretches.join(words.select("word", "zipf"), "word", "left").select(key, "start", "end", F.coalesce("zipf", F.lit(0.0)).alias("__z"))
    places = valued.where(F.col("end") > F.col("start")).select(key, "__z", F.explode(F.sequence("start", F.col("end") - 1)).alias("pos")).groupBy(key, "pos").agg(F.max("__z").alias("__z"))
    return chars.join(places, [key, "pos"], "left").withColumn(value, F.coalesce("__z", F.col(value))).drop("__z")


def resolved(chars: DataFrame, key: str, marker: str = REPEAT) -> DataFrame:
    """real: the last character that is not the marker, up to here."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return chars.withColumn("real", F.last(F.when(F.col("key") != marker, F.col("key")), ignorenulls=True).over(w))


def patched_pairs(chars: DataFrame, key: str, special: DataFrame, plain: DataFrame, trigger: str = "\x01", marker: str = REPEAT, value: str = "bigram_frequency") -> DataFrame:
    """``value`` of pairs with a trigger or repeat key: from ``special(gram, zipf)``, else that of the characters a repeat key stands for."""
    w = Window.partitionBy(key).orderBy("pos")
    rows = resolved(chars, key, marker).select("*", F.lag("key").over(w).alias("__p"), F.lag("real").over(w).alias("__pr"))
    odd = F.col("__p").isin(trigger, marker) | F.col("key").isin(trigger, marker)
    rows = rows.withColumn("__g", F.when(odd, F.concat("__p", "key"))).withColumn("__h", F.when((F.col("__p") == marker) | (F.col("key") == marker), F.concat("__pr", "real")))
    one = special.select(F.col("gram").alias("__g"), F.col("zipf").alias("__a"))
    two = plain.select(F.col("gram").alias("__h"), F.col("zipf").alias("__b"))
    joined = rows.join(one, "__g", "left").join(two, "__h", "left")
    return joined.withColumn(value, F.coalesce("__a", "__b", value)).drop("__p", "__pr", "__g", "__h", "__a", "__b", "real")


def summary(df: DataFrame, mean_ms: float = 110.5, std_ms: float = 50.4) -> DataFrame:
    """Totals over rows (n_normal, n_abbr, z_normal, z_abbr, n_words, n_suffixes, n_tokens)."""
    time = lambda n, z: F.greatest(F.lit(0), F.col(n) - 1) * mean_ms + F.col(z) * std_ms
    rows = df.withColumn("t0", time("n_normal", "z_normal")).withColumn("t1", time("n_abbr", "z_abbr")).withColumn("ms", F.col("t0") - F.col("t1"))
    covered = F.sum(F.col("n_words") + F.col("n_suffixes"))
    return rows.agg(
        (F.sum("ms") / F.greatest(F.lit(1.0), F.sum("t0")) * 100).alias("speedup_pct"),
        F.sum("ms").alias("ms_saved"),
        F.avg("ms").alias("mean_ms"),
        F.stddev_pop("ms").alias("std_ms"),
        F.avg(F.col("z_normal") - F.col("z_abbr")).alias("z_mean"),
        (covered * 100 / F.greatest(F.lit(1), F.sum("n_tokens"))).alias("coverage_pct"),
        F.count("*").alias("n_texts"),
        F.sum("n_words").alias("n_words"),
        F.sum("n_suffixes").alias("n_suffixes"),
    )


def by_entry(df: DataFrame, keys: str, ms: str, normal_ms: str) -> DataFrame:
    """(text, uses, mean_ms, std_ms, speedup_pct, total_ms): a text's saving is shared evenly by its matches."""
    share = lambda c: F.col(c) / F.size(keys)
    rows = df.where(F.size(keys) > 0).select(F.explode(keys).alias("text"), share(ms).alias("s"), share(normal_ms).alias("t"))
    stats = rows.groupBy("text").agg(F.count("*").alias("uses"), F.avg("s").alias("mean_ms"), F.stddev_pop("s").alias("std_ms"), F.avg("t").alias("__t"), F.sum("s").alias("total_ms"))
    return stats.withColumn("speedup_pct", F.when(F.col("__t") > 0, F.col("mean_ms") / F.col("__t") * 100).otherwise(0.0)).drop("__t")


def by_kind(df: DataFrame, ms: str) -> DataFrame:
    """(singleword_ms, suffix_ms): mean saving a match over the texts that have matches of a kind; matches of a text share alike."""
    each = F.col(ms) / (F.col("n_words") + F.col("n_suffixes"))
    return df.agg(F.avg(F.when(F.col("n_words") > 0, each)).alias("singleword_ms"), F.avg(F.when(F.col("n_suffixes") > 0, each)).alias("suffix_ms"))


def with_entries(stats: DataFrame, entries: DataFrame) -> DataFrame:
    """Per-entry figures with the entry's abbreviation and form; figures of unknown entries stay."""
    return stats.join(entries.select(F.lower("text").alias("text"), "abbr", "trigger_form"), "text", "left")
