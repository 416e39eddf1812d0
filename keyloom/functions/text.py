"""Text expressions: tokens, sentences, corpus cleaning, key streams. All are built of Spark functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTENCE_END = r"[.\n!?]+"
TOKEN = r"[a-z]+(?:'[a-z]+)*"
WORD = "[a-zA-Z']+"
URL = r"http\S+|www\S+"
# What gives away automatic and advertising texts, looked for in lower case.
SPAM = (
    "i am a bot", "performed automatically", "this action was performed", "contact the moderators", "beep boop", "bleep bloop", "^^^", "chat with",
    "meet a girl", "recommended subreddits", "click here", "18free", "free now", "onlyfans", "subscribe to", "dm me", "promo code",
)
# The characters that a sentence may have, as a pattern of one that it may not.
FORBIDDEN = r"[^a-zA-Z0-9 ,.!?']"
SHORTEST, LONGEST = 3, 70
TRIGGER, REPEAT = "\x01", "\x02"


def is_spam(text: Column) -> Column:
    """Whether a text has one of SPAM; null is spam."""
    low, found = F.lower(text), F.lit(False)
    for s in SPAM:
        found = found | F.contains(low, F.lit(s))
    return F.coalesce(found, F.lit(True))


def is_sentence(text: Column) -> Column:
    """At least two tokens, none the rare-word mark, at least two and half of them with a letter."""
    tokens = F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")
    alpha = F.size(F.filter(tokens, lambda t: t.rlike(r"\p{L}")))
    marked = F.arrays_overlap(tokens, F.array(F.lit("unk"), F.lit("<unk>")))
    return (F.size(tokens) >= 2) & ~marked & (alpha >= 2) & (alpha * 2 >= F.size(tokens))


def sentences(df: DataFrame, text: str, *keep: str, low: int = 2, high: int = 70) -> DataFrame:
    """(keep..., idx, sentence): trimmed sentences whose length is in the band."""
    pieces = df.select(*keep, F.posexplode(F.split(text, SENTENCE_END)).alias("idx", "__s"))
    return pieces.withColumn("sentence", F.trim("__s")).drop("__s").where(F.length("sentence").between(low, high))


def clean_sentences(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """(keep..., idx, sentence) of a corpus: URLs go first, then pieces with other characters, fourfold characters, odd lengths or too few words."""
    pieces = df.where(F.col(text).isNotNull()).select(*keep, F.posexplode(F.split(F.regexp_replace(text, URL, ""), SENTENCE_END)).alias("idx", "__s"))
    good = pieces.where(~F.col("__s").rlike(FORBIDDEN) & ~F.col("__s").rlike(r"(.)\1{3}"))
    trimmed = good.withColumn("sentence", F.trim(F.regexp_replace("__s", r"\s+", " "))).drop("__s")
    return trimmed.where(F.length("sentence").between(SHORTEST, LONGEST) & is_sentence(F.col("sentence")))


def is_header(text: Column) -> Column:
    return F.trim(text).startswith("=") & F.trim(text).endswith("=")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def core_word(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, "[^a-zA-Z]", ""))


def split_punctuation(token: Column) -> tuple[Column, Column, Column]:
    """What stands before, in and behind a token's word."""
    pattern = r"(?s)^([^a-zA-Z0-9']*)(.*?)([^a-zA-Z0-9']*)$"
    return tuple(F.regexp_extract(token, pattern, i) for i in (1, 2, 3))


def with_repeat_key(word: Column) -> Column:
    """Each character that equals the one before becomes the repeat key."""
    chars = F.split(word, "")
    return F.array_join(F.transform(chars, lambda c, i: F.when((i > 0) & (c == F.get(chars, i - 1)), F.lit(REPEAT)).otherwise(c)), "")


def key_stream(abbr: Column, form: Column, repeat_key: bool) -> Column:
    """The keys that produce an abbreviation."""
    first = F.substring(abbr, 1, 1)
    plain = with_repeat_key(abbr) if repeat_key else abbr
    return (
        F.when(form == "trg", F.concat(plain, F.lit(TRIGGER)))
        .when(form == "doubletap", F.concat(first, first))
        .when(form == "rpt_trg", F.concat(first, F.lit(REPEAT), F.lit(TRIGGER)))
    )


def shown(stream: Column) -> Column:
    return F.translate(stream, TRIGGER + REPEAT, "★↻")


def like_capital(source: Column, text: Column) -> Column:
    """The text with its first letter upper-case if the source's first one is."""
    first = F.substring(source, 1, 1)
    upper = (F.upper(first) == first) & (F.lower(first) != first)
    return F.when(upper, F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))).otherwise(text)


def one_shot(text: Column) -> Column:
    """Each capital A-Z without a capital next to it becomes the one-shot key and the small letter."""
    chars = F.split(text, "")
    capital = lambda c: c.rlike("^[A-Z]$")
    near = lambda i: F.coalesce(capital(F.get(chars, i)), F.lit(False))
    marked = F.transform(chars, lambda c, i: F.when(capital(c) & ~near(i - 1) & ~near(i + 1), F.concat(F.lit(REPEAT), F.lower(c))).otherwise(c))
    return F.array_join(marked, "")


def ordinal_fold(item: Column, n: int = 10) -> Column:
    """The sum of the characters' codes modulo n; 0 for null and empty."""
    codes = F.aggregate(F.split(item, ""), F.lit(0).cast("long"), lambda a, c: a + F.ascii(c))
    return F.coalesce(F.when(item == "", F.lit(0)).otherwise(codes % n), F.lit(0)).cast("int")
