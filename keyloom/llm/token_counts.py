"""Token counts by batch encoding in Arrow functions that return lengths only.

Texts are encoded in batches of bounded bytes. A text above ``piece_bytes`` is split first, at single blanks between two
characters that are neither blank nor U+2581: no piece of the vocabulary has a blank behind a character, and the
encoder puts a blank before each text it is given, so each part that lost its leading blank gets it back and the parts'
counts add up to the text's. A stretch without such a blank stays whole.

Defined results: null is the empty text with 0 tokens; a text's invalid UTF-8 is replaced by U+FFFD; repeated rows are
counted each; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, struct, text_udf, with_fields

#: The vocabulary file; a name within the installed folder of public vocabularies, or a path.
MODEL = "piece_bpe_32k.model"
PIECE_BYTES = 64 << 10
BATCH_BYTES = 1 << 20
LIMIT = 4096
_SAFE = re.compile("(?<=[^\\s▁]) (?=[^\\s▁])")


def vocabulary(name: str) -> str:
    """Where a vocabulary file lies on this machine."""
    import public_tokenizers

    return name if "/" in name else public_tokenizers.path(name)


def split_safely(text: str, piece: int = PIECE_BYTES) -> list[str]:
    """The text in parts of at least ``piece`` characters (but the last), cut at safe blanks, which are left out."""
    parts, start = [], 0
    while len(text) - start > piece and (cut := _SAFE.search(text, start + piece)):
        parts.append(text[start : cut.start()])
        start = cut.end()
    return [*parts, text[start:]]


def counter(model: str = MODEL, piece_bytes: int = PIECE_BYTES, batch_bytes: int = BATCH_BYTES):
    """A kernel from texts to [bytes, tokens]; the model is loaded once."""
    from sentencepiece import SentencePieceProcessor

    encoder = SentencePieceProcessor(model_file=vocabulary(model))

    def kernel(texts: list[bytes]) -> list:
        tokens = np.zeros(len(texts), np.int64)
        batch, owners, size = [], [], 0

        def flush() -> None:
            nonlocal batch, owners, size
            if batch:
                np.add.at(tokens, owners, [len(ids) for ids in encoder.encode(batch, num_threads=1)])
            batch, owners, size = [], [], 0

        for i, raw in enumerate(texts):
            text = raw.decode("utf-8", "replace")
            for part in split_safely(text, piece_bytes) if len(raw) > piece_bytes else (text,):
                batch.append(part)
                owners.append(i)
                size += len(part)
                if size >= batch_bytes:
                    flush()
        flush()
        return [np.array([len(t) for t in texts], np.int64), tokens]

    return kernel


def token_counts(docs: DataFrame, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), model: str = MODEL) -> DataFrame:
    """Columns ``keep`` with n_bytes and n_tokens of the whole text."""
    count = text_udf(lambda: counter(model), struct(n_bytes=T.LongType(), n_tokens=T.LongType()))
    return with_fields(docs, list(keep), count(F.col(text_col)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir)).withColumn("over_limit", F.col("n_tokens") > LIMIT)
