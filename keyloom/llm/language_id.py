"""Language identification by averaged hashed subword embeddings and a linear softmax.

The subwords of a text are the byte 2-, 3- and 4-grams of its words, a blank standing for a word's edge. Each is hashed
to an embedding, the embeddings are averaged and a linear layer with softmax gives the languages. All of it is trained by
stochastic gradient descent in numpy, in one task, on a bounded sample (``max_fit`` rows, those with the smallest hashes
of their ids). A temperature fitted on rows kept back calibrates the probabilities, and so does the threshold below which
a prediction counts as rejected: the lowest one at which accepted predictions on the rows kept back are as precise as
asked. For scoring, embeddings times layer is one small table.

Defined results: a null text and one without any letter is ``und`` with score 0, and so is every text if there was
nothing to learn from; rows with a null id or null language are not learned from; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LETTERS, crc_mod, documents, share, slices, struct, text_udf, with_fields

BUCKETS = 1 << 16
DIM = 16
#: Rows that the model is fitted on, at most; a fifth of them is kept back for the calibration.
MAX_FIT = 6_000
EPOCHS = 6
RATE = 0.6
SEED = 11
#: Precision that accepted predictions shall have on the rows kept back.
PRECISION = 0.99
#: Bytes whose subwords are hashed at once.
BLOCK = 1 << 17
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def subwords(text: bytes) -> Iterator[np.ndarray]:
    """The hashed subwords of a text, in blocks."""
    words = b" " + b" ".join(text.translate(LETTERS).split()) + b" "
    if len(words) < 3:
        return
    for start in range(0, len(words), BLOCK):
        b = np.frombuffer(words, np.uint8, count=min(BLOCK + 3, len(words) - start), offset=start).astype(np.uint32)
        if len(b) < 2:
            return
        blank = b == 32
        two = b[:-1] | b[1:] << 8
        yield (two * np.uint32(0x9E3779B1) >> 16)[: BLOCK]
        if len(b) > 2:
            three = two[:-1] | b[2:] << 16
            yield (three * np.uint32(0x85EBCA77) >> 16)[:BLOCK][~blank[1:-1][:BLOCK]]
        if len(b) > 3:
            four = three[:-1] | b[3:] << 24
            yield ((four ^ four >> 15) * np.uint32(0xC2B2AE3D) >> 16)[:BLOCK][~(blank[1:-2] | blank[2:-1])[:BLOCK]]


def counts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct subwords and their shares of the text."""
    parts = list(subwords(text))
    if not parts:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    at, n = np.unique(np.concatenate(parts), return_counts=True)
    return at.astype(np.int32), (n / n.sum()).astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (buckets, languages): embeddings times layer
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, text: bytes) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for at in subwords(text):
            total += self.table[at].sum(axis=0, dtype=np.float64)
            n += len(at)
        return total / max(n, 1) + self.bias


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[bytes, str]], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED, precision: float = PRECISION) -> Model:
    """Fit embeddings and layer by SGD over single texts; every fifth row is kept back for temperature and threshold."""
    languages = sorted({lang for _, lang in rows})
    place = {lang: i for i, lang in enumerate(languages)}
    seen = [(*counts(t), place[lang]) for t, lang in rows]
    fitted, kept = [x for i, x in enumerate(seen) if i % 5 or len(seen) < 25], [x for i, x in enumerate(seen) if i % 5 == 0]
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    steps, step = max(1, epochs * len(fitted)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(fitted)):
            at, share, y = fitted[i]
            lr = rate * (1 - step / steps)
            step += 1
            mean = share @ emb[at]
            g = _softmax(mean @ layer + bias)
            g[y] -= 1
            back = layer @ g
            layer -= lr * np.outer(mean, g)
            bias -= lr * 0.1 * g
            # Shares sum to 1, so single embeddings move little; the factor makes their steps as large as the layer's.
            emb[at] -= (lr * 20) * share[:, None] * back
    model = Model(languages, emb @ layer, bias)
    logits = np.array([share @ model.table[at] + bias for at, share, _ in kept])
    truth = np.array([y for _, _, y in kept])
    grid = np.geomspace(0.05, 20, 60)
    losses = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(losses))])
    best = _softmax(logits / model.temperature)
    top, right = best.max(axis=1), best.argmax(axis=1) == truth
    order = np.argsort(-top, kind="stable")
    good = np.flatnonzero(np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= precision)
    model.threshold = float(top[order][good[-1]]) if len(good) else 1.0
    return model


def fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[bytes, str]] = []
    for b in batches:
        langs = iter(b.column(1).to_pylist())
        rows += [(t, next(langs)) for texts in slices(b.column(0)) for t in texts]
    if rows:
        m = train(rows)
        values = [[m.languages], [m.table.astype(np.float32).tobytes()], [m.bias.astype(np.float64).tobytes()], [m.temperature], [m.threshold]]
        types = [pa.list_(pa.string()), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=["languages", "tab", "bias", "temperature", "threshold"])


def fit(docs: DataFrame, *, max_fit: int = MAX_FIT) -> Model | None:
    """A model of ``docs(doc_id, text, lang)``; None if no row has a language."""
    known = docs.where("doc_id IS NOT NULL AND lang IS NOT NULL").select("text", "lang", "doc_id", F.xxhash64("doc_id").alias("h"))
    cut = known.select("h").orderBy("h").limit(max_fit).agg(F.max("h")).first()[0]
    if cut is None:
        return None
    ordered = known.where(F.col("h") <= cut).repartition(1).sortWithinPartitions("h", "doc_id", "lang", "text").limit(max_fit)
    got = ordered.select("text", "lang").mapInArrow(fit_rows, "languages array<string>, tab binary, bias binary, temperature double, threshold double").first()
    table = np.frombuffer(bytes(got.tab), np.float32).reshape(BUCKETS, len(got.languages))
    return Model(list(got.languages), table, np.frombuffer(bytes(got.bias), np.float64), got.temperature, got.threshold)


def predict(docs: DataFrame, model: Model | None, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` with lang_pred, score (its calibrated probability) and accepted (score reaches the threshold)."""
    shared = share(docs.sparkSession, model)

    def make():
        m = shared()

        def one(text: bytes) -> tuple[str, float, bool]:
            if m is None or not _LETTER.search(text.decode("utf-8", "replace")):
                return UNKNOWN, 0.0, False
            p = _softmax(m.logits(text) / m.temperature)
            best = int(p.argmax())
            return m.languages[best], float(p[best]), bool(p[best] >= m.threshold)

        return lambda texts: [list(c) for c in zip(*map(one, texts), strict=True)] if texts else [[], [], []]

    returns = struct(lang_pred=T.StringType(), score=T.DoubleType(), accepted=T.BooleanType())
    return with_fields(docs, list(keep), text_udf(make, returns)(F.col(text_col)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs.where(crc_mod("doc_id", 4) != 2))
    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    return predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted")
