"""All features of every character of a corpus at once, made within each text's own row.

The windows of ``features`` need all characters of the corpus in an exchange, sorted by text. Here a batch of texts becomes
one array of character codes, and places, words and syllables are running maxima and sums over it, so nothing is shuffled
and a task holds one batch. What a layout says of a pair of keys is a row of a matrix of 128 x 128 pairs, whose size is
fixed. Frequency tables are sent along up to ``MAX_ENTRIES`` entries, which is checked. Of larger ones the most frequent
entries are sent along, and each text gets the others that occur in it by a join: a row for each of its distinct words (or
grams) that was not sent along goes through an exchange, not one for each character.

Where only sums by group are wanted (``linguistic_sums``), a text is read once. Single characters, pairs and words are counted
in the task; what a word or a pair says is worked out once a kind, and frequencies meet the counts and not the characters.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import TOKEN
from .features import ATTRIBUTES, BIGRAM, DELIMITERS, FREQUENCY_DELIMITERS, TRIGRAM
from .ngrams import zipf

#: Entries of a frequency table that is sent to the tasks.
MAX_ENTRIES = 1_000_000
#: Characters that are taken apart at once.
BLOCK = 1 << 18
#: Entries of pairs, and characters, that a task counts before it hands the counts on.
HELD, HELD_CHARS = 1 << 19, 1 << 25

PLACES = ("sequence_pos", "sequence_length", "sequence_relative_pos")
WORDS = ("word_index", "word_length", "word_relative_pos", "is_word_start", "is_word_end", "is_syllable_start", "is_syllable_end")
REPEATS = ("repetition", "skipgram_repetition")
FREQUENCIES = ("unigram_frequency", "bigram_frequency", "word_frequency")
LINGUISTIC = (*PLACES, *WORDS, *REPEATS, *FREQUENCIES)
ONE_HOT = {"finger": 10, "finger_type": 5, "hand": 3}
LAYOUT = (*(a for a in ATTRIBUTES if a != "slot"), *BIGRAM, *TRIGRAM, "move_dist", "move_sin", "move_cos", *(f"{c}_{i}" for c, n in ONE_HOT.items() for i in range(n)))
#: Columns of the matrix of pairs: those of the second key, of the pair, and the first key's finger.
_PAIR = (*(a for a in ATTRIBUTES if a != "slot"), *BIGRAM, "move_dist", "move_sin", "move_cos", "p_finger")


def _codes(*codes: int) -> np.ndarray:
    return np.isin(np.arange(128), codes)


_DELIMITER, _VOWEL = _codes(*DELIMITERS), _codes(*b"aeiouyAEIOUY")
_Y, _E, _L = _codes(*b"yY"), _codes(*b"eE"), _codes(*b"lL")
#: A key code as it stands in a word that is looked up: lower-cased, a blank where words part.
_LOOKED_UP = bytes(32 if c in FREQUENCY_DELIMITERS else c + 32 if 65 <= c <= 90 else c for c in range(128))


class Block:
    """The characters of some texts end to end."""

    def __init__(self, texts: list[str]) -> None:
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.key = np.where(self.code < 128, self.code, 0).astype(np.int32)
        self.text = np.repeat(np.arange(len(texts)), self.lengths)
        self.place = np.arange(len(self.code)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)

    def before(self, values: np.ndarray, n: int, none) -> np.ndarray:
        """The value n characters before, ``none`` where the text starts later."""
        out = np.full(len(values), none, values.dtype)
        if n < len(values):
            out[n:] = np.where(self.place[n:] >= n, values[:-n], none)
        return out


def places(b: Block) -> dict[str, np.ndarray]:
    length = np.repeat(b.lengths, b.lengths).astype(np.float64)
    return dict(zip(PLACES, (b.place.astype(np.float64), length, np.where(length > 1, b.place / np.maximum(length - 1, 1), 0.0)), strict=True))


def words(b: Block) -> dict[str, np.ndarray]:
    """Places in the word (null for delimiters) and its borders and those of its syllables by vowel groups."""
    n, at = len(b.key), np.arange(len(b.key))
    delim = _DELIMITER[b.key]
    start = np.maximum.accumulate(np.where(delim, at + 1, np.where(b.place == 0, at, 0))) if n else at
    last = np.append(b.place[1:] == 0, True) if n else np.zeros(0, bool)
    end = np.minimum.accumulate(np.where(delim, at, np.where(last, at + 1, n))[::-1])[::-1] if n else at
    index, length = at - start, end - start
    inside = ~delim
    first, final = inside & (index == 0), inside & (at == end - 1)
    # A vowel group counts unless it is a leading y, or a silent e at the end of a word with other groups.
    vowel = _VOWEL[b.key] & inside
    earlier = np.append(False, vowel[:-1])[:n] & ~first
    group = vowel & ~earlier & ~(first & _Y[b.key])
    sums = np.append(0, np.cumsum(group))
    several = sums[np.where(inside, end, at)] - sums[np.where(inside, start, at)] > 1
    silent = group & final & several & _E[b.key] & ~_L[np.append(0, b.key[:-1])[:n]]
    group &= ~silent
    sums = np.append(0, np.cumsum(group))
    later = group & (sums[:-1] > sums[np.where(inside, start, at)])
    # A syllable starts at the letter before a group that is not the word's first.
    syllable = first | (np.append(later[1:], False)[:n] & inside & ~final)
    syllable_end = final | (inside & ~final & np.append(syllable[1:], False)[:n])
    hide = lambda x: np.where(inside, x, np.nan)
    relative = np.where(length > 1, index / np.maximum(length - 1, 1), 0.0)
    return dict(zip(WORDS, (hide(index), hide(length), hide(relative), first.astype(float), final.astype(float), hide(syllable), hide(syllable_end)), strict=True))


def repeats(b: Block) -> dict[str, np.ndarray]:
    one, two = b.before(b.key, 1, 0), b.before(b.key, 2, 0)
    pair = (b.key > 0) & (one > 0)
    return {"repetition": np.where(pair, one == b.key, np.nan), "skipgram_repetition": np.where(pair & (two > 0), (two == b.key) & (two != one), np.nan)}


class Table:
    """Values of n-grams of up to two characters, found by their codes."""

    def __init__(self, rows: list[tuple[str, float]]) -> None:
        keys = np.array([self.number(*map(ord, gram)) for gram, _ in rows], np.int64)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.array([v for _, v in rows], np.float64)[order]

    @staticmethod
    def number(*codes) -> int:
        return codes[-1] if len(codes) == 1 else (codes[0] + 1 << 21) + codes[1]

    def find(self, numbers: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(numbers), np.nan)
        at = np.minimum(np.searchsorted(self.keys, numbers), len(self.keys) - 1)
        return np.where(self.keys[at] == numbers, self.values[at], np.nan)


def word_values(b: Block, values: dict[bytes, float], more: dict[bytes, float]) -> np.ndarray:
    """The value of the word that a character is in, 0 for words without one, null where words part; ``more`` has rarer words."""
    n = len(b.key)
    low = np.frombuffer(_LOOKED_UP, np.uint8)[b.key]
    inside = low != 32
    first = inside & ((b.place == 0) | ~np.append(False, inside[:-1])[:n])
    # Texts are parted as words are.
    spread = np.full(n + len(b.lengths), 32, np.uint8)
    spread[np.arange(n) + b.text] = low
    found = np.fromiter((values.get(w) or more.get(w, 0.0) for w in spread.tobytes().split(b" ") if w), np.float64)
    out = np.full(n, np.nan)
    out[inside] = found[np.cumsum(first)[inside] - 1]
    return out


def linguistic_block(b: Block, tables: tuple, rarer: list[dict]) -> dict[str, np.ndarray]:
    """LINGUISTIC from tables of unigrams, bigrams and words; ``rarer`` are entries of each that the block needs beside them."""
    code = b.code.astype(np.int64)
    one = b.before(code, 1, -1)
    pairs = np.where(one >= 0, Table.number(one, code), -1)
    grams = []
    for table, more, numbers in zip(tables, rarer, (code, pairs), strict=False):
        found = table.find(numbers)
        if more:
            found = np.where(np.isnan(found), Table(list(more.items())).find(numbers), found)
        grams.append(found)
    word = word_values(b, tables[2], {w.encode(): v for w, v in rarer[2].items()})
    return {**places(b), **words(b), **repeats(b), "unigram_frequency": grams[0], "bigram_frequency": grams[1], "word_frequency": word}


def layout_block(b: Block, matrix: np.ndarray) -> dict[str, np.ndarray]:
    """LAYOUT from the matrix of pairs; features of three keys follow from those of both pairs."""
    one, two = b.before(b.key, 1, 0), b.before(b.key, 2, 0)
    now, old = (128 * one + b.key), (128 * two + one)
    get = lambda name, pair: matrix[_PAIR.index(name)][pair]
    out = {name: get(name, now) for name in _PAIR if name != "p_finger"}
    valid = (b.key > 0) & (one > 0) & (two > 0)
    flag = lambda holds: np.where(valid, holds, np.nan)
    finger, p_finger, pp_finger = out["finger"], get("p_finger", now), get("p_finger", old)
    inward, outward, p_in, p_out = out["in_roll"] == 1, out["out_roll"] == 1, get("in_roll", old) == 1, get("out_roll", old) == 1
    out["same_finger_trigram"] = flag((pp_finger == p_finger) & (p_finger == finger))
    out["same_finger_skipgram"] = flag((pp_finger == finger) & ((pp_finger < p_finger) | (pp_finger > p_finger)) & (two != b.key))
    out["skipgram_repetition"] = flag((two == b.key) & (two != one))
    out["in_triroll"], out["out_triroll"] = flag(p_in & inward), flag(p_out & outward)
    out["redirects"] = flag((p_in & outward) | (p_out & inward))
    for name, n in ONE_HOT.items():
        out.update({f"{name}_{i}": (out[name] == i).astype(float) for i in range(n)})
    return out


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > BLOCK:
            yield start, i
            start, size = i, 0
        size += len(t or "")
    if size:
        yield start, len(texts)


def _rows(df: DataFrame, text: str, keep: tuple[str, ...], names: tuple[str, ...], make: Callable[[], Callable], rarer: str | None = None) -> DataFrame:
    """(keep..., pos, key_id, names...) for each character; the kept columns go along by row.

    The kernel is given a block and, of its texts, the entries in the column ``rarer`` if there is one.
    """
    kept = df.select(*keep, F.col(text).alias("__text"), *([F.col(rarer).alias("__rarer")] if rarer else []))
    n_keep = len(kept.columns) - (2 if rarer else 1)
    schema = T.StructType([*kept.schema.fields[:n_keep], T.StructField("pos", T.IntegerType()), T.StructField("key_id", T.IntegerType()), *(T.StructField(n, T.DoubleType()) for n in names)])
    titles = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make()
        for batch in batches:
            texts = batch.column(n_keep).to_pylist()
            for lo, hi in _blocks(texts):
                b = Block([t or "" for t in texts[lo:hi]])
                values = kernel(b, batch.column(n_keep + 1).slice(lo, hi - lo)) if rarer else kernel(b)
                rows = pa.array(b.text + lo)
                columns = [batch.column(i).take(rows) for i in range(n_keep)]
                columns += [pa.array(b.place.astype(np.int32)), pa.array(b.key), *(pa.array(values[n].astype(np.float64, copy=False), from_pandas=True) for n in names)]
                yield pa.RecordBatch.from_arrays(columns, names=titles)

    return kept.mapInArrow(run, schema)


def _share(df: DataFrame, value: object) -> Callable[[], object]:
    held = df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: cloudpickle.loads(held.value)


def _bounded(table: DataFrame, limit: int) -> list | None:
    """The rows of a table; None if there are more than the limit."""
    rows = table.limit(limit + 1).toArrow()
    return None if rows.num_rows > limit else list(zip(*(c.to_pylist() for c in rows.columns), strict=True))


def _cut_off(table: DataFrame, limit: int) -> float:
    """The least value that no more than ``limit`` entries reach; found on the numbers of entries by value."""
    upto, least = 0, math.inf
    for value, n in sorted((tuple(r) for r in table.groupBy("zipf").count().collect()), reverse=True):
        upto += n
        if upto > limit:
            break
        least = value
    return least


#: Every byte of a text in ASCII, where other characters are question marks, which part words as key code 0 does.
_WORD_BYTES = _LOOKED_UP + bytes([32] * 128)
#: What of a text is looked up in each of the tables.
_GRAMS = (set, lambda t: set(map("".join, zip(t, t[1:], strict=False))), lambda t: {w.decode() for w in t.encode("ascii", "replace").translate(_WORD_BYTES).split(b" ") if w})


def _absent(shared: Callable[[], object], kinds: list[int]):
    """(key, text) -> (key, kind, gram): the distinct grams of each text that were not sent along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = {i: held for i, held in zip(kinds, shared(), strict=True)}
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in _blocks(texts):
                keys, which, grams = [], [], []
                for key, t in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), texts[lo:hi], strict=True):
                    for i in kinds:
                        found = _GRAMS[i](t or "") - sent[i]
                        keys += [key] * len(found)
                        which += [i] * len(found)
                        grams += found
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(which, pa.int32()), pa.array(grams, pa.string())], names=["key", "kind", "gram"])

    return run


def linguistic_rows(df: DataFrame, text: str, *keep: str, unigrams: DataFrame, bigrams: DataFrame, vocabulary: DataFrame, limit: int = MAX_ENTRIES) -> DataFrame:
    """(keep..., pos, key_id, LINGUISTIC) for each character of each text.

    ``unigrams(gram, zipf)``, ``bigrams(gram, zipf)`` and ``vocabulary(word, zipf)`` are sent to the tasks up to ``limit``
    entries each, the most frequent ones; what a text has of the others is joined to its row.
    """
    given = [t.select(F.col(name).alias("gram"), "zipf") for t, name in ((unigrams, "gram"), (bigrams, "gram"), (vocabulary, "word"))]
    tables, rest = [_bounded(t, limit) for t in given], []
    for i, t in enumerate(given):
        if tables[i] is None:
            # Counted once, as it is read three times.
            whole = t.persist(StorageLevel.DISK_ONLY)
            least = _cut_off(whole, limit)
            tables[i] = _bounded(whole.where(F.col("zipf") >= least), limit)
            rest.append((i, whole.where(F.col("zipf") < least)))
    shared = _share(df, (Table(tables[0]), Table(tables[1]), {w.encode(): v for w, v in tables[2]}))
    if not rest:

        def make():
            parts = shared()
            return lambda b: linguistic_block(b, parts, [{}, {}, {}])

        return _rows(df, text, keep, LINGUISTIC, make)

    kinds = [i for i, _ in rest]
    keyed = df.withColumn("__key", F.monotonically_increasing_id())
    sent = _share(df, [frozenset(gram for gram, _ in tables[i]) for i in kinds])
    absent = keyed.select("__key", F.col(text)).mapInArrow(_absent(sent, kinds), "key long, kind int, gram string")
    others = [t.select(F.lit(i).alias("kind"), "gram", "zipf") for i, t in rest]
    for more in others[1:]:
        others[0] = others[0].unionByName(more)
    found = absent.join(others[0], ["kind", "gram"]).groupBy("key").agg(F.collect_list(F.struct("kind", "gram", "zipf")).alias("__rarer"))
    joined = keyed.join(found.withColumnRenamed("key", "__of"), F.col("__key") == F.col("__of"), "left")

    def make_joined():
        parts = shared()

        def kernel(b: Block, entries: pa.Array) -> dict[str, np.ndarray]:
            rarer: list[dict] = [{}, {}, {}]
            flat = entries.flatten()
            for kind, gram, value in zip(*(flat.field(n).to_pylist() for n in ("kind", "gram", "zipf")), strict=True):
                rarer[kind][gram] = value
            return linguistic_block(b, parts, rarer)

        return kernel

    return _rows(joined, text, keep, LINGUISTIC, make_joined, "__rarer")


_TOKEN = re.compile(TOKEN)
#: The characters beyond ASCII that are letters of words in lower case, as SQL has it.
_LOWERED = {"\u0130": "i", "\u212a": "k"}
#: Of what kind a count is: the first ones by their places in FREQUENCIES; sums of features have their name as gram.
_SUM = len(FREQUENCIES)


def _kinds(numbers: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each number once with its counts added up."""
    kinds, at = np.unique(numbers, return_inverse=True)
    return kinds, np.bincount(at, n, len(kinds)).astype(np.int64)


class Counts:
    """What the texts of a group have: counts of characters, pairs and words, and sums of the features that are of no kind."""

    def __init__(self) -> None:
        self.sums: dict[str, float] = {}
        self.grams: tuple[list, list] = ([], [])
        self.runs: list[bytes] = []
        self.tokens: Counter[str] = Counter()
        self.held = 0

    def add_sum(self, name: str, value: float) -> None:
        self.sums[name] = self.sums.get(name, 0.0) + float(value)

    def add_grams(self, i: int, numbers: np.ndarray, n: np.ndarray) -> None:
        self.grams[i].append((numbers, n))
        self.held += len(numbers)

    def add(self, texts: list[str]) -> None:
        """Texts of a character or more."""
        lengths = np.array([len(t) for t in texts], np.int64)
        borders = np.cumsum(lengths)[:-1]
        whole = "".join(texts)
        code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        # Codes up to 254 are counted in tables; 255 stands for all others, which are counted by sorting.
        low = np.minimum(code, 255).astype(np.uint8)
        wide = low == 255
        counts = np.bincount(low, minlength=256)[:255]
        at = np.flatnonzero(counts)
        self.add_grams(0, at, counts[at])
        if wide.any():
            self.add_grams(0, *np.unique(code[wide].astype(np.int64), return_counts=True))
        self._add_pairs(code, low, wide, borders)
        self._add_places(lengths)
        self._add_skips(np.where(low < 128, low, np.uint8(0)), borders)
        self.runs.append((" ".join(texts) + " ").encode("ascii", "replace").translate(_WORD_BYTES))
        if any(c in whole for c in _LOWERED):
            for t in texts:
                if any(c in t for c in _LOWERED):
                    self.tokens.update(_TOKEN.findall(t.translate(str.maketrans(_LOWERED)).lower()))
                    # Its runs are counted as well, where these characters part words.
                    self.tokens.subtract(_TOKEN.findall(t.encode("ascii", "replace").decode().lower()))

    def _add_pairs(self, code: np.ndarray, low: np.ndarray, wide: np.ndarray, borders: np.ndarray) -> None:
        pair = low[:-1].astype(np.uint16) << 8 | low[1:]
        counts = np.bincount(pair, minlength=1 << 16)
        np.subtract.at(counts, pair[borders - 1], 1)
        table = counts.reshape(256, 256)
        keys = table[1:128, 1:128]
        if keys.any():
            self.add_sum("repetition", np.trace(keys))
        one, two = np.nonzero(table[:255, :255])
        self.add_grams(1, Table.number(one, two), table[one, two])
        if wide.any():
            beside = wide[:-1] | wide[1:]
            beside[borders - 1] = False
            at = np.flatnonzero(beside)
            self.add_grams(1, *np.unique(Table.number(code[at].astype(np.int64), code[at + 1].astype(np.int64)), return_counts=True))

    def _add_places(self, lengths: np.ndarray) -> None:
        """Sums of 0 to n - 1, of n, and of shares of n - 1 over the n characters of each text."""
        size = lengths.astype(np.float64)
        self.add_sum("n", size.sum())
        for name, value in zip(PLACES, (size * (size - 1) / 2, size * size, np.where(size > 1, size / 2, 0.0)), strict=True):
            self.add_sum(name, value.sum())
        for name in ("is_word_start", "is_word_end"):
            self.add_sum(name, 0.0)

    def _add_skips(self, key: np.ndarray, borders: np.ndarray) -> None:
        two, one, now = key[:-2], key[1:-1], key[2:]
        valid = (two > 0) & (one > 0) & (now > 0)
        across = np.concatenate([borders - 2, borders - 1])
        valid[across[(across >= 0) & (across < len(valid))]] = False
        if valid.any():
            self.add_sum("skipgram_repetition", np.count_nonzero(valid & (two == now) & (one != now)))

    def rows(self) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray]]:
        """Kind, grams, their numbers, and values: sums of features, or the number of characters that have the gram's frequency.

        A gram may come more than once.
        """
        for i, held in enumerate(self.grams):
            if held:
                numbers, n = _kinds(*map(np.concatenate, zip(*held, strict=True)))
                shown = map(chr, numbers.tolist()) if i == 0 else (chr((x >> 21) - 1) + chr(x & (1 << 21) - 1) for x in numbers.tolist())
                yield i, pa.array(shown, pa.string()), n, n.astype(np.float64)
        runs, times = self._kinds_of_runs()
        for lo in range(0, len(runs), HELD):
            some, n = runs.slice(lo, HELD), times[lo : lo + HELD]
            self._add_words(some.to_pylist(), n)
            yield from self._words_of_runs(pc.ascii_rtrim(some, " "), n)
        yield 2, pa.array(self.tokens.keys(), pa.string()), np.array([*self.tokens.values()], np.int64), np.zeros(len(self.tokens))
        yield _SUM, pa.array(self.sums.keys(), pa.string()), np.zeros(len(self.sums), np.int64), np.array([*self.sums.values()], np.float64)

    @staticmethod
    def _words_of_runs(runs: pa.Array, times: np.ndarray) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray]]:
        """The words that are counted in each run; only a run that is one word as a whole has its frequency."""
        plain = pc.ascii_is_alpha(runs)
        chosen = plain.to_numpy(zero_copy_only=False)
        alone, n = runs.filter(plain), times[chosen]
        yield 2, alone, n, n * pc.binary_length(alone).to_numpy().astype(np.float64)
        tokens: Counter[str] = Counter()
        inside: dict[str, int] = {}
        for run, k in zip(runs.filter(pc.invert(plain)).to_pylist(), times[~chosen].tolist(), strict=True):
            found = _TOKEN.findall(run)
            for token in found:
                tokens[token] += k
            if found == [run]:
                inside[run] = k * len(run)
        yield 2, pa.array(tokens.keys(), pa.string()), np.array([*tokens.values()], np.int64), np.array([inside.get(t, 0) for t in tokens], np.float64)

    def _kinds_of_runs(self) -> tuple[pa.Array, np.ndarray]:
        """Each run once, with the blank that ends it, and how often it occurs."""
        data = b"".join(self.runs)
        ends = np.append(0, np.flatnonzero(np.frombuffer(data, np.uint8) == 32) + 1).astype(np.int64)
        # A lone blank ends none.
        runs = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(data)).filter(pa.array(np.diff(ends) > 1))
        found = runs.value_counts()
        return found.field("values").cast(pa.string()), found.field("counts").to_numpy()

    def _add_words(self, runs: list[str], times: np.ndarray) -> None:
        """Features of the words of each run, once a kind; no word goes beyond a run, as where runs part, words do."""
        for lo, hi in _blocks(runs):
            b = Block(runs[lo:hi])
            for name, values in words(b).items():
                known = ~np.isnan(values)
                if known.any():
                    self.add_sum(name, values[known] @ times[lo:hi][b.text[known]].astype(np.float64))
        if runs:
            self.add_sum("word_frequency", 0.0)


def counts(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """(keep..., kind, gram, n, value) from one pass over the texts, counted on disk once as it is read several times.

    For an entry of FREQUENCIES, which is numbered by ``kind``, n is how often the gram occurs in texts and value how many
    characters have its frequency. For other features of LINGUISTIC and for the number "n" of characters, value is the sum.
    """
    kept = df.select(*keep, F.col(text).alias("__text")).where(F.length("__text") > 0)
    schema = T.StructType([*kept.schema.fields[:-1], *(T.StructField(n, t()) for n, t in (("kind", T.IntegerType), ("gram", T.StringType), ("n", T.LongType), ("value", T.DoubleType)))])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, Counts] = {}
        chars = 0

        def emptied() -> Iterator[pa.RecordBatch]:
            for group in list(groups):
                for kind, grams, n, values in groups.pop(group).rows():
                    first = pa.array(np.zeros(len(grams), np.int64))
                    own = (pa.array([v], t).take(first) for v, t in zip((*group, kind), (*kinds, pa.int32()), strict=True))
                    yield pa.RecordBatch.from_arrays([*own, grams, pa.array(n, pa.int64()), pa.array(values, pa.float64())], names=names)

        for batch in batches:
            kinds = [f.type for f in batch.schema][: len(keep)]
            texts: dict[tuple, list[str]] = {}
            for *group, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                texts.setdefault(tuple(group), []).append(t)
            for group, own in texts.items():
                for lo, hi in _blocks(own):
                    groups.setdefault(group, Counts()).add(own[lo:hi])
                    chars += sum(map(len, own[lo:hi]))
                    if chars >= HELD_CHARS or sum(c.held for c in groups.values()) > HELD:
                        yield from emptied()
                        chars = 0
        yield from emptied()

    made = kept.mapInArrow(run, schema).groupBy(*keep, "kind", "gram")
    return made.agg(F.sum("n").alias("n"), F.sum("value").alias("value")).persist(StorageLevel.DISK_ONLY)


def frequency_tables(counted: DataFrame) -> list[DataFrame]:
    """(gram, n, p, zipf) of the characters, pairs and words of ``counts``."""
    return [zipf(counted.where(F.col("kind") == i).groupBy("gram").agg(F.sum("n").alias("n"))) for i in range(len(FREQUENCIES))]


def linguistic_sums(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """(keep..., n, LINGUISTIC): the number of characters and the sums of their features by group, with frequencies from the texts themselves."""
    counted = counts(df, text, *keep)
    sums = counted.where(F.col("kind") == _SUM).select(*keep, "gram", "value")
    for i, (name, table) in enumerate(zip(FREQUENCIES, frequency_tables(counted), strict=True)):
        own = counted.where((F.col("kind") == i) & (F.col("value") > 0)).join(table.select("gram", "zipf"), "gram")
        sums = sums.unionByName(own.select(*keep, F.lit(name).alias("gram"), (F.col("value") * F.col("zipf")).alias("value")))
    of = lambda name: F.sum(F.when(F.col("gram") == name, F.col("value")))
    return sums.groupBy(*keep).agg(of("n").cast("long").alias("n"), *(of(c).alias(c) for c in LINGUISTIC))


def layout_rows(df: DataFrame, text: str, pairs: DataFrame, *keep: str) -> DataFrame:
    """(keep..., pos, key_id, LAYOUT) for each character of each text; ``pairs`` is ``features.pair_table``, of 128 x 128 rows."""
    table = pairs.select("pair", *(F.col(c).cast("double").alias(c) for c in _PAIR)).toPandas()
    matrix = np.full((len(_PAIR), 1 << 14), np.nan)
    matrix[:, table["pair"].to_numpy()] = table[list(_PAIR)].to_numpy(np.float64).T
    shared = _share(df, matrix)

    def make():
        held = shared()
        return lambda b: layout_block(b, held)

    return _rows(df, text, keep, LAYOUT, make)
