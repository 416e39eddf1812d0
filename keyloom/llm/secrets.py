"""Secret scans: fixed formats, and formats learned by grammar inference.

Three fixed formats (an assigned value, an access key id, a hexadecimal run) are found by pattern. The values that they
find are labelled credentials: a prefix tree of them, with counts, is built for each label, and states whose futures are
statistically compatible (Hoeffding bound, ALERGIA's red-blue order) are merged into a probabilistic automaton. Every
other run of 12 or more credential characters in a text, and what is left of a run beside a fixed format, is a candidate,
whatever characters it has; it is reported as ``format`` if an automaton gives it a likelihood a character that is near
what the automaton gives its own credentials, and well above that of a background model of ordinary words and numbers.

The automata are learned from all distinct values in the corpus. Tasks count every prefix of every value; the driver merges
the states of the prefixes that occur in enough values, ``TREE`` of a label at most (all prefixes, if there are no more), where
a step to a rarer prefix is counted but leads nowhere yet. Then all values are read through the merged states, a step that
leads nowhere going to the first state, which is where merging puts states that too few values reach to tell them apart; so
likelihoods come from counts over all values, and thresholds from the likelihoods of all. The background counts the pairs of
all distinct ordinary words. No count leaves a value out; what is bounded is the number of states that are told apart.

Defined results: null is the empty text; offsets are code points, ends exclusive; invalid UTF-8 counts as U+FFFD does;
repeated rows are scanned each; a corpus without credentials teaches no automaton and adds no span; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, documents, share, slices, struct, text_udf, whole_rows, with_fields

KINDS = ("assign", "access", "hex")
#: Prefixes of a label whose states are told apart, at most.
TREE = 4096
#: Entries of a table that a task adds up before it gives them.
REMEMBERED = 200_000
#: Words that the pairs of all ordinary words weigh as much as, beside what the background takes for granted.
WORDS = 400
#: Steps a bit in which likelihoods are added up, as sums of whole numbers have no order.
STEPS = 1 << 24
#: Confidence of the merge test; smaller merges more.
ALPHA = 0.01
#: Bits a character that a candidate may fall below its automaton's mean, and must lie above the background.
SLACK, GAIN = 0.75, 0.4
SHORTEST = 12

_ASSIGN = re.compile(rb"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_KEYS = (b"passw", b"secret", b"token", b"api")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{16,}")
_CANDIDATE = re.compile(rb"[A-Za-z0-9+/_.=-]{%d,}" % SHORTEST)
_EDGES = b"-=_/+."
#: The background reads a mark between words as their border.
_BREAKS = bytes(32 if b in _EDGES else b for b in range(256))
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

Span = tuple[str, int, int]


def base_spans(text: bytes) -> list[Span]:
    """(kind, start, end) in bytes, of each kind leftmost and not overlapping; a match that is too short takes its place and is dropped."""
    found: list[Span] = []
    low = text.translate(_LOWER)
    if any(k in low for k in _KEYS):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if b"AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return found


def values(text: bytes) -> Iterator[tuple[str, bytes]]:
    """(label, credential) of the fixed formats in a text; of an assignment only what is assigned."""
    for kind, start, end in base_spans(text):
        yield kind, _ASSIGN.match(text, start, end)[2] if kind == "assign" else text[start:end]


class Automaton:
    """A deterministic probabilistic automaton: counts of arrivals, ends and steps by state."""

    def __init__(self) -> None:
        self.arrive: list[int] = [0]
        self.end: list[int] = [0]
        self.step: list[dict[int, int]] = [{}]
        self.used: list[dict[int, int]] = [{}]

    def add(self, word: bytes) -> None:
        at = 0
        self.arrive[0] += 1
        for c in word:
            if c not in self.step[at]:
                self.step[at][c] = len(self.arrive)
                self.arrive.append(0)
                self.end.append(0)
                self.step.append({})
                self.used.append({})
            self.used[at][c] = self.used[at].get(c, 0) + 1
            at = self.step[at][c]
            self.arrive[at] += 1
        self.end[at] += 1

    def _differ(self, f1: int, n1: int, f2: int, n2: int, bound: float) -> bool:
        return abs(f1 / n1 - f2 / n2) > bound * (n1**-0.5 + n2**-0.5)

    def compatible(self, a: int, b: int, bound: float) -> bool:
        """Whether no state reached from both by the same word differs in its end or its steps."""
        todo = [(a, b)]
        while todo:
            p, q = todo.pop()
            n, m = self.arrive[p], self.arrive[q]
            if not n or not m:
                continue
            if self._differ(self.end[p], n, self.end[q], m, bound):
                return False
            for c in self.used[p].keys() | self.used[q].keys():
                if self._differ(self.used[p].get(c, 0), n, self.used[q].get(c, 0), m, bound):
                    return False
                if c in self.step[p] and c in self.step[q]:
                    todo.append((self.step[p][c], self.step[q][c]))
        return True

    def fold(self, a: int, b: int) -> None:
        """Add the tree below b to a, state by state."""
        todo = [(a, b)]
        while todo:
            p, q = todo.pop()
            self.arrive[p] += self.arrive[q]
            self.end[p] += self.end[q]
            for c, n in self.used[q].items():
                self.used[p][c] = self.used[p].get(c, 0) + n
                if c not in self.step[q]:
                    continue
                if c in self.step[p]:
                    todo.append((self.step[p][c], self.step[q][c]))
                else:
                    self.step[p][c] = self.step[q][c]

    @staticmethod
    def of(total: int, nodes: dict[int, list[tuple[int, int, int, int]]], least: int) -> Automaton:
        """The tree of ``total`` words from (c, n, ends, key) of each prefix by its parent's key; those of less than ``least`` words are counted steps only."""
        tree = Automaton()
        tree.arrive[0] = total
        todo = [(0, c, n, ends, key) for c, n, ends, key in sorted(nodes.get(ROOT, []), reverse=True)]
        while todo:
            at, c, n, ends, key = todo.pop()
            tree.used[at][c] = n
            if n < least:
                continue
            tree.step[at][c] = q = len(tree.arrive)
            tree.arrive.append(n)
            tree.end.append(ends)
            tree.step.append({})
            tree.used.append({})
            todo += [(q, *child) for child in sorted(nodes.get(key, []), reverse=True)]
        return tree

    def routes(self) -> list[dict[int, int]]:
        """The states reached from the first one, numbered in the order of ``compact``, as {character: state}."""
        order, place = [0], {0: 0}
        for p in order:
            for q in self.step[p].values():
                if q not in place:
                    place[q] = len(order)
                    order.append(q)
        return [{c: place[q] for c, q in self.step[p].items()} for p in order]

    def merge(self, alpha: float) -> None:
        """Red-blue state merging: each state next to the kept ones joins the first compatible one, or is kept."""
        bound = math.sqrt(0.5 * math.log(2 / alpha))
        red, seen = [0], {0}
        while True:
            blue = [(p, c, q) for p in red for c, q in sorted(self.step[p].items()) if q not in seen]
            if not blue:
                return
            p, c, q = max(blue, key=lambda x: (self.arrive[x[2]], -x[0], -x[1]))
            for r in red:
                if self.compatible(r, q, bound):
                    self.step[p][c] = r
                    self.fold(r, q)
                    break
            else:
                red.append(q)
                seen.add(q)

    def compact(self) -> list[tuple[float, dict[int, tuple[int, float]]]]:
        """States reached from the first, as (log2 of ending, {character: (state, log2 of the step)}), smoothed."""
        order, place = [0], {0: 0}
        for p in order:
            for q in self.step[p].values():
                if q not in place:
                    place[q] = len(order)
                    order.append(q)
        out = []
        for p in order:
            total = self.arrive[p] + 1.0
            out.append((math.log2((self.end[p] + 0.5) / total), {c: (place[q], math.log2(max(self.used[p].get(c, 0), 0.5) / total)) for c, q in self.step[p].items()}))
        return out


#: log2 likelihood of a step that the automaton never saw.
UNSEEN = -16.0


def likelihood(states: list, word: bytes) -> float:
    """log2 likelihood a character of a word, its end included."""
    at, total = 0, 0.0
    for i, c in enumerate(word):
        if (nxt := states[at][1].get(c)) is None:
            return (total + UNSEEN * (len(word) - i)) / len(word)
        at = nxt[0]
        total += nxt[1]
    return (total + states[at][0]) / len(word)


class Grammar:
    """Automata by label with their thresholds, and the background: pairs of characters in ordinary words."""

    def __init__(self, automata: dict[str, tuple[list, float]], background: np.ndarray) -> None:
        self.automata = automata
        self.background = background

    def ordinary(self, word: bytes) -> float:
        b = np.frombuffer(b" " + word.translate(_BREAKS), np.uint8)
        return float(self.background[b[:-1], b[1:]].mean())

    def accepts(self, word: bytes) -> bool:
        best = max((likelihood(s, word) - least for s, least in self.automata.values()), default=-1.0)
        if best < 0:
            return False
        return max(likelihood(s, word) for s, _ in self.automata.values()) >= self.ordinary(word) + GAIN

    def spans(self, text: bytes) -> tuple[list[Span], list[Span]]:
        """(base spans, added spans), in bytes; an added span touches no base span, but may lie beside one in the same run."""
        base = base_spans(text)
        if not self.automata:
            return base, []
        added, taken, k = [], sorted((s, e) for _, s, e in base), 0
        for m in _CANDIDATE.finditer(text):
            at, parts = m.start(), []
            while k < len(taken) and taken[k][1] <= at:
                k += 1
            j = k
            while j < len(taken) and taken[j][0] < m.end():
                parts.append((at, taken[j][0]))
                at, j = max(at, taken[j][1]), j + 1
            for lo, hi in [*parts, (at, m.end())]:
                run = text[lo:hi]
                word = run.strip(_EDGES) if run[-1:] != b"=" else run.lstrip(_EDGES)
                if len(word) >= SHORTEST and self.accepts(word):
                    start = lo + run.index(word)
                    added.append(("format", start, start + len(word)))
        return base, added


def _background(pairs: np.ndarray) -> np.ndarray:
    """log2 likelihoods of a character after another in ordinary words, from counts of pairs, blanks being borders."""
    pairs = pairs + 1.0
    # Numbers are ordinary, and so are borders of words beside each other; words of letters show neither.
    pairs[48:58, 48:58] += 256
    pairs[32, 32] += 256
    pairs[32, 48:58] += 16
    pairs[48:58, 32] += 256
    return np.log2(pairs / pairs.sum(axis=1, keepdims=True))


def _pairs_of(word: bytes) -> tuple[np.ndarray, np.ndarray]:
    b = np.frombuffer(b" " + word + b" ", np.uint8)
    return b[:-1], b[1:]


def infer(found: dict[str, list[bytes]], words: Counter, alpha: float = ALPHA, slack: float = SLACK) -> Grammar:
    """A grammar from credentials by label and counts of ordinary words."""
    pairs = np.zeros((256, 256))
    for w, n in words.items():
        np.add.at(pairs, _pairs_of(w), n)
    automata = {}
    for label, credentials in found.items():
        if len(credentials) < FEWEST:
            continue
        tree = Automaton()
        for c in sorted(credentials):
            tree.add(c)
        tree.merge(alpha)
        states = tree.compact()
        own = [likelihood(states, c) for c in credentials]
        automata[label] = (states, float(np.mean(own)) - slack)
    return Grammar(automata, _background(pairs))


#: Key of the empty prefix, and values without which a label has no automaton.
ROOT, FEWEST = 0, 5


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """texts -> distinct (label, value) of the batch, and in label '' its words that could be candidates."""
    for b in batches:
        for texts in slices(b.column(0)):
            got = {v for t in texts for v in values(t)}
            got.update(("", w) for t in texts for w in t.split() if len(w) >= SHORTEST and w.isalpha())
            keys = list(got)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([v for _, v in keys], pa.binary())], names=["label", "value"])


def _added(make: Callable[[], Callable[[str, bytes], Iterator[tuple]]], names: list[str], types: list[pa.DataType]):
    """A task that adds up what each (label, value) gives: (label, key..., two numbers), whose keys have ``names`` and ``types``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each, sums = make(), {}

        def flush() -> pa.RecordBatch:
            keys, numbers = list(zip(*sums, strict=True)), list(zip(*sums.values(), strict=True))
            sums.clear()
            return pa.RecordBatch.from_arrays([*map(pa.array, keys, types), *(pa.array(n, pa.int64()) for n in numbers)], names=[*names, "n", "m"])

        for b in batches:
            for label, value in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for key, n, m in each(label, value.as_py()):
                    old = sums.get(key, (0, 0))
                    sums[key] = old[0] + n, old[1] + m
                    if len(sums) > REMEMBERED:
                        yield flush()
        if sums:
            yield flush()

    return run


def _sums(found: DataFrame, make: Callable, keys: dict[str, str]) -> DataFrame:
    """(key..., n, m), sums over all rows of ``found(label, value)`` of what ``make()`` gives for each."""
    arrow = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    schema = ", ".join(f"{k} {t}" for k, t in keys.items()) + ", n long, m long"
    rows = found.mapInArrow(_added(make, list(keys), [arrow[t] for t in keys.values()]), schema)
    return rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def _prefixes(label: str, value: bytes) -> Iterator[tuple]:
    """Each prefix of a value as (label, key of the prefix without its last character, that character, its own key)."""
    at = ROOT
    for i, c in enumerate(value):
        key = xxhash.xxh64_intdigest(at.to_bytes(8, "little", signed=True) + value[i : i + 1]) - (1 << 63)
        yield (label, at, c, key), 1, i == len(value) - 1
        at = key


def _tree_sizes(nodes: DataFrame, limit: int) -> dict[str, int]:
    """By label the least number of values that no more than ``limit`` prefixes occur in."""
    numbers: dict[str, list[tuple[int, int]]] = {}
    for label, n, count in nodes.groupBy("label", "n").agg(F.count("*")).collect():
        numbers.setdefault(label, []).append((n, count))
    least = {}
    for label, counts in numbers.items():
        upto, least[label] = 0, 1 << 62
        for n, count in sorted(counts, reverse=True):
            upto += count
            if upto > limit:
                break
            least[label] = n
    return least


def _trees(found: DataFrame, limit: int) -> dict[str, Automaton]:
    """The prefix tree of each label, with counts over all its values."""
    nodes = checkpoint(_sums(found, lambda: _prefixes, {"label": "string", "parent": "long", "c": "int", "key": "long"}))
    least = _tree_sizes(nodes, limit)
    known = found.sparkSession.createDataFrame(list(least.items()), "label string, least long")
    kept = nodes.join(F.broadcast(known), "label").where(F.col("n") >= F.col("least")).select("label", F.col("key").alias("parent"))
    first = known.select("label", F.lit(ROOT).cast("long").alias("parent"))
    near = nodes.join(F.broadcast(kept.unionByName(first)), ["label", "parent"], "left_semi")
    trees: dict[str, dict[int, list]] = {label: {} for label in least}
    for label, parent, c, n, ends, key in near.select("label", "parent", "c", "n", "m", "key").toLocalIterator():
        trees[label].setdefault(parent, []).append((c, n, ends, key))
    return {label: Automaton.of(sum(x[1] for x in tree[ROOT]), tree, least[label]) for label, tree in sorted(trees.items())}


def _walked(shared):
    def make():
        routes = shared()

        def each(label: str, value: bytes) -> Iterator[tuple]:
            """The steps of a value, and its end as character -1."""
            if label in routes:
                states, at = routes[label], 0
                for c in value:
                    yield (label, at, c), 1, 0
                    at = states[at].get(c, 0)
                yield (label, at, -1), 1, 0

        return each

    return make


def _judged(shared):
    def make():
        automata = shared()

        def each(label: str, value: bytes) -> Iterator[tuple]:
            if label in automata:
                yield (label,), 1, round(STEPS * likelihood(automata[label], value))

        return each

    return make


def _word_pairs(label: str, value: bytes) -> Iterator[tuple]:
    for a, b in zip(*_pairs_of(value), strict=True):
        yield (int(a), int(b)), 1, 0


def learn(docs: DataFrame, *, text_col: str = "text", tree: int = TREE, alpha: float = ALPHA, slack: float = SLACK, examples: dict[str, list[bytes]] | None = None) -> Grammar:
    """The grammar of all credentials in a corpus, and of ``examples``, further labelled credentials by label."""
    spark = docs.sparkSession
    rows = docs.select(text_col).mapInArrow(_labelled, "label string, value binary")
    if examples:
        rows = rows.unionByName(spark.createDataFrame([(label, bytearray(v)) for label, more in examples.items() for v in more], "label string, value binary"))
    found = checkpoint(rows.distinct())
    credentials, words = found.where("label <> ''"), found.where("label = ''")

    trees = {label: t for label, t in _trees(credentials, tree).items() if t.arrive[0] >= FEWEST}
    for t in trees.values():
        t.merge(alpha)
    routes = {label: t.routes() for label, t in trees.items()}
    counts: dict[str, dict[int, dict[int, int]]] = {label: {} for label in routes}
    for label, at, c, n, _ in _sums(credentials, _walked(share(spark, routes)), {"label": "string", "at": "int", "c": "int"}).collect():
        counts[label].setdefault(at, {})[c] = n
    states = {label: _likelihoods(counts[label], routes[label]) for label in routes}
    judged = _sums(credentials, _judged(share(spark, states)), {"label": "string"}).collect()
    automata = {r.label: (states[r.label], r.m / STEPS / r.n - slack) for r in sorted(judged)}

    pairs = np.zeros((256, 256))
    for a, b, n, _ in _sums(words, lambda: _word_pairs, {"a": "int", "b": "int"}).collect():
        pairs[a, b] = n
    # Each word begins behind one blank.
    return Grammar(automata, _background(pairs * min(1.0, WORDS / max(pairs[32].sum(), 1.0))))


def _likelihoods(counts: dict[int, dict[int, int]], routes: list[dict[int, int]]) -> list:
    """What ``Automaton.compact`` gives, from the numbers of steps and ends (character -1) of all values by state."""
    out = []
    for at, steps in enumerate(routes):
        used = counts.get(at, {})
        total = sum(used.values()) + 1.0
        known = {c: (steps.get(c, 0), math.log2(max(used.get(c, 0), 0.5) / total)) for c in sorted({*steps, *used} - {-1})}
        out.append((math.log2((used.get(-1, 0) + 0.5) / total), known))
    return out


def _points(text: bytes, places: list[int]) -> list[int]:
    """Code points before each byte place (ascending)."""
    if text.isascii():
        return places
    out, at, n = [], 0, 0
    for p in places:
        n += len(text[at:p].decode("utf-8", "replace"))
        out.append(n)
        at = p
    return out


def in_points(text: bytes, spans: list[Span]) -> list[Span]:
    """Spans in code points, by start, then kind as listed."""
    rank = {k: i for i, k in enumerate((*KINDS, "format"))}
    places = sorted({p for _, s, e in spans for p in (s, e)})
    point = dict(zip(places, _points(text, places), strict=True))
    return sorted(((k, point[s], point[e]) for k, s, e in spans), key=lambda x: (x[1], rank[x[0]]))


SPANS = T.ArrayType(struct(kind=T.StringType(), start=T.IntegerType(), end=T.IntegerType()))


def scan(docs: DataFrame, grammar: Grammar, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and spans, the array of (kind, start, end) of every whole text."""
    shared = share(docs.sparkSession, grammar)

    def make():
        g = shared()

        def kernel(texts: list[bytes]) -> list:
            out = []
            for t in texts:
                base, added = g.spans(t)
                out.append([{"kind": k, "start": s, "end": e} for k, s, e in in_points(t, base + added)] if base or added else [])
            return [out]

        return kernel

    return with_fields(docs, list(keep), text_udf(make, struct(spans=SPANS))(F.col(text_col)))


def mask(text: bytes, spans: list[Span]) -> bytes:
    """The text with each stretch that spans cover replaced by the kind of the span that starts it."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += (text[at:s], b"[%s]" % kind.upper().encode())
        at = max(at, e)
    return b"".join(out) + text[at:]


def redact(docs: DataFrame, grammar: Grammar, *, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The documents with secrets masked in the text (and the length column, if there is one, set anew); other columns as they are."""
    names = docs.columns
    shared = share(docs.sparkSession, grammar)

    def make():
        g = shared()

        def kernel(texts: list[bytes]) -> list:
            clean = [mask(t, [*base, *added]) if (base or added) else None for t in texts for base, added in [g.spans(t)]]
            return [[None if c is None else c.decode("utf-8", "replace") for c in clean]]

        return kernel

    masked = text_udf(make, struct(masked=T.StringType()))(F.col("__text"))
    whole = docs.select(whole_rows(), F.col(text_col).alias("__text")).select("__doc", masked.alias("__r")).select("__doc", F.col("__r.masked").alias("__m"))
    columns = []
    for name in names:
        old = F.col("__doc")[name]
        if name == text_col:
            old = F.coalesce("__m", old)
        elif name == length_col:
            old = F.when(F.col("__m").isNotNull(), F.length("__m").cast(docs.schema[name].dataType)).otherwise(old)
        columns.append(old.alias(name))
    return whole.select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    shared = share(spark, learn(docs))
    returns = struct(n_assign=T.LongType(), n_access=T.LongType(), n_hex=T.LongType(), base_sha256=T.StringType(), spans=T.StringType())

    def make():
        g = shared()
        join = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        none = hashlib.sha256(b"").hexdigest()

        def one(t: bytes) -> tuple:
            base, added = g.spans(t)
            if not base and not added:
                return 0, 0, 0, none, ""
            counts = Counter(k for k, _, _ in base)
            fixed = in_points(t, base)
            return *(counts[k] for k in KINDS), hashlib.sha256(join(fixed).encode()).hexdigest(), join(in_points(t, base + added))

        return lambda texts: [list(c) for c in zip(*map(one, texts), strict=True)] if texts else [[] for _ in returns]

    return with_fields(docs, ["doc_id"], text_udf(make, returns)(F.col("text")))
