"""Gated recurrent language model with class-factored output softmax.

The most frequent tokens (``OWN`` at most) are words of their own: each has its own input vector, stands in a class of
``MEMBERS`` words of like frequency, and its probability is the softmax of its class times the softmax of the word within
the class, both from the state of a gated recurrent unit. All other tokens share classes by their last bytes, apart for
the ``top`` most frequent ones and the rest; in such a class a token has its share of the counts, (count + 1) / (sum over
the class), and the class is what the unit reads. Each class of the rest has one place for tokens never seen, so the
probabilities of all events sum to 1.

The unit is trained in numpy by truncated backpropagation on every training document once, in two rounds: a quarter of
the documents, drawn by hash, then the others. In a round every partition starts from the same weights, and the average
weighted by tokens is what the round gives; so results depend on how the table is partitioned, though not on the order in
which tasks run. A text is scored whole: the state is carried from window to window up to its end token.

Tokens travel as XXH64 hashes (two tokens with one hash would be counted as one). The table of the ``top`` tokens has a
fixed size and is broadcast; counts of all others are joined, one row for a distinct rare token of a document.

Defined results: a null or wordless text is just its end token; a null id is neither held out nor learned from; without
training documents every token is unknown; repeated rows count and are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import compress, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import byte_words as byte_words  # tests hold tokens() against it
from .common import SLICE_BYTES, crc_mod, documents, give_back, one_thread, share, slices, stored, struct, text_udf

#: Tokens whose counts are broadcast, words of their own, words in a class, classes of endings (a quarter of them by hash).
TOP, OWN, MEMBERS, ENDINGS = 300_000, 2_048, 64, 24
#: Tokens seen less often stand with the rest, so that training meets the classes in which unseen tokens will be.
TWICE = 2
HIDDEN = 24
#: Streams that are read side by side in training and in scoring, steps of a window, tokens that are scored in one block, and whose outputs are computed at once.
LANES, SCORE_LANES, WINDOW, BLOCK, PART = 128, 256, 32, 1 << 13, 1 << 10
RATE = 0.01
#: Eighths of the training documents that each round learns from, from the first to below the second.
ROUNDS = ((0, 2), (2, 8))
SEED = 5
#: Rows that averages of weights are gathered in.
SLOTS = 8
#: No word can be this, so its hash stands for the end of a text.
END = b"\n"
#: Distinct words whose counts a task holds at once.
REMEMBERED = 400_000
#: Bytes of text that are read side by side.
SIDE_BY_SIDE = 16 << 20


token_hash = xxhash.xxh64_intdigest


def ending(word: bytes) -> int:
    """A word's last two bytes as a number."""
    return word[-1] << 8 | (word[-2] if len(word) > 1 else 0)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(the tokens of all texts end to end as numbers of words, where each text's tokens end, the words).

    Words are those of byte_words; a word may be there that no token is. Arrow's functions for ASCII leave other bytes as
    they are and do not ask whether they are valid.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_binary()).view(pa.large_string())))
    found = split.values.dictionary_encode()
    numbers, distinct = found.indices.to_numpy(), found.dictionary.view(pa.large_binary())
    # One long string is cut into words faster than Arrow hands them out singly.
    words = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(distinct)], pa.int32()), distinct), pa.scalar(b"\n", pa.large_binary()))[0].as_py().split(b"\n")
    # Blanks at an end of a text leave an empty word there.
    real = numbers != (words.index(b"") if b"" in words else -1)
    ends = np.append(0, np.cumsum(real))[split.offsets.to_numpy()[1:]] + np.arange(1, len(texts) + 1)
    whole = np.full(ends[-1], len(words), np.int32)
    inside = np.ones(len(whole), bool)
    inside[ends - 1] = False
    whole[inside] = numbers[real]
    return whole, ends, [*words, END]


def return_memory() -> None:
    """Let Arrow and the C library return what they hold but do not use; workers live on beside other tasks."""
    pa.default_memory_pool().release_unused()
    give_back()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """texts -> partial counts (h, e, n), in parts of bounded size."""
    held: list[tuple[np.ndarray, ...]] = []

    def merged() -> tuple[np.ndarray, ...]:
        h, e, n = (np.concatenate(column) for column in zip(*held, strict=True))
        h, first, at = np.unique(h, return_index=True, return_inverse=True)
        total = np.zeros(len(h), np.int64)
        np.add.at(total, at, n)
        return h, e[first], total

    def batch(h: np.ndarray, e: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(e), pa.array(n)], names=["h", "e", "n"])

    for b in batches:
        for texts in slices(b.column(0)):
            numbers, _, words = tokens(texts)
            n = np.bincount(numbers, minlength=len(words))
            words = list(compress(words, n > 0))
            held.append((np.fromiter(map(token_hash, words), np.uint64, len(words)), np.fromiter(map(ending, words), np.int32, len(words)), n[n > 0]))
            if sum(len(h) for h, _, _ in held) > 1.5 * REMEMBERED:
                held = [merged()]
                if len(held[0][0]) > REMEMBERED:
                    yield batch(*held.pop())
        return_memory()
    if held:
        yield batch(*merged())


@dataclass
class Vocabulary:
    """What is known of tokens without a join: the frequent ones, and how classes are made up.

    Symbols are what the unit reads and predicts: places of words of their own (``members`` for each class), then classes
    of endings; the symbol after the last one starts a text.
    """

    tokens: int
    distinct: int
    hashes: np.ndarray  # of the top tokens, ascending
    counts: np.ndarray
    symbols: np.ndarray  # of the top tokens
    groups: np.ndarray  # class of endings by ending
    sizes: np.ndarray  # by class of endings: sum of (count + 1), places for unseen tokens included
    own: np.ndarray  # counts by (class, member), 0 where a class is not full

    @property
    def places(self) -> int:
        return self.own.size

    @property
    def n_symbols(self) -> int:
        return self.own.size + len(self.sizes)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among the top tokens, whether it is one)."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return at, self.hashes[at] == hashes


def cut_off(counts: DataFrame, top: int) -> int:
    """The least count, at least TWICE, that no more than ``top`` tokens reach; found on the numbers of tokens by count."""
    numbers = counts.where(F.col("c") >= TWICE).groupBy("c").agg(F.count("*").alias("n"))
    upto = numbers.withColumn("upto", F.sum("n").over(Window.orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, 0)))
    found = upto.agg(F.min(F.when(F.col("upto") <= top, F.col("c")))).first()[0]
    return found if found is not None else 1 << 62


def vocabulary(counts: DataFrame, top: int = TOP, own: int = OWN, members: int = MEMBERS, endings: int = ENDINGS) -> tuple[Vocabulary, int]:
    """The vocabulary of ``counts(h, e, c)`` and the count from which on a token is a top one."""
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    last = cut_off(counts, top)
    best = counts.where(F.col("c") >= last).toArrow()
    h, e, c = (best.column(n).to_numpy() for n in ("h", "e", "c"))
    order = np.lexsort((h, -c))
    h, e, c = h[order], e[order], c[order]
    rest = counts.where(F.col("c") < last).groupBy("e").agg(F.sum(F.col("c") + 1).alias("mass")).toArrow()
    mass = np.zeros(1 << 16)
    np.add.at(mass, e[own:], c[own:] + 1)
    rest_mass = np.zeros(1 << 16)
    rest_mass[rest.column("e").to_numpy()] = rest.column("mass").to_numpy()
    alone = endings - endings // 4
    groups = alone + np.arange(1 << 16) % (endings // 4)
    groups[np.argsort(-(mass + rest_mass), kind="stable")[:alone]] = np.arange(alone)
    n_own = min(own, len(c))
    table = np.zeros(-(-n_own // members) * members, np.int64)
    table[:n_own] = c[:n_own]
    symbols = np.where(np.arange(len(c)) < own, np.arange(len(c)), table.size + groups[e]).astype(np.int32)
    sizes = np.zeros(2 * endings)
    np.add.at(sizes, groups[e[own:]], c[own:] + 1.0)
    np.add.at(sizes, endings + groups, rest_mass)
    sizes[endings:] += 1
    sort = np.argsort(h.view(np.uint64))
    return Vocabulary(tokens, distinct, h.view(np.uint64)[sort], c[sort], symbols[sort], groups.astype(np.int32), sizes, table.reshape(-1, members)), last


class Words:
    """The words of a block of texts by number: their hashes, symbols and top counts."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        self.hash = np.zeros(0, np.uint64)
        self.symbol = np.zeros(0, np.int32)
        self.count = np.zeros(0, np.int64)  # -1: not a top token

    def __len__(self) -> int:
        return len(self.hash)

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all texts end to end as numbers of words, and where each text's end; the words are looked up.

        Texts are taken apart some megabytes at a time; a word that comes in several of these parts has a number in each.
        """
        v, found, n_words, n_tokens = self.vocab, [], 0, 0
        parts = np.flatnonzero(np.diff(np.cumsum([len(t) for t in texts]) // SLICE_BYTES, prepend=0)).tolist()
        for lo, hi in pairwise(sorted({0, *parts, len(texts)})):
            numbers, ends, words = tokens(texts[lo:hi])
            h = np.fromiter(map(token_hash, words), np.uint64, len(words))
            at, known = v.find(h)
            symbol, count = np.zeros(len(words), np.int32), np.full(len(words), -1)
            symbol[known], count[known] = v.symbols[at[known]], v.counts[at[known]]
            rest = [ending(w) if w else 0 for w in compress(words, ~known)]
            symbol[~known] = v.places + len(v.sizes) // 2 + v.groups[np.array(rest, np.int64)]
            found.append((numbers + np.int32(n_words), ends + n_tokens, h, symbol, count))
            n_words, n_tokens = n_words + len(words), n_tokens + len(numbers)
        numbers, ends, self.hash, self.symbol, self.count = (np.concatenate(column) for column in zip(*found, strict=True))
        return_memory()
        return numbers, ends


def _by_gate(rows: np.ndarray) -> np.ndarray:
    """Rows of 3 hidden as (3, rows, hidden), so that each gate's numbers lie side by side; those of r and z halved for ``_advance``."""
    planes = np.ascontiguousarray(rows.reshape(len(rows), 3, -1).transpose(1, 0, 2))
    planes[:2] *= 0.5
    return planes


def _advance(a: np.ndarray, h: np.ndarray, rec: np.ndarray, part: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The state after h, into ``after``; inputs by gate ``a`` become r, z and the candidate, ``part`` what h gives by gate."""
    gates, r, z, n = a[:2], *a
    np.matmul(h, rec, out=part)
    gates += part[:2]
    # A sigmoid is half of tanh at half its place, plus a half.
    np.tanh(gates, out=gates)
    gates *= 0.5
    gates += 0.5
    np.multiply(r, part[2], out=after)
    n += after
    np.tanh(n, out=n)
    np.subtract(h, n, out=after)
    after *= z
    after += n
    return after


class Buffers(dict):
    """Arrays that are used again from one window to the next, as memory for new ones is what small steps would wait for."""

    def get(self, name: str, shape: tuple[int, ...], dtype) -> np.ndarray:
        size = math.prod(shape)
        held = super().get(name)
        if held is None or held.size < size or held.dtype != dtype:
            held = self[name] = np.empty(size, dtype)
        return held[:size].reshape(shape)


@dataclass
class Unit:
    """A gated recurrent unit over symbols with an output softmax over classes and one within each class of words."""

    inp: np.ndarray  # (symbols + 1, 3 hidden): gates r, z and candidate
    rec: np.ndarray  # (hidden, 3 hidden)
    out: np.ndarray  # (hidden, classes)
    bias: np.ndarray  # (classes)
    inner: np.ndarray  # (classes of words, members, hidden)
    inner_bias: np.ndarray  # (classes of words, members)
    moments: list = field(default_factory=list)
    steps: int = 0
    buffers: Buffers = field(default_factory=Buffers)

    @staticmethod
    def start(vocab: Vocabulary, hidden: int = HIDDEN, seed: int = SEED) -> Unit:
        """Small random weights; the outputs start from the shares of the training tokens."""
        rng = np.random.default_rng(seed)
        mass = np.append((vocab.own + (vocab.own > 0)).sum(axis=1), vocab.sizes)
        draw = lambda spread, *shape: rng.normal(0, spread, shape).astype(np.float32)
        # A member that is no word has no weight; exp() of so low a bias is 0.
        within = np.where(vocab.own > 0, np.log(vocab.own + 1.0), -1e9).astype(np.float32)
        within -= within.max(axis=1, keepdims=True, initial=0)
        return Unit(
            draw(0.15, vocab.n_symbols + 1, 3 * hidden),
            draw(0.15, hidden, 3 * hidden),
            draw(0.015, hidden, len(mass)),
            np.log(np.maximum(mass / mass.sum(), 1e-9)).astype(np.float32),
            draw(0.015, *vocab.own.shape, hidden),
            within,
        )

    @property
    def parts(self) -> list[np.ndarray]:
        return [self.inp, self.rec, self.out, self.bias, self.inner, self.inner_bias]

    def vector(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts])

    def filled(self, vector: np.ndarray) -> Unit:
        ends = np.cumsum([p.size for p in self.parts])[:-1]
        return Unit(*(v.reshape(p.shape).astype(np.float32) for v, p in zip(np.split(vector, ends), self.parts, strict=True)))

    def step(self, a: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The state after h for inputs ``a``, rows of ``inp``."""
        return _advance(_by_gate(a), h, _by_gate(self.rec), np.empty((3, *h.shape), h.dtype), np.empty_like(h))

    def classes(self, symbols: np.ndarray) -> np.ndarray:
        places, (n, members) = self.inner_bias.size, self.inner_bias.shape
        return np.where(symbols < places, symbols // members, symbols - places + n)

    def _within(self, states: np.ndarray, symbols: np.ndarray):
        """For words of their own, class by class: their places among the symbols, members, states with a 1 behind them, logits
        (member, word), and (class, words, its weights with the biases behind them) of each class that occurs."""
        members, k = self.inner_bias.shape[1], states.shape[1]
        own = np.flatnonzero((symbols >= 0) & (symbols < self.inner_bias.size))
        cls = (symbols[own] // members).astype(np.min_scalar_type(len(self.inner)))
        own, ends = own[np.argsort(cls, kind="stable")], np.cumsum(np.bincount(cls, minlength=len(self.inner))).tolist()
        s = self.buffers.get("own", (len(own), k + 1), states.dtype)
        s[:, :k] = np.take(states, own, axis=0, out=self.buffers.get("rows", (len(own), k), states.dtype), mode="clip")
        s[:, k] = 1
        logits = self.buffers.get("q", (members, len(own)), states.dtype)
        weights = np.concatenate([self.inner, self.inner_bias[:, :, None]], axis=2)
        spans = [(c, slice(lo, hi), weights[c]) for c, (lo, hi) in enumerate(zip([0, *ends], ends)) if lo < hi]  # noqa: B905
        for _, at, w in spans:
            np.matmul(w, s[at].T, out=logits[:, at])
        return own, symbols[own] % members, s, logits, spans

    def learn(self, x: np.ndarray, y: np.ndarray, fresh: np.ndarray, h: np.ndarray, rate: float = RATE) -> tuple[np.ndarray, float]:
        """One window (steps, lanes): forward from h, back through the window, one Adam step; the state after it and the loss."""
        grads, loss, h = self.gradients(x, y, fresh, h)
        if not self.moments:
            self.moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self.parts]
        self.steps += 1
        scale = rate * math.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps)
        (rows, g), *dense = grads
        # Of the input vectors only those that the window has read move.
        p, m, v = (np.take(w, rows, axis=0) for w in (self.inp, *self.moments[0]))
        self._move(p, g, m, v, scale)
        self.inp[rows], self.moments[0][0][rows], self.moments[0][1][rows] = p, m, v
        for p, g, (m, v) in zip(self.parts[1:], dense, self.moments[1:], strict=True):
            self._move(p, g, m, v, scale)
        # Bounded output weights keep exp() of the logits finite.
        np.clip(self.out, -3, 3, out=self.out)
        np.clip(self.inner, -3, 3, out=self.inner)
        return h, loss

    def _move(self, p: np.ndarray, g: np.ndarray, m: np.ndarray, v: np.ndarray, scale: float) -> None:
        """One Adam step of p along g, all in place."""
        some = self.buffers.get("some", p.shape, p.dtype)
        np.clip(g, -0.25, 0.25, out=g)
        np.subtract(g, m, out=some)
        some *= 0.1
        m += some
        g *= g
        g -= v
        g *= 0.001
        v += g
        np.sqrt(v, out=some)
        some += 1e-8
        np.divide(m, some, out=some)
        some *= scale
        p -= some

    def gradients(self, x, y, fresh, h) -> tuple[list, float, np.ndarray]:
        """Gradients of the mean loss over a window in which y of -1 is no token; those of ``inp`` as (rows, values)."""
        k, (steps, lanes), kind = h.shape[1], x.shape, self.inp.dtype
        room = lambda name, *planes: self.buffers.get(name, (*planes, steps, lanes, k), kind)
        # Few and reused arrays, as a window is to stay near the core.
        a, states, before, held, part = room("a", 3), room("states"), room("before"), room("held"), np.empty((3, lanes, k), kind)
        np.take(_by_gate(self.inp), x, axis=1, out=a, mode="clip")
        rec, some = _by_gate(self.rec), fresh.any(axis=1).tolist()
        for t in range(steps):
            before[t] = h
            if some[t]:
                before[t, fresh[t]] = 0
            h = _advance(a[:, t], before[t], rec, part, states[t])
            held[t] = part[2]
        h = h.copy()
        flat, every = y.ravel(), states.reshape(-1, k)
        total = max(int((flat >= 0).sum()), 1)
        d_states, loss, outer = self._outputs(every, flat, total)
        d_states = d_states.reshape(steps, lanes, k)
        # What reaches the inputs of r and z and the recurrent part of the candidate is what reaches the state, times these.
        (r, z, n), dg = a, room("dg", 3)
        np.subtract(1, z, out=dg[0])
        np.subtract(before, n, out=dg[1])
        dg[1] *= z
        dg[1] *= dg[0]
        n *= n
        own = np.subtract(1, n, out=n)
        own *= dg[0]
        np.multiply(own, r, out=dg[2])
        np.subtract(1, r, out=dg[0])
        dg[0] *= dg[2]
        dg[0] *= held
        back = np.zeros((lanes, k), kind)
        turned = np.ascontiguousarray(self.rec.reshape(k, 3, k).transpose(1, 2, 0))
        for t in range(steps - 1, -1, -1):
            d, now = d_states[t], dg[:, t]
            d += back
            now *= d
            np.multiply(d, z[t], out=back)
            for plane in np.matmul(now, turned, out=part):
                back += plane
            if some[t]:
                back[fresh[t]] = 0
        d_rec = np.matmul(before.reshape(-1, k).T, dg.reshape(3, -1, k))
        own *= d_states
        order = np.argsort(x.ravel().astype(np.min_scalar_type(len(self.inp))), kind="stable")
        ordered, by_symbol = x.ravel()[order], self.buffers.get("by_symbol", (x.size, 3, k), kind)
        starts = np.flatnonzero(np.diff(ordered, prepend=-1))
        for i, plane in enumerate((dg[0], dg[1], own)):
            by_symbol[:, i] = np.take(plane.reshape(-1, k), order, axis=0, out=held.reshape(-1, k), mode="clip")
        rows, d_inp = ordered[starts], np.add.reduceat(by_symbol.reshape(-1, 3 * k), starts, axis=0)
        return [(rows, d_inp), d_rec.transpose(1, 0, 2).reshape(k, 3 * k), *outer], loss / total, h

    def _outputs(self, states: np.ndarray, symbols: np.ndarray, total: int) -> tuple[np.ndarray, float, list[np.ndarray]]:
        """(gradients of the states, summed loss, gradients of out, bias, inner, inner_bias) over symbols, -1 being none."""
        cls, kind, k, loss = self.classes(symbols), states.dtype, states.shape[1], 0.0
        d_states = self.buffers.get("d_states", states.shape, kind)
        d_out, d_bias = np.zeros((len(self.bias), k), kind), np.zeros_like(self.bias)
        turned = np.ascontiguousarray(self.out.T)
        # Probabilities stand by (class, place), so that what belongs to a place is spread along rows.
        for lo in range(0, len(symbols), PART):
            s, y, c = states[lo : lo + PART], symbols[lo : lo + PART], cls[lo : lo + PART]
            p = np.matmul(turned, s.T, out=self.buffers.get("p", (len(turned), len(s)), kind))
            p += self.bias[:, None]
            np.exp(p, out=p)
            p *= 1 / (np.ones(len(p), kind) @ p)
            real = y >= 0
            at = np.flatnonzero(real)
            picked = p[c[at], at]
            loss -= float(np.log(np.maximum(picked, 1e-30)).sum())
            p[c[at], at] = picked - 1
            p *= 1 / total if len(at) == len(y) else (real / total).astype(kind)
            d_out += p @ s
            d_bias += p @ np.ones(len(s), kind)
            np.matmul(p.T, turned, out=d_states[lo : lo + PART])
        d_inner = np.zeros((*self.inner_bias.shape, k + 1), kind)
        own, member, s, q, spans = self._within(states, symbols)
        np.exp(q, out=q)
        q *= 1 / (np.ones(len(q), kind) @ q)
        places = np.arange(len(own))
        picked = q[member, places]
        loss -= float(np.log(np.maximum(picked, 1e-30)).sum())
        q[member, places] = picked - 1
        q *= 1 / total
        d_own = self.buffers.get("d_own", s.shape, kind)
        for c, at, w in spans:
            np.matmul(q[:, at], s[at], out=d_inner[c])
            np.matmul(q[:, at].T, w, out=d_own[at])
        d_states[own] += d_own[:, :k]
        return d_states, loss, [d_out.T, d_bias, np.ascontiguousarray(d_inner[:, :, :k]), np.ascontiguousarray(d_inner[:, :, k])]

    def log_odds(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Natural log probability of each symbol after its state."""
        got, cls, kind = np.empty(len(symbols)), self.classes(symbols), states.dtype
        turned = np.ascontiguousarray(self.out.T)
        for lo in range(0, len(symbols), PART):
            s = states[lo : lo + PART]
            logits = np.matmul(turned, s.T, out=self.buffers.get("p", (len(turned), len(s)), kind))
            logits += self.bias[:, None]
            picked = logits[cls[lo : lo + PART], np.arange(len(s))]
            got[lo : lo + PART] = picked - np.log(np.ones(len(logits), kind) @ np.exp(logits, out=logits))
        own, member, _, logits, _ = self._within(states, symbols)
        picked = logits[member, np.arange(len(own))]
        got[own] += picked - np.log(np.ones(len(logits), kind) @ np.exp(logits, out=logits))
        return got

    def score(self, texts: list[np.ndarray], lanes: int = SCORE_LANES) -> np.ndarray:
        """Natural log likelihood of each sequence of symbols (at least one long).

        Whole texts queue up in lanes that are read side by side; a text starts from the zero state, and the state is
        carried to its end.
        """
        if not texts:
            return np.zeros(0)
        lengths = np.array([len(t) for t in texts])
        lanes = max(1, min(lanes, len(texts), int(lengths.sum() // lengths.max())))
        loads, queues = [(0, i) for i in range(lanes)], [[] for _ in range(lanes)]
        for i in np.argsort(-lengths, kind="stable"):
            load, lane = heapq.heappop(loads)
            queues[lane].append(i)
            heapq.heappush(loads, (load + int(lengths[i]), lane))
        queues.sort(key=lambda q: -int(lengths[q].sum()))
        ends = np.array([int(lengths[q].sum()) for q in queues])
        y, fresh = np.zeros((ends[0], lanes), np.int32), np.zeros((ends[0], lanes), bool)
        for lane, queue in enumerate(queues):
            y[: ends[lane], lane] = np.concatenate([texts[i] for i in queue])
            fresh[np.append(0, np.cumsum(lengths[queue])[:-1]), lane] = True
        x = np.vstack([y[:1], y[:-1]])
        x[fresh] = len(self.inp) - 1
        some, logs = fresh.any(axis=1).tolist(), np.zeros(y.shape)
        inp, rec, k = _by_gate(self.inp), _by_gate(self.rec), self.rec.shape[0]
        h = np.zeros((lanes, k), np.float32)
        t = 0
        while t < ends[0]:
            live = int(np.searchsorted(-ends, -t, side="left"))
            stop = min(int(ends[live - 1]), t + max(1, BLOCK // live))
            states = self.buffers.get("states", (stop - t, live, k), h.dtype)
            a, part = (self.buffers.get(name, (3, live, k), h.dtype) for name in ("a", "part"))
            h = h[:live]
            for u in range(t, stop):
                if some[u]:
                    h = h * ~fresh[u, :live, None]
                np.take(inp, x[u, :live], axis=1, out=a, mode="clip")
                h = _advance(a, h, rec, part, states[u - t])
            logs[t:stop, :live] = self.log_odds(states.reshape(-1, k), y[t:stop, :live].ravel()).reshape(-1, live)
            h, t = h.copy(), stop
        result = np.zeros(len(texts))
        for lane, queue in enumerate(queues):
            result[queue] = np.add.reduceat(logs[: ends[lane], lane], np.append(0, np.cumsum(lengths[queue])[:-1]))
        return result


def _streams(texts: list[np.ndarray], start: int, lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts end to end in equal lanes: (symbol before, symbol, whether a text starts), each (steps, lanes).

    Small parts are read in fewer lanes, so that they make more windows. Behind the last text symbols are -1.
    """
    y = np.concatenate(texts)
    fresh = np.zeros(len(y), bool)
    fresh[np.cumsum([0, *map(len, texts[:-1])])] = True
    x = np.append(start, y[:-1]).astype(np.int32)
    x[fresh] = start
    lanes = max(1, min(lanes, max(len(y) // 4096, 16), len(y)))
    n = -(-len(y) // lanes)
    fill = lambda a, v: np.append(a, np.full(n * lanes - len(y), v, a.dtype)).reshape(lanes, n).T
    return fill(x, start), fill(y.astype(np.int32), -1), fill(fresh, False)


def _symbol_texts(texts: list[bytes], words: Words) -> list[np.ndarray]:
    numbers, ends = words.read(texts)
    return np.split(words.symbol[numbers], ends[:-1])


def _train_task(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        vocab, unit, rate = shared()
        words, n = Words(vocab), 0
        for b in batches:
            for texts in slices(b.column(0), SIDE_BY_SIDE):
                x, y, fresh = _streams(_symbol_texts(texts, words), vocab.n_symbols, LANES)
                h = np.zeros((x.shape[1], HIDDEN), np.float32)
                for t in range(0, len(x), WINDOW):
                    h, _ = unit.learn(x[t : t + WINDOW], y[t : t + WINDOW], fresh[t : t + WINDOW], h, rate)
                n += int((y >= 0).sum())
        if n:
            slot = TaskContext.get().partitionId() % SLOTS
            yield pa.RecordBatch.from_arrays([pa.array([slot]), pa.array([n]), pa.array([unit.vector().tobytes()], pa.binary())], names=["slot", "n", "v"])

    return run


def _add_up(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums over a slot's rows of n and of weights times n, added one row after another."""
    total, n = 0.0, 0
    for b in batches:
        for m, v in zip(b.column("n").to_pylist(), b.column("v"), strict=True):
            total, n = total + m * np.frombuffer(v.as_py(), np.float32).astype(np.float64), n + m
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["n", "v"])


def train(texts: DataFrame, vocab: Vocabulary, rounds: tuple = ROUNDS) -> Unit:
    """The unit after the rounds over ``texts(text)``, each started in every partition from the last round's average."""
    unit = Unit.start(vocab)
    part = F.pmod(F.xxhash64(texts.columns[0]), F.lit(8))
    for i, (low, high) in enumerate(rounds):
        shared = share(texts.sparkSession, (vocab, unit, RATE / (1 + i)))
        trained = texts.where((part >= low) & (part < high)).mapInArrow(_train_task(shared), "slot long, n long, v binary")
        rows = trained.groupBy("slot").applyInArrow(_add_up, "n long, v binary").collect()
        if rows:
            unit = unit.filled(sum(np.frombuffer(bytes(r.v), np.float64) for r in rows) / sum(r.n for r in rows))
    return unit


PARTS = struct(
    n_tokens=T.LongType(), n_top=T.LongType(), top_logs=T.DoubleType(), rest_logs=T.DoubleType(), unit_logs=T.DoubleType(), rare=T.ArrayType(T.LongType()), times=T.ArrayType(T.IntegerType())
)


def parts_udf(shared):
    """Text to PARTS: what of its scores follows from the top tokens and the unit, and its other tokens with their numbers."""

    def make():
        one_thread()
        vocab, unit = shared()
        words = Words(vocab)
        log_sizes = np.append(np.zeros(vocab.places), np.log10(np.maximum(vocab.sizes, 1)))

        def kernel(texts: list[bytes]) -> list:
            numbers, ends = words.read(texts)
            starts, lengths = np.append(0, ends[:-1]), np.diff(ends, prepend=0)
            unit_logs = unit.score(np.split(words.symbol[numbers], ends[:-1])) / math.log(10)
            top_log = np.log10(np.maximum(words.count, 0) + 1.0)
            rest_log = np.where(words.symbol < vocab.places, 0.0, top_log) - log_sizes[words.symbol]
            far = np.flatnonzero((words.count < 0)[numbers])
            pairs, times = np.unique(np.searchsorted(ends, far, side="right") * len(words) + numbers[far], return_counts=True)
            of, far_words = np.divmod(pairs, len(words))
            n_far = np.bincount(of, times, minlength=len(texts)).astype(np.int64)
            cuts = np.searchsorted(of, np.arange(1, len(texts)))
            return [
                lengths,
                lengths - n_far,
                np.add.reduceat(top_log[numbers], starts),
                np.add.reduceat(rest_log[numbers], starts),
                unit_logs,
                np.split(words.hash[far_words].view(np.int64), cuts),
                np.split(times.astype(np.int32), cuts),
            ]

        return kernel

    return text_udf(make, PARTS, SIDE_BY_SIDE)


def score(docs: DataFrame, training: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", top: int = TOP) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row, learned from the texts of ``training``."""
    counted = training.select(text_col).mapInArrow(_count, "h long, e int, n long")
    counts = stored(counted.groupBy("h").agg(F.min("e").alias("e"), F.sum("n").alias("c")), "counts")
    vocab, last = vocabulary(counts, top)
    unit = train(training.select(text_col), vocab)
    shared = share(docs.sparkSession, (vocab, unit))
    read = docs.select(F.col(id_col).alias("doc_id"), parts_udf(shared)(F.col(text_col)).alias("r"))
    parts = stored(read.select("doc_id", "r.*", F.monotonically_increasing_id().alias("key")), "parts")
    rare = parts.select("key", F.explode(F.arrays_zip("rare", "times")).alias("z")).select("key", F.col("z.rare").alias("rare"), F.col("z.times").alias("times"))
    others = counts.where(F.col("c") < last).select("h", "c")
    joined = rare.join(others, F.col("rare") == F.col("h"), "left")
    sums = joined.groupBy(F.col("key").alias("k")).agg(
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("rare_logs"), F.sum(F.when(F.col("c") > 0, F.col("times"))).alias("rare_known")
    )
    whole = parts.select("key", "doc_id", "n_tokens", "n_top", "top_logs", "rest_logs", "unit_logs").join(sums, F.col("key") == F.col("k"), "left")
    rare_logs = F.coalesce("rare_logs", F.lit(0.0))
    return whole.select(
        "doc_id",
        "n_tokens",
        (F.col("n_top") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("top_logs") + rare_logs - F.col("n_tokens") * F.lit(math.log10(vocab.tokens + vocab.distinct + 1))).alias("base_score"),
        (F.col("unit_logs") + F.col("rest_logs") + rare_logs).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score(docs, docs.where(crc_mod("doc_id", 7) != 2))
    return scored.withColumn("held_out", F.coalesce(crc_mod("doc_id", 7) == 2, F.lit(False)))
