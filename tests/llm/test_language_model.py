import math
import os
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

from keyloom.llm import language_model as lm

SF = "/root/testdata/sf0.001"


def small(rng=None, classes=2, members=3, rest=2, hidden=4):
    """A unit over few symbols; its places, if ``rng`` is given, are drawn in double precision."""
    vocab = lm.Vocabulary(0, 0, np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int32), np.zeros(0), np.full(rest, 5.0), np.full((classes, members), 7))
    unit = lm.Unit.start(vocab, hidden=hidden)
    return unit if rng is None else lm.Unit(*(rng.normal(0, 0.5, p.shape) for p in unit.parts))


def plain_log_odds(unit, h, y):
    z = (h @ unit.out + unit.bias).astype(float)
    places, members = unit.inner_bias.size, unit.inner_bias.shape[1]
    c = y // members if y < places else len(unit.inner) + y - places
    got = z[c] - np.log(np.exp(z).sum())
    if y < places:
        z = (unit.inner[c] @ h + unit.inner_bias[c]).astype(float)
        got += z[y % members] - np.log(np.exp(z).sum())
    return got


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    unit = small(rng)
    x, y, fresh = rng.integers(0, 9, (5, 3)), rng.integers(-1, 8, (5, 3)), rng.random((5, 3)) < 0.3
    h = rng.normal(0, 0.5, (3, 4))
    (rows, g_inp), *grads = unit.gradients(x, y, fresh, h)[0]
    whole = np.zeros_like(unit.inp)
    whole[rows] = g_inp
    for p, g in zip(unit.parts, [whole, *grads], strict=True):
        for i in list(np.ndindex(p.shape))[::3]:
            old, eps = p[i], 1e-5
            p[i] = old + eps
            up = unit.gradients(x, y, fresh, h)[1]
            p[i] = old - eps
            down = unit.gradients(x, y, fresh, h)[1]
            p[i] = old
            assert math.isclose(g[i], (up - down) / (2 * eps), rel_tol=1e-3, abs_tol=1e-6)


def test_scores_side_by_side_are_those_of_single_texts():
    rng = np.random.default_rng(2)
    unit = small(hidden=5)
    unit = unit.filled(rng.normal(0, 0.5, unit.vector().shape))
    texts = [rng.integers(0, 8, n).astype(np.int32) for n in (1, 40, 7, 7, 900, 1, 33, 900, 2000, 5)]
    for lanes in (1, 3, 256):
        for t, score in zip(texts, unit.score(texts, lanes), strict=True):
            h, x, total = np.zeros((1, 5), np.float32), 8, 0.0
            for y in t:
                h = unit.step(unit.inp[[x]], h)
                total += plain_log_odds(unit, h[0], y)
                x = y
            assert math.isclose(score, total, rel_tol=1e-4)


def test_all_events_sum_to_one():
    unit = small()
    unit = unit.filled(np.random.default_rng(3).normal(0, 0.5, unit.vector().shape))
    h = np.random.default_rng(4).normal(0, 0.5, (1, 4)).astype(np.float32)
    assert math.isclose(np.exp(unit.log_odds(np.repeat(h, 8, axis=0), np.arange(8))).sum(), 1, rel_tol=1e-5)


def test_training_lowers_the_loss():
    unit = small(hidden=lm.HIDDEN)
    y = np.tile(np.array([[0], [4], [6], [3]], np.int32), (8, 4))
    x = np.vstack([np.full((1, 4), 8, np.int32), y[:-1]])
    fresh, h, losses = np.zeros(y.shape, bool), np.zeros((4, lm.HIDDEN), np.float32), []
    for _ in range(300):
        h, loss = unit.learn(x, y, fresh, h)
        losses.append(loss)
    assert losses[-1] < 0.1 * losses[0]


def test_no_token_is_left_out_of_training():
    texts = [np.arange(n, dtype=np.int32) for n in (5, 1, 70, 3)]
    for lanes in (1, 4, 16, 128):
        x, y, fresh = lm._streams(texts, 99, lanes)
        flat = y.T.ravel()
        assert flat[flat >= 0].tolist() == np.concatenate(texts).tolist()
        firsts = fresh.T.ravel()
        assert firsts.sum() == 4 and (flat[firsts] == 0).all() and (x.T.ravel()[firsts] == 99).all()


def test_vocabulary_sums_to_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = docs.select("text").mapInArrow(lm._count, "h long, e int, n long").groupBy("h").agg({"e": "min", "n": "sum"}).toDF("h", "e", "c")
    vocab, last = lm.vocabulary(counts, top=500, own=100, members=16)
    rows = counts.collect()
    top = {int(h): (c, k) for h, c, k in zip(vocab.hashes, vocab.counts, vocab.symbols, strict=True)}
    assert len(top) == sum(r.c >= last for r in rows) <= 500 < sum(r.c >= last - 1 for r in rows)
    sizes, own = np.zeros(len(vocab.sizes)), np.zeros(vocab.own.size)
    for r in rows:
        h = r.h & (1 << 64) - 1
        k = top[h][1] if h in top else vocab.places + lm.ENDINGS + vocab.groups[r.e]
        if k < vocab.places:
            own[k] = r.c
        else:
            sizes[k - vocab.places] += r.c + 1
    sizes[lm.ENDINGS :] += 1
    assert np.allclose(sizes, vocab.sizes) and (own == vocab.own.ravel()).all() and (own > 0).sum() == 100
    assert min(own[own > 0]) >= max(c for c, k in top.values() if k >= vocab.places)
    assert vocab.tokens == sum(r.c for r in rows) and not lm.Words(vocab)


@pytest.mark.parametrize("top", [lm.TOP, 300])
def test_base_columns_match_plain_counts(spark, top):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    tokens = {i: [*"".join(c.lower() if c.isascii() else c for c in t).replace("\n", " ").split(" "), "\n"] for i, t in texts.items()}
    tokens = {i: [w for w in t if w] for i, t in tokens.items()}
    counts = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    total = sum(counts.values())
    for r in lm.score(docs, docs.where(lm.crc_mod("doc_id", 7) != 2), top=top).collect():
        t = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(w in counts for w in t), total)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in t), rel_tol=1e-9)
        assert r.score < 0


def test_better_than_counts_alone_on_texts_held_out(spark):
    rows = [r for r in lm.query(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_rows_of_every_kind(spark):
    rows = [(i, f"a b c d{i % 3} e", 0.5) for i in range(40)] + [(None, "a b zz", None), (90, None, 1.0), (90, "", 1.0), (91, "long " * 30_000, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = lm.score(docs, docs.where("doc_id < 40")).collect()
    assert len(got) == 44
    by = {r.doc_id: r for r in got}
    assert (by[None].n_tokens, by[None].n_known) == (4, 3) and by[90].n_tokens == 1 and (by[91].n_tokens, by[91].n_known) == (30_001, 1)
    none = lm.score(docs, docs.where("false")).collect()
    assert len(none) == 44 and all(r.n_known == 0 and r.base_score == 0 for r in none)
    empty = docs.where("false")
    assert lm.score(empty, empty).count() == 0


def test_unit_learns_from_each_training_document_once(spark, monkeypatch):
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat('some words ', id) AS text")
    part = lm.F.pmod(lm.F.xxhash64("text"), lm.F.lit(8))
    seen = [docs.where((part >= low) & (part < high)).count() for low, high in lm.ROUNDS]
    assert sum(seen) == 4000 and min(seen) > 800
    got = []

    def train(texts, vocab):
        got.append(texts.count())
        return lm.Unit.start(vocab)

    monkeypatch.setattr(lm, "train", train)
    assert lm.score(docs, docs).count() == 4000 and got == [4000]


def test_scores_are_those_of_a_plain_walk(spark, monkeypatch):
    """The query's scores for given weights, word by word, with counts of all training tokens in one dictionary."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = {}

    def train(texts, vocab):
        unit = lm.Unit.start(vocab)
        held["vocab"], held["unit"] = vocab, unit.filled(np.random.default_rng(1).normal(0, 0.3, unit.vector().shape) + unit.vector())
        return held["unit"]

    monkeypatch.setattr(lm, "train", train)
    training = docs.where(lm.crc_mod("doc_id", 7) != 2)
    got = {r.doc_id: r.score for r in lm.score(docs, training, top=3000).collect()}
    vocab, unit = held["vocab"], held["unit"]
    tokens = lambda text: [*lm.byte_words((text or "").encode()), lm.END]
    counts = Counter(w for r in training.collect() for w in tokens(r.text))
    top = {int(h): int(k) for h, k in zip(vocab.hashes, vocab.symbols, strict=True)}
    for r in docs.collect()[:25]:
        h, x, total = np.zeros((1, lm.HIDDEN), np.float32), vocab.n_symbols, 0.0
        for w in tokens(r.text):
            h = unit.step(unit.inp[[x]], h)
            x = top.get(lm.token_hash(w), vocab.places + lm.ENDINGS + int(vocab.groups[lm.ending(w)]))
            total += plain_log_odds(unit, h[0], x)
            if x >= vocab.places:
                total += math.log((counts[w] + 1) / vocab.sizes[x - vocab.places])
        assert math.isclose(got[r.doc_id], total / math.log(10), rel_tol=1e-3)


def test_products_use_one_thread():
    code = "import time, numpy as np; from keyloom.llm.common import one_thread; one_thread(); a = np.ones((400, 400)); w, c = time.perf_counter(), time.process_time(); [a @ a for _ in range(300)]; print((time.process_time() - c) / (time.perf_counter() - w))"
    out = subprocess.run([sys.executable, "-c", code], env=os.environ | {"OMP_NUM_THREADS": "4"}, cwd=os.path.dirname(os.path.dirname(os.path.dirname(__file__))), capture_output=True, text=True, timeout=60)
    assert float(out.stdout) < 1.5, out.stderr


ODD = [b"", b"  ", b" a  b ", b"A\tA\r\nb\x00c \x0b\x0c", b"x\x1cZ \xff\xfeQ \xc3\x84\xc3\xa4\x85 \xc2\xa0 ", b"\n", b"a"]


def test_tokens_are_those_of_a_plain_split(monkeypatch):
    rng = np.random.default_rng(6)
    drawn = [bytes(rng.choice(list(b" \n\x0b\x1cAbZ\xff\xa0\x85"), rng.integers(12)).tolist()) for _ in range(300)]
    vocab = lm.Vocabulary(0, 0, np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int32), np.arange(1 << 16), np.zeros(2), np.zeros((0, 64)))
    for size in (1, 5, 1 << 20):
        monkeypatch.setattr(lm, "SLICE_BYTES", size)
        for texts in (ODD, [b""], drawn, ODD[2:3]):
            plain = [[*lm.byte_words(t), lm.END] for t in texts]
            numbers, ends, words = lm.tokens(texts)
            assert [[words[i] for i in n] for n in np.split(numbers, ends[:-1])] == plain
            read = lm.Words(vocab)
            numbers, ends = read.read(texts)
            assert [read.hash[n].tolist() for n in np.split(numbers, ends[:-1])] == [[lm.token_hash(w) for w in p] for p in plain]
            assert read.symbol[numbers].tolist() == [1 + lm.ending(w) for p in plain for w in p]


@pytest.mark.parametrize("remembered", [1, 3, lm.REMEMBERED])
def test_counts_in_parts_add_up_and_no_text_is_split_in_python(monkeypatch, remembered):
    plain = Counter(w for t in ODD * 3 for w in [*lm.byte_words(t), lm.END])
    monkeypatch.setattr(lm, "REMEMBERED", remembered)
    monkeypatch.setattr(lm, "byte_words", None)
    got = Counter()
    for part in lm._count(iter([lm.pa.RecordBatch.from_arrays([lm.pa.array(ODD, lm.pa.binary())], names=["text"])] * 3)):
        for h, e, n in zip(*(c.to_pylist() for c in part.columns), strict=True):
            got[h & (1 << 64) - 1, e] += n
    assert got == {(lm.token_hash(w), lm.ending(w)): n for w, n in plain.items()}


def test_classes_of_words_share_one_exponential(monkeypatch):
    unit, calls, exp = small(classes=20, hidden=5), [], np.exp
    y = np.random.default_rng(7).integers(0, 62, (8, 16))
    monkeypatch.setattr(lm.np, "exp", lambda *a, **k: calls.append(1) or exp(*a, **k))
    unit.learn(y, y, np.zeros(y.shape, bool), np.zeros((16, 5), np.float32))
    assert len(calls) == 2
    unit.log_odds(np.zeros((128, 5), np.float32), y.ravel())
    assert len(calls) == 4
