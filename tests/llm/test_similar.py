import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as cp
from keyloom.llm import simhash, similar


def plain_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(rows):
    """Ids that stay, over all pairs."""
    sets, parent = {i: plain_shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    return sorted(i for i in parent if find(i) == i)


def corpus():
    rng, rows = random.Random(2), []
    passage = " ".join(f"p{i}" for i in range(40))
    for _ in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 30, 120, 200]))]
        for _ in range(rng.randrange(1, 9)):
            words = list(words)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(5000)}"
            rows.append(" ".join(words) + (" " + passage if rng.random() < 0.3 else ""))
    return list(enumerate([*rows, "", None, " "], 10))


def test_similar_texts_are_within_the_radius():
    """Of long texts at a similarity of 0.8, the least that counts, none may differ in more bits than the filter lets pass."""
    rng, most = np.random.default_rng(5), 0
    for n in (64, 100, 1000):
        for _ in range(300):
            pool = rng.integers(0, 1 << 63, n + n // 4, dtype=np.uint64)
            x, y = np.unique(pool[:n]), np.unique(pool[n // 9 : n + n // 9])
            assert len(np.intersect1d(x, y)) * 5 >= 4 * len(np.union1d(x, y)) - 5
            most = max(most, (simhash.majority(x) ^ simhash.majority(y)).bit_count())
    assert 12 < most <= similar.RADIUS


def test_fingerprint_is_the_majority():
    text = " ".join(f"w{i % 50}" for i in range(400)).encode()
    bits = [sum(int(h) >> k & 1 for h in similar.shingles(text)) for k in range(64)]
    n = len(similar.shingles(text))
    assert simhash.majority(similar.shingles(text)) == sum(1 << k for k, ones in enumerate(bits) if 2 * ones > n)
    assert simhash.majority(np.zeros(0, np.uint64)) == 0


def plain_candidates(rows):
    """Pairs of one shingle with different roots that may be similar, one by one."""
    out = set()
    for (h, n, x, p, a, r), (g, m, y, q, b, s) in itertools.combinations(rows, 2):
        near = (a ^ b).bit_count() <= similar.RADIUS or min(n, m) < similar.LONG
        if h == g and r != s and 5 * min(n, m) >= 4 * max(n, m) and 9 * min(n - p, m - q) >= 4 * (n + m) and near:
            out.add((min(x, y), max(x, y)))
    return out


@pytest.mark.parametrize("block", [1, 3, 7, 1 << 16])
def test_crossing_is_that_of_all_pairs(monkeypatch, block):
    monkeypatch.setattr(similar, "BLOCK", block)
    monkeypatch.setattr(similar, "PAIRS", 5)
    rng = random.Random(11)
    for _ in range(40):
        rows = [(rng.randrange(3), rng.choice([9, 10, 20, 70, 80, 90]), i, rng.randrange(12), rng.choice([0, 1, (1 << 40) - 1]), rng.randrange(5)) for i in range(rng.randrange(60))]
        rows.sort()
        batch = lambda part: pa.RecordBatch.from_arrays([pa.array([r[k] for r in part], pa.int64()) for k in range(6)], names=list("hnvpbr"))
        cut = rng.randrange(len(rows) + 1)
        got = {(u, v) for b in similar._crossing(iter([batch(rows[:cut]), batch(rows[cut:])])) for u, v in zip(*(c.to_pylist() for c in b.columns), strict=True)}
        assert got == plain_candidates(rows)


def test_shared_rows_and_hubs():
    rng = random.Random(12)
    for _ in range(60):
        rows = sorted({(rng.randrange(6), rng.randrange(3), rng.randrange(9)) for _ in range(rng.randrange(25))})
        place = {(h, v): p for h, p, v in rows}
        rows = sorted((h, p, v) for (h, v), p in place.items())
        twice = sorted(rows + [r for r in rows if rng.random() < 0.3])
        cut = rng.randrange(len(twice) + 1)
        batch = lambda part: pa.RecordBatch.from_arrays([pa.array([r[k] for r in part], pa.int64()) for k in range(len(part[0]) if part else 3)], names=list("hpvnb")[: len(part[0]) if part else 3])
        got = [r for b in similar._shared(iter([batch(twice[:cut]), batch(twice[cut:])])) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        nodes = {h: {v for g, _, v in rows if g == h} for h, _, _ in rows}
        assert got == [r for r in rows if len(nodes[r[0]]) > 1]
        whole = [(*r, 20, 0) for r in rows]
        cut = rng.randrange(len(whole) + 1)
        parts = [batch(p) for p in (whole[:cut], whole[cut:]) if p]
        pairs = {(u, v) for b in similar._to_hub(iter(parts)) for u, v in zip(*(c.to_pylist() for c in b.columns), strict=True)}
        hub = {h: next(v for g, _, v in rows if g == h) for h in nodes}
        assert pairs == {(min(v, hub[h]), max(v, hub[h])) for h, p, v in rows if v != hub[h] and 9 * (20 - p) >= 160}


def test_a_family_of_edited_copies_makes_few_candidates(spark):
    """Copies with up to six edits each, most of them less alike than 0.8 to each other."""
    rng, words = random.Random(13), [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(words))]
    for i in range(1, 400):
        edited = list(words)
        for at in rng.sample(range(150), rng.randrange(1, 7)):
            edited[at] = f"x{rng.random()}"
        rows.append((i, " ".join(edited)))
    made = []
    verified = similar.verified

    def counted(pairs, *rest):
        made.append(pairs.count())
        return verified(pairs, *rest)

    similar.verified = counted
    try:
        got = similar.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
        assert sorted(r.doc_id for r in got.collect()) == plain_kept(rows)
    finally:
        similar.verified = verified
    assert sum(made) < 10 * len(rows)


def test_all_similar_pairs_are_joined(spark):
    rows = corpus()
    got = similar.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == plain_kept(rows)


def test_trees_give_candidates_of_the_stage(spark, monkeypatch):
    """Fingerprints within two bits are linked by BK-trees, and what they give is verified with the other candidates."""
    rng, rows = random.Random(8), []
    for i in range(60):
        bits = rng.getrandbits(63)
        rows += [(10 * i + j, bits ^ (1 << rng.randrange(63)) * (j == 2), 100 + 30 * (j == 3)) for j in range(4)]
    got = {(r.u, r.v) for r in similar.near(spark.createDataFrame(rows, "node long, bits long, n int")).collect()}
    by = {r[0]: r for r in rows}
    assert all(u < v and (by[u][1] ^ by[v][1]).bit_count() <= 2 and by[u][2] == by[v][2] for u, v in got)
    assert {(10 * i, 10 * i + 1) for i in range(60)} <= got and {10 * i + 2 for i in range(60)} <= {x for pair in got for x in pair}

    given, verified, made = [], similar.verified, similar.near
    monkeypatch.setattr(similar, "near", lambda reps: given.append(made(reps).collect()) or made(reps))
    tested = []
    monkeypatch.setattr(similar, "verified", lambda pairs, *rest: tested.append(pairs.collect()) or verified(pairs, *rest))
    long = [f"v{i}" for i in range(3000)]
    texts = [(1, " ".join(long)), (2, " ".join([*long, "last"])), (3, "a text of its own")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert sorted(r.doc_id for r in cp.duplicate_stage(spark, docs, "").collect()) == plain_kept(texts) == [1, 3]
    assert given[0] and set(given[0]) <= set(tested[0])


def test_stage_finds_edited_copies_beyond_two_bits(spark):
    words = [f"w{i}" for i in range(200)]
    edited = list(words)
    for at in (20, 70, 120, 170):
        edited[at] = "other"
    texts = [" ".join(words), " ".join(edited)]
    assert (simhash.fingerprint(texts[0].encode()) ^ simhash.fingerprint(texts[1].encode())).bit_count() > 2
    docs = spark.createDataFrame([(2, texts[0]), (1, texts[1]), (3, "quite another text of its own")], "doc_id long, text string")
    assert sorted(r.doc_id for r in cp.duplicate_stage(spark, docs, "").collect()) == [1, 3]


def test_rows_without_ids_and_empty(spark):
    text = "a b c d e f g h i j"
    docs = spark.createDataFrame([(None, text, 1), (4, text, 2), (None, "lone", 3), (None, "lone", 4)], "doc_id long, text string, root int")
    assert sorted(r.root for r in similar.keep_one(docs).collect()) in ([2, 3], [2, 4])
    assert similar.keep_one(docs.limit(0)).count() == 0
