import itertools
import random

import pytest
import xxhash

from keyloom.llm import simhash


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(prints, radius=2):
    """{print: set of prints reachable}, over all pairs."""
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(set(prints), 2):
        if (a ^ b).bit_count() <= radius:
            parent[find(a)] = find(b)
    return {p: find(p) for p in prints}


def test_fingerprint_matches_definition():
    rng = random.Random(3)
    words = ["The", "cat", "é", "Ünd", "x" * 50, " ", "ÀB", "on"]
    texts = ["", "one", "two words", " \t\n", "A\x1cB c d"] + [rng.choice([" ", "\n", "\t "]).join(rng.choices(words, k=k)) for k in (3, 4, 9, 255, 700)]
    for t in texts:
        assert simhash.fingerprint(t.encode()) == plain_fingerprint(t)


def test_fingerprint_blocks(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(1000)).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "BLOCK", 64)
    assert simhash.fingerprint(text) == whole


def test_tree_finds_all_within_radius():
    rng = random.Random(5)
    items = [rng.getrandbits(12) for _ in range(300)]
    tree = simhash.BKTree()
    for x in items:
        tree.add(x)
    for q in items[:40]:
        assert sorted(tree.within(q, 2)) == sorted({x for x in items if (x ^ q).bit_count() <= 2})


@pytest.mark.parametrize("limit", [2048, 16])
def test_classes_match_all_pairs(spark, limit):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(12)]
    prints = []
    for b in base:
        x = b
        for _ in range(rng.randrange(1, 30)):
            for _ in range(rng.randrange(1, 4)):
                x ^= 1 << rng.randrange(64)
            prints.append(x)
    prints += base[:3]
    signed = [(i + 100, simhash._signed(p)) for i, p in enumerate(prints)]
    df = spark.createDataFrame(signed, "doc_id long, bits long")
    got = {r.bits & (1 << 64) - 1: r.component_id for r in simhash.classes(df, tree_limit=limit).collect()}
    roots = plain_classes(prints)
    want = {p: min(i + 100 for i, q in enumerate(prints) if roots[q] == roots[p]) for p in prints}
    assert got == want


def test_rows_of_every_kind(spark):
    text = "a b c d e f g h i j k l m n"
    rows = [(5, text, 1), (2, text, 2), (2, text, 3), (7, None, 4), (8, "", 5), (None, "quite another text here", 6), (9, "lone", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, bits int")
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == [(-1, None), (2, 2), (2, 2), (5, 2), (7, 7), (8, 7), (9, 9)]
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.bits for r in kept.collect()) in ([2, 4, 6, 7], [3, 4, 6, 7])


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0 and simhash.keep_one(df).count() == 0


def test_tree_limit_below_what_splits_reach(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "bits long"), tree_limit=3)
