import hashlib
import math
import random

import pytest

from keyloom.llm import mixing


def plain_targets(sizes, weights, repeat):
    """Excess over the limits is shared again by weight until none is above."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, target, free = sum(sizes.values()), dict.fromkeys(sizes, 0.0), set(sizes)
    left = float(total)
    while left > 1e-9 and free:
        share = left / sum(weight[s] for s in free)
        for s in free:
            target[s] += share * weight[s]
        left = 0.0
        for s in list(free):
            if target[s] >= repeat * sizes[s]:
                left += target[s] - repeat * sizes[s]
                target[s] = repeat * sizes[s]
                free.discard(s)
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, 1, 5, 100, 10_000]) for i in range(rng.randrange(1, 12))} | {None: 7, "é": 300}
    rows = [(s, n) for s, n in sizes.items()] + [("s0", 2)]
    sizes["s0"] += 2
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    assert got == pytest.approx(plain_targets(sizes, mixing.WEIGHTS, 3))


@pytest.mark.parametrize("bucket_rows", [4_000, 7])
def test_copies(spark, bucket_rows):
    rng = random.Random(5)
    rows = [(i, i, rng.choice(["a", "b", "c", None]), int(rng.expovariate(0.01))) for i in range(600)]
    df = spark.createDataFrame(rows, "key long, doc_id long, source string, size long")
    got = mixing.mix(df, bucket_rows=bucket_rows).collect()
    again = {r.key: r.copies for r in mixing.mix(df.repartition(5), bucket_rows=bucket_rows).collect()}
    assert {r.key: r.copies for r in got} == again and len(got) == 600
    for source in ("a", "b", "c", None):
        mine = [r for r in got if r.source == source]
        rate = mine[0].target / mine[0].source_size
        assert {r.copies for r in mine} <= {int(rate), int(rate) + 1} and max(r.copies for r in mine) <= 3
        assert abs(sum(r.copies * r.size for r in mine) - mine[0].target) <= max(r.size for r in mine)


def test_one_offset_by_source_crosses_integers(spark):
    """Copies are those of a plain walk along each source with one offset."""
    rng = random.Random(8)
    rows = [(i, i, rng.choice("ab"), rng.randrange(1, 900)) for i in range(300)]
    got = {r.key: r for r in mixing.mix(spark.createDataFrame(rows, "key long, doc_id long, source string, size long"), bucket_rows=40).collect()}
    draw = lambda text: int(hashlib.md5(text.encode()).hexdigest()[:8], 16)
    for source in "ab":
        bucket = {i: draw(f"7:{i}") % -(-sum(r[2] == source for r in rows) // 40) for _, i, s, _ in rows if s == source}
        order = sorted(bucket, key=lambda i: (bucket[i], rows[i][3] * (1 if bucket[i] % 2 == 0 else -1), i))
        rate, at = got[order[0]].target / got[order[0]].source_size, draw(f"7/{source}") / 2**32
        for place, i in enumerate(order, 1):
            assert got[i].copies == math.floor(place * rate + at) - math.floor((place - 1) * rate + at)


def test_word_count(spark):
    texts = [None, "", " \t\n", "a", "a b c", "x\x1cy\x0bz", "wörd " * 1000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    from pyspark.sql import functions as F

    assert [r.n for r in df.select(mixing.word_count(F.col("t")).alias("n")).collect()] == [0, 0, 0, 1, 2, 2, 1000]


def test_rows_of_every_kind(spark):
    rows = [(None, None, None, 1), (1, "a b c", "s", 2), (1, "a b c", "s", 2), (2, "", "t", 3), (3, "long " * 50_000, "u", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    out = mixing.mix_documents(df)
    assert out.columns == df.columns and set(map(tuple, out.collect())) <= set(rows)
    empty = df.where("false")
    assert mixing.mix_documents(empty).count() == 0
    nothing = mixing.mix_documents(df.where("text = '' OR text IS NULL"))
    assert nothing.count() == 0
