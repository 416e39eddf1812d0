import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from keyloom.llm import packing


@pytest.fixture(scope="module")
def whole():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_ids_are_those_of_tokenizers(spark, whole):
    encode = packing.encoder()
    texts = ["", " ", "a  b\n\n c\t", "don't we'll I'M", "<|endoftext|>x <|endoftext|> y<|endoftext", "日本語 ñandú ça va　!", "x" * 9000, "\x1c\x85  z", "1234 ½ ²", "🙂" * 50, "é ﻿", " \x00 \r\n"]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for t in texts:
        assert encode(t.encode()).tolist() == whole(t), t[:50]


def plain_best_fit(lengths, capacity):
    room, place = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [(r, -b) for b, r in enumerate(room) if r >= lengths[i]]
        if not fits:
            room.append(capacity)
            fits = [(capacity, 1 - len(room))]
        place[i] = min(fits)[0]
        room[-min(fits)[1]] -= lengths[i]
    return sorted(room), [place[i] for i in range(len(lengths))]


def test_best_fit_matches_a_plain_search():
    rng = random.Random(2)
    for capacity in (1, 7, 64, 100):
        lengths = [rng.randrange(1, capacity + 1) for _ in range(400)]
        got = packing.best_fit(lengths, capacity)
        room, place = plain_best_fit(lengths, capacity)
        assert [capacity - o for _, o in got] == place
        used = {}
        for (b, _), n in zip(got, lengths):
            used[b] = used.get(b, 0) + n
        assert sorted(capacity - u for u in used.values()) == room


def test_cut():
    assert packing.cut(2048) == [(0, 2048)] and packing.cut(1) == [(0, 1)]
    assert packing.cut(4096) == [(0, 2048), (2048, 2048)] and packing.cut(2050) == [(0, 2), (2, 2048)]


def check(rows, capacity=packing.CAPACITY):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("shard_rows", [50_000, 100])
def test_query_rows(spark, whole, shard_rows):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.pack(docs, shard_rows=shard_rows).collect()
    n = check(rows)
    least = -(-sum(r.length for r in rows) // packing.CAPACITY)
    assert n <= least * 1.02 + 3
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for d in docs.collect():
        ids, at = np.array([*whole(d.text), 0], "<u4"), 0
        for i, r in enumerate(sorted(by_doc[d.doc_id], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (i, at)
            at += r.length
            assert r.ids_crc32 == zlib.crc32(ids[r.start : at].tobytes())
        assert at == len(ids)


def test_rows_of_every_kind(spark):
    rows = [(1, None, 0), (1, None, 0), (None, "", 1), (2, "word " * 9000, 2), (3, "x", None)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, offset int")).collect()
    check(got)
    assert sum(r.length for r in got if r.doc_id == 2) > 9000 and sorted(r.length for r in got)[:4] == [1, 1, 1, 2]
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
