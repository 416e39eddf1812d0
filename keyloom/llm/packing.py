"""Best-fit packing of documents into token sequences.

A document's tokens and one closing id are a piece; longer documents are cut into pieces of a whole sequence, the first
one taking what is left over. Pieces go in descending length into the open sequence that they leave least room in, which
a segment tree over the remaining capacities finds in logarithmic time. Pieces are dealt at random to shards of bounded
size that are packed on their own: a shard of ``shard_rows`` pieces wastes at most its last few sequences, so the number
of sequences stays within a small share of what one pass over all pieces gives, and no task grows with the input.

The ids are those of ``tokenizers`` for the same vocabulary. They are computed from its rank file by tiktoken, which is
several times faster; a text with an unbroken stretch above ``STRETCH`` bytes goes to tokenizers itself, whose merges take
time in proportion there.

Defined results: a null text is the empty text, a piece of just the closing id; invalid UTF-8 is read as U+FFFD; repeated
rows and repeated or null ids are documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, documents, struct, text_udf
from .token_counts import vocabulary

VOCABULARY = "byte_bpe_50k"
SPECIAL = {"<|endoftext|>": 50256}
CLOSING = 0
CAPACITY = 2048
SHARD_ROWS = 50_000
STRETCH = 4_000

PIECES = T.ArrayType(struct(piece=T.IntegerType(), start=T.LongType(), length=T.LongType(), ids_crc32=T.LongType()))


def encoder(name: str = VOCABULARY):
    """A function from a text to its ids as an array of unsigned 32-bit integers."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(vocabulary(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
    slow: list[Tokenizer] = []

    def encode(raw: bytes) -> np.ndarray:
        text = raw.decode("utf-8", "replace")
        if len(raw) > STRETCH and max(map(len, raw.split()), default=len(raw)) > STRETCH:
            if not slow:
                slow.append(Tokenizer.from_file(vocabulary(f"{name}.json")))
            return np.array(slow[0].encode(text, add_special_tokens=False).ids, np.uint32)
        return fast.encode_to_numpy(text, allowed_special="all")

    return encode


def cut(total: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document."""
    if total <= capacity:
        return [(0, total)]
    first = total % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, total, capacity)]


def piece_udf(capacity: int = CAPACITY, closing: int = CLOSING):
    def make():
        encode = encoder()

        def one(raw: bytes) -> list[dict]:
            ids = np.append(encode(raw), np.uint32(closing)).astype("<u4")
            return [{"piece": i, "start": s, "length": n, "ids_crc32": zlib.crc32(ids[s : s + n].tobytes())} for i, (s, n) in enumerate(cut(len(ids), capacity))]

        return lambda texts: [[one(t) for t in texts]]

    return text_udf(make, struct(pieces=PIECES))


class Capacities:
    """Open bins by remaining capacity, under a segment tree that knows which capacities occur."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.some = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, which: int) -> None:
        self.bins[room].append(which)
        if len(self.bins[room]) == 1:
            at = room + self.size
            while at:
                self.some[at] += 1
                at >>= 1

    def take(self, room: int) -> int:
        which = self.bins[room].pop()
        if not self.bins[room]:
            at = room + self.size
            while at:
                self.some[at] -= 1
                at >>= 1
        return which

    def tightest(self, need: int) -> int | None:
        """The least capacity of at least ``need`` that an open bin has."""
        at = need + self.size
        if self.some[at]:
            return need
        while at > 1:
            if not at & 1 and self.some[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.some[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def best_fit(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(bin, offset) of each length, by best fit in descending order; equal lengths keep their order."""
    rooms, opened = Capacities(capacity), 0
    out = [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        room = rooms.tightest(n)
        if room is None:
            room, which = capacity, opened
            opened += 1
        else:
            which = rooms.take(room)
        out[i] = (which, capacity - room)
        if room > n:
            rooms.put(room - n, which)
    return out


def _pack_shard(table: pa.Table) -> pa.Table:
    table = table.sort_by("key")
    placed = best_fit(table.column("length").to_pylist())
    base = (table.column("shard")[0].as_py() if len(table) else 0) << 32
    return (
        table.drop_columns(["key", "shard"])
        .append_column("sequence_id", pa.array([base + b for b, _ in placed], pa.int64()))
        .append_column("offset", pa.array([o for _, o in placed], pa.int64()))
    )


def pack(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut_up = docs.select(F.col(id_col).alias("doc_id"), piece_udf()(F.col(text_col)).alias("r"))
    pieces = checkpoint(cut_up.select("doc_id", F.explode("r.pieces").alias("p")).select("doc_id", "p.*", F.monotonically_increasing_id().alias("key")))
    shards = max(1, -(-pieces.count() // shard_rows))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    out = T.StructType([f for f in pieces.schema if f.name != "key"]).add("sequence_id", T.LongType()).add("offset", T.LongType())
    return dealt.groupBy("shard").applyInArrow(_pack_shard, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
