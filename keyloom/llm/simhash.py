"""SimHash near-duplicates, linked through BK-trees.

A fingerprint is the bitwise majority over the XXH64 of a text's word shingles. Distinct fingerprints are dealt to
shards that agree on two of four 16-bit blocks: two fingerprints that differ in at most two bits agree on at least two
blocks, so they meet in a shard. Each shard grows a BK-tree (children keyed by their Hamming distance to the parent) and
every fingerprint walks only the edges within the radius. A shard with more than ``tree_limit`` fingerprints is not
searched but dealt again by further bits of those still free; with 11 free bits left a shard cannot exceed the limit, so
memory is bounded and no link is lost. A shard reports a spanning forest of its links, not all pairs. The trees of all
fingerprints have no size bound, so they are not broadcast whole: the fingerprints travel to their shard's tree.

Defined results: a null or wordless text has fingerprint 0, linked like any other; a text of fewer words than a shingle
is one shingle; repeated rows and repeated ids are documents that share a fingerprint; a component without any non-null
id has a null component_id; an empty table gives an empty result. Texts of any length are read whole, in bounded blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_words, checkpoint, documents, stored, struct, text_udf, whole_rows
from .components import components

SHINGLE = 3
RADIUS = 2
SEED = 42
#: Fingerprints that one BK-tree may hold; a power of two.
TREE_LIMIT = 2048
#: Shingles that are hashed at once.
BLOCK = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit SimHash of a UTF-8 text."""
    words = byte_words(text)
    if not words:
        return 0
    digest = partial(xxhash.xxh64_intdigest, seed=seed)
    total = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for start in range(0, total, BLOCK):
        part = words[start : start + BLOCK + shingle - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
        ones += _ones(np.fromiter(map(digest, grams), dtype="<u8"))
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    full = len(bits) // 255 * 255
    return bits[:full].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[full:].sum(axis=0, dtype=np.int64)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of hashed shingles; 0 of none."""
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), BLOCK):
        ones += _ones(hashes[start : start + BLOCK])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_udf(shingle: int = SHINGLE, seed: int = SEED):
    """Text column to struct<bits: long>, the fingerprint's 64 bits as a signed number."""

    def make():
        def kernel(texts: list[bytes]) -> list:
            return [np.array([fingerprint(t, shingle, seed) for t in texts], np.uint64).view(np.int64)]

        return kernel

    return text_udf(make, struct(bits=T.LongType()))


class BKTree:
    """Burkhard-Keller tree over unsigned integers under Hamming distance."""

    def __init__(self) -> None:
        self.items: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, item: int) -> None:
        """Add an item; one that is there already stays once."""
        if not self.items:
            self.items.append(item)
            self.children.append({})
            return
        at = 0
        while d := (item ^ self.items[at]).bit_count():
            if (nxt := self.children[at].get(d)) is None:
                self.children[at][d] = len(self.items)
                self.items.append(item)
                self.children.append({})
                return
            at = nxt

    def within(self, item: int, radius: int) -> list[int]:
        """Items at most ``radius`` away; only edges d-radius..d+radius are followed."""
        found, todo = [], [0] if self.items else []
        items, children = self.items, self.children
        while todo:
            at = todo.pop()
            d = (item ^ items[at]).bit_count()
            if d <= radius:
                found.append(items[at])
            if kids := children[at]:
                for edge in range(max(1, d - radius), d + radius + 1):
                    if edge in kids:
                        todo.append(kids[edge])
        return found


def forest(items: list[int], radius: int) -> list[tuple[int, int]]:
    """(item, root) links that join the same items as all links within the radius do."""
    tree, parent = BKTree(), {}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x in items:
        if x in parent:
            continue
        near = tree.within(x, radius)
        tree.add(x)
        parent[x] = x
        for y in near:
            if (r := find(y)) != (s := find(x)):
                parent[max(r, s)] = min(r, s)
    return [(x, r) for x in parent if (r := find(x)) != x]


def _split(mask: int) -> list[int]:
    """The mask with each third of its free bits added."""
    free = [b for b in range(64) if not mask >> b & 1]
    cut = [free[i * len(free) // 3 : (i + 1) * len(free) // 3] for i in range(3)]
    return [mask | sum(1 << b for b in part) for part in cut]


def _first_masks() -> list[int]:
    blocks = [0xFFFF << (16 * i) for i in range(4)]
    return [blocks[i] | blocks[j] for i in range(4) for j in range(i)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def search_shards(batches: Iterator[pa.RecordBatch], radius: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Rows (mask, key, bits) in order of (mask, key) -> (again, a, b): links a-b, or again and (mask, bits) to be dealt anew.

    At most ``limit`` rows of a shard are held; once there are more, its rows go straight out again.
    """
    held: list[np.ndarray] = []
    n, shard, hot = 0, None, False

    def flush() -> pa.RecordBatch | None:
        nonlocal held, n
        bits, held, n = (np.concatenate(held) if held else np.zeros(0, np.int64)), [], 0
        if len(bits) < 2:
            return None
        links = forest(sorted(bits.view(np.uint64).tolist()), radius)
        return _rows(False, [_signed(a) for a, _ in links], [_signed(b) for _, b in links]) if links else None

    def _rows(again: bool, a, b) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([again] * len(a)), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["again", "a", "b"])

    def anew(bits: np.ndarray) -> pa.RecordBatch:
        masks = [_signed(m) for m in _split(shard[0] & (1 << 64) - 1)]
        return _rows(True, np.repeat(np.array(masks, np.int64), len(bits)), np.tile(bits, 3))

    for batch in batches:
        mask, key, bits = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if not len(mask):
            continue
        edges = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
        starts = [0, *edges.tolist(), len(mask)]
        for lo, hi in zip(starts, starts[1:], strict=False):
            here = (int(mask[lo]), int(key[lo]))
            if here != shard:
                if (out := flush()) is not None:
                    yield out
                shard, hot = here, False
            if not hot and n + hi - lo > limit:
                hot = True
                if held:
                    yield anew(np.concatenate(held))
                held, n = [], 0
            if hot:
                yield anew(bits[lo:hi])
            else:
                held.append(bits[lo:hi])
                n += hi - lo
    if (out := flush()) is not None:
        yield out


def links(prints: DataFrame, *, radius: int = RADIUS, tree_limit: int = TREE_LIMIT) -> DataFrame:
    """(u, v) over distinct ``prints(bits)``: a forest of the links within the radius (2 at most) of every shard."""
    if not 0 <= radius <= 2:
        raise ValueError("shards are complete for radius 0 to 2")
    if tree_limit < 4:
        raise ValueError("a shard of two free bits may hold 4 fingerprints")
    masks = F.explode(F.array(*(F.lit(_signed(m)) for m in _first_masks())))
    dealt, found = prints.select(masks.alias("mask"), "bits"), None
    while True:
        keyed = dealt.select("mask", F.col("mask").bitwiseAND(F.col("bits")).alias("key"), "bits")
        ordered = keyed.repartition("mask", "key").sortWithinPartitions("mask", "key")
        out = checkpoint(ordered.mapInArrow(partial(search_shards, radius=radius, limit=tree_limit), "again boolean, a long, b long"))
        some = out.where("not again").select(F.col("a").alias("u"), F.col("b").alias("v"))
        found = some if found is None else found.unionByName(some)
        over = out.where("again").select(F.col("a").alias("mask"), F.col("b").alias("bits"))
        if over.isEmpty():
            return found
        dealt = over.distinct()


def classes(prints: DataFrame, *, radius: int = RADIUS, tree_limit: int = TREE_LIMIT) -> DataFrame:
    """(bits, component_id) for ``prints(doc_id, bits)``: the smallest id reachable over links, copies counted once each."""
    nodes = checkpoint(prints.groupBy("bits").agg(F.min("doc_id").alias("low")))
    roots = components(links(nodes.select("bits"), radius=radius, tree_limit=tree_limit))
    rooted = nodes.join(roots, nodes.bits == roots.node, "left").select("bits", "low", F.coalesce("root", "bits").alias("root"))
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return rooted.join(least, "root").select("bits", "component_id")


def near_duplicates(
    docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", key_col: str | None = None, shingle: int = SHINGLE, radius: int = RADIUS, tree_limit: int = TREE_LIMIT
) -> DataFrame:
    """(key, doc_id, bits, component_id) for each row; key is ``key_col``, or else the row's number in this scan."""
    value = fingerprint_udf(shingle)(F.col(text_col))
    key = F.col(key_col) if key_col else F.monotonically_increasing_id()
    prints = checkpoint(docs.select(key.alias("key"), F.col(id_col).alias("doc_id"), value.alias("r")).select("key", "doc_id", "r.bits"))
    grouped = classes(prints, radius=radius, tree_limit=tree_limit)
    return prints.join(grouped.withColumnRenamed("bits", "b"), F.col("bits") == F.col("b")).drop("b")


def keep_one(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", **params) -> DataFrame:
    """The documents without near-duplicates: of each group the row with the smallest id stays (the first such row).

    Rows without an id are grouped by fingerprint where no row of their group has one. Rows are numbered and stored
    once, as a second scan need not number them alike once the cluster has changed.
    """
    keyed = stored(docs.select(whole_rows(), F.monotonically_increasing_id().alias("__key")), "keyed")
    doc = F.col("__doc")
    marked = near_duplicates(keyed.select("__key", doc[id_col].alias("doc_id"), doc[text_col].alias("text")), key_col="__key", **params)
    group = F.struct("component_id", F.when(F.col("component_id").isNull(), F.col("bits")))
    kept = marked.groupBy(group.alias("g")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "key"))["key"].alias("__key"))
    return keyed.join(kept.select("__key"), "__key", "left_semi").select("__doc.*")


def keep_one_similar(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The documents without near-duplicates at an exact five-word Jaccard similarity of 0.8 or more; see ``similar``."""
    from .similar import keep_one

    return keep_one(docs, text_col=text_col, id_col=id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = near_duplicates(documents(spark, sf_dir))
    return marked.select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")
