"""SimHash near-duplicates at a similarity of 0.8: every pair at that exact Jaccard similarity of five-word shingles is found.

First come the candidates of SimHash: BK-trees over shards link the fingerprints of five-word shingles within two bits. At
0.8 fingerprints differ in some 10 bits, though, give or take 3. Shards by blocks of bits cannot be complete for that, and a
BK-tree cannot prune: distances of unrelated fingerprints are 32 give or take 4, so a walk within so many bits follows nearly
every edge. The exact check that completes them has shards by the shingles themselves: with all shingles in one order, two
texts at 0.8 or above share at least one among the first fifth (and one more) of each text's shingles. The order puts frequent
shingles last, by counts in a table of fixed size; any order is complete, this one makes few candidates.

Two members of a shard are a candidate if their numbers of shingles allow 0.8, if behind the shard's shingle each has as many
left as they must share (the first shingle that a similar pair shares meets that), and if, for longer texts, their
fingerprints lie within ``RADIUS`` bits, five standard deviations beyond what 0.8 gives. Candidates are verified by the exact
similarity of their texts. Texts with the same set of shingles are one node with one fingerprint.

Verification takes two steps. First come the candidates of the trees, and all members of a shard are held against its hub, the one with the fewest rarer shingles:
in a family of edited copies that is the one without edits of its own. Then members of a shard that are not in one component
yet are held against each other; so the components are those of all similar pairs, though not all pairs within a family are
looked at. A task holds a block of a shard and of the members before it only those that can be the shorter side of a pair.

Defined results: words are those of SimHash, a text of fewer words than a shingle is one shingle, and null and wordless texts
are one group; of a group the row with the smallest id stays (the first such row), one without an id only if none has one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_words, checkpoint, share, slices, stored, whole_rows
from .components import components
from .simhash import links as tree_links
from .simhash import majority

SHINGLE = 5
#: The least similarity, as a fraction.
LEAST = (4, 5)
#: Bits in which the fingerprints of a similar pair may differ, and distinct shingles from which on that holds.
RADIUS, LONG = 24, 64
#: Counters of the table that orders shingles, and the rows in which a task gives it.
COUNTERS, SLOTS = 1 << 20, 64
#: Shingles that are hashed at once, and pairs that are given at once.
BLOCK, PAIRS = 1 << 16, 1 << 16
#: Nodes that a task remembers at once.
REMEMBERED = 1 << 20


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct XXH64 hashes of a text's word shingles, ascending."""
    words, parts = byte_words(text), []
    for start in range(0, max(1, len(words) - shingle + 1) if words else 0, BLOCK):
        part = words[start : start + BLOCK + shingle - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
        parts.append(np.fromiter(map(xxhash.xxh64_intdigest, grams), dtype=np.uint64))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def node_of(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes())


def fits(n, m, p, q, a, b) -> np.ndarray:
    """Whether sizes n and m, places p and q of a shared shingle in the order, and fingerprints a and b allow similarity."""
    low, (num, den) = np.minimum(n, m), LEAST
    sized = den * low >= num * np.maximum(n, m)
    # Of n + m shingles a pair must share the fraction num / (num + den).
    enough = (num + den) * np.minimum(n - p, m - q) >= num * (n + m)
    return sized & enough & ((np.bitwise_count((a ^ b).view(np.uint64)) <= RADIUS) | (low < LONG))


def prefix(found: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles of which two similar texts share one at least: the rarest, one more than may be missing."""
    n, (a, b) = len(found), LEAST
    order = np.lexsort((found, counts[(found % COUNTERS).astype(np.int64)]))
    return found[order[: n + 1 - -(-n * a // b)]]


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both * LEAST[1] >= LEAST[0] * (len(x) + len(y) - both)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id, text) -> (key, id, node, bits, n, slot, counts): a row for each text, and the task's counts of shingles."""
    counts, kind = np.zeros(COUNTERS, np.uint32), None
    names = ["key", "id", "node", "bits", "n", "slot", "counts"]
    for b in batches:
        kind, nodes, bits, sizes = b.column(1).type, [], [], []
        for texts in slices(b.column(2)):
            found = [shingles(t) for t in texts]
            nodes += [node_of(x) for x in found]
            bits += [majority(x) for x in found]
            sizes += [len(x) for x in found]
            counts += np.bincount((np.concatenate(found) % COUNTERS).astype(np.int64), minlength=COUNTERS).astype(np.uint32)
        rows = len(nodes)
        if rows:
            signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, bits)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *signed, pa.array(sizes, pa.int32()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names=names)
    if kind is not None:
        parts = [x.tobytes() for x in np.split(counts, SLOTS)]
        none = [pa.nulls(SLOTS, t) for t in (pa.int64(), kind, pa.int64(), pa.int64(), pa.int32())]
        yield pa.RecordBatch.from_arrays([*none, pa.array(range(SLOTS), pa.int32()), pa.array(parts, pa.binary())], names=names)


def _add_up(key: tuple[pa.Scalar, ...], tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(COUNTERS // SLOTS, np.uint32)
    for b in tables:
        for x in b.column("counts"):
            total += np.frombuffer(x.as_py(), np.uint32)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slot", "counts"])


def _prefixes(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(text) -> (h, p, node) for each shingle of its prefix, p its place; a node that the task has just met is not given again."""
        counts, met = shared(), set()
        for b in batches:
            for texts in slices(b.column(0)):
                nodes, firsts = [], []
                for x in map(shingles, texts):
                    if (node := node_of(x)) not in met:
                        met.add(node)
                        nodes.append(node)
                        firsts.append(prefix(x, counts))
                if nodes:
                    sizes = [len(x) for x in firsts]
                    each = np.repeat(np.array(nodes, np.uint64).view(np.int64), sizes)
                    place = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(firsts).view(np.int64)), pa.array(place), pa.array(each)], names=["h", "p", "node"])
                if len(met) > REMEMBERED:
                    met.clear()

    return run


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(batch.num_columns)]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, p, node) in order -> those whose h comes with another node as well, each once; one row is held."""
    give = lambda rows, which: pa.RecordBatch.from_arrays([pa.array(rows[0][which]), pa.array(rows[1][which].astype(np.int32)), pa.array(rows[2][which])], names=["h", "p", "node"])
    last, met = None, False
    for b in batches:
        if not b.num_rows:
            continue
        rows = _columns(b)
        if last is not None:
            rows = [np.append(x[None], y) for x, y in zip(last, rows, strict=True)]
        new = np.append(True, (rows[0][1:] != rows[0][:-1]) | (rows[2][1:] != rows[2][:-1]))
        rows = [x[new] for x in rows]
        same = rows[0][1:] == rows[0][:-1]
        before = np.append(met, same)
        which = np.flatnonzero((before | np.append(same, False))[:-1])
        if len(which):
            yield give(rows, which)
        last, met = [x[-1] for x in rows], bool(before[-1])
    if last is not None and met:
        yield give([x[None] for x in last], np.array([0]))


def _pairs(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])


def _to_hub(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, p, node, n, bits) in order -> (u, v): candidates of each row and the first row of its h; one row is held."""
    hub = None
    for b in batches:
        if not b.num_rows:
            continue
        rows = _columns(b)
        if hub is not None:
            rows = [np.append(x[None], y) for x, y in zip(hub, rows, strict=True)]
        h, p, node, n, bits = rows
        first = np.append(True, h[1:] != h[:-1])
        at = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
        good = np.flatnonzero((node != node[at]) & fits(n, n[at], p, p[at], bits, bits[at]))
        if len(good):
            yield _pairs(node[good], node[at[good]])
        hub = [x[at[-1]] for x in rows]


def _crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, n, node, p, bits, root) in order -> (u, v): candidates of one h with different roots."""
    num, den = LEAST
    held: list[np.ndarray] | None = None

    def among(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Pairs within a block: each row with the one 1, 2, 3 ... places before, as long as they are of one h."""
        h, n, node, p, bits, root = rows
        at, lag = np.arange(1, len(h)), 1
        while len(at := at[(at >= lag)]) and len(at := at[h[at] == h[at - lag]]):
            i, j = at, at - lag
            # Rows are in order of n, so that none further before can be long enough either.
            at = at[den * n[j] >= num * n[i]]
            i, j = at, at - lag
            good = (root[i] != root[j]) & fits(n[i], n[j], p[i], p[j], bits[i], bits[j])
            if good.any():
                yield _pairs(node[i[good]], node[j[good]])
            lag += 1

    def against(old: list[np.ndarray], rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Pairs of rows held and rows of the block."""
        _, n, node, p, bits, root = rows
        step = max(1, PAIRS // max(len(old[0]), 1))
        for lo in range(0, len(n), step):
            part = slice(lo, lo + step)
            x, y = (lambda k: old[k][None, :]), (lambda values, part=part: values[part][:, None])
            good = (y(root) != x(5)) & fits(y(n), x(1), y(p), x(3), y(bits), x(4))
            i, j = np.nonzero(good)
            if len(i):
                yield _pairs(node[part][i], old[2][j])

    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK):
            rows = _columns(batch.slice(lo, BLOCK))
            h, n, p = rows[0], rows[1], rows[3]
            yield from among(rows)
            if held is not None:
                mine = int(np.searchsorted(h != held[0][0], True)) if h[0] == held[0][0] else 0
                if mine:
                    yield from against(held, [x[:mine] for x in rows])
            # Only the shorter side of a pair is held: its place must leave as much as two texts of its size share.
            tail = np.flatnonzero((h == h[-1]) & ((num + den) * (n - p) >= 2 * num * n))
            kept = [x[tail] for x in rows]
            if held is not None and held[0][0] == h[-1]:
                long = den * held[1] >= num * n[-1]
                kept = [np.append(x[long], y) for x, y in zip(held, kept, strict=True)]
            held = kept if len(kept[0]) else None


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v, text of u, text of v) -> (u, v, same); the last text of v is remembered."""
    last, set_v = None, np.zeros(0, np.uint64)
    for b in batches:
        same = []
        for i in range(b.num_rows):
            v = b.column(1)[i].as_py()
            if v != last:
                last, set_v = v, shingles((b.column(3)[i].as_py() or "").encode())
            same.append(similar(shingles((b.column(2)[i].as_py() or "").encode()), set_v))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(same, pa.bool_())], names=["u", "v", "same"])


def verified(pairs: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, v, same) of distinct ``pairs(u, v)`` of nodes; ``reps(node, key)`` name a row of ``texts(key, text)`` for each."""
    needed = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    some = stored(texts.join(reps.join(needed, "node"), "key").select("node", "text"), "similar-texts")
    left, right = some.select(F.col("node").alias("u"), F.col("text").alias("tu")), some.select(F.col("node").alias("v"), F.col("text").alias("tv"))
    both = pairs.join(left, "u").join(right, "v").select("u", "v", "tu", "tv").sortWithinPartitions("v")
    return checkpoint(both.mapInArrow(_verify, "u long, v long, same boolean"))


def near(reps: DataFrame) -> DataFrame:
    """(u, v): candidates among ``reps(node, bits, n)`` by BK-trees over their fingerprints.

    Nodes of one fingerprint are held against the first of them, fingerprints along a spanning forest of the trees' links; sizes
    must allow the similarity.
    """
    heads = checkpoint(reps.groupBy("bits").agg(F.min(F.struct("node", "n")).alias("head")).select("bits", F.col("head.node").alias("head"), F.col("head.n").alias("m")))
    same = reps.join(heads, "bits").where("node <> head").select("node", "n", "head", "m")
    forest = tree_links(heads.select("bits")).join(heads.select(F.col("bits").alias("u"), F.col("head").alias("node"), F.col("m").alias("n")), "u")
    both = same.unionByName(forest.join(heads.withColumnRenamed("bits", "v"), "v").select("node", "n", "head", "m"))
    sized = both.where(F.least("n", "m") * LEAST[1] >= F.greatest("n", "m") * LEAST[0])
    return sized.select(F.least("node", "head").alias("u"), F.greatest("node", "head").alias("v"))


def groups(texts: DataFrame) -> DataFrame:
    """(key, id, root) of ``texts(key, id, text)``: rows of one root are joined by pairs of similar texts."""
    longs = lambda *names: [T.StructField(n, T.LongType()) for n in names]
    ints = lambda *names: [T.StructField(n, T.IntegerType()) for n in names]
    out = T.StructType([*longs("key"), texts.schema["id"], *longs("node", "bits"), *ints("n", "slot"), T.StructField("counts", T.BinaryType())])
    read = stored(texts.select("key", "id", "text").mapInArrow(_read, out), "similar-nodes")
    rows = read.where("slot IS NULL").select("key", "id", "node", "bits", "n")
    added = read.where("slot IS NOT NULL").select("slot", "counts").groupBy("slot").applyInArrow(_add_up, "slot int, counts binary").collect()
    counts = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(bytes(r.counts), np.uint32) for r in sorted(added, key=lambda r: r.slot))])
    reps = checkpoint(rows.groupBy("node").agg(F.min("key").alias("key"), F.min("bits").alias("bits"), F.min("n").alias("n")))

    firsts = texts.select("text").mapInArrow(_prefixes(share(texts.sparkSession, counts)), "h long, p int, node long")
    shared = firsts.repartition("h").sortWithinPartitions("h", "p", "node").mapInArrow(_shared, "h long, p int, node long")
    met = checkpoint(shared.join(reps.select("node", "n", "bits"), "node"))

    hubs = met.select("h", "p", "node", "n", "bits").repartition("h").sortWithinPartitions("h", "p", "node").mapInArrow(_to_hub, "u long, v long")
    tested = verified(checkpoint(hubs.unionByName(near(reps)).distinct()), reps.select("node", "key"), texts)
    links = tested.where("same").select("u", "v")

    rooted = met.join(components(links).withColumnRenamed("root", "r"), "node", "left").withColumn("root", F.coalesce("r", "node"))
    ordered = rooted.select("h", "n", "node", "p", "bits", "root").repartition("h").sortWithinPartitions("h", "n", "node")
    crossing = ordered.mapInArrow(_crossing, "u long, v long").distinct()
    more = verified(checkpoint(crossing.join(tested.select("u", "v"), ["u", "v"], "left_anti")), reps.select("node", "key"), texts)
    roots = components(links.unionByName(more.where("same").select("u", "v")))
    return rows.select("key", "id", "node").join(roots, "node", "left").select("key", "id", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The documents without near-duplicates. Rows are numbered and stored once, as a second scan need not number them alike."""
    keyed = stored(docs.select(whole_rows(), F.monotonically_increasing_id().alias("__key")), "keyed")
    doc = F.col("__doc")
    marked = groups(keyed.select(F.col("__key").alias("key"), doc[id_col].alias("id"), doc[text_col].alias("text")))
    kept = marked.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "key"))["key"].alias("__key"))
    return keyed.join(kept.select("__key"), "__key", "left_semi").select("__doc.*")
