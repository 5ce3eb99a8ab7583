"""Groups of texts whose shingles are alike, by SimHash fingerprints with pivot distance tables and an exact check.

Two texts link if the Jaccard similarity of their distinct shingles (of five words, as a rule) is at least
the threshold (0.8).

1. Each set has a SimHash fingerprint: a bit is 1 if it is set in over half of the shingles' hashes. All pairs of
   fingerprints within ``MAX_BITS`` come from ``simhash.links``, by pivot distance tables; none is lost.
2. SimHash bits cannot tell pairs near the threshold from others, so some alike pairs are further apart than that. These, and only
   these, come together by shingles. In an order that is the same for all sets, two sets that alike share one
   of their first shingles (the prefix: a fifth of the set and one). The order is by hash, but shingles that many
   texts have come last, so prefixes hold rare ones.
   Among the sets with one shingle, sizes, then a table of Hamming distances to pivots (a pair whose largest
   coordinate difference is over what the two may differ in is discarded), then the bitmaps it is made of, and larger ones of larger
   sets, leave pairs that may be alike. These are parity bitmaps: a bit is the parity of the shingles that fall on it, so two
   sets differ in at least as many shingles as their bitmaps differ in bits, and no pair is lost.
   Only a spanning forest of both kinds of pairs goes on; its components are clusters that no link leaves.
3. The sets of each cluster, once each, come together and links are verified on them, after the same
   tests; again a forest goes out, and its components are the groups.

Where a shingle or a cluster has more than ``TILE`` sets, they are dealt into blocks of that size and each two
blocks meet, so no task holds more than some blocks whatever the group. Equal sets are one node from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstone.llm.bloom import filter_of, has
from loomstone.llm.common import arrow_map, opaque, texts, written
from loomstone.llm.components import components
from loomstone.llm.simhash import MOST_NODES, PIVOTS, Forest, links, majority, shingles, whole_runs

#: Bits of a bitmap; sets of a block; runs up to SMALL are compared by whole arrays.
PARITY, TILE, SMALL = 1024, 512, 16
#: Shingles in more prefixes than CROWDED come last in the order, of these the MOST_LATE most frequent.
CROWDED, MOST_LATE = 64, 1 << 16
#: Differing bits up to which pairs come by their fingerprints.
MAX_BITS = 3
#: Prefix shingles that a task counts before it sends on those it has seen again.
HELD = 1 << 22
EDGES = "a long, b long"


def shingle_set(text: bytes, words_each: int) -> np.ndarray:
    """XXH3 (64 bits) of the distinct shingles, ascending. Sets are compared by these hashes."""
    h = xxhash.xxh3_64_intdigest
    return np.unique(np.array([h(x) for x in set(shingles(text, words_each))], np.uint64))


def prefix(hashes: np.ndarray, similarity: float, late: np.ndarray | None = None) -> np.ndarray:
    """The first shingles in an order that is the same for all sets (by hash, those in ``late`` after all others):
    two sets at least that similar have one of them in common."""
    n = len(hashes)
    if late is not None and len(late):
        last = np.isin(hashes, late)
        hashes = np.concatenate([hashes[~last], hashes[last]])
    return hashes[: n - int(np.ceil(n * similarity - 1e-9)) + 1] if n else hashes


def parity_bits(hashes: np.ndarray, bits: int = PARITY) -> bytes:
    """A bit is the parity of the shingles that fall on it."""
    return np.packbits(np.bincount((hashes >> np.uint64(20)).astype(np.int64) % bits, minlength=bits) & 1).tobytes()


def wide_bits(hashes: np.ndarray) -> bytes | None:
    """A larger bitmap of a larger set, as many bits as shingles or more: sets that differ in over a thousand shingles differ in
    about half of PARITY bits whatever they hold. None for a set of up to PARITY shingles."""
    return parity_bits(hashes, 1 << (len(hashes) - 1).bit_length()) if len(hashes) > PARITY else None


def wide_distance(a: bytes, b: bytes) -> int:
    """Bits in which two bitmaps differ; the larger is folded, as two halves of a bitmap XOR to that of half its size."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def set_fingerprint(hashes: np.ndarray) -> int:
    """The SimHash of a set, 64 bits as a signed long; zero of an empty one."""
    return int(majority(hashes.view(np.uint8).reshape(-1, 8)).view("<i8")[0])


def node_of(hashes: np.ndarray) -> int:
    """A set's node, XXH3 of it as a signed long: equal sets have one node."""
    x = xxhash.xxh3_64_intdigest(hashes.tobytes())
    return x - (x >> 63 << 64)


def _node_sets(batch: pa.RecordBatch, words_each: int) -> list[tuple[int, np.ndarray]]:
    return [(node_of(s), s) for s in (shingle_set(t, words_each) for t in texts(batch, "_t"))]


def crowded_shingles(src: DataFrame, words_each: int, similarity: float) -> np.ndarray:
    """The shingles that come last: those that tasks have seen in several prefixes, over CROWDED times in all.
    Any list is right, as only the order of shingles hangs on it."""
    target = pa.schema([("_key", pa.int64()), ("_n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        nodes: set[int] = set()

        def out() -> pa.RecordBatch:
            k, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            nodes.clear()
            return pa.RecordBatch.from_arrays([pa.array(k[n > 1].view(np.int64)), pa.array(n[n > 1].astype(np.int64))], schema=target)

        for b in (x.slice(i, 512) for x in batches for i in range(0, x.num_rows, 512)):
            for node, s in _node_sets(b, words_each):
                if node not in nodes:
                    nodes.add(node)
                    held.append(prefix(s, similarity))
            if sum(map(len, held)) > HELD:
                yield out()
        if held:
            yield out()

    counted = src.select("_t").mapInArrow(run, "_key long, _n long").groupBy("_key").agg(F.sum("_n").alias("_n"))
    top = counted.filter(F.col("_n") > CROWDED).orderBy(F.desc("_n"), "_key").limit(MOST_LATE).select("_key").toArrow()
    return np.sort(top.column(0).to_numpy().view(np.uint64))


def _measured(src: DataFrame, words_each: int, similarity: float, late: np.ndarray) -> DataFrame:
    """_id, _node, _fp, _size, _bits, _wide and _prefix of each row."""

    def each(b: pa.RecordBatch) -> dict:
        found = _node_sets(b, words_each)
        return {
            "_id": b.column(0),
            "_node": [n for n, _ in found],
            "_fp": [set_fingerprint(s) for _, s in found],
            "_size": [len(s) for _, s in found],
            "_bits": [parity_bits(s) for _, s in found],
            "_wide": [wide_bits(s) for _, s in found],
            "_prefix": [prefix(s, similarity, late).tobytes() for _, s in found],
        }

    kind = T.StructType(
        [src.schema["_id"]]
        + [T.StructField(n, T.LongType()) for n in ("_node", "_fp", "_size")]
        + [T.StructField(n, T.BinaryType()) for n in ("_bits", "_wide", "_prefix")]
    )
    return arrow_map(src, each, kind)


def _keys(measured: DataFrame) -> DataFrame:
    """_key, _node for each shingle of each prefix; a node comes once from each task."""
    target = pa.schema([("_key", pa.int64()), ("_node", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in (x.slice(i, 4096) for x in batches for i in range(0, x.num_rows, 4096)):
            nodes, keys = [], []
            for node, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if node not in seen:
                    seen.add(node)
                    nodes.append(node)
                    keys.append(np.frombuffer(key, np.int64))
            if nodes:
                at = np.repeat(np.array(nodes, np.int64), list(map(len, keys)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(at)], schema=target)

    return measured.select("_node", "_prefix").mapInArrow(run, "_key long, _node long")


def near_fingerprints(nodes: DataFrame) -> DataFrame:
    """Edges a, b that connect all nodes whose fingerprints differ in up to MAX_BITS: a node with the least one of its
    fingerprint, and these along the links of fingerprints."""
    first = written(nodes.groupBy("_fp").agg(F.min("_node").alias("_first")))
    of = lambda x: first.select(opaque("_fp").alias(f"_f{x}"), F.col("_first").alias(x))
    near = links(first.select("_fp"), MAX_BITS).select(F.col("a").alias("_x"), F.col("b").alias("_y"))
    near = near.join(of("a"), F.col("_x") == F.col("_fa")).join(of("b"), F.col("_y") == F.col("_fb")).select("a", "b")
    equal = nodes.select(F.col("_node").alias("a"), "_fp").join(of("b"), F.col("_fp") == F.col("_fb")).filter("a <> b").select("a", "b")
    return near.unionByName(equal)


def _tiles(count: Column, node: Column) -> Column:
    """The tiles of a node among ``count`` ones: its block with every block, its own included. 0 where one block holds all."""
    blocks = F.ceil(count / TILE)
    own = F.pmod(F.xxhash64(node), blocks)
    pair = lambda k: F.greatest(own, k) * blocks + F.least(own, k)
    return F.when(blocks <= 1, F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), pair))


class Run:
    """Nodes that may be alike: which pairs are, by sizes, pivot distances, bitmaps and, where given, the sets."""

    refs = np.random.default_rng(2).integers(0, 256, (PIVOTS, PARITY // 8), np.uint8).view(np.uint64)

    def __init__(self, similarity: float, size: np.ndarray, bits: np.ndarray, wide: np.ndarray, sets: np.ndarray | None, fps: np.ndarray | None = None) -> None:
        """bits: one row of 64-bit words for each node; wide: larger bitmaps or None; fps: fingerprints, where the pairs
        that are near by them are known already."""
        self.similarity, self.size, self.bits, self.wide, self.sets, self.fps = similarity, size, bits, wide, sets, fps
        self.table = np.stack([np.bitwise_count(bits ^ r).sum(axis=1, dtype=np.int16) for r in self.refs], axis=1)

    def known(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the pairs (i, j) have come by their fingerprints."""
        return np.zeros(len(i), bool) if self.fps is None else np.bitwise_count(self.fps[i] ^ self.fps[j]) <= MAX_BITS

    def alike(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The numbers of those pairs (i, j) that are alike, or may be where there are no sets."""
        s, a, b = self.similarity, self.size[i], self.size[j]
        most = (a + b) * (1 - s) / (1 + s) + 1e-6  # shingles that only one of the two has
        left = np.flatnonzero(np.minimum(a, b) >= s * np.maximum(a, b) - 1e-9)
        left = left[np.abs(self.table[i[left]] - self.table[j[left]]).max(axis=1, initial=0) <= most[left]]
        left = left[np.bitwise_count(self.bits[i[left]] ^ self.bits[j[left]]).sum(axis=1, dtype=np.int32) <= most[left]]
        large = (a[left] > PARITY) & (b[left] > PARITY)
        if large.any():
            near = [wide_distance(self.wide[i[k]], self.wide[j[k]]) <= most[k] for k in left[large].tolist()]
            large[large] = ~np.array(near)
            left = left[~large]
        if self.sets is None:
            return left
        return np.array([k for k in left.tolist() if self._verified(int(i[k]), int(j[k]))], np.int64)

    def _verified(self, i: int, j: int) -> bool:
        x, y = (np.frombuffer(self.sets[k], np.uint64) for k in (i, j))
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both >= self.similarity * (len(x) + len(y) - both) - 1e-9

    def links(self, first: int, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Enough links among the n nodes from ``first`` on, beside those that are known: breadth first, each meets only those not
        reached yet."""
        left = np.arange(first, first + n)
        while len(left) > 1:
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                x = queue.pop()
                known = self.known(np.full(len(left), x), left)
                queue.extend(left[known].tolist())
                left = left[~known]
                hit = self.alike(np.full(len(left), x), left)
                if len(hit):
                    yield np.full(len(hit), x), left[hit]
                    queue.extend(left[hit].tolist())
                    left = np.delete(left, hit)


def _forest(similarity: float, with_sets: bool):
    """Rows (_key, _tile, _node, _size, _bits, _wide and _set or _fp) by _key and _tile: edges of a forest of what is alike, with
    _fp beside what is near by fingerprints."""
    target = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for key, tile, node, size, bits, wide, last in whole_runs(batches, 2):
            words = np.frombuffer(b"".join(bits.tolist()), np.uint64).reshape(len(key), -1)
            found = Run(similarity, size, words, wide, *((last,) if with_sets else (None, last.view(np.uint64))))
            number = np.cumsum(np.r_[True, (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])])
            start = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
            count = np.diff(np.r_[start, len(key)])
            for s, n in zip(start[count > SMALL].tolist(), count[count > SMALL].tolist(), strict=True):
                for i, j in found.links(s, n):
                    forest.add(node[i].tolist(), node[j].tolist())
            few = np.repeat((count > 1) & (count <= SMALL), count)
            for off in range(1, int(count[(count > 1) & (count <= SMALL)].max(initial=1))):
                i = np.flatnonzero(few[:-off] & (number[:-off] == number[off:]))
                i = i[~found.known(i, i + off)]
                i = i[found.alike(i, i + off)]
                forest.add(node[i].tolist(), node[i + off].tolist())
            if len(forest.parent) > MOST_NODES:
                yield forest.out(target)
        if forest.parent:
            yield forest.out(target)

    return run


def _compared(rows: DataFrame, similarity: float, last: str) -> DataFrame:
    """rows: _key, _count, _node, _size, _bits, _wide and last, which is _set or _fp. Edges a, b."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("_key", F.explode(_tiles(F.col("_count"), F.col("_node"))).alias("_tile"), "_node", "_size", "_bits", "_wide", last)
    return dealt.repartition(n, "_key", "_tile").sortWithinPartitions("_key", "_tile").mapInArrow(_forest(similarity, last == "_set"), EDGES)


def _clusters(measured: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """node, component: clusters that no link leaves; nodes that may have a link, but the least of each cluster."""
    keys = _keys(measured)
    counts = keys.groupBy("_key").agg(F.count(F.lit(1)).alias("_count")).filter("_count > 1")
    counts = written(counts.select(opaque("_key").alias("_k"), "_count"))
    rows = written(keys.join(counts, F.col("_key") == F.col("_k")).select("_key", "_count", "_node").distinct())
    of = nodes.select(opaque("_node").alias("_n"), "_size", "_bits", "_wide", "_fp")
    far = _compared(rows.join(of, F.col("_node") == F.col("_n")), similarity, "_fp")
    return components(near_fingerprints(nodes).unionByName(far))


def _links(src: DataFrame, clusters: DataFrame, nodes: DataFrame, words_each: int, similarity: float) -> DataFrame:
    """Edges a, b of verified links, enough to connect all that such links connect. clusters: _of, _cluster, _count of every node in one."""
    wanted = filter_of(clusters.select("_of"), clusters.count())
    target = pa.schema([("_node", pa.int64()), ("_set", pa.binary())])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = np.frombuffer(wanted.value, np.uint8), set()
        for b in (x.slice(i, 512) for x in batches for i in range(0, x.num_rows, 512)):
            found = [x for x in dict(_node_sets(b, words_each)).items() if x[0] not in seen]
            hit = has(held, np.array([n for n, _ in found], np.int64).view(np.uint64))
            found = [x for x, y in zip(found, hit.tolist(), strict=True) if y]
            seen.update(n for n, _ in found)
            if found:
                cols = pa.array([n for n, _ in found], pa.int64()), pa.array([s.tobytes() for _, s in found], pa.binary())
                yield pa.RecordBatch.from_arrays(list(cols), schema=target)

    found = src.select("_t").mapInArrow(sets, "_node long, _set binary").dropDuplicates(["_node"])
    of = nodes.select(F.col("_node").alias("_n"), "_size", "_bits", "_wide")
    placed = clusters.join(of, F.col("_of") == F.col("_n")).select("_of", F.col("_cluster").alias("_key"), "_count", "_size", "_bits", "_wide")
    rows = found.join(placed, F.col("_node") == F.col("_of"))
    return _compared(rows.select("_key", "_count", "_node", "_size", "_bits", "_wide", "_set"), similarity, "_set")


def similar_groups(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words_each: int = 5, similarity: float = 0.8
) -> DataFrame:
    """Groups of documents linked by a Jaccard similarity of their distinct shingles of ``similarity`` at least, over any
    number of steps; no such pair is missed, and every link is verified on the whole sets (as 64-bit hashes).

    Returns the id and component_id (the smallest id reachable, its own included), one row for each row of
    ``docs``. A null text counts as empty; texts with equal sets, so also those without words, are one group.
    A null id is never the smallest; component_id is null only where a whole group has none. Repeated rows
    give repeated rows. Other columns are ignored. An empty table gives an empty table.
    """
    if not 0 < similarity <= 1:
        raise ValueError("the similarity is over 0 and at most 1")
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    late = crowded_shingles(src, words_each, similarity)
    measured = written(_measured(src, words_each, similarity, late))
    nodes = measured.groupBy("_node").agg(F.min("_id").alias("_least"), *(F.min(c).alias(c) for c in ("_fp", "_size", "_bits", "_wide")))
    nodes = written(nodes)
    label = _clusters(measured, nodes, similarity)
    size = label.groupBy("component").agg((F.count(F.lit(1)) + 1).alias("_count"))
    size = size.select(opaque("component").alias("_c"), "_count")
    own = size.select(F.col("_c").alias("_of"), F.col("_c").alias("_cluster"), "_count")
    clusters = label.join(size, F.col("component") == F.col("_c")).select(F.col("node").alias("_of"), F.col("_c").alias("_cluster"), "_count")
    links = _links(src, written(clusters.unionByName(own)), nodes, words_each, similarity)
    label = components(links)
    grouped = nodes.join(label, F.col("_node") == F.col("node"), "left")
    grouped = written(grouped.select("_node", "_least", F.coalesce("component", "_node").alias("_group")))
    least = grouped.groupBy("_group").agg(F.min("_least").alias("component_id")).select(opaque("_group").alias("_g"), "component_id")
    member = grouped.join(least, F.col("_group") == F.col("_g")).select(opaque("_node").alias("_of"), "component_id")
    out = measured.select("_id", "_node").join(member, F.col("_node") == F.col("_of"))
    return out.select(F.col("_id").alias(id_col), "component_id")
