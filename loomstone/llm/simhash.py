"""SimHash near-dedup with pivot distance tables.

Texts: A-Z lower-cased, words [^\\x20\\x09-\\x0D]+, shingles of some words joined by one space and
repeated as often as they occur (fewer words: the whole sequence; no word: fingerprint zero).
A bit of the 64-bit fingerprint is 1 if it is set in over half of the shingles' XXH64 (seed 42).
Fingerprints link at up to ``max_bits`` differing bits.

Documents with equal fingerprints are one row from here on. A pair within 3 bits agrees on at
least 3 of 6 blocks of bits, so each fingerprint goes to the 20 buckets of its block triples: 20
rows of 16 bytes, whatever the corpus, and buckets of some 32 equal bits, which stay small at
10^10 fingerprints. Within a bucket the pivot distance table decides: each fingerprint has its
Hamming distances to ``PIVOTS`` reference fingerprints, and a pair whose largest coordinate
difference is over ``max_bits`` is discarded (triangle inequality); survivors are verified. A
bucket over ``HEAVY`` rows is dealt again by four parts of the other three blocks, of which a pair within 3 bits
has one alike: four rows for each, and buckets some 256 times as small. (Distances to pivots would deal it badly: those
of unrelated fingerprints are all close to 32.) A bucket yields a spanning
forest of its links, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstone.llm.common import LOWER, arrow_map, opaque, texts, written
from loomstone.llm.components import components

PIVOTS, BLOCKS, HEAVY = 16, 6, 4096
#: Nodes whose links a task holds before it sends them on.
MOST_NODES = 1_000_000


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: XXH64 of the numbers from 0."""
    return np.array([xxhash.xxh64_intdigest(str(i)) for i in range(n)], np.uint64)


def shingles(text: bytes, words_each: int) -> list[bytes]:
    """All shingles of a text, repeated as they occur."""
    words = text.translate(LOWER).split()
    joined = b" ".join(words)
    if len(words) <= words_each:
        return [joined] if words else []
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - words_each + 1].tolist()
    return [joined[a:b] for a, b in zip(starts, ends[words_each - 1 :].tolist(), strict=True)]


def majority(hashes: np.ndarray) -> np.ndarray:
    """hashes: rows of bytes. The bits, little-endian, that are set in over half of the rows, as bytes."""
    n, width = hashes.shape
    counts = np.zeros(width * 8, np.int64)
    for at in range(0, n, 255 * 64):
        bits = np.unpackbits(hashes[at : at + 255 * 64], axis=1, bitorder="little")
        for i in range(0, len(bits), 255):  # sums of 255 rows fit into a byte
            counts += bits[i : i + 255].sum(0, dtype=np.uint8)
    return np.packbits(counts * 2 > n, bitorder="little")


def fingerprint(text: bytes, words_each: int = 3) -> int:
    """64 bits by XXH64 with seed 42."""
    parts = shingles(text, words_each)
    if not parts:
        return 0
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(x, 42) for x in parts], "<u8")
    return int(majority(hashes.view(np.uint8).reshape(-1, 8)).view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words_each: int = 3) -> DataFrame:
    """_id, _fp (the 64 bits as a signed long)."""

    def each(b: pa.RecordBatch) -> dict:
        fps = np.array([fingerprint(t, words_each) for t in texts(b, "_t")], np.uint64)
        return {"_id": b.column(0), "_fp": pa.array(fps.view(np.int64))}

    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    return arrow_map(src, each, T.StructType([src.schema["_id"], T.StructField("_fp", T.LongType())]))


def _joined_bits(blocks: tuple[int, ...]) -> Column:
    """The bits of some blocks, side by side."""
    edges = [round(64 * i / BLOCKS) for i in range(BLOCKS + 1)]
    out = F.lit(0).cast("long")
    for i in blocks:
        width = edges[i + 1] - edges[i]
        bits = F.shiftrightunsigned(F.col("_fp"), edges[i]).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        out = F.shiftleft(out, width).bitwiseOR(bits)
    return out


def _buckets() -> list[Column]:
    """The key of each block triple: the triple's number above the bits of the three blocks."""
    triples = enumerate(combinations(range(BLOCKS), 3))
    return [F.lit(n << 40).cast("long").bitwiseOR(_joined_bits(blocks)) for n, blocks in triples]


def _slab_keys() -> Column:
    """For a heavy bucket: two fingerprints that agree on three blocks and differ in 3 bits at most agree on one of
    four parts of the rest (33 bits at most), so they share one of four keys."""
    rests = [_joined_bits(tuple(i for i in range(BLOCKS) if i not in blocks)) for blocks in combinations(range(BLOCKS), 3)]
    rest = F.element_at(F.array(*rests), (F.shiftrightunsigned(F.col("_key"), 40) + 1).cast("int"))
    part = lambda k: F.shiftrightunsigned(rest, 8 * k).bitwiseAND(F.lit(255 if k < 3 else 1023).cast("long"))
    return F.array(*(part(k).bitwiseOR(F.lit(k << 10).cast("long")) for k in range(4)))


class Forest:
    """Union-find over the links of a task; what goes out is one edge for each node at most."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    def add(self, a: list[int], b: list[int]) -> None:
        for x, y in zip(a, b, strict=True):
            x, y = self.root(x), self.root(y)
            if x != y:
                self.parent[max(x, y)] = min(x, y)

    def out(self, schema: pa.Schema) -> pa.RecordBatch:
        pairs = [(x, self.root(x)) for x in list(self.parent)]
        pairs = [p for p in pairs if p[0] != p[1]]
        self.parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], schema=schema)


def whole_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of sorted rows, cut so that rows with equal values of the first ``keys`` columns come together."""
    held: list[list[np.ndarray]] = []  # rows of the run that is not known to be over
    for batch in batches:
        new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(new[0]):
            continue
        other = np.flatnonzero(np.logical_or.reduce([c != c[-1] for c in new[:keys]]))
        last = int(other[-1]) + 1 if len(other) else 0  # where the last run of this batch begins
        if last or held and any(h[-1] != c[0] for h, c in zip(held[-1][:keys], new[:keys], strict=True)):
            held.append([x[:last] for x in new])
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held = []
        held.append([x[last:] for x in new])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _forest(max_bits: int):
    """Rows (_key, _slab, _fp) in that order: links of each bucket, as edges of a forest."""
    target = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    refs = pivots()

    def distances(fps: np.ndarray) -> np.ndarray:
        return np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int8)

    def near(fps: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the pairs (i, j) link: the pivot table first, then the bits themselves."""
        left = np.flatnonzero(np.abs(table[i] - table[j]).max(axis=1) <= max_bits)
        return left[np.bitwise_count(fps[i[left]] ^ fps[j[left]]) <= max_bits]

    def large(fps: np.ndarray, table: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Breadth first: each fingerprint meets only those that no one has reached yet."""
        left = np.arange(len(fps))
        while len(left) > 1:
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                x = queue.pop()
                hit = near(fps, table, np.full(len(left), x), left)
                if len(hit):
                    yield np.full(len(hit), x), left[hit]
                    queue.extend(left[hit].tolist())
                    left = np.delete(left, hit)

    def links(key: np.ndarray, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """key: numbers of buckets, ascending."""
        table = distances(fps)
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[start, len(key)])
        for s, n in zip(start[size > 64].tolist(), size[size > 64].tolist(), strict=True):
            for i, j in large(fps[s : s + n], table[s : s + n]):
                yield i + s, j + s
        small = np.repeat((size > 1) & (size <= 64), size)
        for off in range(1, int(size[(size > 1) & (size <= 64)].max(initial=1))):
            i = np.flatnonzero(small[:-off] & (key[:-off] == key[off:]))
            if len(i):
                hit = near(fps, table, i, i + off)
                yield i[hit], i[hit] + off

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for k, slab, f in whole_runs(batches, 2):
            number = np.cumsum(np.r_[0, (k[1:] != k[:-1]) | (slab[1:] != slab[:-1])])
            for i, j in links(number, f.view(np.uint64)):
                forest.add(f[i].tolist(), f[j].tolist())
            if len(forest.parent) > MOST_NODES:
                yield forest.out(target)
        if forest.parent:
            yield forest.out(target)

    return run


def links(distinct: DataFrame, max_bits: int = 3) -> DataFrame:
    """distinct: _fp. Returns edges a, b between fingerprints; their components are those of all links."""
    if not 0 <= max_bits <= 3:
        raise ValueError("three of six equal blocks are certain up to 3 differing bits only")
    rows = distinct.select("_fp", F.explode(F.array(*_buckets())).alias("_key"))
    heavy = rows.groupBy("_key").count().filter(F.col("count") > HEAVY).select(opaque("_key").alias("_heavy"))
    dealt = rows.join(heavy, F.col("_key") == F.col("_heavy"), "left")
    slabs = F.when(F.col("_heavy").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(_slab_keys())
    dealt = dealt.select("_key", F.explode(slabs).alias("_slab"), "_fp")
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = dealt.repartition(n, "_key", "_slab").sortWithinPartitions("_key", "_slab", "_fp")
    return ordered.mapInArrow(_forest(max_bits), "a long, b long")


def near_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words_each: int = 3, max_bits: int = 3) -> DataFrame:
    """SimHash fingerprints and groups of documents linked by them, over any number of steps.

    Returns the id, fingerprint (16 lowercase hex digits) and component_id (the smallest id
    reachable, its own included), one row for each row of ``docs``. A null text counts as empty:
    fingerprint zero, which links like any other. A null id is never the smallest; component_id is
    null only where a whole group has none. Repeated rows give repeated rows. Other columns are
    ignored. An empty table gives an empty table.
    """
    fps = written(fingerprints(docs, id_col, text_col, words_each))
    distinct = written(fps.groupBy("_fp").agg(F.min("_id").alias("_least")))
    label = components(links(distinct, max_bits))
    grouped = written(
        distinct.join(label, distinct["_fp"] == label["node"], "left").select("_fp", "_least", F.coalesce("component", "_fp").alias("_group"))
    )
    least = grouped.groupBy("_group").agg(F.min("_least").alias("component_id")).select(opaque("_group").alias("_g"), "component_id")
    member = written(grouped.join(least, F.col("_group") == F.col("_g")).select(F.col("_fp").alias("_f"), "component_id"))
    out = fps.join(member, fps["_fp"] == member["_f"])
    return out.select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, groups: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """docs without those that are not the smallest id of their group (groups: id, component_id).

    Rows with a null id stay. Of rows that repeat an id, all stay or none."""
    gone = groups.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
