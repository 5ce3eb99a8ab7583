"""Embedding near-dedup by an epsilon grid order join.

Unit vectors with cosine c lie sqrt(2 - 2c) apart, so a cosine threshold is a distance epsilon. A vector's
coordinates are its leading principal dimensions and the length of what they leave out: as the lengths of
two residuals differ by no more than the residuals do, coordinates are never farther apart than the vectors.
Coordinates are sorted by the grid cells of the first of them (epsilon grid order) and cut into blocks
of consecutive vectors. Two blocks whose bounding boxes are more than epsilon apart are never brought together; of
two that are not, only the vectors within epsilon of the other's box travel, as coordinates of 16 bits. Within a
pair of blocks the two sequences are joined recursively: intervals are halved, and pairs of intervals that
are provably distant are skipped. What is left, with the rounding allowed for, names the vectors that may
have a link there. These alone travel as they are, and are joined in the same way by cosine in double precision.

Where vectors have clusters, most pairs of blocks are skipped. Where all directions are alike, no box is far from another:
then each block's coordinates, 2 bytes for each of ``LEADING`` dimensions, meet those of all others, a cost that grows with
the square of the number of blocks, but no whole vector travels without a near coordinate.

Equal vectors are one row with a weight until the end, so a very common vector costs nothing. A block has ``BLOCK``
vectors at most. The driver holds the boxes of the blocks, some 0.03 bytes for each vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstone.llm.common import arrow_map, opaque, written
from loomstone.llm.components import components

#: Principal dimensions that are compared first, and how many of them make the grid; rows of a block and of a leaf.
LEADING, GRID, BLOCK, LEAF = 32, 8, 16_384, 128
#: What rounding to 16 bits may change of a vector's coordinates, and so of a product of two.
ROUNDING = 2.0**-11


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(col: pa.Array, d: int) -> np.ndarray:
    """Rows of a list column; also of a slice."""
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False)).reshape(-1, d)


def coordinates(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Projections of unit vectors, and the lengths of what is left: unit vectors again."""
    c = x @ axes
    return np.c_[c, np.sqrt(np.maximum(0.0, 1 - (c * c).sum(axis=1)))]


def _axes(rows: DataFrame, d: int) -> np.ndarray:
    """The leading principal dimensions of the unit vectors in _v, as columns, most variance first."""
    kind = T.StructType([T.StructField("p", T.IntegerType()), T.StructField("m", T.BinaryType())])

    def pack(m: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"p": pa.array([int(np.abs(m).sum() * 1e6) % 16], pa.int32()), "m": pa.array([m.tobytes()], pa.binary())})

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d + 1, d + 1))
        for b in batches:
            if b.num_rows:
                x = np.c_[np.ones(b.num_rows), unit(_matrix(b.column(0), d))]
                total += x.T @ x
        yield pack(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d + 1, d + 1))
        for b in batches:
            for m in b.column(1).to_pylist():
                total += np.frombuffer(m).reshape(d + 1, d + 1)
        yield pack(total)

    got = rows.select("_v").mapInArrow(moments, kind).repartition(16, "p").mapInArrow(add, kind).collect()
    total = sum((np.frombuffer(r.m).reshape(d + 1, d + 1) for r in got), np.zeros((d + 1, d + 1)))
    mean = total[0, 1:] / total[0, 0]
    _, vectors = np.linalg.eigh(total[1:, 1:] / total[0, 0] - np.outer(mean, mean))
    return vectors[:, ::-1][:, : min(LEADING, d)]


def _position(coords: np.ndarray, eps: float) -> np.ndarray:
    """Place in epsilon grid order as a double: the cells of the leading dimensions, first to last."""
    m = coords.shape[1]
    bits = 48 // m
    width = max(eps, 2.0 / (1 << bits))
    cells = np.clip(np.floor((coords + 1) / width), 0, (1 << bits) - 1)
    out = np.zeros(len(coords))
    for i in range(m):
        out = out * (1 << bits) + cells[:, i]
    return out + (coords[:, 0] + 1.0) / 2.0001  # order within a cell


def _gap(lo_a: np.ndarray, hi_a: np.ndarray, lo_b: np.ndarray, hi_b: np.ndarray) -> np.ndarray:
    """Least distance between boxes; broadcasts."""
    g = np.maximum(0.0, np.maximum(lo_a - hi_b, lo_b - hi_a))
    return np.sqrt((g * g).sum(axis=-1))


def join_intervals(
    ua: np.ndarray, ca: np.ndarray, ub: np.ndarray, cb: np.ndarray, same: bool, threshold: float, eps: float
) -> Iterator[tuple[int, int, np.ndarray]]:
    """(offset in a, offset in b, matrix of links) of all leaves that have links.

    u: vectors whose products are compared with the threshold, c: coordinates that are never farther apart than the
    vectors, both in epsilon grid order. same: a and b are one
    sequence; then each pair comes once, and a vector is never linked with itself."""

    def boxes(c: np.ndarray) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        out = {}

        def cut(s: int, e: int) -> None:
            out[s, e] = (c[s:e].min(axis=0), c[s:e].max(axis=0))
            if e - s > LEAF:
                mid = (s + e) // 2
                cut(s, mid)
                cut(mid, e)

        if len(c):
            cut(0, len(c))
        return out

    box_a = boxes(ca)
    box_b = box_a if same else boxes(cb)
    halves = lambda s, e: [(s, e)] if e - s <= LEAF else [(s, (s + e) // 2), ((s + e) // 2, e)]
    todo = [((0, len(ua)), (0, len(ub)))] if len(ua) and len(ub) else []
    while todo:
        a, b = todo.pop()
        if same and b < a or _gap(*box_a[a], *box_b[b]) > eps:
            continue
        if a[1] - a[0] <= LEAF and b[1] - b[0] <= LEAF:
            hit = ua[a[0] : a[1]] @ ub[b[0] : b[1]].T >= threshold
            if same and a == b:
                hit = np.triu(hit, 1)
            if hit.any():
                yield a[0], b[0], hit
        else:
            todo += [(x, y) for x in halves(*a) for y in halves(*b)]


def near_blocks(lo: np.ndarray, hi: np.ndarray, own: int, eps: float) -> list[int]:
    """The blocks whose boxes are not provably farther than eps from that of a block."""
    return np.flatnonzero(_gap(lo[own], hi[own], lo, hi) <= eps).tolist()


def _longs(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.LongType()) for n in names])


def _blocks(rows: DataFrame, axes: np.ndarray, d: int, n: int, eps: float) -> DataFrame:
    """rows: _node, _v. number, node, c, lo, hi: blocks in epsilon grid order, nodes and 16-bit coordinates as bytes."""

    def place(b: pa.RecordBatch) -> dict:
        c = coordinates(unit(_matrix(b.column(1), d)), axes)
        return {"_node": b.column(0), "_pos": _position(c[:, :GRID], eps), "_c": [r.tobytes() for r in c.astype(np.float16)]}

    kind = T.StructType([T.StructField("_node", T.LongType()), T.StructField("_pos", T.DoubleType()), T.StructField("_c", T.BinaryType())])
    placed = arrow_map(rows.select("_node", "_v"), place, kind)
    ordered = placed.repartitionByRange(-(-n // BLOCK), "_pos", "_node").sortWithinPartitions("_pos", "_node")
    ordered = written(ordered.select(F.monotonically_increasing_id().alias("_m"), "_node", "_c"))
    sizes = ordered.groupBy(F.shiftright("_m", 33).alias("p")).agg(F.min("_m").alias("first"), F.count(F.lit(1)).alias("n"))
    parts = sorted((r.p, r.first, r.n) for r in sizes.collect())  # a row for each partition
    first = np.array([p[1] for p in parts], np.int64)
    before = np.cumsum([0, *(p[2] for p in parts)])[:-1]
    width = axes.shape[1] + 1

    def number(b: pa.RecordBatch) -> dict:
        """Blocks are alike in size however the rows were dealt: the place in the whole order says which."""
        m = b.column(0).to_numpy()
        at = np.searchsorted(first, m, side="right") - 1
        return {"number": (before[at] + m - first[at]) // BLOCK, "_m": b.column(0), "_node": b.column(1), "_c": b.column(2)}

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("_m")
        c = np.frombuffer(b"".join(table.column("_c").to_pylist()), np.float16).reshape(-1, width)
        limits = {"lo": pa.array([c.min(axis=0).astype(float).tolist()]), "hi": pa.array([c.max(axis=0).astype(float).tolist()])}
        node = pa.array([table.column("_node").to_numpy().tobytes()], pa.binary())
        return pa.table({"number": table.column("number").slice(0, 1), "node": node, "c": pa.array([c.tobytes()], pa.binary()), **limits})

    kind = T.StructType([T.StructField(n, T.LongType()) for n in ("number", "_m", "_node")]).add("_c", T.BinaryType())
    numbered = arrow_map(ordered, number, kind)
    kind = "number long, node binary, c binary, lo array<double>, hi array<double>"
    return written(numbered.groupBy("number").applyInArrow(build, kind))


def _candidates(blocks: DataFrame, width: int, eps: float) -> DataFrame:
    """i, j, side, node: the vectors that may have a link between two blocks, or within one."""
    limits = sorted(((r.number, r.lo, r.hi) for r in blocks.select("number", "lo", "hi").collect()), key=lambda x: x[0])
    number = np.array([x[0] for x in limits], np.int64)
    lo, hi = (np.array([x[i] for x in limits]).reshape(len(limits), -1) for i in (1, 2))
    sent = blocks.sparkSession.sparkContext.broadcast((number, lo, hi))
    far = eps + 2 * ROUNDING + 1e-6
    least = 1 - 2 * ROUNDING - far * far / 2 - 1e-6
    kind = T.StructType([*_longs("i", "j", "side").fields, T.StructField("node", T.BinaryType()), T.StructField("c", T.BinaryType())])

    def deal(b: pa.RecordBatch) -> dict:
        number, lo, hi = sent.value
        out: dict[str, list] = {n: [] for n in kind.names}
        for block, node, c in zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in ("number", "node", "c")), strict=True):
            node, c = np.frombuffer(node, np.int64), np.frombuffer(c, np.float16).reshape(-1, width)
            wide, own = c.astype(np.float64), int(np.searchsorted(number, block))
            for k in near_blocks(lo, hi, own, far):
                near = np.arange(len(c)) if k == own else np.flatnonzero(_gap(wide, wide, lo[k], hi[k]) <= far)
                if len(near):
                    row = (min(own, k), max(own, k), int(own > k), node[near].tobytes(), c[near].tobytes())
                    for n, value in zip(kind.names, row, strict=True):
                        out[n].append(value)
        return out

    def meet(table: pa.Table) -> pa.Table:
        rows = {r["side"]: r for r in table.to_pylist()}
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        found: list[tuple[int, np.ndarray]] = []
        if i == j or len(rows) == 2:
            read = lambda r: (np.frombuffer(r["node"], np.int64), np.frombuffer(r["c"], np.float16).reshape(-1, width).astype(np.float32))
            na, ca = read(rows[0])
            nb, cb = (na, ca) if i == j else read(rows[1])
            hits = [np.zeros(len(na), bool), np.zeros(len(nb), bool)]
            for s, t, hit in join_intervals(ca, ca, cb, cb, i == j, least, far):
                hits[0][s : s + hit.shape[0]] |= hit.any(axis=1)
                hits[1][t : t + hit.shape[1]] |= hit.any(axis=0)
            found = [(0, na[hits[0] | hits[1]])] if i == j else [(0, na[hits[0]]), (1, nb[hits[1]])]
        nodes = np.concatenate([x for _, x in found]) if found else np.empty(0, np.int64)
        side = np.concatenate([np.full(len(x), k, np.int64) for k, x in found]) if found else nodes
        return pa.table({"i": np.full(len(nodes), i), "j": np.full(len(nodes), j), "side": side, "node": nodes})

    dealt = arrow_map(blocks.select("number", "node", "c"), deal, kind)
    return dealt.groupBy("i", "j").applyInArrow(meet, _longs("i", "j", "side", "node"))


def _pair_schema() -> T.StructType:
    longs = T.ArrayType(T.LongType())
    return T.StructType([T.StructField(n, longs) for n in ("nodes", "links", "a", "b")])


class Leaves:
    """Links of leaves: how much each node links to, and a forest of the links."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    def add(self, a: np.ndarray, b: np.ndarray, hit: np.ndarray) -> None:
        """Nodes a and b, and which of them link: labels run along the links until each has the least of its component."""
        la, lb, top = a.copy(), b.copy(), np.iinfo(np.int64).max
        while True:
            new_b = np.minimum(lb, np.where(hit, la[:, None], top).min(axis=0))
            new_a = np.minimum(la, np.where(hit, new_b[None, :], top).min(axis=1))
            if (new_a == la).all() and (new_b == lb).all():
                break
            la, lb = new_a, new_b
        for x, y in (*zip(a.tolist(), la.tolist(), strict=True), *zip(b.tolist(), lb.tolist(), strict=True)):
            if x != y and (p := self.root(x)) != (q := self.root(y)):
                self.parent[max(p, q)] = min(p, q)


def _exact(candidates: DataFrame, rows: DataFrame, axes: np.ndarray, d: int, threshold: float, eps: float) -> DataFrame:
    """candidates: i, j, side, node; rows: _node, _v, _n. For each pair of blocks, nodes and how many vectors
    they link to, and edges of a forest."""
    whole = rows.select(opaque("_node").alias("_of"), "_v", F.col("_n").cast("long").alias("_w"))
    placed = candidates.join(whole, F.col("node") == F.col("_of")).select("i", "j", "side", "node", "_w", "_v")

    def join(table: pa.Table) -> pa.Table:
        empty = {n: pa.array([], pa.list_(pa.int64())) for n in ("nodes", "links", "a", "b")}
        same = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        sides = []
        for k in (0,) if same else (0, 1):
            t = table.filter(pa.compute.equal(table.column("side"), k))
            x = unit(_matrix(t.column("_v").combine_chunks(), d)) if t.num_rows else np.empty((0, d))
            c = coordinates(x, axes) if t.num_rows else np.empty((0, axes.shape[1] + 1))
            node = t.column("node").to_numpy()
            order = np.lexsort((node, _position(c[:, :GRID], eps)))
            sides.append((node[order], t.column("_w").to_numpy()[order].astype(float), x[order], c[order]))
        (na, wa, ua, ca), (nb, wb, ub, cb) = sides[0], sides[-1]
        links_a, links_b, leaves = np.zeros(len(na)), np.zeros(len(nb)), Leaves()
        for s, t, hit in join_intervals(ua, ca, ub, cb, same, threshold, eps + 1e-9):
            n, m = hit.shape
            links_a[s : s + n] += hit @ wb[t : t + m]
            links_b[t : t + m] += wa[s : s + n] @ hit
            leaves.add(na[s : s + n], nb[t : t + m], hit)
        edges = [(x, leaves.root(x)) for x in list(leaves.parent) if leaves.root(x) != x]
        nodes, links = (na, links_a + links_b) if same else (np.r_[na, nb], np.r_[links_a, links_b])
        some = links > 0
        if not some.any():
            return pa.table(empty)
        cols = (nodes[some].tolist(), links[some].astype(np.int64).tolist(), [e[0] for e in edges], [e[1] for e in edges])
        return pa.table({n: pa.array([c], pa.list_(pa.int64())) for n, c in zip(empty, cols, strict=True)})

    return placed.groupBy("i", "j").applyInArrow(join, _pair_schema())


def _of_one_dimension(rows: DataFrame, d: int, n: int, threshold: float) -> DataFrame:
    """rows: _node, _v, _n, all of d components. Returns what _exact does."""
    eps = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    axes = _axes(rows, d)
    blocks = _blocks(rows, axes, d, n, eps)
    return _exact(_candidates(blocks, axes.shape[1] + 1, eps), rows, axes, d, threshold, eps)


def near_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """Links between all vectors with cosine >= threshold (over 0), and their groups.

    Returns the id, n_links (other vectors linked directly, copies included), component_id (the
    smallest id reachable, its own included) and kept (id = component_id), one row for each row.
    A vector that is null, empty or zero, or holds null or non-finite components, links with
    nothing, and so does a row whose id is null (component_id and kept are then null). Vectors
    with different numbers of components never link. Repeated rows are vectors of their own.
    Other columns, labels too, are ignored. An empty table gives an empty table.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is over 0 and at most 1")
    src = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).alias("_v"))
    finite = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    fine = F.col("_id").isNotNull() & (F.size("_v") > 0) & finite & F.exists("_v", lambda x: x != 0)
    fine = F.coalesce(fine, F.lit(False))
    # rows of equal vectors meet by 128 bits of hashes, so that vectors travel once
    keys = [F.xxhash64("_v").alias("_h1"), F.xxhash64(F.lit("second"), "_v").alias("_h2")]
    good = src.filter(fine).select("_id", *keys, "_v")
    distinct = good.groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_least"), F.first("_v").alias("_v"))
    distinct = written(distinct.select(F.monotonically_increasing_id().alias("_node"), "*"))
    sizes = distinct.groupBy(F.size("_v").alias("d")).count().collect()  # a row for each number of components
    parts = [_of_one_dimension(distinct.filter(F.size("_v") == r.d), r.d, r["count"], threshold) for r in sizes]
    spark = vectors.sparkSession
    found = written(reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], _pair_schema()))
    links = found.select(F.inline(F.arrays_zip("nodes", "links"))).groupBy(F.col("nodes").alias("_l")).agg(F.sum("links").alias("_links"))
    label = components(found.select(F.inline(F.arrays_zip("a", "b"))))
    node = distinct.drop("_v").join(links, F.col("_node") == F.col("_l"), "left").join(label, F.col("_node") == F.col("node"), "left")
    linked = (F.coalesce("_links", F.lit(0)) + F.col("_n") - 1).alias("_links")
    node = written(node.select("_h1", "_h2", "_least", linked, F.coalesce("component", "_node").alias("_group")))
    least = node.groupBy("_group").agg(F.min("_least").alias("_component")).select(opaque("_group").alias("_g"), "_component")
    node = node.join(least, F.col("_group") == F.col("_g")).select(opaque("_h1").alias("_k1"), opaque("_h2").alias("_k2"), "_links", "_component")
    out = good.drop("_v").join(node, (F.col("_h1") == F.col("_k1")) & (F.col("_h2") == F.col("_k2")))
    out = out.select("_id", F.col("_links").alias("n_links"), F.col("_component").alias("component_id"))
    rest = src.filter(~fine).select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"))
    return out.union(rest).select(F.col("_id").alias(id_col), "n_links", "component_id", (F.col("_id") == F.col("component_id")).alias("kept"))
