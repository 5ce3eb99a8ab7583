"""Conflict-constrained best-fit packing of documents into bins of fixed capacity.

Rows are numbered in a written table and dealt into shards of a bounded number of rows by a hash of the number, so
no task grows with the input and a source, a group of copies or of repeated rows with a third of all rows is spread evenly. Within a shard, pieces go
largest first. Open bins are kept in order of residual capacity; each carries a bitmap of the sources
and one of the duplicate clusters in it. The search starts at the least residual that has
room and goes on to the next larger one until a bin without conflict is found, which is then the
tightest compatible one; if there is none, a bin is opened.

Only ids, sources, clusters and sizes travel, never texts.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstone.llm.common import LOWER, arrow_map, texts, written

CAPACITY, SHARD_ROWS = 2048, 4096


def best_fit(rows: list[tuple], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """rows: (size, source, cluster) with size >= 1, in the order in which ties are settled.

    Returns (row, piece, start, length, bin) for every piece. A row over the capacity is cut into
    full pieces, each a bin of its own, and the rest. A source or cluster of None never conflicts."""
    source_bit: dict = {}
    cluster_bit: dict = {}
    out, pieces, bins = [], [], 0
    for i, (size, _, _) in enumerate(rows):
        full = size // capacity if size > capacity else 0
        for p in range(full):
            out.append((i, p, p * capacity, capacity, bins))
            bins += 1
        if size > full * capacity:
            pieces.append((size - full * capacity, i, full))
    pieces.sort(key=lambda x: (-x[0], x[1]))
    order: list[tuple[int, int]] = []  # (residual, bin), ascending
    marks: dict[int, tuple[int, int]] = {}
    for size, i, piece in pieces:
        _, source, cluster = rows[i]
        s = 0 if source is None else 1 << source_bit.setdefault(source, len(source_bit))
        c = 0 if cluster is None else 1 << cluster_bit.setdefault(cluster, len(cluster_bit))
        at = bisect_left(order, (size, -1))
        while at < len(order) and (marks[order[at][1]][0] & s or marks[order[at][1]][1] & c):
            at += 1
        if at < len(order):
            residual, target = order.pop(at)
        else:
            residual, target = capacity, bins
            bins += 1
            marks[target] = (0, 0)
        marks[target] = (marks[target][0] | s, marks[target][1] | c)
        if residual > size:
            insort(order, (residual - size, target))
        else:
            del marks[target]
        out.append((i, piece, piece * capacity, size, target))
    return out


def measured(docs: DataFrame, id_col: str, text_col: str, source_col: str, cluster_col: str | None = None) -> DataFrame:
    """_id, _source, _size (words and one end), _cluster (128-bit hash of the lower-cased words, or the bytes of
    cluster_col as text) and _row, a number of the row."""
    given = F.lit(None) if cluster_col is None else F.col(cluster_col)
    src = docs.select(
        F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), F.col(text_col).alias("_t"),
        given.cast("string").cast("binary").alias("_given"), F.monotonically_increasing_id().alias("_row"),
    )

    def each(b: pa.RecordBatch) -> dict:
        words = [t.translate(LOWER).split() for t in texts(b, "_t")]
        return {
            "_id": b.column(0),
            "_source": b.column(1),
            "_size": [len(w) + 1 for w in words],
            "_cluster": b.column(3) if cluster_col else [xxhash.xxh3_128_digest(b" ".join(w)) for w in words],
            "_row": b.column(4),
        }

    kind = T.StructType([src.schema["_id"], src.schema["_source"], T.StructField("_size", T.LongType())])
    return arrow_map(src, each, kind.add("_cluster", T.BinaryType()).add("_row", T.LongType()))


def pack(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cluster_col: str | None = None,
    capacity: int = CAPACITY,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """Pack all rows of docs into bins of ``capacity`` tokens (words, and one end for each row).

    No bin holds two pieces of one source, nor two of one duplicate cluster: equal sequences of
    lower-cased words, or equal values of cluster_col, such as the component_id of a near-duplicate operator (null:
    no cluster). Returns the id, source, piece, start and n_tokens (of the piece, in tokens of
    the document) and bin_id (long): every token of every row is in exactly one piece.
    A null text is one token, the end. Null sources never conflict. Null ids, repeated ids and
    repeated rows are packed as rows of their own. Other columns are ignored. An empty table gives an
    empty table. Bins are filled within shards of about ``shard_rows`` rows, so up to one bin for
    each shard and source is emptier than in a single sequence.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    rows = written(measured(docs, id_col, text_col, source_col, cluster_col))
    shards = max(1, -(-rows.count() // shard_rows))
    kind = T.StructType(
        [rows.schema["_id"], rows.schema["_source"], T.StructField("piece", T.IntegerType())]
        + [T.StructField(n, T.LongType()) for n in ("start", "n_tokens", "bin_id")]
    )

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("_id", "_cluster", "_source", "_row")])
        shard = table.column("_shard")[0].as_py()
        got = best_fit(list(zip(*(table.column(c).to_pylist() for c in ("_size", "_source", "_cluster")), strict=True)), capacity)
        index, piece, start, length, bins = zip(*got, strict=True)
        at = pa.array(index)
        return pa.table(
            {
                "_id": table.column("_id").take(at),
                "_source": table.column("_source").take(at),
                "piece": pa.array(piece, pa.int32()),
                "start": pa.array(start, pa.int64()),
                "n_tokens": pa.array(length, pa.int64()),
                "bin_id": pa.array([shard << 32 | x for x in bins], pa.int64()),
            }
        )

    dealt = rows.withColumn("_shard", F.pmod(F.xxhash64("_row"), F.lit(shards)))
    out = dealt.groupBy("_shard").applyInArrow(fill, kind)
    return out.withColumnsRenamed({"_id": id_col, "_source": source_col})
