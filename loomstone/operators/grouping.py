"""Grouping files into blocks, blocks into volumes, and blocks into chunks.

Only metadata is sorted and packed. Packing is a fold over a sorted sequence, range by range of that
sequence: a range has about ``RANGE_ROWS`` files, and blocks of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions import columns as C
from loomstone.sources.store import written

BLOCK_BYTES, CHUNK_BYTES, RANGE_ROWS = 256 << 20, 1 << 20, 100_000


def similarity_order(path: Column) -> list[Column]:
    """By extension, those without one first, then by path."""
    return [C.extension(path).asc_nulls_first(), path.asc()]


def ranked(df: DataFrame, group: str, order: list[Column], out: str) -> DataFrame:
    """df with the place of each row in its group, from 1, by a sort over ranges of (group, order): a group may hold
    all rows. Rows that are equal in the order take places in any order."""
    by = [F.col(group).asc_nulls_first(), *order]
    placed = written(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_m", F.monotonically_increasing_id()))
    parts = placed.groupBy(F.col(group).alias("_g"), F.shiftright("_m", 33).alias("_p")).agg(F.min("_m").alias("_lo"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    both = placed.join(parts, F.col(group).eqNullSafe(F.col("_g")) & (F.shiftright("_m", 33) == F.col("_p")))
    return both.withColumn(out, F.col("_m") - F.col("_lo") + F.col("_before") + 1).drop("_m", "_g", "_p", "_lo", "_n", "_before")


def similarity_rank(files: DataFrame, group: str = "block_type", path: str = "path") -> DataFrame:
    """files with ``similarity``: the place of a file in its group, from 1."""
    return ranked(files, group, similarity_order(F.col(path)), "similarity")


class FirstFit:
    """Bins of one capacity; each size goes to the first bin with room, found in a tree of the largest rooms.

    What is larger than a bin gets one of its own."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.used, self.leaves = capacity, 0, 1
        self.tree = [-1, -1]

    def _set(self, at: int, room: int) -> None:
        tree, i = self.tree, at + self.leaves
        tree[i] = room
        while i > 1:
            i //= 2
            tree[i] = max(tree[2 * i], tree[2 * i + 1])

    def put(self, size: int) -> int:
        tree = self.tree
        if tree[1] >= size:
            i = 1
            while i < self.leaves:
                i = 2 * i if tree[2 * i] >= size else 2 * i + 1
            at = i - self.leaves
            self._set(at, tree[i] - size)
            return at
        at = self.used
        self.used += 1
        if at == self.leaves:
            rooms = tree[self.leaves :]
            self.leaves *= 2
            self.tree = [-1] * (2 * self.leaves)
            for k, room in enumerate(rooms):
                self._set(k, room)
        self._set(at, max(-1, self.capacity - size))
        return at


def first_fit(sizes: list[int], capacity: int) -> list[int]:
    """Bin of each size."""
    bins = FirstFit(capacity)
    return [bins.put(s) for s in sizes]


def pack_blocks(files: DataFrame, capacity: int = BLOCK_BYTES, range_rows: int = RANGE_ROWS) -> DataFrame:
    """files (path, size, block_type, ...) with block_no (from 0 within type and range) and ``shard``, the range:
    one of about ``range_rows`` files in the order of types, extensions and paths.

    Every row gets a block; a file larger than the capacity is admitted into an empty one."""
    files = files.select("*", C.extension(F.col("path")).alias("_ext"))
    ranges = max(1, -(-files.count() // range_rows))
    fields = "block_type string, path string, shard int, block_no int"

    def stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, bins = TaskContext.get().partitionId(), {}  # a block never mixes types
        for b in batches:
            types, paths, sizes, _ = (c.to_pylist() for c in b.columns)
            if types:  # empty files fit anywhere
                at = [bins.setdefault(t, FirstFit(capacity)).put(s or 0) for t, s in zip(types, sizes, strict=True)]
                numbers = {"shard": pa.array([shard] * len(at), pa.int32()), "block_no": pa.array(at, pa.int32())}
                yield pa.RecordBatch.from_pydict({"block_type": types, "path": paths, **numbers})

    order = [F.col("block_type").asc_nulls_first(), F.col("_ext").asc_nulls_first(), F.col("path").asc()]
    slim = files.select("block_type", "path", "size", "_ext").repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    packed = slim.mapInArrow(stretch, fields).withColumnsRenamed({"block_type": "_t", "path": "_p"})
    out = files.drop("_ext").join(packed, (F.col("block_type") == F.col("_t")) & (F.col("path") == F.col("_p")))
    return out.drop("_t", "_p")


def block_ids(packed: DataFrame) -> DataFrame:
    """packed with block_id: blocks of all types in one sequence (text, multimedia, binary, raw, mixed), from 0."""
    blocks = packed.select("block_type", "shard", "block_no").distinct()
    order = Window.orderBy(C.block_rank(F.col("block_type")), "shard", "block_no")  # one row for each block
    ids = blocks.withColumn("block_id", (F.row_number().over(order) - 1).cast("long"))
    ids = ids.withColumnsRenamed({"block_type": "_t", "shard": "_s", "block_no": "_n"})
    same = (F.col("block_type") == F.col("_t")) & (F.col("shard") == F.col("_s")) & (F.col("block_no") == F.col("_n"))
    return packed.join(ids, same).drop("_t", "_s", "_n")


def block_offsets(files: DataFrame, block: str = "block_id", path: str = "path") -> DataFrame:
    """files with block_offset: files of a block follow each other smallest first, equal ones in similarity order."""
    w = Window.partitionBy(block).orderBy("size", *similarity_order(F.col(path)))
    return files.withColumn("block_offset", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))


def is_full(total: Column, capacity: int = BLOCK_BYTES) -> Column:
    """At least nine tenths of the capacity."""
    return total * 10 >= capacity * 9


def block_totals(files: DataFrame, capacity: int = BLOCK_BYTES, block: str = "block_id") -> DataFrame:
    agg = files.groupBy(block).agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("n_bytes"))
    return agg.withColumn("full", is_full(F.col("n_bytes"), capacity))


def chunk_ranges(df: DataFrame, size: str, chunk: int = CHUNK_BYTES) -> DataFrame:
    """df with one row for each chunk: chunk_no, chunk_offset, chunk_size. Size 0 has one empty chunk."""
    last = F.greatest(F.floor((F.col(size) - 1) / chunk), F.lit(0)).cast("int")
    rows = df.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("chunk_no").cast("long") * chunk
    return rows.withColumns({"chunk_offset": start, "chunk_size": F.least(F.lit(chunk), F.col(size) - start)})


def chunks_of(df: DataFrame, value_col: str, chunk: int = CHUNK_BYTES) -> DataFrame:
    """df with chunk_no and chunk (binary) instead of the value; null has none."""
    v = df.filter(F.col(value_col).isNotNull()).withColumn(value_col, F.col(value_col).cast("binary"))
    rows = chunk_ranges(v.withColumn("_size", F.length(value_col).cast("long")), "_size", chunk)
    part = F.col(value_col).substr((F.col("chunk_offset") + 1).cast("int"), F.col("chunk_size").cast("int"))
    return rows.withColumn("chunk", part).drop(value_col, "_size", "chunk_offset", "chunk_size")


def chunk_files(chunks: DataFrame, files: DataFrame, block: str = "block_id") -> DataFrame:
    """Each chunk with the file its first byte belongs to (start <= offset < end), by a range join within a block.

    Both sides are cut into cells of chunk size, so the join is on (block, cell) and only files of a cell meet."""
    cell = CHUNK_BYTES
    begin, stop = F.col("block_offset"), F.col("block_offset") + F.col("size")
    spans = files.filter("size > 0").withColumn("_cell", F.explode(F.sequence(F.floor(begin / cell), F.floor((stop - 1) / cell))))
    spans = spans.select(F.col(block).alias("_b"), "_cell", F.col("path").alias("path"), begin.alias("_from"), stop.alias("_to"))
    left = chunks.withColumn("_at", F.floor(F.col("chunk_offset") / cell))
    hit = (F.col(block) == F.col("_b")) & (F.col("_at") == F.col("_cell")) & (F.col("chunk_offset") >= F.col("_from")) & (F.col("chunk_offset") < F.col("_to"))
    return left.join(spans, hit, "left").drop("_b", "_cell", "_at", "_from", "_to")


def volumes(blocks: DataFrame, volume_size: int, header: int = 50, reserve: int = 0) -> DataFrame:
    """blocks (block_id, size) with volume_id (from 1), volume_offset and oversize.

    A new volume starts when header + what is written + the block would pass the volume size; ``reserve``
    is kept free in every volume for metadata. A block is never split; one that is larger than a volume
    stands alone and is marked. A fold over one row for each block."""

    def fold(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["block_id"])
        number, used, out = 1, 0, []
        for r in rows:
            if used and header + used + r["size"] + reserve > volume_size:
                number, used = number + 1, 0
            out.append((r["block_id"], number, header + used, header + r["size"] + reserve > volume_size))
            used += r["size"]
        ids, numbers, offsets, over = zip(*out, strict=True)
        cols = pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(offsets, pa.int64()), pa.array(over)
        return pa.table(dict(zip(("_id", "volume_id", "volume_offset", "oversize"), cols, strict=True)))

    slim = blocks.select(F.col("block_id").cast("long").alias("block_id"), F.col("size").cast("long").alias("size"))
    placed = slim.groupBy(F.lit(0).alias("_g")).applyInArrow(fold, "_id long, volume_id int, volume_offset long, oversize boolean")
    return blocks.join(placed, F.col("block_id") == F.col("_id")).drop("_id")


def missing_volumes(volume_index: DataFrame, present: DataFrame) -> DataFrame:
    """Rows of the index (block_id, volume_id) whose volume is not present (volume_id)."""
    return volume_index.join(present, "volume_id", "left_anti")


def metadata_volume(healthy: DataFrame) -> DataFrame:
    """archive_id, volume_id to read metadata from: volume 1 if healthy, else the last one."""
    return healthy.groupBy("archive_id").agg(F.when(F.max(F.col("volume_id") == 1), F.lit(1)).otherwise(F.max("volume_id")).alias("volume_id"))


def with_classification(files: DataFrame, classified: DataFrame) -> DataFrame:
    """files with content_type and pipeline by path; without a classification binary."""
    c = classified.select(F.col("path").alias("_p"), "content_type", "pipeline")
    out = files.join(c, F.col("path") == F.col("_p"), "left").drop("_p")
    return out.withColumns({"content_type": F.coalesce("content_type", F.lit("binary")), "pipeline": F.coalesce("pipeline", F.lit("binary"))})
