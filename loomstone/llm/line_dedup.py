"""Line dedup with two Bloom filters.

A line's key is the line with [\\x20\\x09-\\x0D] stripped at both ends and A-Z lower-cased. One
pass over the texts fills two Bloom filters: keys seen in one document, and keys
seen in two. Filters of tasks merge shard by shard: what is in the once-filters of two tasks is
seen twice. A second pass sends on only the keys that the twice-filter suspects, as 128-bit
digests, and a plain aggregation over these gives the exact number of documents and the first
of them. So a false alarm of the filters costs a row, never a wrong result.

Filters have 16 bits and more for each line (0.2 % false alarms), as lines are counted first, up to ``MOST_BITS``
(256 MB; 128 million lines at that rate). In a larger corpus more and more lines are suspects, in the end all, and the
confirming shuffle is that of an exact count, 16 bytes and an id for each line.

The keys to drop travel to the tasks if there are ``MOST_KEYS`` at most, and then no text is shuffled; if there are
more, documents are joined with their keys.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstone.llm import bloom
from loomstone.llm.common import LOWER, ROWS_AT_ONCE, WHITE, arrow_map, arrow_schema, texts, written

#: Bits of a filter at most (256 MB), and keys that travel to all tasks at most.
MOST_BITS, MOST_KEYS = 1 << 31, 1 << 19


def line_keys(text: bytes) -> list[bytes]:
    return [x.strip(WHITE) for x in text.translate(LOWER).split(b"\n")]


def _hashes(batch: pa.RecordBatch) -> tuple[list[list[bytes]], np.ndarray]:
    """Distinct keys of each document, and the hashes of all of them in a row."""
    keys = [[k for k in dict.fromkeys(line_keys(t)) if k] for t in texts(batch, "_t")]
    h = xxhash.xxh64_intdigest
    return keys, np.fromiter((h(k) for ks in keys for k in ks), np.uint64, sum(map(len, keys)))


def _filters(docs: DataFrame, bits: int) -> DataFrame:
    """shard, once, twice: the merged filters, zipped. docs: _t."""
    kind = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("once", T.BinaryType()), T.StructField("twice", T.BinaryType())])
    target = arrow_schema(kind)

    def row(shard: int, parts: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *(pa.array([x], pa.binary()) for x in parts)], schema=target)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for b in (x.slice(i, ROWS_AT_ONCE) for x in batches for i in range(0, x.num_rows, ROWS_AT_ONCE)):
            h, n = np.unique(_hashes(b)[1], return_counts=True)
            bloom.put(twice, h[(n > 1) | bloom.has(once, h)])
            bloom.put(once, h)
        for shard, parts in bloom.shards(once, twice):
            yield row(shard, parts)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for shard, *zipped in zip(*(c.to_pylist() for c in b.columns), strict=True):
                once, twice = map(bloom.unzipped, zipped)
                o, t = held.get(shard, (np.zeros_like(once), np.zeros_like(twice)))
                held[shard] = (o | once, t | twice | (o & once))
        for shard, parts in held.items():
            yield row(shard, [zlib.compress(x.tobytes(), 1) for x in parts])

    return docs.mapInArrow(fill, kind).repartition(bloom.n_tasks(bits), "shard").mapInArrow(merge, kind)


def digest(key: bytes) -> bytes:
    """128 bits that stand for a key."""
    return hashlib.sha256(key).digest()[:16]


def suspects(docs: DataFrame, bits: int | None = None) -> DataFrame:
    """docs: _id, _t. _id, _digest: the distinct keys of each document that the twice-filter holds."""
    docs = docs.select("_id", "_t")
    if bits is None:
        breaks = F.length("_t") - F.length(F.replace("_t", F.lit("\n")))
        bits = bloom.size_for(docs.agg(F.coalesce(F.sum(breaks + 1), F.lit(0))).first()[0], MOST_BITS)
    twice = np.zeros(bits // 8, np.uint8)
    for r in _filters(docs.select("_t"), bits).select("shard", "twice").toLocalIterator():  # bits / 8 bytes
        twice[r.shard * bloom.SHARD_BYTES : (r.shard + 1) * bloom.SHARD_BYTES] = bloom.unzipped(r.twice)
    sent = docs.sparkSession.sparkContext.broadcast(zlib.compress(twice, 1))
    del twice
    state: dict = {}

    def find(b: pa.RecordBatch) -> dict:
        if "held" not in state:
            state["held"] = bloom.unzipped(sent.value)
        keys, h = _hashes(b)
        hit = bloom.has(state["held"], h).tolist()
        rows, digests, at = [], [], 0
        for i, ks in enumerate(keys):
            for k in ks:
                if hit[at]:
                    rows.append(i)
                    digests.append(digest(k))
                at += 1
        return {"_id": b.column(0).take(pa.array(rows, pa.int64())), "_digest": digests}

    return arrow_map(docs, find, T.StructType([docs.schema["_id"], T.StructField("_digest", T.BinaryType())]))


def without(text: bytes, every: set[bytes] | dict, first: set[bytes]) -> tuple[list[bytes], int]:
    """The lines that stay, and how many there were. Keys, by digest, in ``first`` stay once, others in ``every`` go."""
    lines, kept, gone = text.split(b"\n"), [], set()
    for line, key in zip(lines, line_keys(text), strict=True):
        d = digest(key) if key else b""
        if d in first and d not in gone:
            gone.add(d)
        elif d in every or d in first:
            continue
        kept.append(line)
    return kept, len(lines)


def dedup_lines(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = 10,
    keep: str = "none",
    bits: int | None = None,
    most_keys: int = MOST_KEYS,
) -> DataFrame:
    """Drop lines whose key is found in at least ``min_docs`` documents.

    keep="none": such lines go in every document. keep="first": the first such line of the document
    with the smallest id stays. Other lines stay as they were, joined by a line feed.

    Returns the columns of ``docs``, with the text changed, and n_lines and n_dropped (long).
    Every row counts as a document, repeated rows and ids too; rows with equal ids are treated
    alike. A null text counts as the empty text: one empty line, which is never dropped. Empty keys
    never count. A null id is an id like others, though never the smallest. Input columns called
    n_lines or n_dropped are replaced. An empty table gives an empty table.
    """
    if keep not in ("none", "first"):
        raise ValueError(f"keep: {keep}")
    found = written(suspects(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")), bits))
    counts = found.groupBy("_digest").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first")).filter(F.col("_n") >= min_docs)
    counts = written(counts.select("_digest", "_first"))
    base = docs.drop("n_lines", "n_dropped")
    kind = T.StructType([*base.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    passed = base.columns
    col = lambda b, c: b.column(b.schema.get_field_index(c))

    def changed(b: pa.RecordBatch, got: list[tuple[list[bytes], int]]) -> dict:
        out = pa.array([b"\n".join(kept) for kept, _ in got], pa.binary()).cast(pa.string())
        more = {text_col: out, "n_lines": [n for _, n in got], "n_dropped": [n - len(kept) for kept, n in got]}
        return {c: col(b, c) for c in passed} | more

    if counts.count() <= most_keys:
        drops = {bytes(r._digest): r._first for r in counts.toLocalIterator()}  # most_keys rows at most
        sent = docs.sparkSession.sparkContext.broadcast(drops)

        def look_up(b: pa.RecordBatch) -> dict:
            drops, got = sent.value, []
            for text, i in zip(texts(b, text_col), col(b, id_col).to_pylist(), strict=True):
                first = set()
                if keep == "first" and i is not None:
                    first = {d for d in map(digest, set(line_keys(text))) if drops.get(d) == i}
                got.append(without(text, drops, first))
            return changed(b, got)

        return arrow_map(base, look_up, kind)

    # concat hides how the counts are dealt: a very common line may be split over tasks
    counts = counts.select(F.concat(F.col("_digest"), F.lit(b"")).alias("_key"), "_first")
    stays = F.coalesce(F.col("_id") == F.col("_first"), F.lit(False)) & F.lit(keep == "first")
    drops = found.join(counts, found["_digest"] == counts["_key"]).withColumn("_keeps", stays).groupBy(F.col("_id").alias("_of"))
    of = lambda which: F.collect_set(F.when(which, F.col("_digest")))
    drops = drops.agg(of(~F.col("_keeps")).alias("_drop"), of(F.col("_keeps")).alias("_once"))
    joined = base.join(drops, base[id_col].eqNullSafe(drops["_of"]), "left").drop("_of")

    def apply(b: pa.RecordBatch) -> dict:
        each = zip(texts(b, text_col), col(b, "_drop").to_pylist(), col(b, "_once").to_pylist(), strict=True)
        return changed(b, [without(text, set(drop or ()), set(once or ())) for text, drop, once in each])

    return arrow_map(joined, apply, kind)
