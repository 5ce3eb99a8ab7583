"""Bloom filters over 64-bit hashes, filled in tasks and merged shard by shard."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

#: Hash functions, bits for each key, bits of a shard, and the least and most bits of a filter (32 MB).
HASHES, BITS_EACH, SHARD_BITS, LEAST_BITS, MOST_BITS = 4, 16, 1 << 20, 1 << 20, 1 << 28
SHARD_BYTES = SHARD_BITS // 8


def size_for(keys: int, most: int = MOST_BITS) -> int:
    """Bits, a power of two, for so many keys."""
    return min(most, max(LEAST_BITS, 1 << (BITS_EACH * max(keys, 1) - 1).bit_length()))


def positions(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Double hashing: the bit positions of each hash, one array for each hash function."""
    step = (hashes >> np.uint64(31)) | np.uint64(1)
    for i in range(HASHES):
        yield ((hashes + np.uint64(i) * step) & np.uint64(bits - 1)).astype(np.int64)


def put(held: np.ndarray, hashes: np.ndarray) -> None:
    """held: packed bits."""
    for p in positions(hashes, 8 * len(held)):
        p = np.unique(p)
        byte, start = np.unique(p >> 3, return_index=True)
        if len(byte):
            held[byte] |= np.bitwise_or.reduceat((1 << (p & 7)).astype(np.uint8), start)


def has(held: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes the filter holds, or seems to hold."""
    found = np.ones(len(hashes), bool)
    for p in positions(hashes, 8 * len(held)):
        found &= (held[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)
    return found


def shards(*filters: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    """(number, zipped parts of each filter) of the shards that are not empty in the first."""
    for i in range(-(-len(filters[0]) // SHARD_BYTES)):
        parts = [f[i * SHARD_BYTES : (i + 1) * SHARD_BYTES] for f in filters]
        if parts[0].any():
            yield i, [zlib.compress(p.tobytes(), 1) for p in parts]


def n_tasks(bits: int) -> int:
    """Tasks that merge the shards of a filter."""
    return max(1, min(64, bits // SHARD_BITS))


def unzipped(x: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x), np.uint8)


def filter_of(hashes: DataFrame, count: int, most: int = MOST_BITS) -> Broadcast:
    """hashes: one long column of ``count`` rows. A filter of them in all tasks: MOST_BITS at most, so it seems to hold
    more than it does where there are more keys than it has room for."""
    bits = size_for(count, most)
    target = pa.schema([("shard", pa.int32()), ("part", pa.binary())])

    def rows(found: list[tuple[int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.binary())], schema=target)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(bits // 8, np.uint8)
        for b in batches:
            put(held, b.column(0).to_numpy().view(np.uint64))
        for shard, (part,) in shards(held):
            yield rows([(shard, part)])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for shard, part in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held[shard] = held[shard] | unzipped(part) if shard in held else unzipped(part)
        for shard, part in held.items():
            yield rows([(shard, zlib.compress(part.tobytes(), 1))])

    kind = "shard int, part binary"
    parts = hashes.mapInArrow(fill, kind).repartition(n_tasks(bits), "shard").mapInArrow(merge, kind)
    whole = np.zeros(bits // 8, np.uint8)
    for r in parts.collect():  # bits / 8 bytes
        whole[r.shard * SHARD_BYTES : (r.shard + 1) * SHARD_BYTES] = unzipped(r.part)
    return hashes.sparkSession.sparkContext.broadcast(whole.tobytes())
