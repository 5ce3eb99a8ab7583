"""Static order-0 range asymmetric numeral systems, many streams in lockstep.

12-bit frequencies, 64-bit states that start at 2^24, bytes out one by one, symbols from last to first,
and the final state as 8 bytes, big-endian, at the end of the stream.
"""

from __future__ import annotations

import numpy as np

from loomstone.functions import jvm

SCALE_BITS = 12
TOTAL = 1 << SCALE_BITS
LOW = 1 << 24


def normalise(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 4096: floor(4096 p + 0.5), at least 1 for what occurs; the largest (of
    equal ones the last) takes the difference. Without any symbol 16 for each."""
    return normalise_many(counts[None])[0]


def normalise_many(counts: np.ndarray) -> np.ndarray:
    """normalise of each row."""
    n = counts.sum(axis=1)
    p = (counts / np.maximum(n, 1)[:, None]).astype(np.float32)
    out = np.floor(p * np.float32(TOTAL) + np.float32(0.5)).astype(np.int64)
    out[(counts > 0) & (out < 1)] = 1
    out[n == 0] = TOTAL // 256
    row, last_largest = np.arange(len(out)), 255 - out[:, ::-1].argmax(axis=1)
    out[row, last_largest] = np.maximum(1, out[row, last_largest] + TOTAL - out.sum(axis=1))
    left = TOTAL - out.sum(axis=1)
    for k in np.flatnonzero(left):  # the largest could not take it all
        freq, short = out[k], int(left[k])
        for i in np.argsort(-freq, kind="stable"):
            take = max(1 - int(freq[i]), short) if freq[i] else 0
            freq[i] += take
            short -= take
            if not short:
                break
    return out


def encode_many(streams: list[bytes], tables: list[np.ndarray]) -> list[bytes]:
    """Each stream by its own table of 256 frequencies. An empty stream gives no bytes."""
    lanes = sorted((i for i, s in enumerate(streams) if s), key=lambda i: -len(streams[i]))
    out: list[bytes] = [b""] * len(streams)
    if not lanes:
        return out
    sizes = np.array([len(streams[i]) for i in lanes])
    freq = np.stack([tables[i] for i in lanes]).astype(np.int64)
    if (freq.sum(axis=1) != TOTAL).any():
        raise ValueError("frequencies must sum to 4096")
    if sizes[0] <= jvm.MOST and (coded := jvm.rans_encode([streams[i] for i in lanes], list(freq))) is not None:
        if not all(coded):
            raise ValueError("a symbol without frequency")
        for i, c in zip(lanes, coded, strict=True):
            out[i] = c
        return out
    start = np.cumsum(freq, axis=1) - freq
    symbols = np.zeros((len(lanes), sizes[0]), np.uint8)
    for k, i in enumerate(lanes):
        symbols[k, : sizes[k]] = np.frombuffer(streams[i], np.uint8)
    state = np.full(len(lanes), LOW, np.int64)
    room = np.zeros((len(lanes), 2 * int(sizes[0]) + 8), np.uint8)
    used = np.zeros(len(lanes), np.int64)
    for t in range(int(sizes[0]) - 1, -1, -1):
        n = int(np.searchsorted(-sizes, -t, side="left"))  # lanes longer than t
        row = np.arange(n)
        s = symbols[:n, t]
        f, c, x = freq[row, s], start[row, s], state[:n]
        if not f.all():
            raise ValueError("a symbol without frequency")
        while (full := np.flatnonzero(x >= f << 20)).size:
            room[full, used[full]] = x[full] & 255
            used[full] += 1
            x[full] >>= 8
        state[:n] = (x // f << SCALE_BITS) + c + x % f
    for k, i in enumerate(lanes):
        out[i] = room[k, : used[k]].tobytes() + int(state[k]).to_bytes(8, "big")
    return out


def decode_many(coded: list[bytes], tables: list[np.ndarray], sizes: list[int]) -> list[bytes]:
    lanes = sorted((i for i, n in enumerate(sizes) if n), key=lambda i: -sizes[i])
    out: list[bytes] = [b""] * len(coded)
    if not lanes:
        return out
    size = np.array([sizes[i] for i in lanes])
    freq = np.stack([tables[i] for i in lanes]).astype(np.int64)
    if (freq.sum(axis=1) != TOTAL).any():
        raise ValueError("frequencies must sum to 4096")
    if any(len(coded[i]) < 8 for i in lanes):
        raise ValueError("a stream ends early")
    if max(int(size[0]), *(len(coded[i]) for i in lanes)) <= jvm.MOST and (found := jvm.rans_decode([coded[i] for i in lanes], list(freq), size.tolist())) is not None:
        for i, symbols in zip(lanes, found, strict=True):
            out[i] = symbols
        return out
    start = np.cumsum(freq, axis=1) - freq
    slots = np.stack([np.repeat(np.arange(256), f) for f in freq])
    data = np.zeros((len(lanes), max(len(coded[i]) for i in lanes)), np.uint8)
    left = np.zeros(len(lanes), np.int64)
    state = np.zeros(len(lanes), np.int64)
    for k, i in enumerate(lanes):
        left[k] = len(coded[i]) - 8
        data[k, : len(coded[i])] = np.frombuffer(coded[i], np.uint8)
        state[k] = int.from_bytes(coded[i][-8:], "big")
    symbols = np.zeros((len(lanes), int(size[0])), np.uint8)
    for t in range(int(size[0])):
        n = int(np.searchsorted(-size, -t, side="left"))
        row = np.arange(n)
        x = state[:n]
        slot = x & TOTAL - 1
        s = slots[row, slot]
        symbols[:n, t] = s
        x[:] = freq[row, s] * (x >> SCALE_BITS) + slot - start[row, s]
        while (low := np.flatnonzero((x < LOW) & (left[:n] > 0))).size:
            left[low] -= 1
            x[low] = x[low] << 8 | data[low, left[low]]
    for k, i in enumerate(lanes):
        out[i] = symbols[k, : size[k]].tobytes()
    return out
