"""Byte statistics as numpy kernels."""

from __future__ import annotations

import math

import numpy as np

#: Thresholds on the autocorrelation of a stride: for a chunk, and for a file or a stream.
CHUNK_THRESHOLD, STREAM_THRESHOLD = 0.50, 0.75
STRIDES = range(2, 17)


def histogram(data: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(data, np.uint8), minlength=256)


def entropy_of_counts(counts: np.ndarray) -> float:
    """Bits for each symbol; 0 without any."""
    c = counts[counts > 0].astype(np.float64)
    n = c.sum()
    return float(np.log2(n) - (c * np.log2(c)).sum() / n) if n else 0.0


def entropy(data: bytes) -> float:
    return entropy_of_counts(histogram(data))


def order1_entropy(data: bytes) -> float:
    """Conditional entropy of a byte given the one before it; 0 for fewer than two bytes."""
    x = np.frombuffer(data, np.uint8).astype(np.int64)
    if len(x) < 2:
        return 0.0
    pairs = np.bincount(x[:-1] * 256 + x[1:], minlength=65536)
    return max(0.0, entropy_of_counts(pairs) - entropy_of_counts(np.bincount(x[:-1], minlength=256)))


#: round(256 * log2(1 + i / 256))
LOG2_FRACTION = np.round(256 * np.log2(1 + np.arange(256) / 256)).astype(np.int64)


def log2_fixed8(n: int) -> int:
    """log2 in 24.8 fixed point: the eight bits after the leading one give the fraction; 0 for 0."""
    if n <= 0:
        return 0
    top = n.bit_length() - 1
    after = (n << 8 >> top) & 255
    return (top << 8) + int(LOG2_FRACTION[after])


def log2_fixed16(n: int) -> int:
    """log2 in 16.16 fixed point, rounded down; 0 for 0."""
    if n <= 0:
        return 0
    top = n.bit_length() - 1
    value, out = (n << 62 - top) if top <= 62 else n >> top - 62, top
    for _ in range(16):  # one bit by each squaring
        value = value * value >> 62
        bit = value >> 63
        out = out << 1 | bit
        value >>= bit
    return out


def integer_entropy(data: bytes) -> int:
    """Bits for each byte in 24.8 fixed point, in integers throughout."""
    if not data:
        return 0
    counts = [c for c in histogram(data).tolist() if c]
    return max(0, log2_fixed8(len(data)) - sum(c * log2_fixed8(c) for c in counts) // len(data))


def correlations(data: bytes, strides: range | list[int]) -> list[float | None]:
    """Pearson's r of x[i] and x[i + stride] for each stride; None for up to 2 strides of data, and without variance. Sums are
    exact integers."""
    x = np.frombuffer(data, np.uint8).astype(np.float64)
    size, out = len(x), []
    total = np.concatenate([[0.0], np.cumsum(x)])
    squares = np.concatenate([[0.0], np.cumsum(x * x)])
    for s in strides:
        if s <= 0 or size <= 2 * s:
            out.append(None)
            continue
        n = size - s
        sa, sb = int(total[n]), int(total[size] - total[s])
        va = n * int(squares[n]) - sa * sa
        vb = n * int(squares[size] - squares[s]) - sb * sb
        out.append((n * int(x[:n] @ x[s:]) - sa * sb) / math.sqrt(va) / math.sqrt(vb) if va and vb else None)
    return out


def autocorrelations(data: bytes, strides: range | list[int]) -> list[float]:
    """Pearson's r of x[i] and x[i + stride] as float32 for each stride; 0 for up to 2 strides of data.

    Without variance: 1 if all values are equal, else 0. Negative values count as 0."""
    equal = 1.0 if data and data.count(data[:1]) == len(data) else 0.0
    rs = zip(correlations(data, strides), strides, strict=True)
    return [(equal if 0 < 2 * s < len(data) else 0.0) if r is None else float(np.float32(max(0.0, r))) for r, s in rs]


def autocorrelation(data: bytes, stride: int) -> float:
    return autocorrelations(data, [stride])[0]


def best_stride(data: bytes, least: float, at_least: int) -> tuple[int | None, float]:
    """(stride, r): the stride of 2 to 16 with the largest r, of equal ones the smallest, if r >= least."""
    if len(data) < at_least:
        return None, 0.0
    r, negative = max(zip(autocorrelations(data, STRIDES), (-s for s in STRIDES), strict=True))
    return (-negative, r) if r >= least else (None, r)


def file_stride(data: bytes) -> int | None:
    return best_stride(data, STREAM_THRESHOLD, 32)[0]


def chunk_stride(data: bytes) -> int | None:
    return best_stride(data[:4096], CHUNK_THRESHOLD, 64)[0]


def cheapest_stride(data: bytes, sample: int = 1 << 16, gain: float = 0.95) -> int | None:
    """The stride of 2 to 16 whose planes of deltas have the least entropy in a sample from the middle, if that
    is below ``gain`` times the entropy of the bytes; of equal ones the smallest. For records whose bytes do not correlate
    as a whole, such as doubles of which a few bytes are noise."""
    begin = max(0, (len(data) - sample) // 2)
    x = np.frombuffer(data[begin : begin + sample], np.uint8)
    if len(x) < 256:
        return None
    best, found = gain * entropy_of_counts(np.bincount(x, minlength=256)), None
    for s in STRIDES:
        d = x[s:] - x[:-s]
        planes = [d[p::s] for p in range(s)]
        # a small sample understates entropy: by about (symbols - 1) / 2 nats for each plane
        bits = sum(entropy_of_counts(c) * len(p) + (np.count_nonzero(c) - 1) / 1.386 for p, c in ((p, np.bincount(p, minlength=256)) for p in planes)) / len(d)
        if bits < best:
            best, found = bits, s
    return found


def dominant_byte(data: bytes, share: float = 0.40) -> int | None:
    """The most frequent byte (the lowest of equal ones) if it is over floor(share * n)."""
    if not data:
        return None
    h = histogram(data)
    top = int(h.argmax())
    return top if h[top] > math.floor(share * len(data)) else None


def bcj_helps(data: bytes) -> bool:
    """Whether the x86 filter lowers the integer entropy of the first 64 KiB by 0.3 % or more."""
    from loomstone.functions.transforms import bcj_x86

    sample = data[:65536]
    if len(sample) < 64:
        return False
    before = integer_entropy(sample)
    return before > 0 and integer_entropy(bcj_x86(sample)) * 1000 <= before * 997
