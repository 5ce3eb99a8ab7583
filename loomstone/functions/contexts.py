"""Context-mapped literals: statistics by the previous byte, table clustering, coding and decoding."""

from __future__ import annotations

import numpy as np

from loomstone.functions import rans

#: Context of a literal from the byte before it, and how many contexts there are.
MODES = {"full": (lambda p: p, 256), "msb6": (lambda p: p >> 2, 64), "lsb6": (lambda p: p & 63, 64)}
MAX_TABLES, FEWEST_LITERALS = 16, 64


def context_histograms(literals: bytes, previous: bytes, mode: str) -> np.ndarray:
    of, n = MODES[mode]
    ctx = of(np.frombuffer(previous, np.uint8).astype(np.int64))
    return np.bincount(ctx * 256 + np.frombuffer(literals, np.uint8), minlength=n * 256).reshape(n, 256)


def cost_bits(hist: np.ndarray) -> np.ndarray:
    """Sum of c log2(N / c) in bits, over the last axis."""
    c = hist.astype(np.float64)
    n = c.sum(axis=-1)
    log = lambda x: np.where(x > 0, x * np.log2(np.maximum(x, 1)), 0.0)
    return log(n) - log(c).sum(axis=-1)


def merges(hists: np.ndarray, fewest: int, most: int) -> dict[int, list[int]]:
    """Table of each context for every number of tables from fewest to most: merge the two clusters with
    the least loss, of equal ones those with the lowest first contexts."""
    n = len(hists)
    hist = hists.astype(np.float64)
    own = cost_bits(hist)
    loss = np.full((n, n), np.inf)
    for i in range(n - 1):
        loss[i, i + 1 :] = cost_bits(hist[i + 1 :] + hist[i]) - own[i + 1 :] - own[i]
    loss = np.round(loss, 6)  # so that equal losses tie
    leader, alive, out = np.arange(n), np.ones(n, bool), {}
    for left in range(n, max(1, fewest) - 1, -1):
        if left <= most:
            out[left] = np.unique(leader, return_inverse=True)[1].tolist()
        if left <= max(1, fewest):
            break
        i, j = divmod(int(loss.argmin()), n)  # row-major: the lowest first contexts come first
        leader[leader == j] = i
        alive[j] = False
        hist[i] += hist[j]
        own[i] = cost_bits(hist[i])
        loss[j, :] = loss[:, j] = np.inf
        other = np.flatnonzero(alive)
        other = other[other != i]
        new = np.round(cost_bits(hist[other] + hist[i]) - own[other] - own[i], 6)
        loss[np.minimum(i, other), np.maximum(i, other)] = new
    return out


def cluster(hists: np.ndarray, tables: int) -> list[int]:
    """Table of each context, for up to ``tables`` tables."""
    n = len(hists)
    return list(range(n)) if tables >= n else merges(hists, tables, tables)[max(1, tables)]


def clustered_cost(hists: np.ndarray, table_of: list[int], tables: int) -> float:
    merged = np.zeros((tables, 256))
    np.add.at(merged, np.array(table_of), hists)
    return float(cost_bits(merged).sum())


def average_cost(hists: np.ndarray, table_of: list[int], tables: int) -> float:
    n = hists.sum()
    return clustered_cost(hists, table_of, tables) / float(n) if n else 0.0


def decide(literals: bytes, previous: bytes, single_cost: float | None = None) -> tuple[str, int, list[int]] | None:
    """(mode, tables, table of each context) if it costs fewer bits than one table, with overheads in
    the same unit: 2 bytes, the map, and 512 bytes for each further table."""
    if len(literals) < FEWEST_LITERALS:
        return None
    if single_cost is None:
        single_cost = float(cost_bits(np.bincount(np.frombuffer(literals, np.uint8), minlength=256)))
    best = None
    for mode, (_, n) in MODES.items():
        hists = context_histograms(literals, previous, mode)
        for tables, table_of in sorted(merges(hists, 2, 8).items()):
            total = clustered_cost(hists, table_of, tables) + 8 * (2 + n + (tables - 1) * 512)
            if best is None or total < best[0]:
                best = (total, mode, tables, table_of)
    return best[1:] if best[0] < single_cost else None


def encode(literals: bytes, previous: bytes, mode: str, tables: int, table_of: list[int]) -> tuple[bytes, list[np.ndarray]]:
    """One rANS stream in which each literal is coded by the table of its context."""
    of = MODES[mode][0]
    which = np.array(table_of)[of(np.frombuffer(previous, np.uint8).astype(np.int64))]
    lit = np.frombuffer(literals, np.uint8)
    freqs = [rans.normalise(np.bincount(lit[which == t], minlength=256)) for t in range(tables)]
    starts = [np.cumsum(f) - f for f in freqs]
    state, out = rans.LOW, bytearray()
    for s, t in zip(lit[::-1].tolist(), which[::-1].tolist(), strict=True):
        f, c = int(freqs[t][s]), int(starts[t][s])
        while state >= f << 20:
            out.append(state & 255)
            state >>= 8
        state = (state // f << rans.SCALE_BITS) + c + state % f
    return bytes(out) + state.to_bytes(8, "big"), freqs


class Decoder:
    """Gives literals one by one, as the byte before each becomes known."""

    def __init__(self, coded: bytes, mode: str, table_of: list[int], freqs: list[np.ndarray]) -> None:
        self.of, self.table_of = MODES[mode][0], table_of
        self.freqs = [f.tolist() for f in freqs]
        self.starts = [(np.cumsum(f) - f).tolist() for f in freqs]
        self.slots = [np.repeat(np.arange(256), f).tolist() for f in freqs]
        self.data, self.left = coded, len(coded) - 8
        self.state = int.from_bytes(coded[-8:], "big")

    def next(self, previous: int) -> int:
        t = self.table_of[self.of(previous)]
        slot = self.state & rans.TOTAL - 1
        s = self.slots[t][slot]
        self.state = self.freqs[t][s] * (self.state >> rans.SCALE_BITS) + slot - self.starts[t][s]
        while self.state < rans.LOW and self.left:
            self.left -= 1
            self.state = self.state << 8 | self.data[self.left]
        return s


def decode_chain(coded: bytes, n: int, mode: str, table_of: list[int], freqs: list[np.ndarray], first: int = 0) -> bytes:
    """n literals, each the next one's previous byte."""
    decoder, out, prev = Decoder(coded, mode, table_of, freqs), bytearray(), first
    for _ in range(n):
        prev = decoder.next(prev)
        out.append(prev)
    return bytes(out)
