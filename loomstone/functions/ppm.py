"""Order-4 prediction by partial matching, a guess from neighbouring bytes, and a mixer of the two."""

from __future__ import annotations

import numpy as np

from loomstone.functions import rans

ORDER = 4


class Model:
    """Counts of bytes after contexts of up to 4 bytes; starts anew beyond ``nodes`` contexts."""

    def __init__(self, nodes: int = 1 << 16) -> None:
        self.nodes = nodes
        self.reset()

    def reset(self) -> None:
        self.counts: dict[bytes, dict[int, int]] = {}
        self.history = b""

    def contexts(self) -> list[bytes]:
        """Longest first."""
        return [self.history[len(self.history) - k :] for k in range(len(self.history), -1, -1)]

    def update(self, byte: int) -> None:
        if len(self.counts) >= self.nodes:
            self.reset()
        for c in self.contexts():
            seen = self.counts.setdefault(c, {})
            seen[byte] = seen.get(byte, 0) + 1
        self.history = (self.history + bytes([byte]))[-ORDER:]

    def table(self, context: bytes, shut: set[int]) -> tuple[list[tuple[int, int]], int] | None:
        """[(symbol, frequency)] and the escape's frequency: the escape counts as often as there are
        symbols, all scaled to 4096. None for an unknown context."""
        seen = [(s, n) for s, n in sorted(self.counts.get(context, {}).items()) if s not in shut]
        if not seen:
            return None
        total = sum(n for _, n in seen) + len(seen)
        room = rans.TOTAL - 1 - len(seen)
        scaled = [(s, 1 + n * room // total) for s, n in seen]
        return scaled, rans.TOTAL - sum(f for _, f in scaled)

    def events(self, byte: int) -> list[tuple[str, int, int]]:
        """("symbol" or "escape", frequency, start) until the byte is coded."""
        out, shut = [], set()
        for c in self.contexts():
            found = self.table(c, shut)
            if found is None:
                continue
            scaled, escape = found
            start = 0
            for s, f in scaled:
                if s == byte:
                    return [*out, ("symbol", f, start)]
                start += f
            out.append(("escape", escape, start))
            shut |= {s for s, _ in scaled}
        return [*out, ("symbol", 16, 16 * byte)]  # all 256 alike

    def predict(self) -> np.ndarray:
        """Probabilities of the 256 bytes."""
        p, mass, shut = np.zeros(256), 1.0, set()
        for c in self.contexts():
            found = self.table(c, shut)
            if found is None:
                continue
            for s, f in found[0]:
                p[s] += mass * f / rans.TOTAL
            mass *= found[1] / rans.TOTAL
            shut |= {s for s, _ in found[0]}
        p += mass / 256
        return p / p.sum()


def encode(data: bytes, nodes: int = 1 << 16) -> bytes:
    model, events = Model(nodes), []
    for byte in data:
        events += model.events(byte)
        model.update(byte)
    state, out = rans.LOW, bytearray()
    for _, f, c in reversed(events):
        while state >= f << 20:
            out.append(state & 255)
            state >>= 8
        state = (state // f << rans.SCALE_BITS) + c + state % f
    return bytes(out) + state.to_bytes(8, "big")


def decode(coded: bytes, n: int, nodes: int = 1 << 16) -> bytes:
    model, out, left = Model(nodes), bytearray(), len(coded) - 8
    state = int.from_bytes(coded[-8:], "big")

    def take(f: int, c: int) -> None:
        nonlocal state, left
        state = f * (state >> rans.SCALE_BITS) + (state & rans.TOTAL - 1) - c
        while state < rans.LOW and left:
            left -= 1
            state = state << 8 | coded[left]

    while len(out) < n:
        shut: set[int] = set()
        byte = None
        for c in model.contexts():
            found = model.table(c, shut)
            if found is None:
                continue
            slot, start = state & rans.TOTAL - 1, 0
            for s, f in found[0]:
                if slot < start + f:
                    byte = s
                    take(f, start)
                    break
                start += f
            if byte is not None:
                break
            take(found[1], start)
            shut |= {s for s, _ in found[0]}
        if byte is None:
            byte = (state & rans.TOTAL - 1) // 16
            take(16, 16 * byte)
        out.append(byte)
        model.update(byte)
    return bytes(out)


class Neighbours:
    """A guess at a byte from two earlier ones: the byte one record before, and the byte beside it.

    For each plane it learns how often a byte equals the one, the other or neither; old observations fade."""

    FADE = 0.995

    def __init__(self, planes: int) -> None:
        self.shares = np.tile(np.array([1.0, 1.0, 2.0]), (planes, 1))

    def predict(self, plane: int, before: int, beside: int) -> np.ndarray:
        """Probabilities of the 256 bytes."""
        share = self.shares[plane] / self.shares[plane].sum()
        p = np.full(256, share[2] / 256)
        p[before] += share[0]
        p[beside] += share[1]
        return p

    def observe(self, plane: int, value: int, before: int, beside: int) -> None:
        hits = np.array([value == before, value == beside, value not in (before, beside)], float)
        self.shares[plane] = np.maximum(self.shares[plane] * self.FADE, 0.01) + hits / max(hits.sum(), 1)


class LogMixer:
    """Distributions mixed in the logarithmic domain: p is proportional to the product of p_i ** w_i.

    Weights follow the gradient of the log probability of what came, so a model that is right gains."""

    def __init__(self, weights: tuple[float, ...] = (0.8, 0.2), rate: float = 0.02) -> None:
        self.weights, self.rate = np.array(weights), rate

    def mix(self, *models: np.ndarray) -> np.ndarray:
        self.logs = np.log(np.maximum(np.stack(models), 1e-9))
        z = self.weights @ self.logs
        p = np.exp(z - z.max())
        self.mixed = p / p.sum()
        return self.mixed

    def learn(self, symbol: int) -> None:
        """After mix()."""
        gain = self.logs[:, symbol] - self.logs @ self.mixed
        self.weights = np.clip(self.weights + self.rate * np.clip(gain, -4, 4), 0.0, 4.0)
