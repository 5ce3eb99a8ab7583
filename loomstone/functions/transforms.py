"""Reversible byte transforms: each a pair of functions, encode and decode.

Media filters give back their parameters, which decode needs.
"""

from __future__ import annotations

import struct
import math
from collections.abc import Callable
from dataclasses import asdict, dataclass

import numpy as np

from loomstone.functions import jvm
from loomstone.functions.numeric import entropy_of_counts

BWT_CHUNK = 1 << 20


def _u8(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8)


def delta(data: bytes, stride: int, state: bytes = b"") -> tuple[bytes, bytes]:
    """x[i] - x[i - stride] mod 256, and the state (the last ``stride`` bytes by plane) for a next call."""
    s = max(stride, 1)
    seed = state or bytes(s)
    x = np.concatenate([_u8(seed), _u8(data)])
    return (x[s:] - x[:-s]).tobytes(), x[-s:].tobytes()


def undelta(data: bytes, stride: int, state: bytes = b"") -> tuple[bytes, bytes]:
    s = max(stride, 1)
    seed = state or bytes(s)
    x = np.concatenate([_u8(seed), _u8(data)])
    full = np.zeros(-(-len(x) // s) * s, np.uint8)
    full[: len(x)] = x
    out = np.add.accumulate(full.reshape(-1, s), axis=0, dtype=np.uint8).reshape(-1)[: len(x)]
    return out[s:].tobytes(), out[-s:].tobytes()


def delta_if_lower(data: bytes, stride: int) -> tuple[bytes, bool]:
    """The deltas and True if their entropy is lower, else the data and False."""
    changed = delta(data, stride)[0]
    lower = entropy_of_counts(np.bincount(_u8(changed), minlength=256)) < entropy_of_counts(np.bincount(_u8(data), minlength=256))
    return (changed, True) if lower else (data, False)


def transpose(data: bytes, stride: int) -> bytes:
    """Byte i goes to plane i mod stride; planes follow each other."""
    if stride <= 1 or len(data) <= stride:
        return data
    x = _u8(data)
    return b"".join(x[p::stride].tobytes() for p in range(stride))


def untranspose(data: bytes, stride: int) -> bytes:
    if stride <= 1 or len(data) <= stride:
        return data
    x, out, at = _u8(data), np.empty(len(data), np.uint8), 0
    for p in range(stride):
        n = len(range(p, len(data), stride))
        out[p::stride] = x[at : at + n]
        at += n
    return out.tobytes()


def planes_delta(data: bytes, sizes: list[int]) -> bytes:
    """Delta inside planes that follow each other; each plane keeps its first byte."""
    out = _u8(data).copy()
    at = 0
    for n in sizes:
        out[at + 1 : at + n] -= _u8(data)[at : at + n - 1] if n > 1 else out[:0]
        at += n
    return out.tobytes()


def planes_undelta(data: bytes, sizes: list[int]) -> bytes:
    parts, at = [], 0
    for n in sizes:
        parts.append(np.add.accumulate(_u8(data)[at : at + n], dtype=np.uint8).tobytes())
        at += n
    return b"".join(parts) + data[at:]


def plane_sizes(n: int, stride: int) -> list[int]:
    return [len(range(p, n, stride)) for p in range(stride)]


def _rotations(x: np.ndarray) -> np.ndarray:
    """Order of the cyclic rotations, by prefix doubling."""
    n = len(x)
    rank, k = x.astype(np.int64), 1
    while True:
        key = rank * (int(rank.max()) + 1) + np.roll(rank, -k)
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.r_[0, key[1:] != key[:-1]])
        k *= 2
        if k >= n or new[order[-1]] == n - 1:
            return order
        rank = new


def bwt(data: bytes) -> tuple[bytes, list[int]]:
    """The last column of the sorted cyclic rotations, and the row of the text itself, for each chunk."""
    out, rows = [], []
    for at in range(0, len(data), BWT_CHUNK):
        x = _u8(data[at : at + BWT_CHUNK])
        if found := jvm.bwt(x.tobytes()):
            out.append(found[0])
            rows.append(found[1])
            continue
        order = _rotations(x)
        out.append(x[order - 1].tobytes())
        rows.append(int(np.flatnonzero(order == 0)[0]))
    return b"".join(out), rows


def unbwt(data: bytes, rows: list[int]) -> bytes:
    out = []
    for k, row in enumerate(rows):
        x = _u8(data[k * BWT_CHUNK : (k + 1) * BWT_CHUNK])
        if 0 <= row < len(x) and (found := jvm.unbwt(x.tobytes(), row)) is not None:
            out.append(found)
            continue
        follow = np.argsort(x, kind="stable")  # row of the rotation that begins one byte later
        n = len(x)
        # positions by doubling: jump[i] is i steps ahead
        path = np.empty(n, np.int64)
        path[0] = follow[row]
        done, jump = 1, follow
        while done < n:
            take = min(done, n - done)
            path[done : done + take] = jump[path[:take]]
            done += take
            if done < n:
                jump = jump[jump]
        out.append(x[path].tobytes())
    return b"".join(out)


def audio_delta(data: bytes, channels: int = 2, bit_depth: int = 16) -> bytes:
    """Channel 0: difference to the previous frame; others: to channel 0 of the same frame."""
    return _audio(data, channels, bit_depth, False)


def audio_undelta(data: bytes, channels: int = 2, bit_depth: int = 16) -> bytes:
    return _audio(data, channels, bit_depth, True)


def _audio(data: bytes, channels: int, bit_depth: int, back: bool) -> bytes:
    width = bit_depth // 8
    if width not in (1, 2, 3, 4) or channels < 1:
        raise ValueError(f"no samples of {bit_depth} bits in {channels} channels")
    frame = width * channels
    n = len(data) // frame
    raw = np.zeros((n * channels, 4), np.uint8)
    raw[:, :width] = _u8(data[: n * frame]).reshape(-1, width)
    x = raw.view("<u4").reshape(n, channels).copy()
    if back:
        x[:, 0] = np.add.accumulate(x[:, 0], dtype=np.uint32)
        x[:, 1:] += x[:, :1]
    else:
        x[:, 1:] -= x[:, :1]
        x[1:, 0] -= x[:-1, 0].copy()
    out = np.ascontiguousarray(x.astype("<u4")).view(np.uint8).reshape(-1, 4)[:, :width]
    return out.tobytes() + data[n * frame :]


def float_split(data: bytes) -> bytes:
    """Planes of float32: exponents, high 16 bits of the mantissas, low 7 bits with the sign."""
    n = len(data) // 4
    x = np.frombuffer(data[: n * 4], "<u4")
    exponent = (x >> 23 & 255).astype(np.uint8)
    high = (x >> 7 & 0xFFFF).astype("<u2")
    low = ((x & 127) << 1 | x >> 31).astype(np.uint8)
    return exponent.tobytes() + high.tobytes() + low.tobytes() + data[n * 4 :]


def float_join(data: bytes) -> bytes:
    n = len(data) // 4
    exponent = _u8(data[:n]).astype(np.uint32)
    high = np.frombuffer(data[n : 3 * n], "<u2").astype(np.uint32)
    low = _u8(data[3 * n : 4 * n]).astype(np.uint32)
    x = (low & 1) << 31 | exponent << 23 | high << 7 | low >> 1
    return x.astype("<u4").tobytes() + data[4 * n :]


def float_channel_split(data: bytes, channels: int) -> tuple[bytes, list[int]]:
    """Channel by channel the four byte planes of its float32, most significant first; each plane as its
    deltas if that lowers its entropy. Masks, one for each channel: bit p, plane p holds deltas; bit 4 + p,
    its entropy is below 5."""
    frame = 4 * channels
    n = len(data) // frame
    x = _u8(data[: n * frame]).reshape(n, channels, 4)
    out, masks = [], []
    for c in range(channels):
        mask = 0
        for p in range(4):
            plane = np.ascontiguousarray(x[:, c, 3 - p])
            deltas = plane.copy()
            deltas[1:] -= plane[:-1]
            count = lambda v: entropy_of_counts(np.bincount(v, minlength=256))
            h, hd = count(plane), count(deltas)
            if hd < h:
                plane, h, mask = deltas, hd, mask | 1 << p
            if h < 5.0:
                mask |= 16 << p
            out.append(plane.tobytes())
        masks.append(mask)
    return b"".join(out) + data[n * frame :], masks


def float_channel_join(data: bytes, channels: int, masks: list[int]) -> bytes:
    frame = 4 * channels
    n = len(data) // frame
    x = np.empty((n, channels, 4), np.uint8)
    for c in range(channels):
        for p in range(4):
            plane = _u8(data[(4 * c + p) * n : (4 * c + p + 1) * n])
            x[:, c, 3 - p] = np.add.accumulate(plane, dtype=np.uint8) if masks[c] >> p & 1 else plane
    return x.tobytes() + data[n * frame :]


def _pixels(data: bytes, width: int, back: bool) -> bytes:
    n = len(data) // width
    body, tail = data[: n * width], data[n * width :]
    if back:
        flat = planes_undelta(body, [n] * width)
        return _u8(flat).reshape(width, n).T.tobytes() + tail
    flat = np.ascontiguousarray(_u8(body).reshape(n, width).T).tobytes()
    return planes_delta(flat, [n] * width) + tail


def rgb_split(data: bytes) -> bytes:
    """Three colour planes, each as its deltas."""
    return _pixels(data, 3, False)


def rgb_join(data: bytes) -> bytes:
    return _pixels(data, 3, True)


def rgba_delta(data: bytes) -> bytes:
    return _pixels(data, 4, False)


def rgba_undelta(data: bytes) -> bytes:
    return _pixels(data, 4, True)


def _calls(data: bytes, sign: int) -> bytes:
    """At each E8 or E9 that is not part of an operand: the operand plus or minus the address after it."""
    out = bytearray(data)
    n, i = len(data), 0
    marks = np.flatnonzero((_u8(data) & 0xFE) == 0xE8)
    for at in marks.tolist():
        if at < i or at + 5 > n:
            continue
        (value,) = struct.unpack_from("<I", data, at + 1)
        struct.pack_into("<I", out, at + 1, (value + sign * (at + 5)) & 0xFFFFFFFF)
        i = at + 5
    return bytes(out)


def bcj_x86(data: bytes) -> bytes:
    """Relative call and jump targets become absolute ones."""
    return _calls(data, 1)


def unbcj_x86(data: bytes) -> bytes:
    return _calls(data, -1)


def word_delta(data: bytes, channels: int, bits: int) -> tuple[bytes, int]:
    """Records of little-endian words, ``channels`` each: differences of the words as integers along each channel, of the first to third
    order, whichever are smallest; their signs folded into the lowest bit; then plane by plane of their bytes. For
    smooth series, floats too, as their bits are in the order of their values. Returns the bytes and the order."""
    width = bits // 8
    frame = width * channels
    n = len(data) // frame
    x = np.frombuffer(data[: n * frame], f"<u{width}").reshape(n, channels).copy()
    best, order, chosen = math.inf, 1, x
    for k in range(1, 4):
        x[1:] -= x[:-1].copy()
        signed = x.view(f"<i{width}")
        folded = (x << 1) ^ (signed >> (bits - 1)).view(f"<u{width}")
        size = float(np.log2(folded.astype(np.float64) + 1).sum())
        if size < best:
            best, order, chosen = size, k, folded
    planes = np.ascontiguousarray(chosen).view(np.uint8).reshape(n, channels, width).transpose(1, 2, 0)
    return planes.tobytes() + data[n * frame :], order


def word_undelta(data: bytes, channels: int, bits: int, order: int) -> bytes:
    width = bits // 8
    frame = width * channels
    n = len(data) // frame
    planes = _u8(data[: n * frame]).reshape(channels, width, n).transpose(2, 0, 1)
    folded = np.ascontiguousarray(planes).view(f"<u{width}").reshape(n, channels)
    one = folded.dtype.type(1)
    x = (folded >> one) ^ (~(folded & one) + one)
    for _ in range(order):
        x = np.add.accumulate(x, axis=0, dtype=x.dtype)
    return x.astype(f"<u{width}").tobytes() + data[n * frame :]


@dataclass(frozen=True)
class Stack:
    """What was done to a chunk, in this order: delta, transpose, BWT, media filter."""

    stride: int = 0
    bwt: bool = False
    filter: str = "none"
    channels: int = 0
    bit_depth: int = 0
    rows: tuple[int, ...] = ()
    masks: tuple[int, ...] = ()

    def as_row(self) -> dict:
        return asdict(self) | {"rows": list(self.rows), "masks": list(self.masks)}

    @staticmethod
    def of_row(row: dict) -> Stack:
        return Stack(**{k: tuple(v or ()) if k in ("rows", "masks") else v for k, v in row.items()})

    STRUCT = "struct<stride:int,bwt:boolean,filter:string,channels:int,bit_depth:int,rows:array<int>,masks:array<int>>"


#: Media filters by name: (encode, decode); they take the bytes and the stack.
FILTERS: dict[str, tuple[Callable[[bytes, Stack], tuple[bytes, Stack]], Callable[[bytes, Stack], bytes]]] = {}


def register_filter(name: str, encode: Callable[[bytes, Stack], tuple[bytes, Stack]], decode: Callable[[bytes, Stack], bytes]) -> None:
    """A filter of one's own: encode gives the bytes and the stack with what decode needs."""
    if name in FILTERS:
        raise ValueError(f"filter {name} exists")
    FILTERS[name] = (encode, decode)


def _plain(encode: Callable[[bytes], bytes], decode: Callable[[bytes], bytes]):
    return lambda d, s: (encode(d), s), lambda d, s: decode(d)


def _with_masks(data: bytes, s: Stack) -> tuple[bytes, Stack]:
    out, masks = float_channel_split(data, s.channels)
    return out, Stack(**(s.as_row() | {"rows": s.rows, "masks": tuple(masks)}))


def _with_order(data: bytes, s: Stack) -> tuple[bytes, Stack]:
    out, order = word_delta(data, s.channels, s.bit_depth)
    return out, Stack(**(s.as_row() | {"rows": (order,), "masks": s.masks}))


register_filter("none", *_plain(bytes, bytes))
register_filter("audio_delta", lambda d, s: (audio_delta(d, s.channels, s.bit_depth), s), lambda d, s: audio_undelta(d, s.channels, s.bit_depth))
register_filter("float_split", *_plain(float_split, float_join))
register_filter("float_channel_split", _with_masks, lambda d, s: float_channel_join(d, s.channels, list(s.masks)))
register_filter("rgb_split", *_plain(rgb_split, rgb_join))
register_filter("rgba_delta", *_plain(rgba_delta, rgba_undelta))
register_filter("bcj_x86", *_plain(bcj_x86, unbcj_x86))
register_filter("word_delta", _with_order, lambda d, s: word_undelta(d, s.channels, s.bit_depth, s.rows[0]))


def apply_stack(data: bytes, s: Stack) -> tuple[bytes, Stack]:
    """The bytes after all steps, and the stack that undoes them. Unknown filters raise KeyError."""
    encode = FILTERS[s.filter][0]
    if s.stride > 1:
        data = transpose(delta(data, s.stride)[0], s.stride)
    if s.bwt and data:
        data, rows = bwt(data)
        s = Stack(**(s.as_row() | {"rows": tuple(rows), "masks": s.masks}))
    return encode(data, s)


def undo_stack(data: bytes, s: Stack) -> bytes:
    data = FILTERS[s.filter][1](data, s)
    if s.bwt and data:
        data = unbwt(data, list(s.rows))
    if s.stride > 1:
        data = undelta(untranspose(data, s.stride), s.stride)[0]
    return data
