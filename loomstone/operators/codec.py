"""Encode and decode chunks: choose a transform by measured size, tokenise, separate, entropy-code.

A payload: number of tokens, sizes of the five symbol streams, coded sizes of their segments, the streams' frequency
tables (only symbols that occur), the coded segments, and the extra bits of distances. Segments of all rows of a batch are
coded in lockstep.
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.functions import numeric as N
from loomstone.functions import rans
from loomstone.functions import tokens as K
from loomstone.functions import transforms as X
from loomstone.functions.arrow import add_columns, as_binary, spread

#: Symbols of a stream that share a state of the entropy coder.
SEGMENT = 8192
FIELDS = f"codec string, raw_size long, transform {X.Stack.STRUCT}, payload binary"


def _tables_bytes(tables: np.ndarray) -> list[bytes]:
    """Of each table the number of symbols that occur, those symbols, and their frequencies less one."""
    row, seen = np.nonzero(tables)
    counts = np.bincount(row, minlength=len(tables))
    symbols, freq = seen.astype(np.uint8).tobytes(), (tables[row, seen] - 1).astype("<u2").tobytes()
    ends = np.cumsum(counts).tolist()
    return [struct.pack("<H", b - a) + symbols[a:b] + freq[2 * a : 2 * b] for a, b in zip([0, *ends], ends, strict=False)]


def _read_table(data: bytes, at: int) -> tuple[np.ndarray, int]:
    (n,) = struct.unpack_from("<H", data, at)
    at += 2
    symbols = np.frombuffer(data, np.uint8, n, at)
    counts = np.frombuffer(data, "<u2", n, at + n)
    freq = np.zeros(256, np.int64)
    freq[symbols] = counts.astype(np.int64) + 1
    if freq.sum() != rans.TOTAL:
        raise ValueError("frequencies must sum to 4096")
    return freq, at + 3 * n


def _segments(size: int) -> list[slice]:
    """A stream is coded in segments with states of their own, so that long streams go in lockstep too."""
    return [slice(i, min(size, i + SEGMENT)) for i in range(0, size, SEGMENT)]


def code_tokens(parsed: list[K.Tokens], leasts: list[np.ndarray | None]) -> list[bytes]:
    """The payload of each list of tokens."""
    parts = K.separate_many(parsed, leasts)
    streams = [s[k] for s, _ in parts for k in K.STREAMS]
    tables = rans.normalise_many(np.array([N.histogram(s) for s in streams], np.int64).reshape(-1, 256))
    pieces = [(s[part], t) for s, t in zip(streams, tables, strict=True) for part in _segments(len(s))]
    coded = iter(rans.encode_many([p[0] for p in pieces], [p[1] for p in pieces]))
    out, table_bytes = [], _tables_bytes(tables)
    for i, (tokens, (_, extra)) in enumerate(zip(parsed, parts, strict=True)):
        mine = range(5 * i, 5 * i + 5)
        done = [next(coded) for j in mine for _ in _segments(len(streams[j]))]
        head = struct.pack(f"<{6 + len(done)}I", len(tokens), *(len(streams[j]) for j in mine), *map(len, done))
        out.append(head + b"".join(table_bytes[j] for j in mine if streams[j]) + b"".join(done) + extra)
    return out


def decode_tokens(payloads: list[bytes], leasts: list[np.ndarray | None]) -> list[K.Tokens]:
    coded, tables, sizes, rest = [], [], [], []
    for p in payloads:
        n_tokens, *raw = struct.unpack_from("<6I", p, 0)
        parts = [[x.stop - x.start for x in _segments(n)] for n in raw]
        count = sum(map(len, parts))
        lengths = struct.unpack_from(f"<{count}I", p, 24)
        at = 24 + 4 * count
        for mine in parts:
            if mine:
                table, at = _read_table(p, at)
                tables += [table] * len(mine)
                sizes += mine
        for n in lengths:
            coded.append(p[at : at + n])
            at += n
        rest.append((n_tokens, [len(mine) for mine in parts], p[at:]))
    pieces = iter(rans.decode_many(coded, tables, sizes))
    named = [{k: b"".join(next(pieces) for _ in range(n)) for k, n in zip(K.STREAMS, counts, strict=True)} for _, counts, _ in rest]
    return [K.rejoin(s, extra, n, m) for s, (n, _, extra), m in zip(named, rest, leasts, strict=True)]


def _candidates(data: bytes, kind: str, level: str) -> list[X.Stack]:
    """Stacks to try; the first is the baseline and stays on ties."""
    plain = X.Stack()
    if K.LEVELS[level].optimal and kind == "text":
        return [plain, X.Stack(bwt=True)]

    def records(k: int) -> list[X.Stack]:
        words = [X.Stack(filter="word_delta", channels=8 * k // bits, bit_depth=bits) for bits in (16, 32, 64) if 8 * k % bits == 0]
        return [X.Stack(stride=k), *([X.Stack(filter="float_channel_split", channels=k // 4)] if k % 4 == 0 else []), *words]

    if kind == "multimedia" and (stride := N.chunk_stride(data)):
        return records(stride)
    if kind in ("executable", "binary") and N.bcj_helps(data) and (kind == "executable" or data[:2] == b"MZ" or data[:4] == b"\x7fELF"):
        return [X.Stack(filter="bcj_x86")]
    if kind in ("multimedia", "binary") and (stride := N.cheapest_stride(data)):
        return [plain, *records(stride)]
    return [plain]


def encode_batch(chunks: list[bytes], kinds: list[str], level: str, transpose: bool = True) -> list[tuple[str, int, X.Stack, bytes]]:
    """(codec, raw size, stack, payload) of each chunk. Raw blocks, entropies over 7.95 and empty chunks are stored."""
    settings = K.LEVELS[level]
    out: list[tuple[str, int, X.Stack, bytes]] = [("raw", len(c), X.Stack(), c) for c in chunks]
    tried: list[tuple[int, X.Stack, bytes, np.ndarray | None]] = []
    for i, (data, kind) in enumerate(zip(chunks, kinds, strict=True)):
        if not data or kind == "raw" or N.entropy(data) > 7.95:
            continue
        for stack in _candidates(data, kind, level) if transpose else [X.Stack()]:
            changed, done = X.apply_stack(data, stack)
            tried.append((i, done, changed, K.min_match_map(len(changed), done.masks)))
    leasts = [t[3] for t in tried]
    if settings.optimal:
        parsed = K.parse_optimal_many([t[2] for t in tried], settings, leasts)
    else:
        parsed = K.parse_many([t[2] for t in tried], settings, leasts)
    best: dict[int, int] = {}
    for (i, stack, _, _), payload in zip(tried, code_tokens(parsed, leasts), strict=True):
        if i not in best or len(payload) < best[i]:
            best[i] = len(payload)
            out[i] = ("lz77", len(chunks[i]), stack, payload)
    return out


def decode_batch(codecs: list[str], raw_sizes: list[int], stacks: list[X.Stack], payloads: list[bytes]) -> list[bytes]:
    out = list(payloads)
    at = [i for i, c in enumerate(codecs) if c == "lz77"]
    if unknown := set(codecs) - {"raw", "lz77"}:
        raise ValueError(f"unknown codecs: {sorted(unknown)}")
    leasts = [K.min_match_map(raw_sizes[i], stacks[i].masks) for i in at]
    for i, data in zip(at, K.expand_many(decode_tokens([payloads[i] for i in at], leasts)), strict=True):
        out[i] = X.undo_stack(data, stacks[i])
    if wrong := [i for i, (d, n) in enumerate(zip(out, raw_sizes, strict=True)) if len(d) != n]:
        raise ValueError(f"{len(wrong)} chunks decode to another size")
    return out


def encode(df: DataFrame, value_col: str, level: str = "balanced", kind_col: str | None = None, transpose: bool = True) -> DataFrame:
    """df with codec, raw_size, transform and payload instead of the value; a null value has a null codec.

    kind_col: "text", "multimedia", "executable", "binary" or "raw"; without it every value counts as binary.
    transpose=False: no transform is tried."""
    if level not in K.LEVELS:
        raise ValueError(f"level: {level}")
    df = as_binary(spread(df), value_col)

    def f(cols: dict[str, list]) -> dict[str, list]:
        values = cols[value_col]
        kinds = cols[kind_col] if kind_col else ["binary"] * len(values)
        at = [i for i, v in enumerate(values) if v is not None]
        rows: list = [(None, None, None, None)] * len(values)
        for i, (codec, n, stack, payload) in zip(at, encode_batch([values[i] for i in at], [kinds[i] or "binary" for i in at], level, transpose), strict=True):
            rows[i] = (codec, n, stack.as_row(), payload)
        return {n: [r[k] for r in rows] for k, n in enumerate(("codec", "raw_size", "transform", "payload"))}

    return add_columns(df, FIELDS, f, [value_col, *([kind_col] if kind_col else [])], drop=(value_col,))


def decode(df: DataFrame, out_col: str = "value") -> DataFrame:
    """df with the value instead of codec, raw_size, transform and payload."""

    def f(cols: dict[str, list]) -> dict[str, list]:
        at = [i for i, c in enumerate(cols["codec"]) if c is not None]
        out: list = [None] * len(cols["codec"])
        stacks = [X.Stack.of_row(cols["transform"][i]) for i in at]
        codecs, sizes, payloads = ([cols[n][i] for i in at] for n in ("codec", "raw_size", "payload"))
        got = decode_batch(codecs, sizes, stacks, payloads)
        for i, v in zip(at, got, strict=True):
            out[i] = v
        return {out_col: out}

    using = ["codec", "raw_size", "transform", "payload"]
    return add_columns(df, f"{out_col} binary", f, using, drop=tuple(using))


def apply_transform(df: DataFrame, value_col: str, stack: X.Stack, out: str = "coded") -> DataFrame:
    """df with the transformed bytes and the stack that undoes them instead of the value."""

    def f(cols: dict[str, list]) -> dict[str, list]:
        pairs = [(None, None) if v is None else X.apply_stack(v, stack) for v in cols[value_col]]
        return {out: [p[0] for p in pairs], "transform": [p[1] and p[1].as_row() for p in pairs]}

    return add_columns(as_binary(spread(df), value_col), f"{out} binary, transform {X.Stack.STRUCT}", f, [value_col], drop=(value_col,))


def undo_transform(df: DataFrame, coded: str = "coded", out: str = "value") -> DataFrame:
    def f(cols: dict[str, list]) -> dict[str, list]:
        return {out: [None if v is None else X.undo_stack(v, X.Stack.of_row(t)) for v, t in zip(cols[coded], cols["transform"], strict=True)]}

    return add_columns(df, f"{out} binary", f, [coded, "transform"], drop=(coded, "transform"))


def token_summary(df: DataFrame, value_col: str, level: str = "balanced") -> DataFrame:
    """df with n_literals, n_matches, n_reps, covered (bytes in matches), flag_price and raw_size instead of the value."""

    def f(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in ("n_literals", "n_matches", "n_reps", "covered", "literal_price")}
        values = [v or b"" for v in cols[value_col]]
        for t in K.parse_many(values, K.LEVELS[level], [None] * len(values)):
            for k, n in enumerate(("n_literals", "n_matches", "n_reps")):
                out[n].append(int((t.kind == k).sum()))
            out["covered"].append(int(t.length[t.kind > 0].sum()))
            out["literal_price"].append(K.price_model(t).flags[0])
        return out

    kind = "n_literals long, n_matches long, n_reps long, covered long, literal_price long"
    return add_columns(as_binary(spread(df), value_col), kind, f, [value_col], drop=(value_col,))


def stream_diagnostics(df: DataFrame, value_col: str, level: str = "balanced") -> DataFrame:
    """stream, raw_bytes, coded_bytes, mean_h0 and mean_h1 (bits for a symbol, of order 0 and 1), efficiency (the bits of
    order 0 by those of the coded bytes) and savings (what coding the stream saves, of its raw bytes), over all values: how
    the separate streams code. Without symbols efficiency and savings are 0."""

    def f(cols: dict[str, list]) -> dict[str, list]:
        values = [v or b"" for v in cols[value_col]]
        parts = [K.separate(t)[0] for t in K.parse_many(values, K.LEVELS[level], [None] * len(values))]
        streams = [p[k] for p in parts for k in K.STREAMS]
        coded = rans.encode_many(streams, [rans.normalise(N.histogram(s)) for s in streams])
        rows = [
            {"stream": K.STREAMS[i % 5], "raw": len(s), "coded": len(c), "bits": N.entropy(s) * len(s), "bits1": N.order1_entropy(s) * len(s)}
            for i, (s, c) in enumerate(zip(streams, coded, strict=True))
        ]
        return {"_s": [rows[5 * i : 5 * i + 5] for i in range(len(parts))]}

    kind = "_s array<struct<stream:string,raw:long,coded:long,bits:double,bits1:double>>"
    each = add_columns(as_binary(spread(df.select(value_col)), value_col), kind, f, [value_col], drop=(value_col,))
    raw, coded = F.sum("raw"), F.sum("coded")
    share = lambda x, of: F.round(F.coalesce(x / F.nullif(of, F.lit(0)), F.lit(0.0)), 6)
    return each.select(F.inline("_s")).groupBy("stream").agg(
        raw.alias("raw_bytes"), coded.alias("coded_bytes"), share(F.sum("bits"), raw).alias("mean_h0"), share(F.sum("bits1"), raw).alias("mean_h1"),
        share(F.sum("bits") / 8, coded).alias("efficiency"), share(raw - coded, raw).alias("savings"),
    )
