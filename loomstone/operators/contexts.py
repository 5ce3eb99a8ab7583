"""Context-mapped coding, prediction by partial matching and mixing, one value at a time."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from loomstone.functions import contexts as X
from loomstone.functions import ppm as P
from loomstone.functions.arrow import add_columns, as_binary, spread


def decide(df: DataFrame, value_col: str) -> DataFrame:
    """df with mode, tables, table_of and saves (bits against one table) instead of the value; null mode: one table is best."""

    def f(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"mode": [], "tables": [], "table_of": [], "single_bits": []}
        for v in cols[value_col]:
            got = X.decide(v, b"\0" + v[:-1]) if v else None
            mode, tables, table_of = got or (None, None, None)
            single = float(X.cost_bits(np.bincount(np.frombuffer(v or b"", np.uint8), minlength=256)))
            for n, x in zip(out, (mode, tables, table_of, single), strict=True):
                out[n].append(x)
        return out

    return add_columns(as_binary(spread(df), value_col), "mode string, tables int, table_of array<int>, single_bits double", f, [value_col], drop=(value_col,))


FIELDS = "mode string, table_of array<int>, freqs array<array<int>>, n int, coded binary"


def encode(df: DataFrame, value_col: str, mode: str = "msb6", tables: int = 4) -> DataFrame:
    """df with context-coded bytes and what decoding needs, instead of the value."""

    def f(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in ("mode", "table_of", "freqs", "n", "coded")}
        for v in cols[value_col]:
            v = v or b""
            before = b"\0" + v[:-1] if v else b""
            table_of = X.cluster(X.context_histograms(v, before, mode), tables)
            coded, freqs = X.encode(v, before, mode, tables, table_of)
            for n, x in zip(out, (mode, table_of, [q.tolist() for q in freqs], len(v), coded), strict=True):
                out[n].append(x)
        return out

    return add_columns(as_binary(spread(df), value_col), FIELDS, f, [value_col], drop=(value_col,))


def decode(df: DataFrame, out: str = "value") -> DataFrame:
    def f(cols: dict[str, list]) -> dict[str, list]:
        rows = zip(*(cols[n] for n in ("mode", "table_of", "freqs", "n", "coded")), strict=True)
        return {out: [X.decode_chain(coded, n, mode, table_of, [np.array(q) for q in freqs]) for mode, table_of, freqs, n, coded in rows]}

    using = ["mode", "table_of", "freqs", "n", "coded"]
    return add_columns(df, f"{out} binary", f, using, drop=tuple(using))


def ppm_encode(df: DataFrame, value_col: str, nodes: int = 1 << 16) -> DataFrame:
    """df with n and coded instead of the value, by order-4 prediction."""
    f = lambda c: {"n": [len(v or b"") for v in c[value_col]], "coded": [P.encode(v or b"", nodes) for v in c[value_col]]}
    return add_columns(as_binary(spread(df), value_col), "n int, coded binary", f, [value_col], drop=(value_col,))


def ppm_decode(df: DataFrame, out: str = "value", nodes: int = 1 << 16) -> DataFrame:
    f = lambda c: {out: [P.decode(v, n, nodes) for v, n in zip(c["coded"], c["n"], strict=True)]}
    return add_columns(df, f"{out} binary", f, ["n", "coded"], drop=("n", "coded"))


def mixing_report(df: DataFrame, value_col: str, stride: int = 1) -> DataFrame:
    """df with mixed_bits, ppm_bits and the final weights instead of the value: what mixing PPM with a guess
    from neighbouring bytes does for each value. Null counts as empty."""

    def one(v: bytes) -> tuple[float, float, float, float]:
        model, near, mixer = P.Model(), P.Neighbours(stride), P.LogMixer()
        mixed = alone = 0.0
        for i, byte in enumerate(v):
            before, beside = v[i - stride] if i >= stride else 0, v[i - 1] if i else 0
            p = model.predict()
            alone -= np.log2(p[byte])
            mixed -= np.log2(mixer.mix(p, near.predict(i % stride, before, beside))[byte])
            mixer.learn(byte)
            near.observe(i % stride, byte, before, beside)
            model.update(byte)
        return mixed, alone, *mixer.weights

    def f(cols: dict[str, list]) -> dict[str, list]:
        rows = [one(v or b"") for v in cols[value_col]]
        return {n: [r[i] for r in rows] for i, n in enumerate(("mixed_bits", "ppm_bits", "ppm_weight", "neighbour_weight"))}

    kind = "mixed_bits double, ppm_bits double, ppm_weight double, neighbour_weight double"
    return add_columns(as_binary(spread(df), value_col), kind, f, [value_col], drop=(value_col,))
