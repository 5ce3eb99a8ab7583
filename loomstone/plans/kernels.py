"""Small reports and round trips of single kernels, for the catalogue."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from loomstone.functions import numeric as N
from loomstone.functions import rans
from loomstone.functions import transforms as X
from loomstone.functions.arrow import add_columns, as_binary


def rans_encode(df: DataFrame, value_col: str) -> DataFrame:
    """df with n, freqs and coded instead of the value."""

    def f(cols: dict[str, list]) -> dict[str, list]:
        v = [x or b"" for x in cols[value_col]]
        tables = [rans.normalise(N.histogram(x)) for x in v]
        return {"n": list(map(len, v)), "freqs": [t.tolist() for t in tables], "coded": rans.encode_many(v, tables)}

    return add_columns(as_binary(df, value_col), "n int, freqs array<int>, coded binary", f, [value_col], drop=(value_col,))


def rans_decode(df: DataFrame, out: str = "value") -> DataFrame:
    f = lambda c: {out: rans.decode_many(c["coded"], [np.array(t) for t in c["freqs"]], c["n"])}
    return add_columns(df, f"{out} binary", f, ["n", "freqs", "coded"], drop=("n", "freqs", "coded"))


def frequency_report(df: DataFrame, value_col: str) -> DataFrame:
    """df with total (of the normalised frequencies), symbols and largest instead of the value."""

    def f(cols: dict[str, list]) -> dict[str, list]:
        t = [rans.normalise(N.histogram(x or b"")) for x in cols[value_col]]
        return {"total": [int(x.sum()) for x in t], "symbols": [int((x > 0).sum()) for x in t], "largest": [int(x.max()) for x in t]}

    return add_columns(as_binary(df, value_col), "total int, symbols int, largest int", f, [value_col], drop=(value_col,))


def bcj_report(df: DataFrame, value_col: str) -> DataFrame:
    f = lambda c: {"bcj_helps": [N.bcj_helps(v or b"") for v in c[value_col]]}
    return add_columns(as_binary(df, value_col), "bcj_helps boolean", f, [value_col], drop=(value_col,))


def doubles_round_trip(df: DataFrame, value_col: str, keys: list[str]) -> DataFrame:
    """A batch of doubles as one byte sequence: delta and planes of stride 8 and back."""

    def f(cols: dict[str, list]) -> dict[str, list]:
        raw = np.array(cols[value_col], "<f8").tobytes()
        coded = X.transpose(X.delta(raw, 8)[0], 8)
        if len(raw) > 64 and coded == raw:
            raise AssertionError("nothing was done")
        return {value_col: np.frombuffer(X.undelta(X.untranspose(coded, 8), 8)[0], "<f8").tolist()}

    return add_columns(df, f"{value_col} double", f, [value_col]).select(*keys, value_col)
