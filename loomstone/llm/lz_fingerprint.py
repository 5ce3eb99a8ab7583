"""Lempel-Ziv phrase fingerprints.

A document's UTF-8 bytes are parsed into the phrases of a growing dictionary (LZ78: the shortest
prefix of the rest that is not a phrase yet becomes one). The phrases' hashes form a set, and the
``SIZE`` least hashes are its minimum-hash signature: the fingerprint. The likeness of two
fingerprints estimates the Jaccard similarity of the phrase sets, which follows how well one text
helps to compress the other (Raff and Nicholas, "An Alternative to NCD for Large Sequences,
Lempel-Ziv Jaccard Distance", 2017); it is exact for texts of up to ``SIZE`` phrases.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstone.llm.common import arrow_map, arrow_schema, texts
from loomstone.llm.ordered import with_next

SIZE = 128


class Parse:
    """A parse that can be continued, and copied to be continued in two ways."""

    __slots__ = ("hashes", "node", "open", "trie")

    def __init__(self) -> None:
        self.trie: dict[int, int] = {}  # node * 256 + byte -> node
        self.node = 0
        self.open = b""  # bytes of the phrase that is not complete yet
        self.hashes: list[int] = []

    def copy(self) -> Parse:
        new = Parse()
        new.trie, new.node, new.open, new.hashes = self.trie.copy(), self.node, self.open, self.hashes.copy()
        return new

    def feed(self, data: bytes) -> Parse:
        trie, node, at, cuts = self.trie, self.node, 0, []
        get, cut = trie.get, cuts.append
        for byte in data:
            at += 1
            key = node << 8 | byte
            node = get(key)
            if node is None:
                trie[key] = len(trie) + 1
                cut(at)
                node = 0
        self.node = node
        h, start = xxhash.xxh32_intdigest, 0
        if cuts:
            data = self.open + data
            more = len(self.open)
            ends = [c + more for c in cuts]
            self.hashes += [h(data[a:b]) for a, b in zip([start, *ends], ends, strict=False)]
            self.open = data[ends[-1] :]
        else:
            self.open += data
        return self

    def signature(self) -> np.ndarray:
        return np.unique(np.array(self.hashes, np.uint32))[:SIZE]


def as_text(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: of the least hashes of the union, how many are in both; 1.0 for two empty ones."""
    union = np.union1d(a, b)[:SIZE]
    if not len(union):
        return 1.0
    return float((np.isin(union, a) & np.isin(union, b)).sum() / len(union))


def fingerprint(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fingerprint of every row: 8 hex digits for each of up to 128 hashes. Equal texts
    have equal fingerprints; null or empty: the empty string."""
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    each = lambda b: {"_id": b.column(0), "fingerprint": [as_text(Parse().feed(t).signature()) for t in texts(b, "_t")]}
    kind = T.StructType([src.schema["_id"], T.StructField("fingerprint", T.StringType())])
    return arrow_map(src, each, kind).withColumnRenamed("_id", id_col)


def likeness_of(a: str, b: str) -> Column:
    """Likeness of two fingerprint columns (0 to 1; null if one is null)."""

    @F.pandas_udf("double")
    def f(x, y):
        read = lambda s: np.frombuffer(bytes.fromhex(s), ">u4").astype(np.uint32)
        return x.combine(y, lambda p, q: None if p is None or q is None else likeness(read(p), read(q)))

    return f(F.col(a), F.col(b))


def edits_and_neighbours(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint each text, its edited text, and compare both with it and with the next text.

    The edited text: the last floor(n_chars / 4) code points give way to the first as many, or
    all, of the next document by ascending id; after the last comes the first.
    Returns the id, n_chars (code points), edited_sha256, fingerprint, edited_fingerprint, near_edited
    and near_next (double), one row for each row of docs. A null text counts as empty; two empty
    fingerprints have likeness 1.0, an empty and another one 0.0. Null ids come first, equal ids are
    ordered by text. A single row is its own next. Other columns are ignored.
    """
    src = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    kind = T.StructType(
        [T.StructField(id_col, src.schema["_id"].dataType), T.StructField("n_chars", T.LongType())]
        + [T.StructField(c, T.StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")]
        + [T.StructField(c, T.DoubleType()) for c in ("near_edited", "near_next")]
    )
    ordered = with_next(src, "_id").select("_run", "_after", "_id", "_t")
    names, target = kind.names, arrow_schema(kind)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that waits for its next
        run = None
        for b in batches:
            out: list[tuple] = []
            for new_run, after, key, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if new_run != run:
                    run, held = new_run, None
                elif held is None:  # the run is over
                    continue
                n = len(text)
                head = Parse().feed(text[: n - n // 4].encode())
                whole = head.copy().feed(text[n - n // 4 :].encode()).signature()
                if held is not None:
                    old_key, old_text, old_head, old_sig = held
                    cut = len(old_text) - len(old_text) // 4
                    tail = text[: len(old_text) - cut].encode()
                    edited = old_head.feed(tail).signature()
                    sha = hashlib.sha256(old_text[:cut].encode() + tail).hexdigest()
                    out.append((old_key, len(old_text), sha, as_text(old_sig), as_text(edited), likeness(old_sig, edited), likeness(old_sig, whole)))
                held = None if after else (key, text, head, whole)
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, o, strict=True)) for o in out], schema=target)

    return ordered.mapInArrow(each, kind)
