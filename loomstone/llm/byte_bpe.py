"""Byte-level BPE encoding and decoding through a sentencepiece model made from the vocabulary.

The model is serialised here, field by field, from the tiktoken rank file: every token's bytes are
mapped one to one to characters (byte b to U+0100 + b), its score is its negative rank, and the
normaliser does nothing at all. sentencepiece then merges the neighbours with the best score first,
leftmost on ties, which is the merge order of byte-level BPE. A text is cut into pre-tokens by the
vocabulary's pattern, each is encoded on its own, and decoding maps ids back to bytes.
"""

from __future__ import annotations

import base64
import struct
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstone.llm.common import arrow_map

#: Pre-tokens whose ids a task remembers (when full, it starts anew), and texts encoded in one call.
REMEMBERED, TOGETHER = 200_000, 64
#: Wire format of sentencepiece's ModelProto: field numbers and enum values.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE, SCORE, TYPE, UNKNOWN_TYPE = 1, 2, 3, 2
MODEL_TYPE, BPE, VOCAB_SIZE, UNK_ID, BOS_ID, EOS_ID, PAD_ID = 3, 2, 4, 40, 41, 42, 43
NORMALIZER_NAME, ADD_DUMMY_PREFIX, REMOVE_EXTRA, ESCAPE = 1, 3, 4, 5
#: bytes -> the characters that stand for them
CHARACTERS = [chr(0x100 + b) for b in range(256)]


def read_ranks(data: bytes) -> dict[bytes, int]:
    """A tiktoken file: base64 token and rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _block(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model: piece 0 is the unknown one, piece r + 1 is the token of rank r."""
    by_rank = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must be 0, 1, 2 and so on")
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"no token for the bytes {missing}")
    score = lambda x: _varint(SCORE << 3 | 5) + struct.pack("<f", x)
    parts = [_block(PIECES, _block(PIECE, b"<unk>") + score(0.0) + _number(TYPE, UNKNOWN_TYPE))]
    for rank, token in enumerate(by_rank):
        parts.append(_block(PIECES, _block(PIECE, "".join(CHARACTERS[b] for b in token).encode()) + score(float(-rank))))
    trainer = _number(MODEL_TYPE, BPE) + _number(VOCAB_SIZE, len(by_rank) + 1) + _number(UNK_ID, 0)
    trainer += b"".join(_number(x, -1) for x in (BOS_ID, EOS_ID, PAD_ID))
    normalizer = _block(NORMALIZER_NAME, b"identity") + b"".join(_number(x, 0) for x in (ADD_DUMMY_PREFIX, REMOVE_EXTRA, ESCAPE))
    return b"".join(parts) + _block(TRAINER, trainer) + _block(NORMALIZER, normalizer)


class Codec:
    """Encodes whole texts as the vocabulary's own library would."""

    def __init__(self, rank_file: bytes, pattern: str) -> None:
        import regex
        import sentencepiece

        self.ranks = read_ranks(rank_file)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.ranks))
        self.split = regex.compile(pattern).findall
        self.known: dict[str, list[int]] = {}

    def _encode_new(self, pieces: list[str]) -> None:
        raw = [p.encode() for p in pieces]
        # a pre-token that is a token as a whole is that token, whatever the merges say
        whole = [self.ranks.get(r) for r in raw]
        rest = [r for r, w in zip(raw, whole, strict=True) if w is None]
        ids = iter(self.model.encode([r.decode("latin-1").translate(_SHIFT) for r in rest], num_threads=1) if rest else [])
        for p, w in zip(pieces, whole, strict=True):
            self.known[p] = [w] if w is not None else [i - 1 for i in next(ids)]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """One call of the model for all pre-tokens that are new."""
        pieces = list(map(self.split, texts))
        known = self.known
        if new := [p for p in dict.fromkeys(chain.from_iterable(pieces)) if p not in known]:
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = list(dict.fromkeys(chain.from_iterable(pieces)))
            self._encode_new(new)
        out = []
        for part in pieces:
            ids: list[int] = []
            for p in part:
                ids += known[p]
            out.append(ids)
        return out


#: latin-1 character b -> U+0100 + b
_SHIFT = {b: 0x100 + b for b in range(256)}


@lru_cache(1)
def codec(rank_file: bytes, pattern: str) -> Codec:
    return Codec(rank_file, pattern)


@lru_cache(1)
def tokens(rank_file: bytes) -> list[bytes]:
    """The bytes of each id."""
    return [t for t, _ in sorted(read_ranks(rank_file).items(), key=lambda x: x[1])]


def _sent(df: DataFrame, path: str, pattern: str):
    """The vocabulary's bytes (about a megabyte), read on the driver; executors need no copy of the file."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast((f.read(), pattern))


def encode(docs: DataFrame, path: str, pattern: str, *, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with the whole text of each row as token ids (array<int>), without special tokens.

    A null or empty text has no ids. A column called like ids_col is replaced; other columns stay. Null and repeated ids and
    repeated rows are encoded like others, so repeated rows stay repeated; an empty table gives an empty table.
    """
    sent = _sent(docs, path, pattern)
    base = docs.drop(ids_col)
    kind = T.StructType([*base.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))])
    passed = base.columns

    def each(b: pa.RecordBatch) -> dict:
        c = codec(*sent.value)
        cols = {n: b.column(i) for i, n in enumerate(passed)}
        texts = [t or "" for t in cols[text_col].to_pylist()]
        ids = [np.array(x, np.int32) for i in range(0, len(texts), TOGETHER) for x in c.encode_all(texts[i : i + TOGETHER])]
        ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
        return cols | {ids_col: pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))}

    return arrow_map(base, each, kind)


def decode(rows: DataFrame, path: str, pattern: str, *, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """rows with the bytes (binary) that the ids stand for; null ids give no bytes. A token may end
    within a character, so bytes of a part of a text need not be UTF-8. A column called like out_col is replaced; repeated rows
    stay repeated; an empty table gives an empty table."""
    sent = _sent(rows, path, pattern)
    base = rows.drop(out_col)
    kind = T.StructType([*base.schema.fields, T.StructField(out_col, T.BinaryType())])
    passed = base.columns

    def each(b: pa.RecordBatch) -> dict:
        table = tokens(sent.value[0])
        cols = {n: b.column(i) for i, n in enumerate(passed)}
        # one row's ids as Python numbers at a time
        return cols | {out_col: [b"".join(map(table.__getitem__, x.values.to_numpy().tolist() if x.is_valid else ())) for x in cols[ids_col]]}

    return arrow_map(base, each, kind)


def with_digest(rows: DataFrame, *, ids_col: str = "ids") -> DataFrame:
    """rows with n_tokens and ids_sha256 (of the decimal ids, joined by commas) instead of the ids."""
    text = F.coalesce(F.array_join(F.col(ids_col).cast("array<string>"), ","), F.lit(""))
    return rows.withColumns({"n_tokens": F.coalesce(F.size(ids_col), F.lit(0)).cast("long"), "ids_sha256": F.sha2(text, 256)}).drop(ids_col)
