"""Authenticated encryption of chunks with AES-256-GCM.

Keys come from a password by scrypt (the standard library has no Argon2; parameters are stored and the
stored ones are used again). An IV is derived from a random salt and the chunk's place, so a task that
is run again makes the same bytes and no IV is used twice under a key. The chunk's place is
authenticated too, so chunks can't change places.
"""

from __future__ import annotations

import hashlib
import os
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTINEL = b"loomstone key check"


class WrongPassword(ValueError):
    pass


@dataclass(frozen=True)
class Kdf:
    salt: str  # hex
    n: int = 1 << 15
    r: int = 8
    p: int = 1

    def key(self, password: str) -> bytes:
        return hashlib.scrypt(password.encode(), salt=bytes.fromhex(self.salt), n=self.n, r=self.r, p=self.p, maxmem=256 << 20, dklen=32)

    def as_row(self) -> dict:
        return asdict(self)


def new_kdf() -> Kdf:
    return Kdf(os.urandom(16).hex())


def little_endian(number: Column) -> Column:
    """A long as 8 bytes, lowest first."""
    code = F.lpad(F.hex(number.cast("long")), 16, "0")
    return F.unhex(F.concat(*(F.substring(code, 15 - 2 * i, 2) for i in range(8))))


def _iv(salt: str, *place: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.concat(F.lit(bytes.fromhex(salt)), *map(little_endian, place)), 256), 1, 24))


def _with_key(df: DataFrame, key: bytes) -> DataFrame:
    """df with the key as _key, from a table of one row: a literal would be told in plans, the UI and event logs."""
    one = df.sparkSession.createDataFrame([(bytearray(key),)], "_key binary")
    return df.crossJoin(F.broadcast(one))


def encrypt(df: DataFrame, value_col: str, key: bytes, salt: str, place: list[str]) -> DataFrame:
    """df with the value as IV, ciphertext and tag; ``place``: long columns that say which chunk it is."""
    where = [F.col(c) for c in place]
    aad = F.concat(*map(little_endian, where))
    sealed = F.aes_encrypt(F.col(value_col), F.col("_key"), F.lit("GCM"), F.lit("DEFAULT"), _iv(salt, *where), aad)
    return _with_key(df, key).withColumn(value_col, sealed).drop("_key")


def decrypt(df: DataFrame, value_col: str, key: bytes, place: list[str]) -> DataFrame:
    """df with the value decrypted; a wrong key, changed bytes or another place fail the query."""
    aad = F.concat(*(little_endian(F.col(c)) for c in place))
    return _with_key(df, key).withColumn(value_col, F.aes_decrypt(F.col(value_col), F.col("_key"), F.lit("GCM"), F.lit("DEFAULT"), aad)).drop("_key")


def try_decrypt(df: DataFrame, value_col: str, key: bytes, place: list[str]) -> DataFrame:
    """As decrypt, but null where it fails."""
    aad = F.concat(*(little_endian(F.col(c)) for c in place))
    return _with_key(df, key).withColumn(value_col, F.try_aes_decrypt(F.col(value_col), F.col("_key"), F.lit("GCM"), F.lit("DEFAULT"), aad)).drop("_key")


def sentinel(spark, key: bytes, salt: str) -> bytes:
    """A known text under the key."""
    one = spark.range(1).select(F.lit(SENTINEL).alias("v"), F.lit(-1).cast("long").alias("p"))
    return bytes(encrypt(one, "v", key, salt, ["p"]).first().v)


def check_sentinel(spark, stored: bytes, key: bytes) -> bool:
    """False for a wrong key; a value that can't be one raises ValueError."""
    if len(stored) != 12 + len(SENTINEL) + 16:
        raise ValueError("no key check value")
    one = spark.range(1).select(F.lit(stored).alias("v"), F.lit(-1).cast("long").alias("p"))
    got = try_decrypt(one, "v", key, ["p"]).first().v
    return got is not None and bytes(got) == SENTINEL
