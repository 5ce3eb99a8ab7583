"""Checksums and their verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checksums(df: DataFrame, value_col: str) -> DataFrame:
    """df with crc32 (bigint) and sha256 (lower-case hex) of the value; null for null."""
    v = F.col(value_col).cast("binary")
    return df.withColumns({"crc32": F.crc32(v), "sha256": F.sha2(v, 256)})


def verdict(crc_now: Column, crc_stored: Column, sha_now: Column, sha_stored: Column) -> Column:
    """"not_found", "crc_mismatch", "sha256_mismatch" or "ok", in this order of checks."""
    return F.when(sha_stored.isNull(), "not_found").when(~crc_now.eqNullSafe(crc_stored), "crc_mismatch").when(~sha_now.eqNullSafe(sha_stored), "sha256_mismatch").otherwise("ok")


def verify(values: DataFrame, key: str, value_col: str, stored: DataFrame) -> DataFrame:
    """key, status of every value against stored (key, crc32, sha256); stored rows without a value are "missing"."""
    now = checksums(values.select(key, value_col), value_col).select(key, F.col("crc32").alias("_c"), F.col("sha256").alias("_s"), F.lit(True).alias("_here"))
    both = now.join(stored.select(key, "crc32", "sha256"), key, "full_outer")
    return both.select(key, F.when(F.col("_here").isNull(), "missing").otherwise(verdict(F.col("_c"), F.col("crc32"), F.col("_s"), F.col("sha256"))).alias("status"))


def table_digest(df: DataFrame, key: Column, sha: Column) -> DataFrame:
    """One row: n, digest of all (key, sha) pairs, independent of their order (a sum of hashes)."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(key, sha).cast("decimal(38,0)")).cast("string").alias("digest"))
