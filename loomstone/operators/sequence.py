"""Sequence operators on rows (key, pos, value): deltas, planes, transitions, runs.

Each key is a sequence of its own and is sorted once; what only depends on the plane uses (key, pos mod
stride), so long sequences split by plane.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def byte_rows(df: DataFrame, key: str, value_col: str, prefix: int) -> DataFrame:
    """key, pos (from 0), b: the first ``prefix`` bytes of each value, one row each."""
    cut = df.select(key, F.substring(F.col(value_col).cast("binary"), 1, prefix).alias("_v"))
    code = cut.select(key, F.hex("_v").alias("_h")).filter("length(_h) > 0")
    rows = code.select(key, "_h", F.explode(F.sequence(F.lit(0), (F.length("_h") / 2 - 1).cast("int"))).alias("pos"))
    return rows.select(key, "pos", F.conv(F.substr("_h", 2 * F.col("pos") + 1, F.lit(2)), 16, 10).cast("int").alias("b"))


def delta(rows: DataFrame, key: str, pos: str, value: str, stride: int = 1, modulus: int | None = 256) -> DataFrame:
    """rows with ``d``: the value minus that of ``stride`` rows earlier (0 before the start)."""
    w = Window.partitionBy(key, F.pmod(F.col(pos), F.lit(max(stride, 1)))).orderBy(pos)
    d = F.col(value) - F.lag(value, 1, 0).over(w)
    return rows.withColumn("d", F.pmod(d, F.lit(modulus)) if modulus else d)


def undelta(rows: DataFrame, key: str, pos: str, d: str, stride: int = 1, modulus: int | None = 256, out: str = "v") -> DataFrame:
    """rows with the running sums of the deltas in each plane."""
    w = Window.partitionBy(key, F.pmod(F.col(pos), F.lit(max(stride, 1)))).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(d).over(w)
    return rows.withColumn(out, F.pmod(total, F.lit(modulus)) if modulus else total)


def transposed_position(pos: Column, n: Column, stride: int) -> Column:
    """Where byte ``pos`` of n goes when planes follow each other; the same for a stride up to 1 or n <= stride."""
    plane, row = F.pmod(pos, F.lit(stride)), F.floor(pos / stride)
    longer = F.pmod(n, F.lit(stride))
    before = plane * F.floor(n / stride) + F.least(plane, longer)
    return F.when((F.lit(stride) <= 1) | (n <= stride), pos).otherwise(before + row).cast("int")


def transpose(rows: DataFrame, key: str, pos: str, stride: int) -> DataFrame:
    """rows with ``out_pos``."""
    sizes = Window.partitionBy(key)
    return rows.withColumn("out_pos", transposed_position(F.col(pos), F.count(F.lit(1)).over(sizes), stride))


def plane_delta(rows: DataFrame, key: str, pos: str, value: str, stride: int) -> DataFrame:
    """Deltas inside planes, each plane keeping its first value: rows with out_pos and ``d``."""
    w = Window.partitionBy(key, F.pmod(F.col(pos), F.lit(stride))).orderBy(pos)
    before = F.lag(value).over(w)
    return transpose(rows, key, pos, stride).withColumn("d", F.when(before.isNull(), F.col(value)).otherwise(F.pmod(F.col(value) - before, F.lit(256))))


def transitions(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """before, after, n: counts of adjacent pairs within each key."""
    w = Window.partitionBy(key).orderBy(order)
    pairs = rows.select(F.lag(value).over(w).alias("before"), F.col(value).alias("after")).filter("before IS NOT NULL")
    return pairs.groupBy("before", "after").agg(F.count(F.lit(1)).alias("n"))


def runs(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Maximal runs of equal values: key, run (from 1), value, start, stop, n."""
    w = Window.partitionBy(key).orderBy(order)
    change = F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"), F.lit(1))
    first = F.when(F.row_number().over(w) == 1, 1).otherwise(change)
    numbered = rows.select(key, F.col(value).alias("value"), F.col(order).alias("_o"), first.alias("_c"))
    numbered = numbered.withColumn("run", F.sum("_c").over(Window.partitionBy(key).orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "run", "value").agg(F.min("_o").alias("start"), F.max("_o").alias("stop"), F.count(F.lit(1)).alias("n"))


def boundary_hints(run_rows: DataFrame, key: str) -> DataFrame:
    """Where the stride of a stream changes: key, byte_offset, content types and strides before and after.

    run_rows: what runs() gives for strides by position; stride 0 stands for none."""
    w = Window.partitionBy(key).orderBy("run")
    kind = lambda s: F.when(s > 0, "multimedia").otherwise("binary")
    some = lambda s: F.when(s > 0, s)
    before = run_rows.withColumn("_b", F.lag("value").over(w)).filter("run > 1")
    return before.select(
        key, F.col("start").alias("byte_offset"), kind(F.col("_b")).alias("content_before"), kind(F.col("value")).alias("content_after"),
        some(F.col("_b")).alias("stride_before"), some(F.col("value")).alias("stride_after"),
    )


def end_report(history: DataFrame, key: str, pos: str, stride: str) -> DataFrame:
    """key, verdict ("uniform" or "varied"), n_ranges: what a whole history of strides amounts to."""
    r = runs(history, key, pos, stride)
    return r.groupBy(key).agg(F.when(F.count(F.lit(1)) == 1, "uniform").otherwise("varied").alias("verdict"), F.count(F.lit(1)).alias("n_ranges"))
