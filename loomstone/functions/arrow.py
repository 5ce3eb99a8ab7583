"""Arrow plumbing for kernels that work on one value at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows whose Python objects a task holds at once.
ROWS = 256


def as_binary(df: DataFrame, value_col: str) -> DataFrame:
    """The value column as bytes: strings as UTF-8; null stays null."""
    return df.withColumn(value_col, F.col(value_col).cast("binary")) if df.schema[value_col].dataType != T.BinaryType() else df


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where it is a plain scan of fewer partitions: for kernels that cost far more than
    a shuffle. Behind an exchange the partitions are left as they are (counting them would run it)."""
    if "Exchange" in df._jdf.queryExecution().sparkPlan().toString() or df._jdf.queryExecution().executedPlan().toString().startswith("AdaptiveSparkPlan"):
        return df
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def add_columns(df: DataFrame, fields: str, f: Callable[[dict[str, list]], dict[str, list]], using: list[str], drop: tuple[str, ...] = ()) -> DataFrame:
    """df with further columns (a DDL string) that f computes from the lists of the columns ``using``.

    Only the columns of df that stay, and those that f uses, go to Python and back."""
    added = T.StructType.fromDDL(fields)
    keep = [s for s in df.schema if s.name not in {a.name for a in added} and s.name not in drop]
    kind = T.StructType([*keep, *added.fields])
    target = to_arrow_schema(kind)
    names = [s.name for s in keep]
    new = [a.name for a in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                col = lambda n, b=b: b.column(b.schema.get_field_index(n))
                out = f({n: col(n).to_pylist() for n in using})
                yield pa.RecordBatch.from_arrays([*(col(n) for n in names), *(pa.array(out[n], target.field(n).type) for n in new)], schema=target)

    return df.mapInArrow(run, kind)


def per_value(f: Callable[[bytes], object], using: str, out: str) -> Callable[[dict[str, list]], dict[str, list]]:
    """f for each non-null value of one column; null gives null."""
    return lambda cols: {out: [None if v is None else f(v) for v in cols[using]]}
