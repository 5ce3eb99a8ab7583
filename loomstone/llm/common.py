"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstone.sources.store import erase, shared_dir, written

__all__ = ["LOWER", "ROWS_AT_ONCE", "WHITE", "arrow_map", "arrow_schema", "crc_mod", "documents", "erase", "opaque", "shared_dir", "spread", "texts", "written"]

#: Lower-cases A-Z in UTF-8 bytes; no other byte changes.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: [\x20\x09-\x0D], which is also what bytes.split() without arguments splits at.
WHITE = b" \t\n\x0b\x0c\r"
#: Rows that arrow_map works on together.
ROWS_AT_ONCE = 512


def spread(df: DataFrame) -> DataFrame:
    """A plain scan over all cores, where it has fewer partitions; for a large table it is left as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """The columns (all without any) of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spread(docs.select(*cols) if cols else docs)


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the id as text, mod n. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


def opaque(col: str) -> Column:
    """The same long, but so that the planner knows nothing of how it is dealt: both sides of a
    join on it get an exchange of their own, and then Spark may split a hot partition."""
    return F.col(col).bitwiseXOR(F.lit(0).cast("long"))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    col = batch.column(batch.schema.get_field_index(name))
    kind = pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()
    return [x or b"" for x in col.cast(kind).to_pylist()]


def arrow_map(
    df: DataFrame, f: Callable[[pa.RecordBatch], dict | None], schema: str | T.StructType
) -> DataFrame:
    """mapInArrow with a function from a batch to a dict of columns, None for no rows.

    Batches are cut, so that a task holds the Python objects of some hundred rows at a time."""
    kind = df.sparkSession.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    target = arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(i, ROWS_AT_ONCE) for x in batches for i in range(0, x.num_rows, ROWS_AT_ONCE)):
            if (out := f(b)) is not None:
                yield pa.RecordBatch.from_arrays(
                    [x if isinstance(x, pa.Array) else pa.array(x, t.type) for x, t in ((out[t.name], t) for t in target)],
                    schema=target,
                )

    return df.mapInArrow(run, kind)


def arrow_schema(kind: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(kind)
