"""Deal rows into runs of consecutive ids, each with the row that follows it.

For operators that look at a document and the next one by id. No task sees more than some runs,
and only runs' limits (a bounded number of ids) come to the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_RUNS = 20_000


def run_starts(ids: DataFrame, rows_each: int) -> list[int]:
    """Ascending first ids of runs of about ``rows_each`` rows, or more where that would be over MOST_RUNS runs; ids: one
    long column without nulls. Cuts are approximate percentiles, and a run starts at its least id."""
    col = ids.columns[0]
    n = ids.count()
    if not n:
        return []
    runs = min(MOST_RUNS, -(-n // rows_each))
    if runs == 1:
        return [ids.agg(F.min(col)).first()[0]]
    shares = ",".join(repr(i / runs) for i in range(1, runs))
    cuts = ids.agg(F.expr(f"percentile_approx({col}, array({shares}), {max(10_000, 10 * runs)})")).first()[0]
    cuts = np.unique(np.array(cuts, np.int64))

    @F.pandas_udf("long")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, x.to_numpy(), side="left"))

    return sorted(r.a for r in ids.groupBy(run(F.col(col)).alias("r")).agg(F.min(col).alias("a")).collect())  # MOST_RUNS rows


def with_next(rows: DataFrame, id_col: str, rows_each: int = 128) -> DataFrame:
    """rows with _run and _after, dealt by _run and sorted by _run, _after, id and the other columns.

    Within a run the rows with _after = 0 are consecutive by id; the first row with _after = 1
    is the row that follows the run's last, for the last run the very first row. A null id comes
    before all others; equal ids are ordered by the other columns."""
    starts = run_starts(rows.select(F.col(id_col).cast("long").alias("_i")).filter("_i IS NOT NULL"), rows_each)
    nulls = not rows.filter(F.col(id_col).isNull()).isEmpty()
    firsts = np.array(([-(2**63)] if nulls else []) + starts, np.int64)

    @F.pandas_udf("long")
    def place(ids: pd.Series) -> pd.Series:
        """The run's number, doubled, plus one if the row may be its first."""
        if not len(firsts):
            return pd.Series(np.zeros(len(ids), np.int64))
        v = ids.to_numpy()
        at = np.maximum(np.searchsorted(firsts, v, side="right") - 1, 0)
        return pd.Series(at * 2 + (firsts[at] == v))

    last = max(len(firsts) - 1, 0)
    run = F.shiftright("_place", 1)
    own = F.struct(run.alias("_run"), F.lit(0).alias("_after"))
    before = F.struct(F.when(run == 0, F.lit(last).cast("long")).otherwise(run - 1).alias("_run"), F.lit(1).alias("_after"))
    dealt = rows.withColumn("_place", place(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)).cast("long")))).select(
        *rows.columns, F.inline(F.when(F.col("_place").bitwiseAND(F.lit(1).cast("long")) == 1, F.array(own, before)).otherwise(F.array(own)))
    )
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest = [F.col(c).asc_nulls_first() for c in rows.columns if c != id_col]
    return dealt.repartition(n, "_run").sortWithinPartitions("_run", "_after", F.col(id_col).asc_nulls_first(), *rest)
