"""Where a job's time goes, phase by phase."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


class Phases:
    """``with phases("name"):`` around each phase; a name that comes again adds up."""

    def __init__(self) -> None:
        self.seconds: dict[str, float] = {}

    @contextmanager
    def __call__(self, name: str) -> Iterator[None]:
        began = time.monotonic()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.monotonic() - began

    def report(self, spark: SparkSession) -> DataFrame:
        """phase, seconds, share, in the order in which phases began."""
        total = sum(self.seconds.values()) or 1.0
        rows = [(k, v, v / total) for k, v in self.seconds.items()]
        return spark.createDataFrame(rows, "phase string, seconds double, share double")
