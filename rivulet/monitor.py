"""Counts and latencies of running queries, reported through a callback."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


class Monitor(StreamingQueryListener):
    """Hands each batch's name, rows and milliseconds to report; names in disabled are left out."""

    def __init__(self, report: Callable[[dict], None], disabled: set[str] | None = None):
        self.report, self.disabled = report, disabled or set()

    def onQueryStarted(self, event): ...

    def onQueryProgress(self, event):
        p = event.progress
        if (p.name or str(p.id)) not in self.disabled:
            self.report({"query": p.name or str(p.id), "batch": p.batchId, "rows": p.numInputRows, "ms": p.batchDuration})

    def onQueryTerminated(self, event): ...


def attach(spark: SparkSession, report: Callable[[dict], None], disabled: set[str] | None = None) -> Monitor:
    m = Monitor(report, disabled)
    spark.streams.addListener(m)
    return m


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The frame, and an observation that has its row count once it has run."""
    o = Observation(name)
    return df.observe(o, F.count(F.lit(1)).alias("rows")), o
