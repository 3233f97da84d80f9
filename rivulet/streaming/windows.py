"""Tumbling, sliding and session windows; the same plan for a batch and a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: How late a row of a stream may be before its window is closed, unless a script says otherwise.
DELAY = "10 minutes"


def event_time(df: DataFrame, on: str | None) -> tuple[DataFrame, str]:
    """The frame with a timestamp column to window by: a field (without zone: read as UTC), or the time of processing."""
    name = "__at"
    if on is None:
        return df.withColumn(name, F.current_timestamp()), name
    c = F.col(f"`{on}`")
    kind = df.schema[on].dataType
    if isinstance(kind, T.LongType):
        c = F.timestamp_millis(c)
    return df.withColumn(name, c.cast("timestamp")), name


def windowed(df: DataFrame, on: str | None, every: tuple[int, str], keys: list[Column], outputs: list[Column], slide: tuple[int, str] | None = None, delay: tuple[int, str] | None = None, session: bool = False) -> DataFrame:
    """One row for each window and key with the outputs (aggregates, named); rows whose outputs are all null are left out.

    The window's start and end come first, as window_start and window_end. A session window goes on as long as rows of its key
    follow each other within every; it has no slide. delay is how late a row of a stream may be, DELAY by default.
    """
    span = lambda x: f"{x[0]} {x[1]}s"
    d, at = event_time(df, on)
    if d.isStreaming:
        d = d.withWatermark(at, span(delay) if delay else DELAY)
    w = F.session_window(at, span(every)) if session else F.window(at, span(every), span(slide) if slide else None)
    names = [f"__k{i}" for i in range(len(keys))]
    d = d.withColumns(dict(zip(names, keys, strict=True))) if keys else d
    out = d.groupBy(w.alias("__w"), *names).agg(*outputs)
    shown = [c for c in out.columns if c != "__w" and c not in names]
    out = out.where(F.coalesce(*(F.col(f"`{c}`").cast("string") if not isinstance(out.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType)) else F.when(F.col(f"`{c}`").isNotNull(), "") for c in shown)).isNotNull())
    return out.select(F.col("__w.start").alias("window_start"), F.col("__w.end").alias("window_end"), *(F.col(f"`{c}`") for c in shown))
