"""Python functions with a life of their own: set up in each task, limited in time, and timed.

The function runs over Arrow batches of its arguments, one call a row, as its interface asks.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: One call in so many is timed.
SAMPLED = 100


class Function:
    """Override call, and prepare and cleanup where they matter; a task has an instance of its own."""

    def prepare(self, config: dict) -> None: ...

    def call(self, *values: object) -> object:
        raise NotImplementedError

    def cleanup(self) -> None: ...


class Timer:
    """Calls, and the seconds that the timed ones of them took, of all tasks that have ended."""

    def __init__(self, spark: SparkSession):
        self.calls, self.timed, self.seconds = (spark.sparkContext.accumulator(x) for x in (0, 0, 0.0))

    @property
    def mean(self) -> float | None:
        return self.seconds.value / self.timed.value if self.timed.value else None


def managed(make: Callable[[], Function], returns: str, config: dict | None = None, within: float | None = None, default: object = None, timer: Timer | None = None) -> Callable[..., Column]:
    """A function of columns. A call that takes longer than within seconds gives default; the call itself goes on in its thread."""
    config = dict(config or {})

    def run(batches: Iterator) -> Iterator[pd.Series]:
        f = make()
        f.prepare(config)
        pool = ThreadPoolExecutor(8) if within else None
        calls, timed, seconds = 0, 0, 0.0
        try:
            for batch in batches:
                out = []
                for values in zip(*(batch if isinstance(batch, tuple) else (batch,)), strict=True):
                    values = tuple(None if x is None or x is pd.NA or isinstance(x, float) and x != x else x for x in values)
                    began = time.perf_counter() if not calls % SAMPLED else None
                    try:
                        out.append(pool.submit(f.call, *values).result(within) if pool else f.call(*values))
                    except Late:
                        out.append(default)
                    if began is not None:
                        timed, seconds = timed + 1, seconds + time.perf_counter() - began
                    calls += 1
                yield pd.Series(out, dtype=object)
        finally:
            if pool:
                pool.shutdown(wait=False, cancel_futures=True)
            if timer is not None:
                timer.calls.add(calls)
                timer.timed.add(timed)
                timer.seconds.add(seconds)
            f.cleanup()

    def one(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from run(batches)

    def several(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        yield from run(batches)

    kinds = {True: (Iterator[pd.Series], Iterator[pd.Series]), False: (Iterator[tuple[pd.Series, ...]], Iterator[pd.Series])}
    for g, k in ((one, True), (several, False)):
        g.__annotations__ = dict(zip(("batches", "return"), kinds[k], strict=True))
    single, many = (F.pandas_udf(g, returns) for g in (one, several))
    return lambda *columns: (single if len(columns) == 1 else many)(*columns)
