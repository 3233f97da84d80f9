"""Stream functions that keep a state for each key."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass
class Stateful:
    """run(key, frames, state, **options) gives frames; state has exists, get, update(tuple) and remove(), as Spark's group state."""

    run: Callable
    keys: list[str]
    state: object
    timeout: str = "NoTimeout"


class _Once:
    """The state of a key in a batch, where each key comes once."""

    hasTimedOut = False

    def __init__(self):
        self._value: tuple | None = None

    @property
    def exists(self) -> bool:
        return self._value is not None

    @property
    def get(self) -> tuple:
        if self._value is None:
            raise ValueError("no state has been set")
        return self._value

    def update(self, value: tuple) -> None:
        self._value = value

    def remove(self) -> None:
        self._value = None

    def setTimeoutDuration(self, _) -> None: ...

    def setTimeoutTimestamp(self, *_) -> None: ...


def stateful(df: DataFrame, n: int, f: Stateful, schema: T.StructType, options: dict) -> DataFrame:
    """f over the rows of each key, which is df's first n columns. In a batch a key's rows are streamed through f, a frame at a time."""
    names = df.columns[:n]
    if df.isStreaming:

        def each(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
            yield from f.run(key, (x.drop(columns=names, errors="ignore") for x in frames), state, **options)

        return df.groupBy(*names).applyInPandasWithState(each, schema, f.state, "append", f.timeout)

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, pd.DataFrame]]:
        for x in frames:
            for key, rows in x.groupby(names, sort=False, dropna=False):
                yield tuple(None if pd.isna(k) else k for k in key), rows.drop(columns=names).reset_index(drop=True)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, rows in groupby(parts(frames), key=lambda p: p[0]):
            yield from f.run(key, (r for _, r in rows), _Once(), **options)

    return df.repartition(*names).sortWithinPartitions(*names).mapInPandas(run, schema)
