"""Taps written in Python: open, next and close, read by as many tasks as they ask for, in batch and as a stream."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from rivulet.errors import FlowError


class Tap:
    """Override next, and what else matters. In a stream next gives None where there is nothing just now; in batch that is the end.

    schema is what rows look like where a script gives none; parallelism is how many tasks read a batch, each with a tap of its
    own that knows its part.
    """

    schema: str | None = None
    parallelism: int = 1

    def open(self, path: str, args: list, part: int) -> None: ...

    def next(self) -> tuple | None:
        raise NotImplementedError

    def close(self) -> None: ...


def _rows(make: Callable[[], Tap], path: str, args: list, part: int) -> Iterator[tuple]:
    tap = make()
    tap.open(path, args, part)
    try:
        while (row := tap.next()) is not None:
            yield row
    finally:
        tap.close()


class _Part(InputPartition):
    def __init__(self, part: int):
        self.part = part


def source(make: Callable[[], Tap]) -> Callable:
    """A tap for register_tap() from a class of them, or anything else that makes one."""

    def tap(spark: SparkSession, path: str, args: list, schema: T.StructType | None, stream: bool) -> DataFrame:
        shape = schema or make().schema
        if shape is None:
            raise FlowError("the tap needs a schema", 1002)

        class Batch(DataSourceReader):
            def partitions(self):
                return [_Part(k) for k in range(max(1, make().parallelism))]

            def read(self, partition):
                yield from _rows(make, path, args, partition.part)

        class Stream(SimpleDataSourceStreamReader):
            """The driver polls one tap; what it has read stays until it is committed, so that a batch can be read again."""

            def __init__(self):
                self.tap, self.kept, self.at = None, {}, 0

            def initialOffset(self):
                return {"at": 0}

            def read(self, start):
                if self.tap is None:
                    self.tap = make()
                    self.tap.open(path, args, 0)
                rows, at = [], int(start["at"])
                while at + len(rows) in self.kept:
                    rows.append(self.kept[at + len(rows)])
                while len(rows) < 10_000 and (row := self.tap.next()) is not None:
                    self.kept[at + len(rows)] = row
                    rows.append(row)
                return iter(rows), {"at": at + len(rows)}

            def readBetweenOffsets(self, start, end):
                return iter([self.kept[k] for k in range(int(start["at"]), int(end["at"]))])

            def commit(self, end):
                for k in [k for k in self.kept if k < int(end["at"])]:
                    del self.kept[k]

        called = f"rivulet_tap_{uuid.uuid4().hex}"

        class Source(DataSource):
            @classmethod
            def name(cls):
                return called

            def schema(self):
                return shape

            def reader(self, schema):
                return Batch()

            def simpleStreamReader(self, schema):
                return Stream()

        spark.dataSource.register(Source)
        return (spark.readStream if stream else spark.read).format(called).load()

    return tap
