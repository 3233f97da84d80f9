"""Ordering by a comparison of two tuples, for orders that no key expresses."""

from __future__ import annotations

import heapq
import tempfile
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import cmp_to_key

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.conversion import ArrowTableToRowsConversion

#: Rows that a task sorts at once: their keys are Python objects, and the rows Arrow's.
RUN = 50_000

#: Rows of the sample for each task.
SAMPLED = 20

_PLAIN = (T.NumericType, T.StringType, T.BooleanType, T.DateType)


def _rows(batch: pa.RecordBatch, schema: T.StructType) -> list[tuple]:
    """The tuples of a batch's first columns, those of schema, with values as Spark's rows have them."""
    table = pa.Table.from_batches([batch]).select(list(range(len(schema))))
    if all(isinstance(f.dataType, _PLAIN) for f in schema):
        return list(zip(*(c.to_pylist() for c in table.columns), strict=True))
    return [tuple(r) for r in ArrowTableToRowsConversion.convert(table, schema)]


def _sorted(batches: Iterator[pa.RecordBatch], schema: T.StructType, key: Callable) -> Iterator[pa.RecordBatch]:
    """Rows in the order of their keys: runs of RUN rows are sorted, and where there are several they go to disk and are merged."""
    files, held, rows = [], [], 0

    def run() -> pa.Table:
        nonlocal held, rows
        keys = [key(r) for b in held for r in _rows(b, schema)]
        out = pa.Table.from_batches(held).take(pa.array(sorted(range(len(keys)), key=keys.__getitem__), pa.int64()))
        held, rows = [], 0
        return out

    def written(table: pa.Table) -> None:
        files.append(tempfile.TemporaryFile())
        with pa.ipc.new_stream(files[-1], table.schema) as w:
            w.write_table(table, 2_000)
        files[-1].seek(0)

    for b in batches:
        for at in range(0, b.num_rows, RUN):
            if rows and rows + min(RUN, b.num_rows - at) > RUN:
                written(run())
            held.append(b.slice(at, RUN))
            rows += held[-1].num_rows
    if not files:
        if held:
            yield from run().to_batches(10_000)
        return
    written(run())

    def read(f) -> Iterator[tuple]:
        for b in pa.ipc.open_stream(f):
            for i, r in enumerate(_rows(b, schema)):
                yield key(r), b, i

    def taken(places: list[tuple]) -> Iterator[pa.RecordBatch]:
        starts, parts, n = {}, [], 0
        for _, b, _ in places:
            if id(b) not in starts:
                starts[id(b)] = n
                parts.append(b)
                n += b.num_rows
        yield from pa.Table.from_batches(parts).take(pa.array([starts[id(b)] + i for _, b, i in places], pa.int64())).combine_chunks().to_batches()

    places = []
    for place in heapq.merge(*map(read, files), key=lambda p: p[0]):
        places.append(place)
        if len(places) == 10_000:
            yield from taken(places)
            places = []
    if places:
        yield from taken(places)


def by_comparison(df: DataFrame, columns: list[Column], compare: Callable[[tuple, tuple], int], descending: bool = False) -> DataFrame:
    """The rows of df in the order of compare, which is given two tuples of the columns' values and returns less than, equal to or more than 0.

    Rows are dealt by ranges of a sample of their keys to as many tasks as RUN asks for, and each task sorts its own, by runs
    that are merged from disk: only the keys of a run are Python objects. Rows that are equal to several bounds are dealt to
    all ranges between. A key function is to be preferred wherever there is one, as Spark sorts by it.
    """
    n, names = len(columns), df.columns
    order = (lambda a, b: compare(b, a)) if descending else compare
    hashed = [F.col(f"`{c}`") for c, t in df.dtypes if "map<" not in t and "variant" not in t]
    keyed = df.select(*(c.alias(f"__{i}") for i, c in enumerate(columns)), (F.xxhash64(*hashed) if hashed else F.lit(0).cast("long")).alias("__deal"), *(df[f"`{c}`"] for c in names))
    keys = T.StructType(keyed.schema.fields[:n])
    total = keyed.count()
    tasks = max(1, -(-total // RUN), min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // 1_000))
    sample = keyed.select(*keys.names).sample(min(1.0, SAMPLED * tasks / max(total, 1)), seed=0).collect() if tasks > 1 else []
    sample = sorted(map(tuple, sample), key=cmp_to_key(order))
    bounds = [sample[len(sample) * k // tasks] for k in range(1, tasks)] if sample else []

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = cmp_to_key(order)
        ends = [key(b) for b in bounds]
        for b in batches:
            ranges = []
            for r, h in zip(map(key, _rows(b, keys)), b.column(n).to_pylist(), strict=True):
                low = bisect_left(ends, r)
                high = low if low == len(ends) or r < ends[low] else bisect_right(ends, r, low)
                ranges.append(low + h % (high - low + 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ranges, pa.int32())], names=[*b.schema.names, "__range"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sorted(batches, keys, cmp_to_key(order)):
            yield b.select(list(range(n + 1, n + 1 + len(names))))

    dealt = keyed.mapInArrow(deal, T.StructType([*keyed.schema, T.StructField("__range", T.IntegerType())])) if bounds else keyed.withColumn("__range", F.lit(0))
    return dealt.repartitionById(len(bounds) + 1, F.col("__range")).mapInArrow(sort, df.schema)
