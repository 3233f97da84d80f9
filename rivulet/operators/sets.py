"""Union, intersection, difference, distinct and split of whole rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def union(frames: list[DataFrame], by_name: bool = False) -> DataFrame:
    """All rows of all inputs, repeated ones too; by place (shorter rows padded with null) or by name."""
    if by_name:
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    wide = max(frames, key=lambda d: len(d.columns))

    def padded(df: DataFrame) -> DataFrame:
        more = [F.lit(None).cast(f.dataType).alias(f.name) for f in wide.schema[len(df.columns) :]]
        return df.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, wide.columns, strict=False)), *more)

    return reduce(lambda a, b: a.union(b), map(padded, frames))


def meet(frames: list[DataFrame], how: str, every: bool) -> DataFrame:
    """Rows of the first input that the others have too (intersect), or that none of them has (except); every counts repeats."""
    name = how + "All" if every else {"intersect": "intersect", "except": "subtract"}[how]
    plain = [_entries(df) for df in frames]
    return _maps(reduce(lambda a, b: getattr(a, name)(b), plain), frames[0].schema)


def _sorted(c: Column, kind: T.DataType) -> Column:
    """The same value with its maps, however deep they are, as sorted arrays of entries, which can be compared."""
    if isinstance(kind, T.MapType):
        return F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(_sorted(e.key, kind.keyType).alias("key"), _sorted(e.value, kind.valueType).alias("value"))))
    if "map<" not in kind.simpleString():
        return c
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _sorted(x, kind.elementType))
    return F.when(c.isNotNull(), F.struct(*(_sorted(c.getField(f.name), f.dataType).alias(f.name) for f in kind)))


def _unsorted(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.transform(c, lambda e: F.struct(_unsorted(e.key, kind.keyType).alias("key"), _unsorted(e.value, kind.valueType).alias("value"))))
    if "map<" not in kind.simpleString():
        return c
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _unsorted(x, kind.elementType))
    return F.when(c.isNotNull(), F.struct(*(_unsorted(c.getField(f.name), f.dataType).alias(f.name) for f in kind)))


def _entries(df: DataFrame) -> DataFrame:
    return df.select(*(_sorted(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema))


def _maps(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.select(*(_unsorted(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in schema))


def distinct(df: DataFrame) -> DataFrame:
    """Each row once; a map counts by its entries, whatever their order and however deep it is in other values."""
    if "map<" not in df.schema.simpleString():
        return df.distinct()
    return _maps(_entries(df).distinct(), df.schema)


def split(df: DataFrame, conditions: list[Column]) -> list[DataFrame]:
    """One frame a condition, and last the rows for which none is true (null counts as not true)."""
    none = reduce(lambda a, b: a & b, (~F.coalesce(c, F.lit(False)) for c in conditions))
    return [*(df.where(c) for c in conditions), df.where(none)]
