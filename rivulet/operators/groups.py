"""Grouping into bags, and co-grouping of several inputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.operators.joins import equal


def bags(df: DataFrame, group: Column, name: str) -> DataFrame:
    """group and a bag of whole tuples; null is a group of its own."""
    rows = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    return df.select(group.alias("group"), rows.alias("__row")).groupBy("group").agg(F.collect_list("__row").alias(name))


def cubed(df: DataFrame, keys: list[tuple[str, Column]], how: str, name: str) -> DataFrame:
    """group (a tuple of the named keys, null where all of them are taken together) and a bag, for each grouping of a cube or rollup."""
    rows = F.collect_list(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias(name)
    by = [f"__c{i}" for i in range(len(keys))]
    d = df.withColumns({c: k for c, (_, k) in zip(by, keys, strict=True)})
    return getattr(d, how)(*by).agg(rows).select(F.struct(*(F.col(c).alias(n) for c, (n, _) in zip(by, keys, strict=True))).alias("group"), name)


def cogroup(inputs: list[tuple[DataFrame, Column, str, bool]], compound: bool) -> DataFrame:
    """group and one bag an input; (frame, key, bag's name, inner) each.

    An absent side is an empty bag. A null key alone never matches: each input has its own row for it. A compound key
    with a null component matches like any other. inner drops groups whose bag is empty.
    """
    sides = []
    for k, (df, key, name, _) in enumerate(inputs):
        kind = T.ArrayType(df.schema)
        sides.append((bags(df, key, name).withColumnRenamed("group", f"__g{k}"), name, kind))

    def both(a: tuple[DataFrame, Column], b: tuple[DataFrame, Column]) -> tuple[DataFrame, Column]:
        return a[0].join(b[0], equal([a[1]], [b[1]], null_safe=compound), "full_outer"), F.coalesce(a[1], b[1])

    out, group = reduce(both, [(df, F.col(f"__g{k}")) for k, (df, _, _) in enumerate(sides)])
    out = out.select(group.alias("group"), *(F.coalesce(F.col(f"`{n}`"), F.array().cast(k)).alias(n) for _, n, k in sides))
    for _, _, name, inner in inputs:
        if inner:
            out = out.where(F.size(F.col(f"`{name}`")) > 0)
    return out
