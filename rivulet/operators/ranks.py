"""Numbering and ranking without a single task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.storage import checkpoint


def _offsets(counts: DataFrame) -> DataFrame:
    """part and the rows before it, from one row (part, n) a task."""
    rows = sorted(counts.collect(), key=lambda r: r.part)  # one row a task
    out, before = [], 0
    for r in rows:
        out.append((r.part, before))
        before += r.n
    return counts.sparkSession.createDataFrame(out, "part int, before long")


def number(df: DataFrame, name: str) -> DataFrame:
    """Prepends a row number in the order of the input: tasks number their own rows, from where the tasks before end."""
    d = checkpoint(df.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    before = _offsets(d.groupBy(F.col("__part").alias("part")).agg(F.count("*").alias("n")))
    local = F.col("__at") - F.shiftleft(F.col("__part").cast("long"), 33)
    d = d.join(F.broadcast(before), F.col("__part") == F.col("part"))
    return d.select((local + F.col("before") + 1).alias(name), *(F.col(f"`{c}`") for c in df.columns))


def rank(df: DataFrame, keys: list[Column], sort: list, name: str, dense: bool) -> DataFrame:
    """Prepends the rank by keys; rows with equal keys have one rank, and unless dense the next rank skips their number.

    The distinct keys are sorted over many tasks; each task adds up its own, from where the tasks before it end.
    sort makes the sort columns of the key columns' new names.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    d = df.withColumns(dict(zip(names, keys, strict=True)))
    distinct = d.groupBy(*names).agg(F.count("*").alias("n"))
    order = sort(names)
    ranged = checkpoint(distinct.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    weight = F.lit(1).cast("long") if dense else F.col("n")
    before = _offsets(ranged.groupBy("part").agg(F.sum(weight).alias("n")))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranged.withColumn("r", F.coalesce(F.sum(weight).over(inside), F.lit(0))).join(F.broadcast(before), "part")
    ranked = ranked.select(*(F.col(n).alias(n + "_") for n in names), (F.col("r") + F.col("before") + 1).cast("long").alias(name))
    match = F.lit(True)
    for n in names:
        match = match & F.col(n).eqNullSafe(F.col(n + "_"))
    return d.join(ranked, match).select(name, *(F.col(f"`{c}`") for c in df.columns))
