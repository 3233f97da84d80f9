"""Helpers that the operators share: tables, the shared folder, Arrow text access, sorted groups, components."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local master gets a temporary one; on a cluster that is an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="rivulet-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage: the rows are written once to the shared folder and read from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder that this library has written, by whatever file system its path names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def free(name: str, taken: list[str]) -> str:
    """A column's name that isn't taken: name, or name with as many underscores behind it as that needs."""
    while name in taken:
        name += "_"
    return name


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns of a row that have one (maps don't), to order rows by that are equal in what counts."""
    return F.xxhash64(*(F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def utf8_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column without a copy of each text; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def pieces_of(batches: Iterator[pa.RecordBatch], column: str, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The rows of batches, as few at a time that the texts of column have size bytes in sum, about, or are one text."""
    for b in batches:
        lengths = pa.compute.fill_null(pa.compute.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(lengths) // size
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if j > i:
                yield b.slice(i, j - i)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, at_least: int = 1) -> Iterator[pa.Table]:
    """Tables of whole key groups from batches that are sorted by key; each has at_least rows, but for the last."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < at_least:
            continue
        keys = np.concatenate([b.column(key).to_numpy(zero_copy_only=False) for b in held])
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if not len(cuts):
            continue
        whole = pa.Table.from_batches(held)
        yield whole.slice(0, int(cuts[-1]))
        held, rows = whole.slice(int(cuts[-1])).to_batches(), rows - int(cuts[-1])
    if held:
        yield pa.Table.from_batches(held)


def local_roots(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """For nodes 0..n-1 and links a-b the smallest node that each reaches; label carries an earlier answer on."""
    label = np.arange(n) if label is None else label
    while len(a):
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            break
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        np.minimum.at(label, high, low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
    return label


def components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from each node that has a link, by alternating large-star and small-star steps.

    edges: two long columns a and b, in any order, repeated or not; loops and nulls are ignored. Returns node and
    root, one row for each node in a link. Every step is a grouped minimum and a join; nothing is collected but a
    count and a checksum of the links, which show when they no longer change. The steps end for every graph, after a
    number of them that grows with the logarithm of its size.
    """
    e = checkpoint(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while (mark := tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())) != seen and mark[0]:
        seen = mark
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpoint(star.unionByName(least.withColumnRenamed("m", "v")).distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
