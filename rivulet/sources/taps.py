"""Sources. A tap is a function of a session, a path, its arguments and the declared schema that gives a DataFrame."""

from __future__ import annotations

import importlib.resources
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.errors import FlowError
from rivulet.functions import codec
from rivulet.functions.casts import cast

#: Rows of constants by key, for scripts that read them with ConstantTuples.
CONSTANTS: dict[str, list] = {}


def apply_schema(df: DataFrame, schema: T.StructType | None) -> DataFrame:
    """Casts the first fields to the schema and pads short rows with null; surplus fields are left out."""
    if schema is None:
        return df
    out = []
    for k, f in enumerate(schema):
        if k < len(df.columns):
            c = F.col(f"`{df.columns[k]}`")
            c = c if f.metadata.get("untyped") else cast(c, df.schema[k].dataType, f.dataType)
        else:
            c = F.lit(None).cast(f.dataType)
        out.append(c.alias(f.name, metadata=f.metadata or None) if f.metadata else c.alias(f.name))
    return df.select(*out)


def from_lines(lines: DataFrame, delimiter: str, schema: T.StructType | None, width: int | None = None) -> DataFrame:
    """Fields of lines (column value), cut at a regular expression; trailing empty fields count as missing."""
    d = lines.select(F.split("value", delimiter).alias("p"))
    last = F.coalesce(F.array_max(F.filter(F.transform("p", lambda x, i: F.when(x != "", i + 1)), lambda i: i.isNotNull())), F.lit(0))
    d = d.select(F.slice("p", F.lit(1), last).alias("p"))
    n = len(schema) if schema is not None else width
    if n is None:
        n = d.agg(F.max(F.size("p"))).first()[0] or 1
    d = d.select(*(F.get("p", F.lit(k)).alias(f"_{k}") for k in range(n)))
    return apply_schema(d, schema)


def text_tap(spark: SparkSession, path: str, args: list, schema: T.StructType | None, stream: bool) -> DataFrame:
    """Delimited UTF-8 lines without header or quotes; the delimiter is a regular expression, a tab by default."""
    delimiter = args[0] if args else "\t"
    if stream:
        if schema is None:
            raise FlowError("a stream of lines needs a schema", 1002)
        return from_lines(spark.readStream.text(path), delimiter, schema)
    return from_lines(spark.read.text(path), delimiter, schema)


def resource_tap(spark: SparkSession, path: str, args: list, schema: T.StructType | None, stream: bool) -> DataFrame:
    """Lines of a file inside an installed package: package/path."""
    package, _, name = path.partition("/")
    lines = (importlib.resources.files(package) / name).read_text("utf-8").splitlines()
    return from_lines(spark.createDataFrame([(x,) for x in lines], "value string"), args[0] if args else "\t", schema)


def constant_tap(spark: SparkSession, path: str, args: list, schema: T.StructType | None, stream: bool) -> DataFrame:
    """Rows registered under path in CONSTANTS: texts of tuples such as (1,a,{(2)},[k#v]), read by the schema."""
    rows = CONSTANTS.get(path)
    if rows is None:
        raise FlowError(f"no constants named {path}", 1003)
    if schema is None:
        parts = [codec._parts(r.strip()[1:-1]) or [] for r in rows]
        n = max(map(len, parts), default=1)
        return spark.createDataFrame([tuple(p + [None] * (n - len(p))) for p in parts], T.StructType([T.StructField(f"_{k}", T.StringType()) for k in range(n)]))
    values = [codec.parse(r, schema) for r in rows]
    return spark.createDataFrame([tuple(v[f.name] for f in schema) for v in values], schema)


def _file(form: str) -> Callable:
    def tap(spark: SparkSession, path: str, args: list, schema: T.StructType | None, stream: bool) -> DataFrame:
        if stream:
            reader = spark.readStream.format(form)
            return apply_schema(reader.schema(spark.read.format(form).load(path).schema).load(path), schema)
        return apply_schema(spark.read.format(form).load(path), schema)

    return tap


def csv_tap(spark: SparkSession, path: str, args: list, schema: T.StructType | None, stream: bool) -> DataFrame:
    """Quoted CSV; the first argument is the delimiter, the second 'header' if there is one."""
    reader = (spark.readStream if stream else spark.read).option("sep", args[0] if args else ",").option("header", str("header" in args[1:]).lower())
    if stream:
        if schema is None:
            raise FlowError("a stream of CSV needs a schema", 1002)
        reader = reader.schema(T.StructType([T.StructField(f.name, T.StringType()) for f in schema]))
    return apply_schema(reader.csv(path), schema)


def rate_tap(spark: SparkSession, path: str, args: list, schema: T.StructType | None, stream: bool) -> DataFrame:
    return spark.readStream.format("rate").option("rowsPerSecond", args[0] if args else 1).load()


def kafka_tap(spark: SparkSession, path: str, args: list, schema: T.StructType | None, stream: bool) -> DataFrame:
    """A topic's values as text; path is servers/topic. Needs Spark's Kafka connector on the class path."""
    servers, _, topic = path.rpartition("/")
    reader = (spark.readStream if stream else spark.read).format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    return from_lines(reader.load().select(F.col("value").cast("string").alias("value")), args[0] if args else "\t", schema or T.StructType().add("_0", "string"))


def jdbc_tap(spark: SparkSession, path: str, args: list, schema: T.StructType | None, stream: bool) -> DataFrame:
    """A table of a database; path is its address. Arguments: the table, and if several tasks are to read it a numeric column, its bounds and their number.

    Needs the database's driver on the class path.
    """
    if stream:
        raise FlowError("a database isn't a stream", 1002)
    reader = spark.read.format("jdbc").option("url", path).option("dbtable", args[0])
    for name, value in zip(("partitionColumn", "lowerBound", "upperBound", "numPartitions"), args[1:], strict=False):
        reader = reader.option(name, value)
    return apply_schema(reader.load(), schema)


TAPS: dict[str, Callable] = {
    "TextLines": text_tap, "PackageResource": resource_tap, "ConstantTuples": constant_tap, "CSV": csv_tap, "Rate": rate_tap, "Kafka": kafka_tap, "JDBC": jdbc_tap,
    "Parquet": _file("parquet"), "ORC": _file("orc"), "JSON": _file("json"),
}


def default_tap(path: str) -> str:
    name = Path(path.rstrip("/")).name.lower()
    for end, tap in ((".parquet", "Parquet"), (".orc", "ORC"), (".json", "JSON"), (".jsonl", "JSON"), (".csv", "CSV")):
        if name.endswith(end):
            return tap
    return "TextLines"


def read(spark: SparkSession, path: str, using: tuple[str, list] | None, schema: T.StructType | None, stream: bool, taps: dict[str, Callable]) -> DataFrame:
    name, args = using or (default_tap(path), [])
    tap = taps.get(name) or TAPS.get(name)
    if tap is None:
        raise FlowError(f"no tap named {name}", 1004)
    return tap(spark, path, args, schema, stream)
