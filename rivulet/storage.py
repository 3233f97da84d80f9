"""Cutting lineage through the shared folder, and settings that hold while a plan is built."""

from __future__ import annotations

import tempfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from rivulet.errors import FlowError

#: Scripts wrap around on overflow and give null for bad casts and division by zero; names tell cases apart.
SETTINGS = {"spark.sql.ansi.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.caseSensitive": "true", "spark.sql.legacy.sizeOfNull": "false"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str] | None = None):
    """Sets what plans are built under and restores it; Spark keeps the settings that a plan was built with."""
    values = SETTINGS if values is None else values
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset a local master gets a temporary folder; on a cluster that is an error, as no other machine sees one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise FlowError("spark.checkpoint.dir must name a folder that driver and executors share", 1012)
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="rivulet-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared folder and reads them from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
