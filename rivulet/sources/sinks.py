"""Sinks: files for STORE; dumpers for DUMP, which are set up, given rows and torn down once a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.errors import FlowError
from rivulet.functions import codec


class Dumper:
    """Override put, and set_up and tear_down where they matter."""

    def set_up(self, alias: str) -> None: ...

    def put(self, row: tuple) -> None:
        raise NotImplementedError

    def tear_down(self, alias: str) -> None: ...


class TextDumper(Dumper):
    """Prints each row as the text of a tuple."""

    def __init__(self, out: Callable[[str], None] = print):
        self.out = out

    def put(self, row: tuple) -> None:
        self.out(codec.render(row))


class ListDumper(Dumper):
    """Keeps rows in a list."""

    def __init__(self):
        self.rows: list[tuple] = []

    def put(self, row: tuple) -> None:
        self.rows.append(row)


DUMPERS: dict[str, Callable[..., Dumper]] = {"Text": TextDumper, "List": ListDumper}


def plain(value: object) -> object:
    """Rows as tuples, all the way down."""
    if isinstance(value, tuple):
        return tuple(map(plain, value))
    if isinstance(value, list):
        return [plain(v) for v in value]
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return value


def dump(alias: str, rows: Iterable, dumper: Dumper) -> None:
    """Rows are fetched a partition at a time where rows is a frame's toLocalIterator()."""
    dumper.set_up(alias)
    for r in rows:
        dumper.put(plain(r))
    dumper.tear_down(alias)


def default(path: str) -> str:
    """The form of files by the path's ending."""
    return {".parquet": "Parquet", ".orc": "ORC", ".json": "JSON", ".csv": "CSV"}.get(Path(path).suffix, "TextLines")


def _formed(df: DataFrame, path: str, using: tuple[str, list] | None) -> tuple[DataFrame, str, dict]:
    """The frame that is written, the format, and its options: Parquet, ORC, JSON, CSV, or lines of delimited text in the text form of values."""
    name, args = using or (default(path), [])
    if name == "TextLines":
        texts = [F.coalesce(codec.to_text(F.col(f"`{f.name}`"), f.dataType), F.lit("")) for f in df.schema]
        return df.select(F.concat_ws(args[0] if args else "\t", *texts).alias("value")), "text", {}
    if name not in ("Parquet", "ORC", "JSON", "CSV"):
        raise FlowError(f"no sink named {name}", 1005)
    return df, name.lower(), {"sep": args[0]} if name == "CSV" and args else {}


def store(df: DataFrame, path: str, using: tuple[str, list] | None) -> None:
    """Writes files in the place of those that are there."""
    rows, form, options = _formed(df, path, using)
    rows.write.mode("overwrite").options(**options).format(form).save(path)


def appending(df: DataFrame, path: str, using: tuple[str, list] | None):
    """A writer of a stream's rows, each batch behind those before it, once even if it is run again."""
    rows, form, options = _formed(df, path, using)
    return rows.writeStream.format(form).options(**options).option("path", path)
