"""The text form of nested values: tuple (a,b), bag {(a),(b)}, map [k#v,...]; null is empty."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CLOSE = {"(": ")", "{": "}", "[": "]"}


def _parts(text: str, sep: str = ",") -> list[str] | None:
    """Pieces between separators outside brackets; None if the brackets don't balance."""
    out, start, want = [], 0, []
    for i, c in enumerate(text):
        if c in _CLOSE:
            want.append(_CLOSE[c])
        elif c in ")}]":
            if not want or want.pop() != c:
                return None
        elif c == sep and not want:
            out.append(text[start:i])
            start = i + 1
    return None if want else [*out, text[start:]]


def _inside(text: str, left: str) -> str | None:
    text = text.strip()
    return text[1:-1] if len(text) > 1 and text[0] == left and text[-1] == _CLOSE[left] else None


def _atom(text: str, kind: T.DataType) -> object:
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, T.BinaryType):
        return text.encode()
    s = text.strip()
    if isinstance(kind, T.BooleanType):
        return {"true": True, "false": False}.get(s.lower())
    try:
        if isinstance(kind, (T.IntegerType, T.LongType)):
            bits = 31 if isinstance(kind, T.IntegerType) else 63
            s = s[:-1] if bits == 63 and s[-1:] in ("l", "L") else s
            try:
                n = int(s)
            except ValueError:
                n = int(float(s))
            return n if -(1 << bits) <= n < 1 << bits else None
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            return float(s[:-1] if s[-1:] in "fF" and isinstance(kind, T.FloatType) else s)
        if isinstance(kind, T.DecimalType):
            from decimal import Decimal

            return Decimal(s)
        if isinstance(kind, T.TimestampType):
            return pd.Timestamp(s).to_pydatetime()
    except (ValueError, OverflowError, ArithmeticError):
        return None
    return None


def parse(text: str | None, kind: T.DataType) -> object:
    """The value of a text; None for an empty text of another type than text, and for one that is malformed."""
    if text is None or (text == "" and not isinstance(kind, (T.StringType, T.BinaryType))):
        return None
    if isinstance(kind, T.StructType):
        inside = _inside(text, "(")
        parts = None if inside is None else _parts(inside) if inside or len(kind) else []
        if parts is None:
            return None
        parts += [None] * (len(kind) - len(parts))
        return {f.name: parse(p, f.dataType) for f, p in zip(kind, parts, strict=False)}
    if isinstance(kind, T.ArrayType):
        inside = _inside(text, "{")
        if inside is None:
            return None
        parts = _parts(inside) if inside.strip() else []
        if parts is None:
            return None
        rows = [parse(p, kind.elementType) for p in parts]
        return None if any(r is None for r in rows) else rows
    if isinstance(kind, T.MapType):
        inside = _inside(text, "[")
        if inside is None:
            return None
        out = {}
        for p in (_parts(inside) or []) if inside.strip() else []:
            key, mark, value = p.partition("#")
            if not mark or not key:
                return None
            out[key] = parse(value, kind.valueType)
        return out if _parts(inside) is not None else None
    return _atom(text, kind)


def render(value: object) -> str:
    """The text of a value, for sinks; every entry of a map is written, by key."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).decode("utf-8", "replace")
    if isinstance(value, dict):
        return "[" + ",".join(f"{k}#{render(v)}" for k, v in sorted(value.items())) + "]"
    if isinstance(value, tuple):
        return "(" + ",".join(map(render, value)) + ")"
    if isinstance(value, list):
        return "{" + ",".join(render(v) if isinstance(v, tuple) else f"({render(v)})" for v in value) + "}"
    if hasattr(value, "isoformat"):
        return value.isoformat(timespec="milliseconds") + ("" if value.tzinfo else "Z")
    return str(value)


def _void(value: object, kind: T.DataType) -> object:
    """A pandas-friendly value: a struct as a tuple, a map as a dict."""
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return {f.name: _void(value[f.name], f.dataType) for f in kind}
    if isinstance(kind, T.ArrayType):
        return [_void(v, kind.elementType) for v in value]
    return value


def from_text(column: Column, kind: T.DataType) -> Column:
    """Parses a text column into a tuple, bag or map (Arrow batches; atoms never come here)."""
    if isinstance(kind, T.StructType):  # a struct result would be a frame; one field more keeps nulls
        wrapped = T.ArrayType(kind)
        one = F.pandas_udf(lambda s: s.map(lambda t: None if (v := parse(t, kind)) is None else [_void(v, kind)]), wrapped)
        return F.get(one(column), F.lit(0))
    return F.pandas_udf(lambda s: s.map(lambda t: _void(parse(t, kind), kind)), kind)(column)


def to_text(column: Column, kind: T.DataType) -> Column:
    """The text of a value as an expression."""
    if isinstance(kind, T.StructType):
        inside = [F.coalesce(to_text(column.getField(f.name), f.dataType), F.lit("")) for f in kind]
        return F.when(column.isNotNull(), F.concat(F.lit("("), F.concat_ws(",", *inside), F.lit(")")))
    if isinstance(kind, T.ArrayType):
        item = kind.elementType
        one = lambda x: to_text(x, item) if isinstance(item, T.StructType) else F.concat(F.lit("("), F.coalesce(to_text(x, item), F.lit("")), F.lit(")"))
        return F.when(column.isNotNull(), F.concat(F.lit("{"), F.array_join(F.transform(column, one), ","), F.lit("}")))
    if isinstance(kind, T.MapType):
        one = lambda e: F.concat(e.key, F.lit("#"), F.coalesce(to_text(e.value, kind.valueType), F.lit("")))
        return F.when(column.isNotNull(), F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.map_entries(column)), one), ","), F.lit("]")))
    if isinstance(kind, T.BinaryType):
        return F.decode(column, "UTF-8")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return column.cast("string")
