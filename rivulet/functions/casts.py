"""The cast matrix. Built with ANSI mode off: bad text is null, numbers narrow as in Java."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.errors import FlowError
from rivulet.functions import codec

_TIME = (T.TimestampType, T.TimestampNTZType)
_COMPLEX = (T.StructType, T.ArrayType, T.MapType)


def _whole(text: Column, bits: int) -> Column:
    """Text to a whole number: digits as they are, else a decimal number cut at the point; null beyond the range."""
    digits = F.when(text.rlike(r"\A[+-]?\d{1,38}\z"), text.cast("decimal(38,0)"))
    low, high = -(1 << bits), (1 << bits) - 1
    name = "int" if bits == 31 else "bigint"
    number = text.cast("double")
    cut = F.when((number > float(low - 1) if bits == 31 else number >= float(low)) & (number < float(high + 1)), number.cast(name))
    return F.when(digits.isNotNull(), F.when((digits >= F.lit(str(low)).cast("decimal(38,0)")) & (digits <= F.lit(str(high)).cast("decimal(38,0)")), digits.cast(name))).otherwise(cut)


def cast(c: Column, source: T.DataType, target: T.DataType) -> Column:
    """c as the target type, by the rules of scripts."""
    if isinstance(target, T.MapType) and isinstance(source, T.MapType):
        return F.transform_values(c, lambda _, v: cast(v, source.valueType, target.valueType))
    if isinstance(target, T.StructType) and isinstance(source, T.StructType):
        if not len(target):
            return c
        if len(target) != len(source):
            raise FlowError(f"cannot cast a tuple of {len(source)} fields to one of {len(target)}", 1051)
        return F.when(c.isNotNull(), F.struct(*(cast(c.getField(a.name), a.dataType, b.dataType).alias(b.name) for a, b in zip(source, target, strict=True))))
    if isinstance(target, T.ArrayType) and isinstance(source, T.ArrayType):
        if isinstance(target.elementType, T.StructType) and not len(target.elementType):
            return c
        return F.transform(c, lambda x: cast(x, source.elementType, target.elementType))
    if isinstance(source, T.NullType) or source == target:
        return c.cast(target)
    text = F.decode(c, "UTF-8") if isinstance(source, T.BinaryType) else c if isinstance(source, T.StringType) else None
    if isinstance(target, _COMPLEX):
        if text is None:
            raise FlowError(f"cannot cast {source.simpleString()} to {target.simpleString()}", 1052)
        return codec.from_text(text, target)
    if isinstance(source, _COMPLEX):
        if isinstance(target, T.StringType):
            return codec.to_text(c, source)
        raise FlowError(f"cannot cast {source.simpleString()} to {target.simpleString()}", 1052)
    if isinstance(target, T.StringType):
        return codec.to_text(c, source)
    if isinstance(target, T.BinaryType):
        return F.encode(codec.to_text(c, source), "UTF-8")
    if text is not None:
        s = F.trim(text)
        if isinstance(target, T.BooleanType):
            return F.when(F.lower(s) == "true", True).when(F.lower(s) == "false", False)
        if isinstance(target, T.IntegerType):
            return _whole(s, 31)
        if isinstance(target, T.LongType):
            return _whole(F.regexp_replace(s, "[lL]$", ""), 63)
        if isinstance(target, T.FloatType):
            return F.regexp_replace(s, "[fF]$", "").cast("float")
        if isinstance(target, T.TimestampType):
            return F.try_to_timestamp(s)
        return s.cast(target)
    if isinstance(source, T.BooleanType):
        if isinstance(target, _TIME):
            raise FlowError("cannot cast boolean to datetime", 1052)
        return c.cast("int").cast(target)
    if isinstance(target, T.BooleanType):
        if isinstance(source, _TIME):
            raise FlowError("cannot cast datetime to boolean", 1052)
        return c != 0
    if isinstance(source, _TIME):
        return F.unix_millis(c.cast("timestamp")).cast(target) if not isinstance(target, _TIME) else c.cast(target)
    if isinstance(target, _TIME):
        return F.timestamp_millis(c.cast("bigint"))
    return c.cast(target)
