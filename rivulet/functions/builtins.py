"""The function library: scalar functions of columns, and aggregates in two forms.

A scalar gets columns and their types and returns a column. An aggregate has a grouped form, over the rows of a
group, and a bag form, over an array of tuples; the planner takes the first wherever it can, so that bags are never
built.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.errors import FlowError
from rivulet.functions.codec import to_text
from rivulet.types import INTEGRAL

SCALARS: dict[str, Callable[[list[Column], list[T.DataType]], Column]] = {}


@dataclass
class Aggregate:
    """grouped(values, first field, types) over rows; bag(array, field or None, element type)."""

    grouped: Callable[[Column, T.DataType], Column]
    bag: Callable[[Column, T.DataType], Column]
    whole: bool = False  # counts tuples: its argument may be the bag itself


def scalar(*names: str):
    def add(f):
        for n in names:
            SCALARS[n] = f
        return f

    return add


def _plain(**functions) -> None:
    for name, f in functions.items():
        SCALARS[name] = lambda a, t, f=f: f(*a)


def _wide(t: T.DataType) -> str:
    return "bigint" if isinstance(t, INTEGRAL) else t.simpleString() if isinstance(t, T.DecimalType) else "double"


def _sum(c: Column, t: T.DataType) -> Column:
    zero = F.lit(0).cast(_wide(t))
    kept = F.filter(c, lambda x: x.isNotNull())
    return F.when(F.size(kept) > 0, F.aggregate(kept, zero, lambda a, x: (a + x.cast(_wide(t))).cast(_wide(t))))


def _avg(c: Column, t: T.DataType) -> Column:
    kept = F.filter(c, lambda x: x.isNotNull())
    return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(kept))


AGGREGATES: dict[str, Aggregate] = {
    "COUNT": Aggregate(lambda c, t: F.count(c), lambda c, t: F.size(F.filter(c, lambda x: x.isNotNull())).cast("long"), True),
    "COUNT_STAR": Aggregate(lambda c, t: F.count(F.lit(1)), lambda c, t: F.size(c).cast("long"), True),
    "SUM": Aggregate(lambda c, t: F.sum(c.cast(_wide(t))).cast(_wide(t)), _sum),
    "AVG": Aggregate(lambda c, t: F.avg(c.cast("double")), _avg),
    "MIN": Aggregate(lambda c, t: F.min(c), lambda c, t: F.array_min(c)),
    "MAX": Aggregate(lambda c, t: F.max(c), lambda c, t: F.array_max(c)),
    "STDDEV": Aggregate(lambda c, t: F.stddev_samp(c.cast("double")), lambda c, t: _unfused("STDDEV")),
    "APPROX_COUNT_DISTINCT": Aggregate(lambda c, t: F.approx_count_distinct(c), lambda c, t: F.size(F.array_distinct(F.filter(c, lambda x: x.isNotNull()))).cast("long")),
}


def _unfused(name: str):
    raise FlowError(f"{name} needs a group, not a bag that was built before", 1053)


# ---- text

_plain(
    LOWER=F.lower, UPPER=F.upper, TRIM=F.trim, LTRIM=F.ltrim, RTRIM=F.rtrim, REVERSE=F.reverse,
    REPLACE=lambda s, a, b: F.regexp_replace(s, a, b),
    STARTSWITH=F.startswith, ENDSWITH=F.endswith, EqualsIgnoreCase=lambda a, b: F.lower(a) == F.lower(b),
    LCFIRST=lambda s: F.concat(F.lower(F.substring(s, 1, 1)), F.substr(s, F.lit(2))),
    UCFIRST=lambda s: F.concat(F.upper(F.substring(s, 1, 1)), F.substr(s, F.lit(2))),
    SUBSTRING=lambda s, i, j: F.substr(s, i.cast("int") + 1, F.greatest((j - i).cast("int"), F.lit(0))),
    LAST_INDEX_OF=lambda s, t: F.when(F.contains(s, t), F.length(s) - F.length(t) - F.position(F.reverse(t), F.reverse(s)) + 1).when(s.isNotNull() & t.isNotNull(), -1),
    GET_JSON=lambda s, p: F.call_function("get_json_object", s, p),
)


@scalar("CONCAT")
def _concat(a, t):
    if all(isinstance(x, T.ArrayType) for x in t):
        return F.concat(*a)
    return F.concat(*(to_text(c, k) for c, k in zip(a, t, strict=True)))


@scalar("INDEXOF")
def _indexof(a, t):
    return F.position(a[1], a[0], a[2].cast("int") + 1 if len(a) > 2 else F.lit(1)) - 1


@scalar("REGEX_EXTRACT")
def _regex_extract(a, t):
    return F.when(F.rlike(a[0], a[1]), F.call_function("regexp_extract", a[0], a[1], a[2].cast("int")))


@scalar("STRSPLIT")
def _strsplit(a, t):
    return F.call_function("split", a[0], a[1] if len(a) > 1 else F.lit(r"\s+"), a[2].cast("int") if len(a) > 2 else F.lit(-1))


@scalar("TOKENIZE")
def _tokenize(a, t):
    cut = F.concat(F.lit("["), F.regexp_replace(a[1], r"([\[\]\\^-])", r"\\$1"), F.lit("]+")) if len(a) > 1 else F.lit('[ ",()*]+')
    return F.transform(F.filter(F.call_function("split", a[0], cut, F.lit(-1)), lambda x: x != ""), lambda x: F.struct(x.alias("token")))


@scalar("SIZE")
def _size(a, t):
    if isinstance(t[0], (T.ArrayType, T.MapType)):
        return F.when(a[0].isNotNull(), F.size(a[0]).cast("long"))
    if isinstance(t[0], T.StructType):
        return F.when(a[0].isNotNull(), F.lit(len(t[0])).cast("long"))
    if isinstance(t[0], (T.StringType, T.BinaryType)):
        return F.length(a[0]).cast("long")
    return F.when(a[0].isNotNull(), F.lit(1).cast("long"))


@scalar("IsEmpty")
def _is_empty(a, t):
    return F.size(a[0]) == 0


# ---- numbers

_plain(
    SQRT=F.sqrt, CBRT=F.cbrt, EXP=F.exp, SIN=F.sin, COS=F.cos, TAN=F.tan, ASIN=F.asin, ACOS=F.acos, ATAN=F.atan,
    SINH=F.sinh, COSH=F.cosh, TANH=F.tanh, ABS=F.abs, RANDOM=lambda: F.rand(),
    CEIL=lambda x: F.ceil(x).cast("double"), FLOOR=lambda x: F.floor(x).cast("double"),
    ROUND_TO=lambda x, n: F.bround(x, n),
)


def _log(f):
    def log(a, t):
        x = a[0].cast("double")
        return F.when(x > 0, f(x)).when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).when(F.isnan(x), x)

    return log


SCALARS["LOG"], SCALARS["LOG10"] = _log(F.ln), _log(F.log10)


@scalar("ROUND")
def _round(a, t):
    return F.floor(a[0] + 0.5).cast("int" if isinstance(t[0], T.FloatType) else "bigint")


# ---- dates (UTC)

_UNITS = {"Seconds": 1000, "Minutes": 60_000, "Hours": 3_600_000, "Days": 86_400_000, "Weeks": 604_800_000, "MilliSeconds": 1}


def _ms(c: Column) -> Column:
    return F.unix_millis(c.cast("timestamp"))


for _name, _size_ms in _UNITS.items():
    SCALARS[f"{_name}Between"] = lambda a, t, n=_size_ms: F.call_function("div", _ms(a[0]) - _ms(a[1]), F.lit(n).cast("bigint"))


def _months(a) -> Column:
    x, y = a[0].cast("timestamp"), a[1].cast("timestamp")
    whole = (F.year(x) - F.year(y)) * 12 + F.month(x) - F.month(y)
    moved = F.add_months(y.cast("date"), whole).cast("timestamp").cast("bigint") * 1000 + _ms(y) % 86_400_000
    return (whole - F.when((whole > 0) & (moved > _ms(x)), 1).when((whole < 0) & (moved < _ms(x)), -1).otherwise(0)).cast("bigint")


SCALARS["MonthsBetween"] = lambda a, t: _months(a)
SCALARS["YearsBetween"] = lambda a, t: F.call_function("div", _months(a), F.lit(12).cast("bigint"))
_plain(
    CurrentTime=lambda: F.current_timestamp(), GetYear=F.year, GetMonth=F.month, GetDay=F.dayofmonth, GetHour=F.hour, GetMinute=F.minute,
    GetSecond=F.second, GetMilliSecond=lambda x: (_ms(x) % 1000).cast("int"), GetWeek=F.weekofyear,
    GetWeekYear=lambda x: F.extract(F.lit("YEAROFWEEK"), x), ToMilliSeconds=_ms, ToUnixTime=lambda x: F.unix_seconds(x.cast("timestamp")),
)


@scalar("ToDate")
def _to_date(a, t):
    if isinstance(t[0], T.StringType):
        return F.try_to_timestamp(*a[:2])
    return F.timestamp_millis(a[0].cast("bigint"))


@scalar("ToString")
def _to_string(a, t):
    return F.call_function("date_format", a[0], a[1]) if len(a) > 1 else to_text(a[0], t[0])


def duration(text: str) -> Column:
    """An interval of an ISO-8601 duration such as P1DT2H."""
    m = re.fullmatch(r"P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?", text)
    if not m or text in ("P", "PT"):
        raise FlowError(f"bad duration {text!r}", 1054)
    y, mo, w, d, h, mi, s = (x or "0" for x in m.groups())
    return F.make_interval(*(F.lit(int(x)) for x in (y, mo, w, d, h, mi)), F.lit(float(s)))


# ---- constructors, maps, bags


@scalar("TOTUPLE")
def _totuple(a, t):
    return F.struct(*(c.alias(f"_{i}") for i, c in enumerate(a)))


@scalar("TOBAG")
def _tobag(a, t):
    return F.array(*(c if isinstance(k, T.StructType) else F.struct(c.alias("_0")) for c, k in zip(a, t, strict=True)))


@scalar("TOMAP")
def _tomap(a, t):
    return F.create_map(*(c.cast("string") if not i % 2 else c for i, c in enumerate(a)))


_plain(
    KEYSET=lambda m: F.transform(F.map_keys(m), lambda x: F.struct(x.alias("key"))),
    VALUELIST=lambda m: F.transform(F.map_values(m), lambda x: F.struct(x.alias("value"))),
    VALUESET=lambda m: F.transform(F.array_distinct(F.map_values(m)), lambda x: F.struct(x.alias("value"))),
)


@scalar("SUBTRACT")
def _subtract(a, t):
    return F.array_except(a[0], a[1].cast(t[0]))


@scalar("DIFF")
def _diff(a, t):
    other = a[1].cast(t[0])
    return F.concat(F.array_except(a[0], other), F.array_except(other, a[0]))


@scalar("INVERSEMAP")
def _inverse(a, t):
    values = F.array_distinct(F.map_values(a[0]))
    keys = lambda v: F.transform(F.filter(F.map_entries(a[0]), lambda e: e.value == v), lambda e: F.struct(e.key.alias("key")))
    return F.map_from_arrays(F.transform(values, lambda v: v.cast("string")), F.transform(values, keys))


@scalar("BagToString")
def _bag_to_string(a, t):
    fields = t[0].elementType.fields
    texts = F.flatten(F.transform(a[0], lambda x: F.array(*(to_text(x.getField(f.name), f.dataType) for f in fields))))
    return F.call_function("array_join", texts, a[1] if len(a) > 1 else F.lit("_"))


@scalar("BagToTuple")
def _bag_to_tuple(a, t):
    return F.flatten(F.transform(a[0], lambda x: F.array(*(x.getField(f.name) for f in t[0].elementType.fields))))
