"""Expressions to columns, within a scope that says what names mean."""

from __future__ import annotations

import copy
import json
import re
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.errors import FlowError
from rivulet.functions.builtins import AGGREGATES, SCALARS, Aggregate, _wide, duration
from rivulet.functions.casts import cast
from rivulet.plans.ast import Call, Cast, Const, Deref, Lookup, Make, Name, Node, Op, Order, Over, Range, Star
from rivulet.types import ATOMS, INTEGRAL, parse_type

_TEXT = (T.StringType, T.BinaryType)


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@lru_cache(512)
def _empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], T.StructType.fromJson(json.loads(schema)))


class Scope:
    """Fields by name or place; get gives a field's column. functions: those a session defines, by name."""

    def __init__(self, spark: SparkSession, schema: T.StructType, get: Callable[[str], Column] = col, functions: dict | None = None, outer: Scope | None = None):
        self.spark, self.schema, self.get, self.functions, self.outer = spark, schema, get, functions or {}, outer
        self.extra: dict[str, tuple[Column, T.DataType]] = {}

    def find(self, name: str | int) -> T.StructField | None:
        if isinstance(name, int):
            return self.schema.fields[name] if name < len(self.schema) else None
        exact = [f for f in self.schema if f.name == name]
        if exact:
            return exact[0]
        tail = [f for f in self.schema if f.name.endswith("::" + name)]
        if len(tail) > 1:
            raise FlowError(f"{name} could be any of {', '.join(f.name for f in tail)}", 1025)
        return tail[0] if tail else None

    def named(self, node: Name) -> tuple[Column, T.DataType]:
        if node.name in self.extra:
            return self.extra[node.name]
        f = self.find(node.name)
        if f is not None:
            return self.get(f.name), f.dataType
        if isinstance(node.name, int):
            return F.lit(None), T.NullType()  # a field beyond the last is null
        if self.outer is not None:
            return self.outer.named(node)
        raise FlowError(f"no field {node.name} among {', '.join(self.schema.names)}", 1025, node.line, node.column)

    def type(self, node: Node) -> T.DataType:
        """The type of an expression, as Spark's analyzer sees it on an empty frame."""
        if isinstance(node, Name):
            return self.named(node)[1]
        if isinstance(node, Const) and node.kind in ATOMS:
            return ATOMS[node.kind]
        return self.plain()._analyzed(node)

    def plain(self) -> Scope:
        """This scope over a frame's own columns, with outer fields and extra names as further columns."""
        schema, extra = list(self.schema.fields), {}
        scope: Scope | None = self
        while scope is not None:
            if scope is not self:
                schema += [f for f in scope.schema if f.name not in {x.name for x in schema}]
            for k, (_, t) in scope.extra.items():
                if k not in extra and k not in {x.name for x in schema}:
                    schema.append(T.StructField(k, t))
                elif k in {x.name for x in schema} and scope is self:
                    schema = [x for x in schema if x.name != k] + [T.StructField(k, t)]
            scope = scope.outer
        return Scope(self.spark, T.StructType(schema), col, self.functions)

    def _analyzed(self, node: Node) -> T.DataType:
        frame = _empty(self.spark, self.schema.json())
        return frame.select(compile(node, self).alias("x")).schema[0].dataType


def element_scope(scope: Scope, kind: T.DataType, x: Column) -> Scope:
    """The scope of one tuple of a bag."""
    fields = kind if isinstance(kind, T.StructType) else T.StructType().add("_0", kind)
    get = (lambda f: x.getField(f)) if isinstance(kind, T.StructType) else lambda f: x
    return Scope(scope.spark, fields, get, scope.functions, scope)


def _number(node: Node, scope: Scope) -> tuple[Column, T.DataType]:
    c, t = compile(node, scope), scope.type(node)
    if isinstance(t, _TEXT):  # an untyped field in arithmetic is a double
        return cast(c, t, T.DoubleType()), T.DoubleType()
    return c, t


def _arithmetic(node: Op, scope: Scope) -> Column:
    (a, s), (b, t) = (_number(x, scope) for x in node.args)
    whole = isinstance(s, INTEGRAL) and isinstance(t, INTEGRAL)
    if node.op == "/":
        if whole:
            wide = "bigint" if isinstance(s, T.LongType) or isinstance(t, T.LongType) else "int"
            return F.when(b != 0, F.call_function("div", a, b)).cast(wide)
        return F.when(b != 0, a / b)
    if node.op == "%":
        return F.when(b != 0, F.pmod(a, b) if isinstance(s, T.DecimalType) else a % b)
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b}[node.op]()


def _alike(node: Op, scope: Scope) -> tuple[Column, Column]:
    """Both sides of a comparison as columns that Spark can compare."""
    (a, s), (b, t) = ((compile(x, scope), scope.type(x)) for x in node.args)
    if isinstance(s, T.MapType) and isinstance(t, T.MapType):
        return F.array_sort(F.map_entries(a)), F.array_sort(F.map_entries(b))
    numeric = lambda k: isinstance(k, T.NumericType)
    if isinstance(s, _TEXT) and numeric(t):
        a = cast(a, s, T.DoubleType())
    if isinstance(t, _TEXT) and numeric(s):
        b = cast(b, t, T.DoubleType())
    return a, b


def _condition(c: Column, yes: Column, no: Column) -> Column:
    """Null where the condition is null."""
    return F.when(c, yes).when(~c, no)


def _make(node: Make, scope: Scope) -> Column:
    if node.kind == "map":
        parts = [x for k, v in node.items for x in (compile(k, scope).cast("string"), compile(v, scope))]
        return F.create_map(*parts)
    items = [compile(x, scope) for x in node.items]
    if node.kind == "tuple":
        return F.struct(*(c.alias(f"_{i}") for i, c in enumerate(items)))
    return F.array(*(c if isinstance(scope.type(x), T.StructType) else F.struct(c.alias("_0")) for c, x in zip(items, node.items, strict=True)))


def first_field(bag: Column, kind: T.DataType) -> tuple[Column, T.DataType]:
    """An array of the first field of each tuple of a bag."""
    item = kind.elementType
    if not isinstance(item, T.StructType):
        return bag, item
    return F.transform(bag, lambda x: x.getField(item[0].name)), item[0].dataType


def _aggregate(node: Call, scope: Scope) -> Column:
    agg = AGGREGATES[node.name.upper()]
    bag, kind = compile(node.args[0], scope), scope.type(node.args[0])
    if not isinstance(kind, T.ArrayType):
        raise FlowError(f"{node.name} takes a bag", 1045, node.line, node.column)
    if node.name.upper() == "COUNT_STAR":
        return agg.bag(bag, kind)
    values, t = first_field(bag, kind)
    return agg.bag(values, t)


def order_key(c: Column, kind: T.DataType) -> Column:
    return F.array_sort(F.map_entries(c)) if isinstance(kind, T.MapType) else c


def sort_bag(bag: Column, kind: T.ArrayType, keys: list[tuple[Callable[[Column], Column], bool]]) -> Column:
    """A bag ordered by keys (a function of a tuple, and whether it descends); null is the smallest."""

    def compare(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for key, down in reversed(keys):
            x, y = key(a), key(b)
            less, more = (1, -1) if down else (-1, 1)
            out = F.when(x.isNull() & y.isNull(), out).when(x.isNull(), less).when(y.isNull(), more).when(x < y, less).when(x > y, more).otherwise(out)
        return out

    return F.array_sort(bag, compare)


def _top(node: Call, scope: Scope) -> Column:
    n, place, bag = node.args
    kind = scope.type(bag)
    field = kind.elementType[int(place.value)].name
    return F.slice(sort_bag(compile(bag, scope), kind, [(lambda x: x.getField(field), True)]), F.lit(1), compile(n, scope).cast("int"))


def _call(node: Call, scope: Scope) -> Column:
    name = node.name
    if isinstance(scope.functions.get(name), Aggregate):
        bag, kind = compile(node.args[0], scope), scope.type(node.args[0])
        return scope.functions[name].bag(*first_field(bag, kind))
    if name in scope.functions:
        return scope.functions[name](*(compile(a, scope) for a in node.args))
    upper = name.upper()
    if upper in AGGREGATES:
        return _aggregate(node, scope)
    if upper == "TOP":
        return _top(node, scope)
    if name in ("COR", "COV"):
        raise FlowError(f"{name} needs a group, not a bag that was built before", 1053, node.line, node.column)
    if name in ("AddDuration", "SubtractDuration"):
        at, by = compile(node.args[0], scope).cast("timestamp"), duration(node.args[1].value)
        return at + by if name == "AddDuration" else at - by
    if name == "REGEX_EXTRACT_ALL":
        groups = re.compile(node.args[1].value).groups
        whole = F.concat(F.lit(r"\A(?:"), compile(node.args[1], scope), F.lit(r")\z"))
        s = compile(node.args[0], scope)
        return F.when(F.rlike(s, whole), F.struct(*(F.call_function("regexp_extract", s, whole, F.lit(i + 1)).alias(f"_{i}") for i in range(groups))))
    known = SCALARS.get(name) or next((f for k, f in SCALARS.items() if k.upper() == upper), None)
    if known is None:
        raise FlowError(f"no function {name}", 1070, node.line, node.column)
    args = expand(node.args, scope)
    return known([compile(a, scope) for a in args], [scope.type(a) for a in args])


def expand(nodes: list[Node], scope: Scope) -> list[Node]:
    """* and ranges as the fields they stand for."""
    out: list[Node] = []
    for n in nodes:
        if isinstance(n, Star):
            out += [Name(x) for x in scope.schema.names]
        elif isinstance(n, Range):
            names = scope.schema.names
            at = lambda x: x.name if isinstance(x.name, int) else names.index(scope.find(x.name).name)
            out += [Name(x) for x in names[at(n.first) if n.first else 0 : (at(n.last) if n.last else len(names) - 1) + 1]]
        else:
            out.append(n)
    return out


def _deref(node: Deref, scope: Scope) -> Column:
    base, kind = compile(node.of, scope), scope.type(node.of)
    inner = kind.elementType if isinstance(kind, T.ArrayType) else kind
    if not isinstance(inner, T.StructType):
        raise FlowError(f"{inner.simpleString()} has no fields", 1026, node.line, node.column)
    names = []
    for f in node.fields:
        found = Scope(scope.spark, inner).find(f.name)
        if found is None:
            raise FlowError(f"no field {f.name} among {', '.join(inner.names)}", 1025, f.line, f.column)
        names.append(found.name)
    if isinstance(kind, T.ArrayType):
        return F.transform(base, lambda x: F.struct(*(x.getField(n).alias(n) for n in names)))
    return base.getField(names[0]) if node.single else F.struct(*(base.getField(n).alias(n) for n in names))


#: Functions of rows in their order, besides the aggregates.
_ORDERED = {
    "ROW_NUMBER": F.row_number, "RANK": F.rank, "DENSE_RANK": F.dense_rank, "PERCENT_RANK": F.percent_rank, "CUME_DIST": F.cume_dist, "NTILE": F.ntile,
    "LAG": F.lag, "LEAD": F.lead, "FIRST_VALUE": F.first, "LAST_VALUE": F.last,
}


def _over(node: Over, scope: Scope) -> Column:
    """A window of rows. Without keys all rows are one task's, as SQL has it."""
    name, args = node.call.name.upper(), node.call.args
    over = Window.partitionBy(*(compile(k, scope) for k in node.keys)).orderBy(*sort_columns(node.orders, scope))
    if node.rows:
        low, high = node.rows
        over = over.rowsBetween(Window.unboundedPreceding if low is None else -low, Window.unboundedFollowing if high is None else high)
    if name in _ORDERED:
        values = [a.value if isinstance(a, Const) else compile(a, scope) for a in args]
        c = _ORDERED[name](*values).over(over)
        return c.cast("long") if name in ("ROW_NUMBER", "RANK", "DENSE_RANK") else c
    if name == "COUNT_STAR":
        return F.count(F.lit(1)).over(over)
    if name not in AGGREGATES or len(args) != 1:
        raise FlowError(f"{node.call.name} isn't a function of a window of rows", 1070, node.line, node.column)
    value, kind = compile(args[0], scope), scope.type(args[0])
    return (F.sum(value).over(over).cast(_wide(kind)) if name == "SUM" else AGGREGATES[name].grouped(value, kind).over(over))


def compile(node: Node, scope: Scope) -> Column:  # noqa: A001
    """The column of an expression."""
    if isinstance(node, Const):
        if node.kind == "null":
            return F.lit(None)
        return F.lit(node.value).cast(ATOMS[node.kind]) if node.kind in ATOMS else F.lit(node.value)
    if isinstance(node, Name):
        return scope.named(node)[0]
    if isinstance(node, Star):
        return F.struct(*(scope.get(n).alias(n) for n in scope.schema.names))
    if isinstance(node, Deref):
        return _deref(node, scope)
    if isinstance(node, Lookup):
        return F.try_element_at(compile(node.of, scope), F.lit(node.key))
    if isinstance(node, Cast):
        return cast(compile(node.of, scope), scope.type(node.of), parse_type(node.kind))
    if isinstance(node, Call):
        return _call(node, scope)
    if isinstance(node, Make):
        return _make(node, scope)
    if isinstance(node, Over):
        return _over(node, scope)
    if isinstance(node, Op):
        op, args = node.op, node.args
        if op in ("+", "-", "*", "/", "%"):
            return _arithmetic(node, scope)
        if op == "neg":
            return -_number(args[0], scope)[0]
        if op in ("==", "!=", "<", "<=", ">", ">="):
            a, b = _alike(node, scope)
            return {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
        if op in ("and", "or"):
            a, b = compile(args[0], scope), compile(args[1], scope)
            return a & b if op == "and" else a | b
        if op == "not":
            return ~compile(args[0], scope)
        if op in ("isnull", "notnull"):
            c = compile(args[0], scope)
            return c.isNull() if op == "isnull" else c.isNotNull()
        if op == "matches":
            return F.rlike(compile(args[0], scope), F.concat(F.lit(r"\A(?:"), compile(args[1], scope), F.lit(r")\z")))
        if op == "in":
            hits = [compile(Op("==", [args[0], a]), scope) for a in args[1:]]
            out = hits[0]
            for h in hits[1:]:
                out = out | h
            return out
        if op == "cond":
            yes, no = scope.type(args[1]), scope.type(args[2])
            c, a, b = (compile(x, scope) for x in args)
            if yes != no and isinstance(yes, (T.ArrayType, T.StructType)) and isinstance(no, type(yes)):  # tuples whose fields are named otherwise
                a = a.cast(no)
            return _condition(c, a, b)
        if op == "case":
            out = compile(args[-1], scope) if len(args) % 2 else F.lit(None)
            for k in range(len(args) // 2 - 1, -1, -1):
                out = _condition(compile(args[2 * k], scope), compile(args[2 * k + 1], scope), out)
            return out
    raise FlowError(f"cannot use {type(node).__name__} here", 1000, node.line, node.column)


def walk(node: object):
    """All nodes of an expression, itself first."""
    if isinstance(node, Node):
        yield node
        for v in vars(node).values():
            yield from walk(v)
    elif isinstance(node, (list, tuple, dict)):
        for v in node.values() if isinstance(node, dict) else node:
            yield from walk(v)


def rewrite(node: object, change: Callable[[Node], Node | None]) -> object:
    """The same expression with the nodes that change() gives something for in the place of the old ones."""
    if isinstance(node, Node):
        new = change(node)
        if new is not None:
            return new
        out = copy.copy(node)
        for k, v in vars(node).items():
            setattr(out, k, rewrite(v, change))
        return out
    if isinstance(node, dict):
        return {k: rewrite(v, change) for k, v in node.items()}
    return type(node)(rewrite(v, change) for v in node) if isinstance(node, (list, tuple)) else node


def sort_columns(orders: list[Order], scope: Scope) -> list[Column]:
    """Sort keys: null is the smallest, so first upwards and last downwards."""
    out = []
    for o in orders:
        for e in expand([o.expr], scope):
            c = order_key(compile(e, scope), scope.type(e))
            out.append(c.desc_nulls_last() if o.descending else c.asc_nulls_first())
    return out
