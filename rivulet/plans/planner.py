"""Steps to DataFrames. Relations are built on demand, so a script may define more than it uses."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.errors import FlowError
from rivulet.functions.builtins import AGGREGATES, Aggregate
from rivulet.functions.casts import cast
from rivulet.operators import groups, joins, ordering, ranks, sets
from rivulet.plans.ast import Call, Cast, Const, Deref, Item, Make, Name, Node, Op, Step
from rivulet.plans.expressions import Scope, _empty, col, compile, element_scope, expand, order_key, rewrite, sort_bag, sort_columns, walk
from rivulet.sources import taps
from rivulet.streaming import keyed
from rivulet.streaming.keyed import Stateful
from rivulet.streaming.windows import windowed
from rivulet.types import parse_schema


@dataclass
class Grouped:
    """A GROUP, COGROUP or CUBE before its bags are built: inputs as (alias, frame, keys, inner).

    how is cube or rollup for those. having holds conditions on the bags, each with the filter that it is of built bags.
    """

    inputs: list[tuple[str, DataFrame, list[tuple[str, Column]], bool]]
    all: bool = False
    how: str | None = None
    having: list[tuple[Node, Callable[[DataFrame], DataFrame]]] = field(default_factory=list)
    parallel: int | None = None

    @property
    def compound(self) -> bool:
        return len(self.inputs[0][2]) > 1

    def key(self, k: int) -> Column:
        keys = self.inputs[k][2]
        if self.all:
            return F.lit("all")
        return F.struct(*(c.alias(n) for n, c in keys)) if len(keys) > 1 else keys[0][1]


@dataclass
class Relation:
    frame: DataFrame | None
    grouped: Grouped | None = None

    @property
    def lazy(self) -> bool:
        """Whether it is a group whose bags nothing has asked for."""
        return self.frame is None

    @property
    def df(self) -> DataFrame:
        if self.frame is None:
            g = self.grouped
            if g.how:
                alias, df, keys, _ = g.inputs[0]
                made = groups.cubed(df, keys, g.how, alias)
            elif len(g.inputs) == 1:
                alias, df, _, _ = g.inputs[0]
                made = groups.bags(df, g.key(0), alias)
            else:
                made = groups.cogroup([(df, g.key(k), alias, inner) for k, (alias, df, _, inner) in enumerate(g.inputs)], g.compound)
            for _, keep in g.having:
                made = keep(made)
            self.frame = _tasks(made, g.parallel)
        return self.frame


def _tasks(df: DataFrame, n: int | None) -> DataFrame:
    """What a grouped or joined frame is with PARALLEL n: its shuffle's partitions in n tasks, or dealt anew where they are fewer than n."""
    if not n or df.isStreaming:
        return df
    return df.coalesce(n) if n <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(n)


class _NotFused(Exception):
    pass


@dataclass
class _Values:
    """What an aggregate's argument holds for each row: value and type of the tuples' first field, and which rows count.

    whole: the columns of the tuples, where they have others than the first. distinct: whether equal tuples count once.
    """

    value: Column
    kind: T.DataType
    when: Column | None = None
    distinct: bool = False
    whole: list[str] | None = None

    def where(self, c: Column) -> Column:
        return c if self.when is None else F.when(self.when, c)

    def tuples(self) -> Column:
        """The tuple of a row, null where the row or its first field doesn't count."""
        counts = self.value.isNotNull() if self.when is None else self.when & self.value.isNotNull()
        return F.when(counts, F.struct(*(col(c) for c in self.whole)) if self.whole else self.value)

    def set(self, name: str, stream: bool = False) -> Column:
        """An aggregate of distinct tuples. Spark has no distinct aggregates of streams: there the set itself is kept."""
        c, wide = self.where(self.value), "bigint" if isinstance(self.kind, (T.IntegerType, T.LongType)) else "double"
        if name == "MIN":
            return F.min(c)
        if name == "MAX":
            return F.max(c)
        if name == "COUNT":
            return F.size(F.collect_set(self.tuples())).cast("long") if stream else F.count_distinct(self.tuples())
        if name in ("SUM", "AVG") and not self.whole and not stream:
            total = F.sum_distinct(c.cast(wide))
            return total if name == "SUM" else total / F.count_distinct(c)
        if name in ("SUM", "AVG"):
            found = F.collect_set(self.tuples())
            return AGGREGATES[name].bag(F.transform(found, lambda x: x.getField(self.whole[0])) if self.whole else found, self.kind)
        raise _NotFused


class _GroupScope(Scope):
    """The rows of a group, before they are bags: group is the key, and a bag may only be aggregated."""

    def __init__(self, scope: Scope, alias: str, rows: Scope, group: T.DataType, place: int = 1, key: Column | None = None):
        self.key = F.col("group") if key is None else key
        super().__init__(scope.spark, T.StructType().add("group", group), lambda f: self.key, scope.functions)
        self.alias, self.rows, self.bags, self.place, self.stream = alias, rows, {}, place, False

    def named(self, node: Name) -> tuple[Column, T.DataType]:
        if node.name in self.extra:
            return self.extra[node.name]
        if node.name in ("group", 0):
            return self.key, self.schema[0].dataType
        raise _NotFused

    def plain(self) -> Scope:
        return self

    def _analyzed(self, node: Node) -> T.DataType:
        frame = _empty(self.spark, T.StructType([*self.rows.schema.fields, self.schema[0]]).json() if "group" not in self.rows.schema.names else self.schema.json())
        return frame.groupBy("group").agg(self.column(node).alias("x")).schema[-1].dataType

    def _values(self, arg: Node) -> _Values:
        if isinstance(arg, Name) and arg.name in (self.alias, self.place):
            f = self.rows.schema[0]
            return _Values(self.rows.get(f.name), f.dataType, whole=self.rows.schema.names if len(self.rows.schema) > 1 else None)
        if isinstance(arg, Name) and arg.name in self.bags:
            return self.bags[arg.name]
        if isinstance(arg, Deref) and isinstance(arg.of, Name) and len(arg.fields) == 1:
            of = self._values(arg.of)
            if of.distinct:
                raise _NotFused
            c, t = self.rows.named(arg.fields[0])
            return _Values(c, t, of.when)
        raise _NotFused

    def distinct(self, arg: Node) -> _Values:
        """DISTINCT of a bag. Maps can't be told apart by an aggregate."""
        of = self._values(arg)
        if any("map<" in t.dataType.simpleString() for t in (self.rows.schema if of.whole else [T.StructField("x", of.kind)])):
            raise _NotFused
        return replace(of, distinct=True)

    def apart(self, node: Call) -> bool:
        """Whether an aggregate holds more of a group than a number or two."""
        return node.name in self.functions or node.name.upper() == "APPROX_COUNT_DISTINCT"

    def deduplicates(self, node: Call) -> bool:
        return any(self._values(x).distinct for x in node.args)

    def column(self, node: Node) -> Column:
        if isinstance(node, Call) and isinstance(self.functions.get(node.name), Aggregate) and len(node.args) == 1:
            v = self._values(node.args[0])
            if v.distinct:
                raise _NotFused
            return self.functions[node.name].grouped(v.where(v.value), v.kind)
        if isinstance(node, Call) and node.name not in self.functions:
            name = node.name.upper()
            if name in ("COR", "COV") and len(node.args) == 2:
                a, b = map(self._values, node.args)
                if a.when is not None or b.when is not None or a.distinct or b.distinct:
                    raise _NotFused
                return (F.corr if name == "COR" else F.covar_pop)(a.value.cast("double"), b.value.cast("double"))
            if name in ("SIZE", "ISEMPTY") and len(node.args) == 1:
                v = self._values(node.args[0])
                if v.distinct:
                    raise _NotFused
                rows = F.count(v.where(F.lit(1)))
                return rows if name == "SIZE" else rows == 0
            if name in AGGREGATES and len(node.args) == 1:
                v = self._values(node.args[0])
                if v.distinct:
                    return v.set(name, self.stream)
                if name == "COUNT_STAR":
                    return F.count(v.where(F.lit(1)))
                return AGGREGATES[name].grouped(v.where(v.value), v.kind)
        return _compile_with(node, self)


def _compile_with(node: Node, scope: _GroupScope) -> Column:
    """compile(), with this scope's aggregates inside."""
    return compile(_replace(node, scope), scope)


def _aggregates(n: Node, functions: dict) -> bool:
    """Whether a node is a call of an aggregate, of the library or of the session."""
    if not isinstance(n, Call):
        return False
    return isinstance(functions[n.name], Aggregate) if n.name in functions else n.name.upper() in (*AGGREGATES, "COR", "COV")


def _of_bag(n: Node, scope: _GroupScope) -> bool:
    """Whether a node is the size of the scope's bag, or asks if it is empty."""
    if not isinstance(n, Call) or n.name in scope.functions or n.name.upper() not in ("SIZE", "ISEMPTY") or len(n.args) != 1:
        return False
    of = n.args[0].of if isinstance(n.args[0], Deref) else n.args[0]
    return isinstance(of, Name) and of.name in (scope.alias, scope.place, *scope.bags)


def _replace(node: Node, scope: _GroupScope) -> Node:
    """Aggregate calls below node as fields of the scope that stand for them."""

    def change(n: Node) -> Node | None:
        if _aggregates(n, scope.functions) or _of_bag(n, scope):
            key = f"__agg{id(n)}"
            scope.extra[key] = (scope.column(n), scope._analyzed(n))
            return Name(key)
        return None

    return rewrite(node, change)


def _aggregated(df: DataFrame, group: str, wanted: dict[str, Column], calls: dict[str, Call], scope: _GroupScope) -> DataFrame:
    """The groups of df (a column), and the aggregates of them.

    Spark keeps the other aggregates of a group beside each value that a distinct one has seen, so those that hold sketches
    or values are made by themselves there, and joined.
    """
    apart = [] if df.isStreaming or not any(map(scope.deduplicates, calls.values())) else [k for k, n in calls.items() if scope.apart(n)]
    out = df.groupBy(group).agg(*(c.alias(k) for k, c in wanted.items() if k not in apart))
    if not apart:
        return out
    more = df.groupBy(F.col(group).alias("__same")).agg(*(wanted[k].alias(k) for k in apart))
    return out.join(more, F.col(group).eqNullSafe(F.col("__same"))).drop("__same")


def _root(node: Node) -> object:
    """The name that a bag's projections begin with."""
    while isinstance(node, Deref):
        node = node.of
    return node.name if isinstance(node, Name) else None


def _nulls(node: Node) -> bool:
    """Whether an expression is a bag of one tuple of nulls."""
    if isinstance(node, Cast):
        return _nulls(node.of)
    if isinstance(node, Call) and node.name.upper() in ("TOBAG", "TOTUPLE"):
        return all(map(_nulls, node.args)) and (node.name.upper() == "TOTUPLE" or len(node.args) == 1)
    if isinstance(node, Make) and node.kind in ("bag", "tuple"):
        return all(map(_nulls, node.items)) and (node.kind == "tuple" or len(node.items) == 1)
    return isinstance(node, Const) and node.value is None


def _emptiness(node: Node, bags: list[str]) -> list[Node] | None:
    """The parts of a condition that is made of IsEmpty(bag) and NOT IsEmpty(bag) by AND, or None."""
    if isinstance(node, Op) and node.op == "and":
        parts = [_emptiness(x, bags) for x in node.args]
        return None if None in parts else [y for x in parts for y in x]
    inner = node.args[0] if isinstance(node, Op) and node.op == "not" else node
    ok = isinstance(inner, Call) and inner.name.upper() == "ISEMPTY" and len(inner.args) == 1 and isinstance(inner.args[0], Name) and inner.args[0].name in bags
    return [node] if ok else None


def _empty_of(node: Node) -> tuple[str, bool]:
    """Of such a part the bag, and whether it must be empty."""
    return (node.args[0].args[0].name, False) if isinstance(node, Op) else (node.args[0].name, True)


@dataclass
class Planner:
    """Relations by alias; taps, functions and streams as the session has them."""

    spark: SparkSession
    stream: bool = False
    functions: dict = field(default_factory=dict)
    taps: dict = field(default_factory=dict)
    streams: dict = field(default_factory=dict)
    comparators: dict = field(default_factory=dict)
    relations: dict[str, Relation] = field(default_factory=dict)
    fuse: bool = True

    def __post_init__(self):
        self.aliases: dict[str, tuple[str, list]] = {}

    # ---- names

    def get(self, alias: str, step: Step | None = None) -> Relation:
        if alias not in self.relations:
            raise FlowError(f"no relation {alias}", 1006, *(step and (step.line, step.column) or (None, None)))
        return self.relations[alias]

    def df(self, alias: str) -> DataFrame:
        return self.get(alias).df

    def scope(self, df: DataFrame) -> Scope:
        return Scope(self.spark, df.schema, col, self.functions)

    def run(self, step: Step) -> None:
        """Adds what a relation step defines. Acting steps (DUMP, STORE, ...) are the session's."""
        made = getattr(self, f"_{step.verb}")(step)
        if step.alias is not None:
            n = step.args.get("parallel")
            if n and made.frame is not None and step.verb in ("tap", "load"):
                made = Relation(made.frame.repartition(n))
            elif n and made.frame is None:
                made.grouped.parallel = n
            elif n and step.verb in ("join", "distinct", "cross"):
                made = Relation(_tasks(made.frame, n))
            self.relations[step.alias] = made

    # ---- scalars: A.f where A is a relation of one row

    def _scalars(self, df: DataFrame, nodes: object, bags: tuple[str, ...] = ()) -> tuple[DataFrame, object]:
        """The frame with a column for each scalar, and the nodes that name it; bags are names that are no scalars."""
        known = self.scope(df)
        found: dict[tuple, str] = {}
        for n in walk(nodes):
            if isinstance(n, Deref) and isinstance(n.of, Name) and isinstance(n.of.name, str) and n.of.name not in bags and known.find(n.of.name) is None and n.of.name in self.relations:
                found.setdefault((n.of.name, n.fields[0].name), f"__scalar{len(found)}")
        if not found:
            return df, nodes
        for (alias, name), column in found.items():
            other = self.df(alias)
            f = self.scope(other).find(name)
            one = other.agg(F.count("*").alias("n"), F.first(col(f.name)).alias("v"))
            one = one.select(F.when(F.col("n") > 1, F.raise_error(F.lit(f"{alias} has more than one row"))).otherwise(F.col("v")).alias(column))
            df = df.crossJoin(F.broadcast(one))  # one row

        def swap(n: Node) -> Node | None:
            if isinstance(n, Deref) and isinstance(n.of, Name) and (n.of.name, n.fields[0].name) in found:
                return Name(found[n.of.name, n.fields[0].name])
            return None

        return df, rewrite(nodes, swap)

    # ---- sources

    def _tap(self, step: Step) -> Relation:
        a = step.args
        using = a["using"]
        if using and using[0] in self.aliases:
            using = self.aliases[using[0]]
        df = taps.read(self.spark, a["path"], using, parse_schema(a["schema"]) if a["schema"] else None, self.stream and step.verb == "tap", self.taps)
        return Relation(df.limit(a["limit"]) if a.get("limit") else df)

    _load = _tap

    # ---- one input

    def _filter(self, step: Step) -> Relation:
        of = self.get(step.args["of"], step)
        if of.frame is None and of.grouped and self.fuse and (tests := _emptiness(step.args["by"], [i[0] for i in of.grouped.inputs])):
            keep = [(n, lambda d, n=n: d.where(compile(n, self.scope(d)))) for n in tests]
            return Relation(None, replace(of.grouped, having=[*of.grouped.having, *keep]))
        df, by = self._scalars(self.df(step.args["of"]), step.args["by"])
        out = df.where(compile(by, self.scope(df)))
        return Relation(out.select(*(col(c) for c in self.df(step.args["of"]).columns)))

    def _distinct(self, step: Step) -> Relation:
        df = self.df(step.args["of"])
        return Relation(df.dropDuplicates() if df.isStreaming else sets.distinct(df))

    def _order(self, step: Step) -> Relation:
        df = self.df(step.args["of"])
        using = step.args.get("using")
        if using:
            return Relation(self._compared(df, step, using[0]))
        return Relation(df.orderBy(*sort_columns(step.args["by"], self.scope(df))))

    def _compared(self, df: DataFrame, step: Step, name: str) -> DataFrame:
        """A registered comparator: a key function of the sort columns, so that the sort stays in the engine, or a comparison of two tuples of them."""
        if name not in self.comparators:
            raise FlowError(f"no comparator {name}", 1070, step.line, step.column)
        scope = self.scope(df)
        key, compare = self.comparators[name]
        exprs = [(compile(e, scope), o.descending) for o in step.args["by"] for e in expand([o.expr], scope)]
        if compare is not None:
            return ordering.by_comparison(df, [c for c, _ in exprs], compare, step.args["by"][0].descending)
        return df.orderBy(*(key(c).desc_nulls_last() if down else key(c).asc_nulls_first() for c, down in exprs))

    def _limit(self, step: Step) -> Relation:
        n = step.args["n"]
        if isinstance(n, Const):
            return Relation(self.df(step.args["of"]).limit(int(n.value)))
        one, n = self._scalars(self.spark.range(1), n)
        value = one.select(compile(n, self.scope(one))).first()[0]
        if value is None or value <= 0:
            raise FlowError(f"LIMIT needs a positive number, not {value}", 1007, step.line, step.column)
        return Relation(self.df(step.args["of"]).limit(int(value)))

    def _sample(self, step: Step) -> Relation:
        return Relation(self.df(step.args["of"]).sample(step.args["share"], seed=0))

    def _rank(self, step: Step) -> Relation:
        a, df = step.args, self.df(step.args["of"])
        name = f"rank_{a['of']}"
        if not a["by"]:
            return Relation(ranks.number(df, name))
        scope = self.scope(df)
        exprs = [(e, o.descending) for o in a["by"] for e in expand([o.expr], scope)]
        sort = lambda names: [F.col(n).desc_nulls_last() if down else F.col(n).asc_nulls_first() for n, (_, down) in zip(names, exprs, strict=True)]
        return Relation(ranks.rank(df, [compile(e, scope) for e, _ in exprs], sort, name, a["dense"]))

    def _split(self, step: Step) -> Relation:
        a, df = step.args, self.df(step.args["of"])
        parts = sets.split(df, [compile(c, self.scope(df)) for _, c in a["branches"]])
        for (name, _), part in zip(a["branches"], parts, strict=False):
            self.relations[name] = Relation(part)
        if a["otherwise"]:
            self.relations[a["otherwise"]] = Relation(parts[-1])
        return Relation(df)

    def _partition(self, step: Step) -> Relation:
        a, df = step.args, self.df(step.args["of"])
        keys = [compile(e, self.scope(df)) for e in a["keys"]]
        return Relation(df.repartition(*([a["parallel"]] if a.get("parallel") else []), *keys))

    def _bind(self, step: Step) -> Relation:
        """Inputs that belong together downstream; each stays usable, and the alias stands for all their rows."""
        frames = [self.df(x) for x in step.args["inputs"]]
        return Relation(sets.union(frames))

    def _stream(self, step: Step) -> Relation:
        a, df = step.args, self.df(step.args["of"])
        name, *pairs = a["command"].split("#")
        if name not in self.streams:
            raise FlowError(f"nothing registered as {name}", 1071, step.line, step.column)
        options = dict(p.partition("=")[::2] for p in pairs)
        schema = parse_schema(a["schema"]) if a["schema"] else df.schema
        f = self.streams[name]
        if isinstance(f, Stateful):
            keys = [compile(Name(k), self.scope(df)).alias(f"__k{i}") for i, k in enumerate(f.keys)]
            return Relation(keyed.stateful(df.select(*keys, *(col(c) for c in df.columns)), len(keys), f, schema, options))
        return Relation(df.mapInPandas(lambda frames: f(frames, **options) if options else f(frames), schema))

    def _cube(self, step: Step) -> Relation:
        a, df = step.args, self.df(step.args["of"])
        scope = self.scope(df)
        keys = [(self._name(e, i), compile(e, scope)) for i, e in enumerate(a["keys"])]
        return Relation(None, Grouped([("cube", df, keys, False)], how=a["how"]))

    # ---- several inputs

    def _union(self, step: Step) -> Relation:
        return Relation(sets.union([self.df(x) for x in step.args["inputs"]], step.args["by_name"]))

    def _intersect(self, step: Step) -> Relation:
        return Relation(sets.meet([self.df(x) for x in step.args["inputs"]], step.verb, step.args["all"]))

    _except = _intersect

    def _prefixed(self, alias: str, df: DataFrame) -> DataFrame:
        return df.select(*(col(c).alias(f"{alias}::{c}") for c in df.columns))

    def _cross(self, step: Step) -> Relation:
        return Relation(joins.cross([self._prefixed(x, self.df(x)) for x in step.args["inputs"]]))

    def _join(self, step: Step) -> Relation:
        a = step.args
        using = a["using"][0] if a["using"] else None
        if a["kind"] != "inner" and len(a["inputs"]) != 2:
            raise FlowError("an outer join has two inputs", 1109, step.line, step.column)
        if using == "replicated" and a["kind"] not in ("inner", "left"):
            raise FlowError("a replicated join is inner or left outer", 1109, step.line, step.column)
        frames, seen = [], set()
        for r in a["inputs"]:
            df, alias = self.df(r["of"]), r["of"]
            while alias in seen:
                alias += "_"
            seen.add(alias)
            scope = self.scope(df)
            keys = [compile(e, scope) for e in expand(r["keys"], scope)]
            names = [f"__{len(frames)}_{i}" for i in range(len(keys))]
            d = df.select(*(col(c).alias(f"{alias}::{c}") for c in df.columns), *(k.alias(n) for k, n in zip(keys, names, strict=True)))
            frames.append((d, [F.col(n) for n in names]))
        out = joins.join(frames, a["kind"], using)
        return Relation(out.drop(*(c for c in out.columns if c.startswith("__"))))

    def _group(self, step: Step) -> Relation:
        inputs, everything = [], False
        seen: set[str] = set()
        for r in step.args["inputs"]:
            df = self.df(r["of"])
            scope = self.scope(df)
            exprs = expand(r["keys"], scope)
            everything |= not exprs
            names = [self._name(e, i) for i, e in enumerate(exprs)]
            names = [n if names.count(n) == 1 else f"{n}_{i}" for i, n in enumerate(names)]
            alias = r["of"]
            while alias in seen:
                alias += "_"
            seen.add(alias)
            inputs.append((alias, df, [(n, compile(e, scope)) for n, e in zip(names, exprs, strict=True)], r["inner"]))
        if len({len(i[2]) for i in inputs}) != 1:
            raise FlowError("inputs have different numbers of keys", 1008, step.line, step.column)
        if step.args.get("using") and len(inputs) > 1 and step.args["using"][0] == "merge" and any(i[3] for i in inputs):
            raise FlowError("a merge COGROUP has no INNER", 1009, step.line, step.column)
        if len(inputs) > 1:  # keys of one name and type on all sides
            first = inputs[0][2]
            inputs = [(a, d, [(n, c) for (n, _), (_, c) in zip(first, k, strict=True)], i) for a, d, k, i in inputs]
        return Relation(None, Grouped(inputs, everything))

    _cogroup = _group

    # ---- FOREACH

    @staticmethod
    def _name(e: Node, i: int) -> str:
        if isinstance(e, Name) and isinstance(e.name, str):
            return e.name.rpartition("::")[2]
        if isinstance(e, Deref) and e.single and isinstance(e.fields[0].name, str):
            return e.fields[0].name
        return f"_{i}"

    def _foreach(self, step: Step) -> Relation:
        a = step.args
        if "every" in a:
            return self._window(step)
        of = self.get(a["of"], step)
        block = a.get("block") or [Step("generate", None, {"items": a["items"]})]
        if of.frame is None and of.grouped and self.fuse:
            g = of.grouped
            for plan in (self._flattened, self._joined, self._ranked, self._unbagged, self._fused if len(g.inputs) == 1 else self._fused_sides):
                try:
                    return Relation(_tasks(plan(g, block), g.parallel))
                except _NotFused:
                    pass
        df, block = self._scalars(of.df, block, tuple(s.alias for s in block[:-1]))
        scope = self.scope(df)
        for s in block[:-1]:
            scope.extra[s.alias] = self._nested(s, scope)
        return Relation(self._generate(df, scope, block[-1].args["items"]))

    def _flattened(self, g: Grouped, block: list[Step]) -> DataFrame:
        """COGROUP and FLATTEN of every bag: a join. A scalar null key matches nothing; a compound one does."""
        items = block[-1].args["items"]
        bags = [i[0] for i in g.inputs]
        named = [x.expr.name for x in items if x.flatten and isinstance(x.expr, Name) and not x.names]
        if len(block) > 1 or len(g.inputs) < 2 or g.all or g.having or named != bags or len(items) != len(bags):
            raise _NotFused
        out = joins.join(self._sides(g), null_safe=g.compound)
        return out.drop(*(c for c in out.columns if c.startswith("__")))

    def _sides(self, g: Grouped) -> list[tuple[DataFrame, list[Column]]]:
        """Each input's rows with alias:: before its columns, and its keys."""
        frames = []
        for k, (alias, df, keys, _) in enumerate(g.inputs):
            names = [f"__{k}_{i}" for i in range(len(keys))]
            d = df.select(*(col(c).alias(f"{alias}::{c}") for c in df.columns), *(c.alias(n) for n, (_, c) in zip(names, keys, strict=True)))
            frames.append((d, [F.col(n) for n in names]))
        return frames

    def _joined(self, g: Grouped, block: list[Step]) -> DataFrame:
        """COGROUP of two, and FLATTEN of one or both bags, or of nulls where a bag is empty: a semi, anti, inner or outer join."""
        aliases = [i[0] for i in g.inputs]
        if len(block) > 1 or len(aliases) != 2 or g.all:
            raise _NotFused
        plans = []
        for item in block[-1].args["items"]:
            e, optional = item.expr, False
            if isinstance(e, Op) and e.op == "cond" and _emptiness(e.args[0], aliases) and _nulls(e.args[1]):
                of, empty = _empty_of(e.args[0])
                optional, e = empty, e.args[2]
                if not empty or _root(e) != of:
                    raise _NotFused
            if not item.flatten or _root(e) not in aliases:
                raise _NotFused
            alias = _root(e)
            schema = g.inputs[aliases.index(alias)][1].schema
            fields = [self._field_of(schema, f) for f in e.fields] if isinstance(e, Deref) else list(schema.fields)
            plans.append((alias, fields, optional, item))
        used = [p[0] for p in plans]
        must = {a: (not optional) for a, _, optional, _ in plans}
        empty = {}
        for part, _ in g.having:
            alias, is_empty = _empty_of(part)
            if empty.setdefault(alias, is_empty) != is_empty or is_empty and alias in used:
                raise _NotFused
        must |= {a: True for a, e in empty.items() if not e} | {a: True for a, _, _, inner in g.inputs if inner}
        if len(set(used)) != len(used):
            raise _NotFused
        (left, lk), (right, rk) = self._sides(g)
        same = joins.equal(lk, rk, g.compound)
        if len(used) == 1:
            mine, other = ((left, right) if used[0] == aliases[0] else (right, left))
            alias = aliases[1] if used[0] == aliases[0] else aliases[0]
            if alias not in empty and not must.get(alias):
                out = mine  # every row is in a group
            else:
                out = mine.join(other, same, "left_anti" if empty.get(alias) else "left_semi")
        else:
            kind = {(True, True): "inner", (True, False): "left_outer", (False, True): "right_outer", (False, False): "full_outer"}[must[aliases[0]], must[aliases[1]]]
            out = joins.join([(left, lk), (right, rk)], {"left_outer": "left"}.get(kind, kind), null_safe=g.compound)
        outs = []
        for i, (alias, fields, _, item) in enumerate(plans):
            names = parse_schema(item.names) if item.names else None
            outs += self._named(fields, lambda f, a=alias: col(f"{a}::{f.name}"), names, self._name(item.expr, i))
        return out.select(*self._unique(outs))

    def _field_of(self, schema: T.StructType, node: Name) -> T.StructField:
        found = Scope(self.spark, schema).find(node.name)
        if found is None:
            raise _NotFused
        return found

    @staticmethod
    def _named(fields: list[T.StructField], get: Callable[[T.StructField], Column], names: T.StructType | None, of: str) -> list[tuple[Column, str, str]]:
        """A flattened tuple's fields as columns: each with its name, and its name with the tuple's before it."""
        out = []
        for j, f in enumerate(fields):
            given = names[j] if names and j < len(names) else None
            c = get(f)
            if given is not None and not given.metadata.get("untyped"):
                c = cast(c, f.dataType, given.dataType)
            out.append((c, given.name if given is not None else f.name, f"{of}::{f.name}"))
        return out

    @staticmethod
    def _unique(outs: list[tuple[Column, str, str]]) -> list[Column]:
        """Columns by their names; by the longer ones where several have one name."""
        seen: dict[str, int] = {}
        for _, n, _ in outs:
            seen[n] = seen.get(n, 0) + 1
        final, used = [], set()
        for c, n, full in outs:
            n = full if seen[n] > 1 else n
            while n in used:
                n += "_"
            used.add(n)
            final.append(c.alias(n))
        return final

    def _group_fields(self, item: Item, kind: T.DataType, key: Column) -> list[tuple[Column, str, str]]:
        """The outputs of group or FLATTEN(group)."""
        names = parse_schema(item.names) if item.names else None
        if item.flatten and isinstance(kind, T.StructType):
            return self._named(kind.fields, lambda f: key.getField(f.name), names, "group")
        return [(key, names[0].name if names else "group", "group")]

    def _ranked(self, g: Grouped, block: list[Step]) -> DataFrame:
        """GROUP and FLATTEN of the first rows of its bag, by ORDER and LIMIT or by TOP: row numbers within the group, of which no more are kept anywhere."""
        alias, df, _, _ = g.inputs[0]
        if len(g.inputs) > 1 or g.all or g.how or g.having or df.isStreaming or len(block) not in (1, 3):
            raise _NotFused
        items = block[-1].args["items"]
        mine = [x for x in items if not (isinstance(x.expr, Name) and x.expr.name in ("group", 0))]
        if len(mine) != 1 or not mine[0].flatten:
            raise _NotFused
        rows, e = self.scope(df), mine[0].expr
        if len(block) == 3:
            order, limit = block[:2]
            if order.verb != "order" or limit.verb != "limit" or order.args.get("using") or _root(order.args["of"]) != alias or isinstance(order.args["of"], Deref):
                raise _NotFused
            if _root(limit.args["of"]) != order.alias or isinstance(limit.args["of"], Deref) or _root(e) != limit.alias or not isinstance(limit.args["n"], Const):
                raise _NotFused
            sort, n = sort_columns(order.args["by"], rows), int(limit.args["n"].value)
            fields = [self._field_of(df.schema, f) for f in e.fields] if isinstance(e, Deref) else list(df.schema.fields)
        else:
            if not isinstance(e, Call) or e.name.upper() != "TOP" or len(e.args) != 3 or not all(isinstance(x, Const) for x in e.args[:2]) or _root(e.args[2]) != alias:
                raise _NotFused
            bag = e.args[2]
            fields = [self._field_of(df.schema, f) for f in bag.fields] if isinstance(bag, Deref) else list(df.schema.fields)
            n, by = int(e.args[0].value), fields[int(e.args[1].value)]
            sort = [order_key(col(by.name), by.dataType).desc_nulls_last()]
        kind = df.select(g.key(0).alias("x")).schema[0].dataType
        d = df.select(g.key(0).alias("__group"), *(col(f.name) for f in dict.fromkeys(df.schema.fields)))
        d = d.withColumn("__n", F.row_number().over(Window.partitionBy("__group").orderBy(*sort))).where(F.col("__n") <= n)
        outs = []
        for i, item in enumerate(items):
            if item is mine[0]:
                names = parse_schema(item.names) if item.names else None
                outs += self._named(fields, lambda f: col(f.name), names, self._name(item.expr, i))
            else:
                outs += self._group_fields(item, kind, F.col("__group"))
        return d.select(*self._unique(outs))

    def _unbagged(self, g: Grouped, block: list[Step]) -> DataFrame:
        """GROUP and FLATTEN of its bag, or of what FILTER, projections and DISTINCT leave of it: the rows themselves with their group, each once a group for DISTINCT."""
        alias, df, _, _ = g.inputs[0]
        items = block[-1].args["items"]
        mine = [x for x in items if not (isinstance(x.expr, Name) and x.expr.name in ("group", 0))]
        if len(g.inputs) > 1 or g.how or g.having or df.isStreaming or len(mine) != 1 or not mine[0].flatten:
            raise _NotFused
        key, names = "__group", df.columns
        if key in names or len(set(names)) != len(names):
            raise _NotFused
        base = df.select(g.key(0).alias(key), *(col(c) for c in names))
        bags = {alias: base, 1: base}

        def rows(node: Node) -> DataFrame:
            if isinstance(node, Name) and node.name in bags:
                return bags[node.name]
            if isinstance(node, Deref) and all(isinstance(f, Name) for f in node.fields):
                d = rows(node.of)
                fields = [self._field_of(T.StructType(d.schema.fields[1:]), f).name for f in node.fields]
                if len(set(fields)) == len(fields):
                    return d.select(key, *(col(f) for f in fields))
            raise _NotFused

        for s in block[:-1]:
            d = rows(s.args["expr"] if s.verb == "assign" else s.args.get("of"))
            if s.verb == "filter":
                try:
                    d = d.where(compile(s.args["by"], self.scope(d.drop(key))))
                except FlowError:
                    raise _NotFused from None  # of more than the bag's rows
            elif s.verb == "distinct":
                if "map<" in d.schema.simpleString():
                    raise _NotFused
                d = d.distinct()
            elif s.verb != "assign":
                raise _NotFused
            bags[s.alias] = d
        d = rows(mine[0].expr)
        outs = []
        for i, item in enumerate(items):
            if item is mine[0]:
                names = parse_schema(item.names) if item.names else None
                outs += self._named(d.schema.fields[1:], lambda f: col(f.name), names, self._name(item.expr, i))
            else:
                outs += self._group_fields(item, d.schema[key].dataType, F.col(key))
        return d.select(*self._unique(outs))

    def _bag_step(self, s: Step, scope: _GroupScope) -> bool:
        """A step of a block over the scope's bag, as conditions on its rows; whether it is over that bag."""
        of = s.args["expr"] if s.verb == "assign" else s.args.get("of")
        if s.verb not in ("filter", "distinct", "assign") or not isinstance(of, (Deref, Name)):
            raise _NotFused
        if _root(of) not in (scope.alias, *scope.bags):
            return False
        if s.verb == "distinct":
            scope.bags[s.alias] = scope.distinct(of)
        elif s.verb == "assign":
            scope.bags[s.alias] = scope._values(of)
        else:
            if not isinstance(of, Name) or of.name != scope.alias:
                raise _NotFused
            scope.bags[s.alias] = replace(scope._values(of), when=compile(s.args["by"], scope.rows))
        return True

    def _fused(self, g: Grouped, block: list[Step]) -> DataFrame:
        """GROUP, CUBE or ROLLUP and aggregates of its bag: one grouped aggregate, without the bag."""
        alias, df, keys, _ = g.inputs[0]
        if "group" in df.columns or g.having:
            raise _NotFused
        if g.how:
            by = [f"__c{i}" for i in range(len(keys))]
            key = F.struct(*(F.col(c).alias(n) for c, (n, _) in zip(by, keys, strict=True)))
            df, block = self._scalars(df.withColumns({c: k for c, (_, k) in zip(by, keys, strict=True)}), block, (alias, *(s.alias for s in block[:-1])))
            kind, rows, groups_of = df.select(key.alias("x")).schema[0].dataType, self.scope(df.drop(*by)), getattr(df, g.how)(*by)
        else:
            df, block = self._scalars(df.withColumn("group", g.key(0)), block, (alias, *(s.alias for s in block[:-1])))
            key, kind, rows, groups_of = F.col("group"), df.schema["group"].dataType, self.scope(df.drop("group")), df.groupBy("group")
        scope = _GroupScope(self.scope(df), alias, rows, kind, key=key)
        scope.stream = df.isStreaming
        for s in block[:-1]:
            if not self._bag_step(s, scope):
                raise _NotFused
        calls: dict[str, Call] = {}

        def change(n: Node) -> Node | None:
            if _aggregates(n, scope.functions) or _of_bag(n, scope):
                calls[f"__a{len(calls)}"] = n
                return Name(f"__a{len(calls) - 1}")
            return None

        items = block[-1].args["items"]
        changed = [replace(item, expr=rewrite(item.expr, change)) for item in items]
        if not g.how and not df.isStreaming and any(map(scope.apart, calls.values())) and any(map(scope.deduplicates, calls.values())):
            d = _aggregated(df, "group", {k: scope.column(n) for k, n in calls.items()}, calls, scope)
            over, key, items = self.scope(d), F.col("group"), changed
        else:
            d = over = None
        outs: list[tuple[Column, str]] = []
        for i, item in enumerate(items):
            names = parse_schema(item.names) if item.names else None
            if isinstance(item.expr, Name) and item.expr.name in ("group", 0):
                outs += [(c, n) for c, n, _ in self._group_fields(item, kind, key)]
                continue
            if item.flatten:
                raise _NotFused
            c = compile(item.expr, over) if over else scope.column(item.expr)
            if names and not names[0].metadata.get("untyped"):
                c = cast(c, over.type(item.expr) if over else scope._analyzed(item.expr), names[0].dataType)
            outs.append((c, names[0].name if names else self._name(block[-1].args["items"][i].expr, i)))
        if over:
            return d.select(*(c.alias(n) for c, n in outs))
        out = groups_of.agg(*(c.alias(f"__{k}") for k, (c, _) in enumerate(outs)))
        return out.select(*(F.col(f"__{k}").alias(n) for k, (_, n) in enumerate(outs)))

    def _fused_sides(self, g: Grouped, block: list[Step]) -> DataFrame:
        """COGROUP and aggregates of its bags: each input aggregated by itself, and the groups joined. A bag without rows counts 0."""
        scopes, frames = [], []
        names = [i[0] for i in g.inputs]
        for k, (alias, df, _, _) in enumerate(g.inputs):
            if "group" in df.columns:
                raise _NotFused
            d = df.withColumn("group", g.key(k))
            scopes.append(_GroupScope(self.scope(d), alias, self.scope(df), d.schema["group"].dataType, k + 1))
            frames.append(d)
        for s in block[:-1]:
            if not any([self._bag_step(s, x) for x in scopes]):
                raise _NotFused
        wanted: list[dict[str, Column]] = [{f"__n{k}": F.count(F.lit(1))} for k in range(len(scopes))]
        zero: dict[str, Column] = {}
        calls: list[dict[str, Call]] = [{} for _ in scopes]

        def change(n: Node) -> Node | None:
            for k, scope in enumerate(scopes):
                if (_aggregates(n, scope.functions) or _of_bag(n, scope)) and isinstance(n, Call):
                    if any(_root(a) not in (scope.alias, scope.place, *scope.bags) for a in n.args):
                        continue
                    name = f"__{k}a{len(wanted[k])}"
                    wanted[k][name], calls[k][name] = scope.column(n), n
                    if n.name.upper() in ("COUNT", "COUNT_STAR", "SIZE", "APPROX_COUNT_DISTINCT") and n.name not in scope.functions:
                        zero[name] = F.lit(0).cast("long")
                    if n.name.upper() == "ISEMPTY":
                        zero[name] = F.lit(True)
                    return Name(name)
            return None

        items = [(item, rewrite(item.expr, change)) for item in block[-1].args["items"]]
        if any(isinstance(n, Name) and n.name in (*names, *range(1, len(names) + 1), *(b for x in scopes for b in x.bags)) for _, e in items for n in walk(e)):
            raise _NotFused  # a bag itself
        if any(isinstance(n, Deref) and isinstance(n.of, Name) and n.of.name in self.relations for _, e in items for n in walk(e)):
            raise _NotFused
        sides = [(_aggregated(d.withColumn(f"__g{k}", F.col("group")), f"__g{k}", wanted[k], calls[k], scopes[k]), F.col(f"__g{k}")) for k, d in enumerate(frames)]
        out, group = sides[0]
        for d, key in sides[1:]:
            out, group = out.join(d, joins.equal([group], [key], null_safe=g.compound), "full_outer"), F.coalesce(group, key)
        for k, (_, _, _, inner) in enumerate(g.inputs):
            if inner:
                out = out.where(F.col(f"__n{k}") > 0)
        for part, _ in g.having:
            alias, empty = _empty_of(part)
            n = F.col(f"__n{names.index(alias)}")
            out = out.where(n.isNull() if empty else n > 0)
        out = out.select(group.alias("group"), *(F.coalesce(F.col(n), zero[n]).alias(n) if n in zero else F.col(n) for w in wanted for n in w if not n.startswith("__n")))
        scope, outs = self.scope(out), []
        for i, (item, e) in enumerate(items):
            given = parse_schema(item.names) if item.names else None
            if isinstance(e, Name) and e.name in ("group", 0):
                outs += self._group_fields(item, out.schema["group"].dataType, F.col("group"))
                continue
            if item.flatten:
                raise _NotFused
            c = compile(e, scope)
            if given and not given[0].metadata.get("untyped"):
                c = cast(c, scope.type(e), given[0].dataType)
            name = given[0].name if given else self._name(item.expr, i)
            outs.append((c, name, name))
        return out.select(*self._unique(outs))

    def _nested(self, s: Step, scope: Scope) -> tuple[Column, T.DataType]:
        """A step inside { }: a bag from a bag, or any expression. Its type is what Spark's analyzer says."""
        verb, a = s.verb, s.args

        def build(scope: Scope) -> Column:
            if verb == "assign":
                return compile(a["expr"], scope)
            bag, kind = compile(a["of"], scope), scope.type(a["of"])
            item = kind.elementType
            inside = lambda x: element_scope(scope, item, x)
            if verb == "filter":
                return F.filter(bag, lambda x: compile(a["by"], inside(x)))
            if verb == "order":
                pairs = [(e, o.descending) for o in a["by"] for e in expand([o.expr], element_scope(scope, item, F.lit(None)))]
                return sort_bag(bag, kind, [(lambda x, e=e: compile(e, inside(x)), down) for e, down in pairs])
            if verb == "distinct":
                return F.array_distinct(bag)
            if verb == "limit":
                return F.slice(bag, F.lit(1), compile(a["n"], scope).cast("int"))
            if verb == "foreach":
                items = [(i, e) for i, e in enumerate(a["items"])]
                return F.transform(bag, lambda x: F.struct(*(compile(e.expr, inside(x)).alias(parse_schema(e.names)[0].name if e.names else self._name(e.expr, i)) for i, e in items)))
            out = bag
            for m in a["more"]:
                other = scope.type(m).elementType
                c, fields = compile(m, scope), list(item.fields)
                prefix = {f.name for f in fields} & {f.name for f in other}
                rename = lambda n: n + "_" if n in prefix else n
                out = F.flatten(F.transform(out, lambda x: F.transform(c, lambda y: F.struct(*(x.getField(f.name).alias(f.name) for f in fields), *(y.getField(f.name).alias(rename(f.name)) for f in other)))))
                item = T.StructType([*fields, *(T.StructField(rename(f.name), f.dataType) for f in other)])
            return out

        plain = scope.plain()
        kind = _empty(self.spark, plain.schema.json()).select(build(plain).alias("x")).schema[0].dataType
        return build(scope), kind

    def _generate(self, df: DataFrame, scope: Scope, items: list[Item]) -> DataFrame:
        """The outputs of GENERATE; each flattened bag is an explode, so several make a cross product and an empty one drops the row."""
        plans: list = []
        for i, item in enumerate(items):
            names = parse_schema(item.names) if item.names else None
            for e in expand([item.expr], scope):
                kind = scope.type(e)
                c = compile(e, scope)
                if item.flatten and isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
                    plans.append(("bag" if not isinstance(kind, T.StructType) else "tuple", c, kind, names, self._name(e, i)))
                else:
                    name = names[0].name if names else self._name(e, i)
                    if names and not names[0].metadata.get("untyped"):
                        c = cast(c, kind, names[0].dataType)
                    plans.append(("one", c, kind, names, name))
        wide = df.select(*(p[1].alias(f"__{k}") for k, p in enumerate(plans)))
        outs: list[tuple[Column, str, str]] = []
        for k, (how, _, kind, names, name) in enumerate(plans):
            at = F.col(f"__{k}")
            if how == "one":
                outs.append((at, name, name))
                continue
            if how == "bag":
                if isinstance(kind, T.MapType):
                    wide, kind = wide.withColumn(f"__{k}", F.map_entries(at)), T.ArrayType(T.StructType().add("key", kind.keyType).add("value", kind.valueType))
                rest = [c for c in wide.columns if c != f"__{k}"]
                wide = wide.select(*rest, F.explode(at).alias(f"__{k}"))
                kind = kind.elementType
            if not isinstance(kind, T.StructType):
                outs.append((at, names[0].name if names else name, name))
                continue
            outs += self._named(kind.fields, lambda f, at=at: at.getField(f.name), names, name)
        return wide.select(*self._unique(outs))

    def _window(self, step: Step) -> Relation:
        """FOREACH a WINDOW n SECONDS BY keys ON field GENERATE ...: expressions over keys and aggregates.

        An output that isn't aggregated is the key it names, or else the value of the window's latest row.
        """
        a, df = step.args, self.df(step.args["of"])
        on = self.scope(df).find(a["on"].name).name if a["on"] else None
        rows = self.scope(df)
        keys = [compile(e, rows) for e in a["keys"]]
        block = a.get("block") or [Step("generate", None, {"items": a["items"]})]
        scope = _GroupScope(rows, a["of"], rows, T.NullType())
        key_of = {repr(e): i for i, e in enumerate(a["keys"])}
        for s in block[:-1]:
            if s.verb != "distinct":
                raise FlowError(f"{s.verb.upper()} isn't allowed in a window", 1010, s.line, s.column)
            scope.bags[s.alias] = scope.distinct(s.args["of"])
        latest = F.col("__at")

        def build(node: Node) -> Column:
            if repr(node) in key_of:
                return F.col(f"__k{key_of[repr(node)]}")
            if _aggregates(node, self.functions):
                name = node.name.upper()
                try:
                    values = [scope._values(x) for x in node.args]
                except _NotFused:
                    values = [_Values(compile(x, rows), rows.type(x)) for x in node.args]
                v = values[0]
                if node.name in self.functions:
                    return self.functions[node.name].grouped(v.value, v.kind)
                if name in ("COR", "COV"):
                    return (F.corr if name == "COR" else F.covar_pop)(*(x.value.cast("double") for x in values))
                if v.distinct:
                    try:
                        return v.set(name, df.isStreaming)
                    except _NotFused:
                        raise FlowError(f"{name} of distinct tuples isn't allowed in a window", 1010, node.line, node.column) from None
                if name == "COUNT_STAR":
                    return F.count(F.lit(1))
                return AGGREGATES[name].grouped(v.value, v.kind)
            if not any(_aggregates(n, self.functions) for n in walk(node)):
                return F.max_by(compile(node, rows), latest)

            def change(n: Node) -> Node | None:
                if repr(n) in key_of or _aggregates(n, self.functions):
                    key = f"__agg{id(n)}"
                    c = build(n)
                    frame = df.groupBy(*(k.alias(f"__k{i}") for i, k in enumerate(keys))) if repr(n) in key_of else df
                    scope.extra[key] = (c, frame.agg(F.max(F.lit(1))).select(c.alias("x")).schema[0].dataType if repr(n) in key_of else df.agg(c.alias("x")).schema[0].dataType)
                    return Name(key)
                return None

            return compile(rewrite(node, change), scope)

        outs = [build(i.expr).alias(parse_schema(i.names)[0].name if i.names else self._name(i.expr, k)) for k, i in enumerate(block[-1].args["items"])]
        return Relation(windowed(df, on, a["every"], keys, outs, a.get("slide"), a.get("delay"), a.get("session", False)))
