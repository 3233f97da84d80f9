"""What a script is parsed into: expressions and steps."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Node:
    line: int = field(default=0, kw_only=True, compare=False)
    column: int = field(default=0, kw_only=True, compare=False)


@dataclass
class Const(Node):
    value: object
    kind: str


@dataclass
class Name(Node):
    """A field by name (rel::field too) or by place; a name may also be a relation, for a scalar."""

    name: str | int


@dataclass
class Star(Node):
    pass


@dataclass
class Range(Node):
    first: Name | None
    last: Name | None


@dataclass
class Deref(Node):
    of: Node
    fields: list[Name]
    single: bool


@dataclass
class Lookup(Node):
    of: Node
    key: str


@dataclass
class Op(Node):
    """op: + - * / % neg == != < <= > >= and or not matches isnull notnull in cond case."""

    op: str
    args: list[Node]


@dataclass
class Cast(Node):
    kind: str
    of: Node


@dataclass
class Call(Node):
    name: str
    args: list[Node]


@dataclass
class Over(Node):
    """A call over the rows that share keys, ordered; rows is how many before and behind the row count (None: all)."""

    call: Call
    keys: list[Node]
    orders: list
    rows: tuple[int | None, int | None] | None = None


@dataclass
class Make(Node):
    """A tuple, bag or map that is written out."""

    kind: str
    items: list


@dataclass
class Item(Node):
    """One output of GENERATE: an expression, whether it is flattened, and the names it gets."""

    expr: Node
    flatten: bool = False
    names: str | None = None


@dataclass
class Order(Node):
    expr: Node
    descending: bool = False


@dataclass
class Step(Node):
    """alias = verb ...; args by name. A step without an alias acts (DUMP, STORE, DESCRIBE, EXPLAIN, DEFINE)."""

    verb: str
    alias: str | None = None
    args: dict = field(default_factory=dict)
