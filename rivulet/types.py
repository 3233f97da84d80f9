"""Types and schema texts: `a:int, t:(x:long), b:{(y:chararray)}, m:map[double]`."""

from __future__ import annotations

import re

from pyspark.sql import types as T

from rivulet.errors import FlowError

ATOMS = {
    "boolean": T.BooleanType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "chararray": T.StringType(),
    "bytearray": T.BinaryType(),
    "datetime": T.TimestampType(),
    "biginteger": T.DecimalType(38, 0),
    "bigdecimal": T.DecimalType(38, 18),
}
#: Numbers, from the narrowest to the widest.
WIDTH = {"int": 0, "long": 1, "float": 2, "double": 3}
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


class _Reader:
    def __init__(self, text: str):
        self.text, self.words, self.i = text, re.findall(r"[A-Za-z_$][\w$]*(?:::\w+)*|[(){}\[\],:]|\S", text), 0

    def peek(self) -> str:
        return self.words[self.i] if self.i < len(self.words) else ""

    def take(self, word: str | None = None) -> str:
        got = self.peek()
        if not got or (word and got != word):
            raise FlowError(f"bad schema {self.text!r}: expected {word or 'more'}, found {got!r}", 1001)
        self.i += 1
        return got

    def fields(self, end: str) -> T.StructType:
        out = T.StructType()
        while self.peek() != end:
            name = f"_{len(out)}"
            if re.match(r"\w", self.peek()) and not (self.peek().lower() in (*ATOMS, "tuple", "bag", "map") and self.words[self.i + 1 : self.i + 2] != [":"]):
                name = self.take()
                kind = self.kind() if self.peek() == ":" and self.take() else None
            else:
                kind = self.kind()
            out.add(name, kind or T.StringType(), True, {} if kind else {"untyped": True})
            if self.peek() != ",":
                break
            self.take()
        return out

    def kind(self) -> T.DataType:
        word = self.peek()
        if word.lower() in ATOMS:
            return ATOMS[self.take().lower()]
        if word.lower() == "tuple":
            self.take()
            if self.peek() != "(":
                return T.StructType()
            word = "("
        if word.lower() == "bag":
            self.take()
            if self.peek() != "{":
                return T.ArrayType(T.StructType())
            word = "{"
        if word.lower() == "map":
            self.take()
            if self.peek() != "[":
                return T.MapType(T.StringType(), T.StringType())
            word = "["
        if word == "(":
            self.take("(")
            out = self.fields(")")
            self.take(")")
            return out
        if word == "{":
            self.take("{")
            if self.peek() != "}":
                if re.match(r"\w", self.peek()) and self.words[self.i + 1 : self.i + 2] == [":"] and self.words[self.i + 2 : self.i + 3] in (["("], ["tuple"]):
                    self.take(), self.take()
                out = self.kind()
                out = out if isinstance(out, T.StructType) else T.StructType().add("_0", out)
            else:
                out = T.StructType()
            self.take("}")
            return T.ArrayType(out)
        if word == "[":
            self.take("[")
            value = T.StringType() if self.peek() == "]" else self.kind()
            self.take("]")
            return T.MapType(T.StringType(), value)
        raise FlowError(f"unknown type {word!r} in {self.text!r}", 1001)


def parse_schema(text: str) -> T.StructType:
    """A struct of the fields; a field without a type is text that is cast where it is used (metadata: untyped)."""
    text = text.strip()
    text = text[1:-1] if text.startswith("(") and text.endswith(")") and _closes_last(text) else text
    r = _Reader(text)
    out = r.fields("")
    if r.peek():
        raise FlowError(f"bad schema {text!r} at {r.peek()!r}", 1001)
    return out


def _closes_last(text: str) -> bool:
    depth = 0
    for i, c in enumerate(text):
        depth += (c in "({[") - (c in ")}]")
        if not depth:
            return i == len(text) - 1
    return False


def parse_type(text: str) -> T.DataType:
    r = _Reader(text)
    out = r.kind()
    if r.peek():
        raise FlowError(f"bad type {text!r}", 1001)
    return out


def name_of(kind: T.DataType) -> str:
    """The type as a schema text names it."""
    if isinstance(kind, T.StructType):
        return "(" + ", ".join(f"{f.name}: {name_of(f.dataType)}" for f in kind) + ")"
    if isinstance(kind, T.ArrayType):
        return "{" + name_of(kind.elementType) + "}"
    if isinstance(kind, T.MapType):
        return f"map[{name_of(kind.valueType)}]"
    if isinstance(kind, T.DecimalType):
        return "bigdecimal" if kind.scale else "biginteger"
    if isinstance(kind, T.TimestampNTZType):
        return "datetime"
    return next((k for k, v in ATOMS.items() if isinstance(kind, type(v))), kind.simpleString())
