"""Parsing, expressions, casts and the text form of values, against results worked out by hand."""

import pytest
from hypothesis import given
from hypothesis import settings as fast
from hypothesis import strategies as st
from pyspark.sql import types as T

from rivulet import catalog
from rivulet.config import Config
from rivulet.errors import FlowError
from rivulet.functions import codec
from rivulet.plans.ast import Call, Const, Deref, Name, Op
from rivulet.plans.parser import Parser, parse
from rivulet.session import Session
from rivulet.sources.taps import CONSTANTS
from rivulet.types import name_of, parse_schema, parse_type


def expr(text):
    return Parser(text).expr()


def test_precedence():
    assert expr("1 + 2 * 3") == Op("+", [Const(1, "int"), Op("*", [Const(2, "int"), Const(3, "int")])])
    assert expr("not a and b or c") == Op("or", [Op("and", [Op("not", [Name("a")]), Name("b")]), Name("c")])
    assert expr("a == 1 ? x.y : COUNT($2)") == Op("cond", [Op("==", [Name("a"), Const(1, "int")]), Deref(Name("x"), [Name("y")], True), Call("COUNT", [Name(2)])])
    assert expr("a IS NOT NULL") == Op("notnull", [Name("a")])
    assert expr("-a # 'k'").op == "neg"


def test_literals():
    assert [expr(x).kind for x in ("1", "3000000000", "1L", "1.5f", "1.5", "1e3", "'a'", "null", "true", "5BI", "5BD")] == ["int", "long", "long", "float", "double", "double", "chararray", "null", "boolean", "biginteger", "bigdecimal"]
    assert expr(r"'it\'s\n\u0041'").value == "it's\nA"


def test_errors_say_where():
    with pytest.raises(FlowError) as e:
        parse("a = LOAD 'x';\nb = FILTER a BY (c == ;")
    assert (e.value.line, e.value.column) == (2, 23)
    for bad in ("a = ;", "a = LOAD x;", "b = JOIN a;;c", "a = NATIVE 'x';", "x = FOREACH a { y = ORDER b BY c; };"):
        with pytest.raises(FlowError):
            parse(bad)


def test_comments_and_parameters():
    steps = parse("-- one\na = LOAD '$dir/x'; /* two\n*/ b = LIMIT a ${n};", {"dir": "/d", "n": 3})
    assert steps[0].args["path"] == "/d/x" and steps[1].args["n"] == Const(3, "int")


def test_schemas():
    s = parse_schema("a:int, b, t:(x:long, y:chararray), g:{t:(z:double)}, h:bag{(q:int)}, m:map[], n:[int], d:datetime")
    assert [name_of(f.dataType) for f in s] == ["int", "chararray", "(x: long, y: chararray)", "{(z: double)}", "{(q: int)}", "map[chararray]", "map[int]", "datetime"]
    assert s["b"].metadata == {"untyped": True}
    assert parse_type("bag{tuple(int)}") == T.ArrayType(T.StructType().add("_0", T.IntegerType()))
    with pytest.raises(FlowError):
        parse_schema("a:whatever")


@fast(max_examples=60, deadline=None)
@given(st.recursive(st.integers(-9, 9).map(lambda i: ("int", i)), lambda s: st.lists(s, min_size=1, max_size=3).map(lambda x: ("tuple", x)), max_leaves=8))
def test_text_form_round_trip(value):
    def kind(v):
        return T.IntegerType() if v[0] == "int" else T.StructType([T.StructField(f"_{i}", kind(x)) for i, x in enumerate(v[1])])

    def plain(v):
        return v[1] if v[0] == "int" else tuple(map(plain, v[1]))

    def tuples(v, k):
        return v if not isinstance(k, T.StructType) else tuple(tuples(v[f.name], f.dataType) for f in k)

    text, k = codec.render(plain(value)), kind(value)
    assert tuples(codec.parse(text, k), k) == plain(value)


@pytest.mark.parametrize(("text", "kind", "value"), [("(1,a", "(a:int,b:chararray)", None), ("(1)", "(a:int,b:int)", {"a": 1, "b": None}), ("{}", "{(x:int)}", []), ("{(1),(2)}", "{(x:int)}", [{"x": 1}, {"x": 2}]), ("[#1]", "map[int]", None), ("[k#1,l#x]", "map[int]", {"k": 1, "l": None}), ("", "(a:int)", None), ("{(1)]", "{(x:int)}", None)])
def test_malformed_text_is_null(text, kind, value):
    assert codec.parse(text, parse_type(kind)) == value


def run(spark, script, alias="out", **constants):
    CONSTANTS.update(constants)
    s = catalog.session(spark).load(script)
    return sorted((tuple(r) for r in s.relation(alias).collect()), key=str)


def test_arithmetic(spark):
    got = run(spark, "t = TAP 'ar' USING ConstantTuples() AS (i:int, j:int, d:double); out = FOREACH t GENERATE i / j, i % j, i + j, i / d;", ar=["(7,2,2.0)", "(-7,2,0.0)", "(7,0,)", "(2147483647,1,1.0)"])
    assert got == sorted([(3, 1, 9, 3.5), (-3, -1, -5, None), (None, None, 7, None), (2147483647, 0, -2147483648, 2147483647.0)], key=str)


def test_matches_is_whole(spark):
    got = run(spark, "t = TAP 're' USING ConstantTuples() AS (i:int, s:chararray, p:chararray); out = FOREACH t GENERATE i, s MATCHES p;", re=["(1,abc,b)", "(2,abc,.*b.*)", "(3,,.*)", "(4,a\n,a)"])
    assert got == [(1, False), (2, True), (3, True), (4, False)]


def test_wide_casts(spark):
    got = run(spark, "t = TAP 'w' USING ConstantTuples() AS (d:double, l:long, b:boolean); out = FOREACH t GENERATE (int)d, (long)d, (int)l, (int)b, (boolean)d, (chararray)b, (chararray)l;", w=["(1e20,4294967297,true)", "(-1.9,-1,false)"])
    assert got == sorted([(2147483647, 9223372036854775807, 1, 1, True, "true", "4294967297"), (-1, -1, -1, 0, True, "false", "-1")], key=str)


def test_casts_between_kinds_fail(spark):
    for bad in ("(datetime)true", "(tuple(int))3", "(int)TOTUPLE(1)"):
        with pytest.raises(FlowError):
            run(spark, f"t = TAP 'logic' USING ConstantTuples() AS (p:boolean, q:boolean); out = FOREACH t GENERATE {bad} AS x;")


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("workers: 2\nfunctions:\n  F:\n    size: 3\naliases:\n  a:\n    size: 4\n    names: x, y ,\n")
    c = Config.read(str(tmp_path / "c.yaml"))
    assert c.number("size", function="F") == 3 and c.number("size", function="F", alias="a") == 4 and c.number("workers") == 2
    assert c.names("names", alias="a") == ["x", "y"] and not c.flag("none")


def test_unknown_names(spark):
    for bad in ("out = FILTER nothing BY x == 1;", "t = TAP 'logic' USING ConstantTuples() AS (p:boolean); out = FOREACH t GENERATE zz;", "t = TAP 'logic' USING ConstantTuples() AS (p:boolean); out = FOREACH t GENERATE NoSuch(p);", "t = TAP 'x' USING NoTap(); "):
        with pytest.raises(FlowError):
            Session(spark).load(bad)
