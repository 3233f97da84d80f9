"""Operators and sessions: null keys, fused against unfused plans, sinks, streams, and all registered queries against DuckDB."""

import time
from functools import cmp_to_key

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__
from rivulet import catalog, explain, monitor
from rivulet.errors import FlowError
from rivulet.functions.managed import Function
from rivulet.operators import joins, ordering
from rivulet.plans.parser import macros
from rivulet.session import Session, start
from rivulet.sources import sinks
from rivulet.sources.custom import Tap, source
from rivulet.storage import shared_dir


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    for t in catalog.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((v is not None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, sf, oracle, name):
    df = catalog.queries()[name](spark, sf)
    cur = oracle.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert canonical(df.columns, df.collect()) == canonical(names, cur.fetchall())


def test_joins_of_whole_tables(spark, sf, oracle):
    three, full = (catalog.queries()[name](spark, sf).collect() for name in ("join_three_way", "join_full"))
    assert {r.c_custkey for r in three} == {r[0] for r in oracle.execute("SELECT c_custkey FROM customer SEMI JOIN supplier ON c_nationkey = s_nationkey").fetchall()}
    assert {r.o_orderkey for r in full} - {None} == {r[0] for r in oracle.execute("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'").fetchall()}
    assert any(r.o_orderkey is None for r in full) and any(r.c_custkey is None for r in full)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


GROUPED = [
    "group_count", "group_multi_key", "group_null_key", "having", "count_distinct_nested", "nested_filter_count", "group_expr_key", "join_cogroup_flatten", "distinct_of_filtered",
    "distinct_whole_tuples", "cube_rollup", "rollup", "nested_order_limit", "top_per_group", "cogroup_counts", "cogroup_null_keys", "cogroup_compound_null", "cogroup_inner", "cogroup_three",
    "cogroup_three_aggregates", "cogroup_merge", "partition_bind_group", "semi_cogroup", "anti_cogroup", "anti_null_keys", "join_cogroup_outer",
]


@pytest.mark.parametrize("name", GROUPED)
def test_fused_is_unfused(spark, sf, name):
    script = catalog.prepared(catalog.SCRIPTS[name][0])
    fused, plain = (catalog.session(spark, fuse=f).load(script, {"sf": sf}).relation("out") for f in (True, False))
    assert canonical(fused.columns, fused.collect()) == canonical(plain.columns, plain.collect())
    assert "collect_list" not in explain.text(fused) and "collect_list" in explain.text(plain)


def test_plans_prune_and_push(spark, sf):
    script = catalog.prepared("f = FILTER lineitem BY l_discount > 0.05; g = GROUP f BY l_returnflag; out = FOREACH g GENERATE group, SUM(f.l_quantity);")
    plan = explain.text(catalog.session(spark).load(script, {"sf": sf}).relation("out"))
    assert "GreaterThan(l_discount,0.05)" in plan and "ReadSchema: struct<l_quantity:double,l_discount:double,l_returnflag:string>" in plan


def test_outer_joins_need_two_inputs(spark, sf):
    for bad in ("j = JOIN nation BY n_nationkey LEFT, supplier BY s_nationkey, customer BY c_nationkey;", "j = JOIN nation BY n_nationkey FULL, supplier BY s_nationkey USING 'replicated';"):
        with pytest.raises(FlowError) as e:
            catalog.session(spark).load(catalog.prepared(bad), {"sf": sf})
        assert e.value.code == 1109


def test_scalar_of_many_rows_fails(spark, sf):
    s = catalog.session(spark).load(catalog.prepared("out = FILTER nation BY n_regionkey == region.r_regionkey;"), {"sf": sf})
    with pytest.raises(Exception, match="more than one row"):
        s.relation("out").collect()


def test_limit_of_nothing_fails(spark, sf):
    with pytest.raises(FlowError):
        catalog.session(spark).load(catalog.prepared("out = LIMIT nation 1 - 1;"), {"sf": sf})


def test_sinks(spark, sf, tmp_path):
    said = []
    s = Session(spark, out=said.append)
    kept = sinks.ListDumper()
    s.register_dumper("Keep", lambda: kept)
    s.run(f"n = LOAD '{sf}/nation.parquet'; f = FILTER n BY n_nationkey < 2; g = GROUP f BY n_regionkey; DUMP f; DUMP g USING Keep(); DESCRIBE g; EXPLAIN f; STORE f INTO '{tmp_path}/t'; STORE g INTO '{tmp_path}/p.parquet';")
    assert len(said) == 4 and said[0].startswith("(0,") and said[2] == "g: {group: int, f: {(n_nationkey: int, n_name: chararray, n_regionkey: int)}}" and "Scan parquet" in said[3]
    assert sum(len(bag) for _, bag in kept.rows) == 2
    lines = spark.read.text(f"{tmp_path}/t")
    again = Session(spark).load(f"t = LOAD '{tmp_path}/t' AS (k:int, n:chararray, r:int);").relation("t")
    assert lines.count() == 2 and sorted(again.collect()) == sorted(spark.read.parquet(f"{sf}/nation.parquet").where("n_nationkey < 2").collect())
    assert spark.read.parquet(f"{tmp_path}/p.parquet").count() == len(kept.rows)
    assert '"n" -> "f"' in s.dot()


def test_ragged_lines(spark, tmp_path):
    (tmp_path / "r.tsv").write_text("1\tx\t2.5\n2\n3\t\t\n4\ty\t1\textra\n\n")
    got = Session(spark).load(f"t = TAP '{tmp_path}/r.tsv' AS (a:int, b:chararray, c:double);").relation("t").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "x", 2.5), (2, None, None), (3, None, None), (4, "y", 1.0), (None, None, None)], key=str)


def test_stream_of_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.tsv").write_text("1\tx\n2\ty\n3\tx\n")
    kept = sinks.ListDumper()
    s = Session(spark, stream=True, config={"aliases": {"r": {"mode": "complete"}}})
    s.register_dumper("Keep", lambda: kept)
    s.run(f"t = TAP '{tmp_path}/in' AS (k:int, v:chararray); g = GROUP t BY v; r = FOREACH g GENERATE group, COUNT(t) AS n; DUMP r USING Keep();")
    s.wait(60)
    s.stop()
    assert sorted(kept.rows) == [("x", 2), ("y", 1)]


def test_service_and_monitor(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.tsv").write_text("1\n2\n")
    reports = []
    m = monitor.attach(spark, reports.append)
    s = start(spark, f"t = TAP '{tmp_path}/in' AS (k:int); f = FILTER t BY k > 1; STORE f INTO '{tmp_path}/out';")
    try:
        until(lambda: sum(r["rows"] for r in reports) == 2)
        (tmp_path / "in/b.tsv").write_text("0\n3\n")  # a service goes on
        until(lambda: sum(r["rows"] for r in reports) == 4)
        assert all(q.isActive for q in s.queries)
    finally:
        s.stop()
        spark.streams.removeListener(m)
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/out").collect()) == ["2", "3"]
    assert len({r["query"] for r in reports}) == 1 and all(r["ms"] >= 0 for r in reports)


def until(done, seconds=60):
    end = time.time() + seconds
    while not done():
        assert time.time() < end
        time.sleep(0.1)


@pytest.mark.parametrize("mode", ["append", "update", "complete"])
def test_store_of_a_stream_keeps_batches(spark, tmp_path, mode):
    (tmp_path / "in").mkdir()
    script = f"t = TAP '{tmp_path}/in' AS (k:int); " + (f"f = FILTER t BY k > 0; STORE f INTO '{tmp_path}/out';" if mode == "append" else f"g = GROUP t BY k; f = FOREACH g GENERATE group, COUNT(t); STORE f INTO '{tmp_path}/out';")
    for name, text in (("a", "1\n2\n"), ("b", "2\n3\n")):
        (tmp_path / f"in/{name}.tsv").write_text(text)
        s = Session(spark, stream=True, config={"checkpoint": str(tmp_path / "state"), "mode": mode}).run(script)
        s.wait()
    got = sorted(r.value for r in spark.read.option("recursiveFileLookup", "true").text(f"{tmp_path}/out").collect())
    assert got == {"append": ["1", "2", "2", "3"], "update": ["1\t1", "2\t1", "2\t2", "3\t1"], "complete": ["1\t1", "2\t2", "3\t1"]}[mode]


class Queue(Tap):
    """Gives what is in a list, and nothing once that is at its end."""

    rows = [(i, f"r{i}") for i in range(5)]
    schema = "k int, v string"

    def open(self, path, args, part):
        self.at = 0

    def next(self):
        self.at += 1
        return self.rows[self.at - 1] if self.at <= len(self.rows) else None


def test_custom_tap_in_a_stream(spark):
    kept = sinks.ListDumper()
    s = Session(spark, stream=True, config={"trigger": "0 seconds"})
    s.register_tap("Queue", source(Queue))
    s.register_dumper("Keep", lambda: kept)
    s.run("t = TAP 'x' USING Queue(); f = FILTER t BY k != 2; DUMP f USING Keep();")
    try:
        until(lambda: len(kept.rows) == 4)
    finally:
        s.stop()
    assert sorted(kept.rows) == [(i, f"r{i}") for i in (0, 1, 3, 4)]


def test_state_of_a_stream_stays(spark, tmp_path):
    (tmp_path / "in").mkdir()
    kept = sinks.ListDumper()
    for name, text in (("a", "x\ny\nx\n"), ("b", "x\n")):
        (tmp_path / f"in/{name}.tsv").write_text(text)
        s = Session(spark, stream=True, config={"checkpoint": str(tmp_path / "state")})
        s.register_stream("tally", catalog._tally, keys=["event_type"], state="n long")
        s.register_dumper("Keep", lambda: kept)
        s.run(f"t = TAP '{tmp_path}/in' AS (event_type:chararray); c = STREAM t THROUGH `tally` AS (event_type:chararray, n:long); DUMP c USING Keep();")
        s.wait()
    assert sorted(kept.rows) == [("x", 2), ("x", 3), ("y", 1)]


class Slow(Function):
    log: list = []

    def prepare(self, config):
        self.pause = float(config["pause"])

    def call(self, k):
        time.sleep(self.pause if k else 0)
        return "in time"


def test_managed_functions(spark):
    s = Session(spark, config={"functions": {"Slow": {"pause": "3"}}})
    timer = s.register_managed("Slow", Slow, "string", within=1.0, default="late")
    s.register_frame("t", spark.range(3).coalesce(1))
    got = s.load("out = FOREACH t GENERATE id, Slow((int)id) AS said;").relation("out").collect()
    assert sorted(map(tuple, got)) == [(0, "in time"), (1, "late"), (2, "late")]
    assert timer.calls.value == 3 and timer.timed.value == 1 and timer.mean < 1


def test_registered_aggregate_needs_a_group(spark, sf):
    s = catalog.session(spark).load(catalog.prepared("g = GROUP nation BY n_regionkey; f = FILTER g BY SIZE(nation) > 1L;"), {"sf": sf})
    with pytest.raises(FlowError):
        s.load("out = FOREACH f GENERATE Squares(nation.n_nationkey);")


@pytest.mark.parametrize("share", ["true", "false"])
def test_sinks_share_what_they_are_made_of(spark, sf, tmp_path, share):
    s = Session(spark)
    s.load(f"SET share '{share}'; n = LOAD '{sf}/nation.parquet'; g = GROUP n BY n_regionkey; c = FOREACH g GENERATE group AS r, COUNT(n) AS k; a = FILTER c BY r < 2; b = FILTER c BY r > 2; STORE a INTO '{tmp_path}/a'; STORE b INTO '{tmp_path}/b';")
    assert s._shared(s.actions) == ["c"]
    seen, act = [], s._act
    s._act = lambda step: (seen.append("InMemoryTableScan" in explain.text(s.planner.df(step.args["of"]).where("true"))), act(step))
    s.run()
    assert seen == [share == "true"] * 2
    assert sorted(r.value for x in "ab" for r in spark.read.text(f"{tmp_path}/{x}").collect()) == ["0\t5", "1\t5", "3\t5", "4\t5"]


def test_macros():
    text = "DEFINE two(a) RETURNS b { x = FILTER $a BY k > 1;\n $b = LIMIT x 2; };\nDEFINE four(a) RETURNS b { y = two($a); $b = UNION y, y; };\nr = four(t); q = two(r);"
    got = macros(text)
    assert got.count("FILTER") == 2 and "r = UNION" in got and "q = LIMIT" in got and "$" not in got and "DEFINE" not in got
    with pytest.raises(FlowError):
        macros("DEFINE m(a) RETURNS b { $b = LIMIT $a 1; }; x = m(p, q);")


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        class _jsc:
            @staticmethod
            def sc():
                return type("X", (), {"getCheckpointDir": lambda self: type("O", (), {"isEmpty": lambda self: True})()})()

    with pytest.raises(FlowError):
        shared_dir(type("S", (), {"sparkContext": Context()})())


def test_observed(spark):
    df, o = monitor.observed(spark.range(7), "n")
    df.collect()
    assert o.get == {"rows": 7}


@pytest.mark.parametrize("kind", ["inner", "left"])
def test_skewed_join(spark, monkeypatch, kind):
    from pyspark.sql import functions as F

    from rivulet.operators import joins, ordering

    left = spark.range(4000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 100 == 1, None).otherwise(F.col("id") % 50).alias("a"), F.col("id").alias("v"))
    right = spark.range(60).select((F.col("id") % 30).alias("b"), F.col("id").alias("w"))
    want = left.join(right, F.col("a") == F.col("b"), {"left": "left_outer"}.get(kind, kind))
    monkeypatch.setattr(joins, "REPLICATE_LIMIT", 0)
    got = joins.join([(left, [F.col("a")]), (right, [F.col("b")])], kind, "skewed")
    assert got.columns == ["a", "v", "b", "w"] and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    spread = joins.skewed(left, [F.col("a")], right, [F.col("b")], kind, 5)
    assert spread.exceptAll(want).count() == 0 and spread.count() == want.count()


def test_rate_tap(spark):
    kept = sinks.ListDumper()
    s = Session(spark, stream=True, config={"trigger": "0 seconds"})
    s.register_dumper("Keep", lambda: kept)
    s.run("t = TAP 'x' USING Rate(50); f = FOREACH t GENERATE value * 2L AS v; DUMP f USING Keep();")
    try:
        until(lambda: len(kept.rows) >= 3)
    finally:
        s.stop()
    assert all(v % 2 == 0 for (v,) in kept.rows)


def test_rank_over_many_tasks(spark):
    from pyspark.sql import functions as F

    df = spark.range(5000).select((F.col("id") * 7919 % 613).alias("k"), "id").repartition(7)
    for dense, sql in ((True, "dense_rank()"), (False, "rank()")):
        s = Session(spark)
        s.register_frame("t", df)
        got = s.load(f"r = RANK t BY k DESC, id {'DENSE' if dense else ''}; q = RANK t BY k {'DENSE' if dense else ''};")
        df.createOrReplaceTempView("t")
        for alias, order in (("r", "k DESC, id"), ("q", "k")):
            want = spark.sql(f"SELECT cast({sql} OVER (ORDER BY {order}) AS bigint) AS r, k, id FROM t")
            assert got.relation(alias).exceptAll(want).count() == 0


def test_pairs_of_a_key_are_dealt(spark, monkeypatch):
    """A key that both sides repeat is joined in several tasks, with the rows of a plain join."""
    a = spark.sql("SELECT CASE WHEN id < 300 THEN 7 WHEN id < 310 THEN null ELSE id END AS k, id AS x FROM range(330)")
    b = spark.sql("SELECT CAST(CASE WHEN id < 200 THEN 7 WHEN id < 205 THEN null ELSE id + 110 END AS int) AS k, id % 150 AS y FROM range(220)")
    a.createOrReplaceTempView("dealt_a")
    b.createOrReplaceTempView("dealt_b")
    monkeypatch.setattr(joins, "CELL", 5000)
    script = "i = JOIN a BY k, b BY k; l = JOIN a BY k LEFT, b BY k; g = COGROUP a BY (k, x - x), b BY (k, y - y); f = FOREACH g GENERATE FLATTEN(a), FLATTEN(b);"
    s = catalog.session(spark)
    for name, df in (("a", a), ("b", b)):
        s.register_frame(name, df)
    s.load(script)
    for name, sql in (("i", "JOIN dealt_b b ON a.k = b.k"), ("l", "LEFT JOIN dealt_b b ON a.k = b.k"), ("f", "JOIN dealt_b b ON a.k <=> b.k")):
        got, want = s.relation(name).toDF("k", "x", "k2", "y"), spark.sql(f"SELECT a.k, x, b.k AS k2, y FROM dealt_a a {sql}")
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
        sizes = got.where("x < 300").groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) > 1 and max(r["count"] for r in sizes) < 60_000
    few = s.load("c = FILTER b BY y < 0L; j = JOIN a BY k, c BY k;").relation("j")
    assert few.count() == 0 and "__li" not in explain.text(few)


def test_comparison_sorts_by_runs(spark, monkeypatch):
    """Rows are dealt to several tasks, ties too, and a task sorts runs that it merges: no task holds its rows as Python objects."""
    df = spark.sql("SELECT CASE WHEN id % 10 = 9 THEN null WHEN id < 4000 THEN 5 ELSE id * 7919 % 613 END AS k, id, named_struct('d', TIMESTAMP'2024-01-01 00:00:00' + make_interval(0, 0, 0, CAST(id % 3 AS int)), 'm', map('a', id)) AS s FROM range(6000)").repartition(3)
    s = catalog.session(spark)
    place = lambda t: (t[0] is None, -(t[0] or 0))
    s.register_comparator("NullsLast", compare=lambda a, b: (place(a) > place(b)) - (place(a) < place(b)))
    s.register_frame("t", df)
    for how in ("", "DESC"):
        o = s.load(f"o = ORDER t BY k {how} USING NullsLast;").relation("o")
        rows = o.collect()
        assert [r.k for r in rows] == [r[0] for r in sorted(((r.k,) for r in df.collect()), key=place, reverse=bool(how))]
        assert sorted((r.id, r.s.m["a"]) for r in rows) == [(i, i) for i in range(6000)]
        sizes = [r["count"] for r in o.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 4 and max(sizes) < 3600 and "MapInArrow" in explain.text(o)  # 3600 rows are 5
    s.register_comparator("Late", compare=lambda a, b: (b[0].d.day, b[1]) > (a[0].d.day, a[1]) or -1)  # a tuple's fields by their names, as rows have them
    late = [(r.s.d.day, r.id) for r in s.load("l = ORDER t BY s, id USING Late;").relation("l").collect()]
    assert late == sorted(late, reverse=True) and len(late) == 6000
    assert s.load("e = FILTER t BY id < 0L; f = ORDER e BY k USING NullsLast;").relation("f").count() == 0

    monkeypatch.setattr(ordering, "RUN", 700)
    values = [i * 7919 % 5003 for i in range(5003)]
    batches = pa.Table.from_pydict({"__0": values, "v": [str(v) for v in values]}).to_batches(1000)
    got = pa.Table.from_batches(ordering._sorted(iter(batches), T.StructType().add("__0", "long"), cmp_to_key(lambda a, b: b[0] - a[0])))
    assert got["v"].to_pylist() == [str(v) for v in sorted(values, reverse=True)]


FLATTENED = {
    "nested_distinct": (catalog.SCRIPTS["nested_distinct"][0], "lineitem"),
    "flatten": ("g = GROUP lineitem BY (l_returnflag, l_linestatus); out = FOREACH g GENERATE FLATTEN(lineitem.(l_linenumber, l_tax)) AS (n:long, t), FLATTEN(group);", "lineitem"),
    "filter": ("g = GROUP customer BY c_nationkey; out = FOREACH g { f = FILTER customer BY c_acctbal > 0; p = f.(c_mktsegment, c_custkey); q = p.c_mktsegment; d = DISTINCT q; GENERATE group, FLATTEN(d) AS m; };", "customer"),
    "after": ("g = GROUP t ALL; out = FOREACH g { d = DISTINCT t; GENERATE FLATTEN(d.v); };", None),
    "nulls": ("g = GROUP t BY k; out = FOREACH g { d = DISTINCT t; GENERATE group, FLATTEN(d); };", None),
    "empty": ("e = FILTER t BY v == 'z'; g = GROUP e BY k; out = FOREACH g { d = DISTINCT e; GENERATE group, FLATTEN(d); };", None),
}


@pytest.mark.parametrize("name", FLATTENED)
def test_flattened_bags_are_not_built(spark, sf, name):
    script, table = FLATTENED[name]
    script = catalog.prepared(script) if table else "t = TAP 'pairs' USING ConstantTuples() AS (k:int, v:chararray); " + script
    fused, plain = (catalog.session(spark, fuse=f).load(script, {"sf": sf}).relation("out") for f in (True, False))
    assert fused.schema.simpleString() == plain.schema.simpleString()
    assert canonical(fused.columns, fused.collect()) == canonical(plain.columns, plain.collect())
    assert "collect_list" not in explain.text(fused) and "collect_list" in explain.text(plain)


def test_accumulated_squares_need_no_bag(spark, sf):
    """A registered fold of a group is combined before the shuffle, and has a form for bags; nulls count in neither."""
    script = "t = TAP 'pairs' USING ConstantTuples() AS (k:int, v:chararray); g = GROUP t BY v; out = FOREACH g GENERATE group AS v, SumSquares(t.k) AS s;"
    for fuse in (True, False):
        out = catalog.session(spark, fuse=fuse).load(script).relation("out")
        assert sorted(map(tuple, out.collect())) == [("a", 5), ("b", 2), ("c", None)] and ("collect_list" in explain.text(out)) != fuse
    assert "collect_list" not in explain.text(catalog.queries()["udaf_accumulator"](spark, sf))


def test_sketches_are_apart_from_distinct_values(spark, sf):
    """Spark would keep a sketch beside each distinct value of a group: aggregates that hold more than a number are made by themselves."""
    block = "{ d = DISTINCT t.k; GENERATE FLATTEN(group) AS (v, e), COUNT(d) AS n, APPROX_COUNT_DISTINCT(t.k) - COUNT(d) AS z, (double)Middle(t.k) AS m, COUNT_STAR(t) AS s; }"
    script = f"t = TAP 'pairs' USING ConstantTuples() AS (k:int, v:chararray); u = FOREACH t GENERATE k, (k IS NULL ? null : v) AS v; g = GROUP u BY (v, v); out = FOREACH g {block};".replace("t.k", "u.k").replace("COUNT_STAR(t)", "COUNT_STAR(u)")
    out = catalog.session(spark).load(script).relation("out")
    assert sorted(map(tuple, out.collect()), key=str) == [("a", "a", 2, 0, 1.5, 2), ("b", "b", 1, 0, 1.0, 2), (None, None, 0, 0, None, 2)]
    sides = "t = TAP 'pairs' USING ConstantTuples() AS (k:int, v:chararray); l = FOREACH t GENERATE *; g = COGROUP t BY v, l BY v; x = FOREACH g { s = t.k; d = DISTINCT s; GENERATE group AS v, COUNT(d) AS n, APPROX_COUNT_DISTINCT(t.k) AS a, COUNT(l) AS c; };"
    both = catalog.session(spark).load(sides).relation("x")
    assert sorted(map(tuple, both.collect()), key=str) == [("a", 2, 2, 2), ("b", 1, 1, 2), ("c", 0, 0, 0)]
    for df in (out, both, catalog.queries()["approx_distinct"](spark, sf)):
        nodes = [x for x in explain.text(df).splitlines() if "partial_approx_count_distinct" in x or "merge_approx_count_distinct" in x]
        assert nodes and not any("count(" in x or "merge_approx" in x for x in nodes)  # beside a distinct count sketches are merged
