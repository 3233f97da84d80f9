"""Registered queries: a script whose relation `out` is the result, and SQL with the same rows."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet import monitor
from rivulet.config import Config
from rivulet.errors import FlowError
from rivulet.functions.managed import Function
from rivulet.session import Session
from rivulet.sources import sinks
from rivulet.sources.custom import Tap
from rivulet.sources.taps import CONSTANTS
from rivulet.storage import settings, shared_dir

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

CONSTANTS["ragged"] = ["(1,x,2.5)", "(2)", "(3,,)", "(4,y,1,extra)"]
CONSTANTS["nested"] = ["((1,a),{(1),(2)},[k#1,l#2])", "((2,b),{},[k#3])", "(,{(3)},)"]
CONSTANTS["bags"] = ["(1,{(3,c),(1,a),(1,a)})", "(2,{})", "(3,)"]
CONSTANTS["two_bags"] = ["(1,{(1),(2)},{(10),(20)})", "(2,{(3)},{})"]
CONSTANTS["maps"] = ["(1,[a#1,b#2])", "(2,[b#2,a#1])", "(3,[a#1])", "(4,)"]
CONSTANTS["numbers"] = ["(1, 12 )", "(2,1.9)", "(3,-2.5)", "(4,1e3)", "(5,12L)", "(6,1.5f)", "(7,abc)", "(8,2147483648)", "(9,true)", "(10,TRUE)", "(11,t)"]
CONSTANTS["logic"] = [f"({p},{q})" for p in ("true", "false", "") for q in ("true", "false", "")]
CONSTANTS["null_l"] = ["(1,a)", "(1,b)", "(2,c)", "(,d)", "(,e)"]
CONSTANTS["null_r"] = ["(1,x)", "(3,y)", "(,z)"]
CONSTANTS["pair_l"] = ["(1,,p)", "(1,1,q)"]
CONSTANTS["pair_r"] = ["(1,,r)", "(1,1,s)"]
CONSTANTS["ranks"] = ["(a,10)", "(b,10)", "(c,8)", "(d,)"]

#: name: (script, SQL). Tables that a script names are loaded before it.
SCRIPTS: dict[str, tuple[str, str | None]] = {
    # ---- sources, projection, filters
    "tap_scan": ("out = FOREACH nation GENERATE *;", "SELECT * FROM nation"),
    "tap_limit": ("t = TAP '$sf/lineitem.parquet' LIMIT 7; g = GROUP t ALL; out = FOREACH g GENERATE COUNT_STAR(t) AS n;", "SELECT 7::BIGINT AS n"),
    "foreach_project": ("out = FOREACH lineitem GENERATE l_orderkey, l_quantity * 2.0 AS twice, $3 AS line;", "SELECT l_orderkey, l_quantity * 2.0::DOUBLE AS twice, l_linenumber AS line FROM lineitem"),
    "project_range": ("out = FOREACH part GENERATE p_partkey..p_brand, p_size..;", "SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part"),
    "project_range_to": ("out = FOREACH part GENERATE ..p_name, $9 AS missing;", "SELECT p_partkey, p_name, NULL::INT AS missing FROM part"),
    "filter_cmp": ("out = FILTER lineitem BY l_discount > 0.02 AND (l_quantity <= 10 OR l_returnflag == 'R') AND NOT (l_linenumber != 1);", "SELECT * FROM lineitem WHERE l_discount > 0.02 AND (l_quantity <= 10 OR l_returnflag = 'R') AND l_linenumber = 1"),
    "filter_null3vl": ("a = FOREACH customer GENERATE c_custkey, (c_nationkey == 3 ? null : c_nationkey) AS n; out = FILTER a BY n > 5 OR n IS NULL;", "SELECT c_custkey, nullif(c_nationkey, 3) AS n FROM customer WHERE nullif(c_nationkey, 3) > 5 OR nullif(c_nationkey, 3) IS NULL"),
    "filter_not_null": ("a = FOREACH customer GENERATE c_custkey, (c_nationkey == 3 ? null : c_nationkey) AS n; out = FILTER a BY NOT (n > 5);", "SELECT c_custkey, nullif(c_nationkey, 3) AS n FROM customer WHERE NOT (nullif(c_nationkey, 3) > 5)"),
    "filter_matches": ("f = FILTER part BY p_name MATCHES '.*e.*' AND NOT p_type MATCHES 'E'; out = FOREACH f GENERATE p_partkey, p_name MATCHES '[a-m].*' AS low;", "SELECT p_partkey, regexp_full_match(p_name, '[a-m].*') AS low FROM part WHERE regexp_full_match(p_name, '.*e.*') AND NOT regexp_full_match(p_type, 'E')"),
    "bincond": ("a = FOREACH customer GENERATE c_custkey, (c_nationkey == 3 ? null : c_nationkey) AS n; out = FOREACH a GENERATE c_custkey, (n > 10 ? 'high' : 'low') AS level;", "SELECT c_custkey, CASE WHEN nullif(c_nationkey, 3) > 10 THEN 'high' WHEN NOT nullif(c_nationkey, 3) > 10 THEN 'low' END AS level FROM customer"),
    "case_in": ("out = FOREACH orders GENERATE o_orderkey, (CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END) AS code, o_orderpriority IN ('1-URGENT', '2-HIGH') AS hot;", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS code, o_orderpriority IN ('1-URGENT', '2-HIGH') AS hot FROM orders"),
    "logic_tables": ("l = TAP 'logic' USING ConstantTuples() AS (p:boolean, q:boolean); out = FOREACH l GENERATE p, q, p AND q AS a, p OR q AS o, NOT p AS n, (p ? 1 : 0) AS c;", "SELECT p, q, p AND q AS a, p OR q AS o, NOT p AS n, CASE WHEN p THEN 1 WHEN NOT p THEN 0 END AS c FROM (VALUES (true), (false), (NULL::BOOLEAN)) a(p), (VALUES (true), (false), (NULL::BOOLEAN)) b(q)"),
    # ---- arithmetic and casts
    "arith_int_div": ("out = FOREACH lineitem GENERATE l_orderkey, l_linenumber, (l_linenumber - 4) / 2 AS half, l_orderkey / l_linenumber AS per;", "SELECT l_orderkey, l_linenumber, (l_linenumber - 4) // 2 AS half, l_orderkey // l_linenumber AS per FROM lineitem"),
    "arith_div_zero": ("out = FOREACH lineitem GENERATE l_orderkey, l_linenumber, 10 / (l_linenumber - 1) AS a, l_quantity / (l_discount - l_discount) AS b, l_linenumber % (l_linenumber - 1) AS c;", "SELECT l_orderkey, l_linenumber, 10 // nullif(l_linenumber - 1, 0) AS a, NULL::DOUBLE AS b, l_linenumber % nullif(l_linenumber - 1, 0) AS c FROM lineitem"),
    "arith_mod": ("out = FOREACH lineitem GENERATE l_orderkey, l_linenumber, (l_linenumber - 4) % 3 AS m, l_orderkey % 7L AS k;", "SELECT l_orderkey, l_linenumber, (l_linenumber - 4) % 3 AS m, l_orderkey % 7 AS k FROM lineitem"),
    "arith_wrap": ("out = FOREACH nation GENERATE n_nationkey, 2147483647 + n_nationkey AS over, -n_nationkey AS less;", "SELECT n_nationkey, ((2147483647::BIGINT + n_nationkey + 2147483648) % 4294967296 - 2147483648)::INT AS over, -n_nationkey AS less FROM nation"),
    "cast_text_num": (
        "t = TAP 'numbers' USING ConstantTuples() AS (id:int, s:chararray); out = FOREACH t GENERATE id, (int)s AS i, (long)s AS l, (double)s AS d, (boolean)s AS b;",
        "SELECT * FROM (VALUES (1,12,12::BIGINT,12.0::DOUBLE,NULL::BOOLEAN),(2,1,1,1.9,NULL),(3,-2,-2,-2.5,NULL),(4,1000,1000,1000.0,NULL),(5,NULL,12,NULL,NULL),(6,1,1,1.5,NULL),(7,NULL,NULL,NULL,NULL),(8,NULL,2147483648,2147483648.0,NULL),(9,NULL,NULL,NULL,true),(10,NULL,NULL,NULL,true),(11,NULL,NULL,NULL,NULL)) t(id,i,l,d,b)",
    ),
    "cast_bool_num": ("out = FOREACH lineitem GENERATE l_orderkey, l_linenumber, (int)(l_quantity > 25.0 ? 1.9 : -1.9) AS i, (boolean)(l_linenumber - 1) AS b, (chararray)l_orderkey AS t, (int)(l_orderkey * 10000000000L) AS w;", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN 1 ELSE -1 END AS i, l_linenumber <> 1 AS b, l_orderkey::VARCHAR AS t, (((l_orderkey * 10000000000) % 4294967296 + 4294967296 + 2147483648) % 4294967296 - 2147483648)::INT AS w FROM lineitem"),
    "cast_dt_long": ("out = FOREACH events GENERATE event_id, (long)ts AS ms, ToMilliSeconds((datetime)((long)ts)) AS again;", "SELECT event_id, epoch_us(ts) // 1000 AS ms, epoch_us(ts) // 1000 AS again FROM events"),
    # ---- nested values
    "map_lookup": ("m = FOREACH nation GENERATE n_nationkey, TOMAP('name', n_name, 'region', (chararray)n_regionkey) AS m; out = FOREACH m GENERATE n_nationkey, m#'name' AS name, m#'none' AS none, SIZE(m) AS size;", "SELECT n_nationkey, n_name AS name, NULL::VARCHAR AS none, 2::BIGINT AS size FROM nation"),
    "map_equality": ("t = TAP 'maps' USING ConstantTuples() AS (id:int, m:map[]); u = FOREACH t GENERATE m; d = DISTINCT u; g = GROUP d ALL; out = FOREACH g GENERATE COUNT_STAR(d) AS n;", "SELECT 3::BIGINT AS n"),
    "json_lookup": ("out = FOREACH events GENERATE event_id, (int)GET_JSON(props, '$.k') AS k;", "SELECT event_id, (props::JSON ->> '$.k')::INT AS k FROM events"),
    "tuple_deref": ("t = FOREACH nation GENERATE TOTUPLE(n_nationkey, n_name) AS t, n_regionkey; out = FOREACH t GENERATE t._1 AS name, t.(_0) AS inner_, n_regionkey; out = FOREACH out GENERATE name, FLATTEN(inner_) AS key, n_regionkey;", "SELECT n_name AS name, n_nationkey AS key, n_regionkey FROM nation"),
    "bag_project": ("g = GROUP nation BY n_regionkey; b = FOREACH g GENERATE group, nation.(n_nationkey, n_name) AS b; out = FOREACH b GENERATE group, FLATTEN(b);", 'SELECT n_regionkey AS "group", n_nationkey, n_name FROM nation'),
    "tokenize_flatten": ("w = FOREACH benchmark GENERATE FLATTEN(TOKENIZE(text)) AS word; g = GROUP w BY word; out = FOREACH g GENERATE group AS word, COUNT_STAR(w) AS n;", "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '[ \",()*]+')) AS word FROM benchmark) WHERE word <> '' GROUP BY word"),
    "flatten_product": ("t = TAP 'two_bags' USING ConstantTuples() AS (id:int, p:{(x:int)}, q:{(y:int)}); out = FOREACH t GENERATE id, FLATTEN(p), FLATTEN(q);", "SELECT * FROM (VALUES (1,1,10),(1,1,20),(1,2,10),(1,2,20)) t(id,x,y)"),
    "bag_functions": (
        "t = TAP 'bags' USING ConstantTuples() AS (id:int, b:{(x:int,y:chararray)}); out = FOREACH t { d = DISTINCT b; o = ORDER b BY x DESC; l = LIMIT o 1; f = FILTER b BY y == 'a'; GENERATE id, IsEmpty(b) AS e, SIZE(b) AS n, COUNT(d) AS u, SUM(b.x) AS s, AVG(b.x) AS a, MAX(l.x) AS m, COUNT(f) AS f; };",
        "SELECT * FROM (VALUES (1,false,3::BIGINT,2::BIGINT,5::BIGINT,5/3::DOUBLE,3,2::BIGINT),(2,true,0,0,NULL,NULL,NULL,0),(3,NULL,NULL,NULL,NULL,NULL,NULL,NULL)) t(id,e,n,u,s,a,m,f)",
    ),
    "nested_cross": ("t = TAP 'two_bags' USING ConstantTuples() AS (id:int, p:{(x:int)}, q:{(y:int)}); out = FOREACH t { c = CROSS p, q; GENERATE id, FLATTEN(c); };", "SELECT * FROM (VALUES (1,1,10),(1,1,20),(1,2,10),(1,2,20)) t(id,x,y)"),
    "nested_foreach": ("g = GROUP nation BY n_regionkey; out = FOREACH g { f = FOREACH nation GENERATE n_nationkey * 2 AS k2; GENERATE group AS r, SUM(f.k2) AS s; };", "SELECT n_regionkey AS r, sum(n_nationkey * 2)::BIGINT AS s FROM nation GROUP BY 1"),
    "text_codec_roundtrip": ("t = TAP 'nested' USING ConstantTuples() AS (t:(a:int,b:chararray), g:{(x:int)}, m:map[int]); out = FOREACH t GENERATE (chararray)t AS t, (chararray)g AS g, (chararray)m AS m;", "SELECT * FROM (VALUES ('(1,a)','{(1),(2)}','[k#1,l#2]'),('(2,b)','{}','[k#3]'),(NULL,'{(3)}',NULL)) t(t,g,m)"),
    "ragged_rows": ("t = TAP 'ragged' USING ConstantTuples() AS (a:int, b:chararray, c:double); out = FOREACH t GENERATE a, b, c;", "SELECT * FROM (VALUES (1,'x',2.5::DOUBLE),(2,NULL,NULL),(3,'',NULL),(4,'y',1.0)) t(a,b,c)"),
    # ---- groups
    "group_count": ("g = GROUP orders BY o_orderstatus; out = FOREACH g GENERATE group AS status, COUNT(orders) AS n;", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1"),
    "group_multi_key": (
        "f = FILTER lineitem BY l_discount > 0.02; g = GROUP f BY (l_returnflag, l_linestatus); r = FOREACH g GENERATE FLATTEN(group), COUNT(f) AS n, ROUND_TO(SUM(f.l_quantity), 2) AS qty, ROUND_TO(AVG(f.l_extendedprice), 4) AS price, MIN(f.l_shipdate) AS first, MAX(f.l_tax) AS tax; out = ORDER r BY l_returnflag, l_linestatus;",
        "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 4) AS price, min(l_shipdate) AS first, max(l_tax) AS tax FROM lineitem WHERE l_discount > 0.02 GROUP BY 1, 2",
    ),
    "group_all": ("g = GROUP lineitem ALL; out = FOREACH g GENERATE COUNT_STAR(lineitem) AS n, ROUND_TO(SUM(lineitem.l_quantity), 2) AS q;", "SELECT count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem"),
    "group_null_key": ("a = FOREACH customer GENERATE (c_nationkey == 3 ? null : c_nationkey) AS k, c_acctbal; g = GROUP a BY k; out = FOREACH g GENERATE group AS k, COUNT_STAR(a) AS n, COUNT(a) AS m;", "SELECT nullif(c_nationkey, 3) AS k, count(*) AS n, count(nullif(c_nationkey, 3)) AS m FROM customer GROUP BY 1"),
    "group_flatten": ("g = GROUP supplier BY s_nationkey; out = FOREACH g GENERATE group, FLATTEN(supplier.s_suppkey) AS s;", 'SELECT s_nationkey AS "group", s_suppkey AS s FROM supplier'),
    "group_expr_key": ("g = GROUP lineitem BY l_linenumber % 2; out = FOREACH g GENERATE group AS odd, SUM(lineitem.l_linenumber) AS s, SUM(lineitem.l_linenumber) / COUNT(lineitem) AS mean;", "SELECT l_linenumber % 2 AS odd, sum(l_linenumber)::BIGINT AS s, (sum(l_linenumber) // count(*))::BIGINT AS mean FROM lineitem GROUP BY 1"),
    "having": ("g = GROUP orders BY o_custkey; c = FOREACH g GENERATE group AS k, COUNT(orders) AS n; out = FILTER c BY n > 12L;", "SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12"),
    "count_distinct_nested": ("g = GROUP lineitem BY l_returnflag; out = FOREACH g { s = lineitem.l_suppkey; d = DISTINCT s; GENERATE group AS f, COUNT(d) AS n; };", "SELECT l_returnflag AS f, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1"),
    "top_per_group": ("g = GROUP orders BY o_orderpriority; t = FOREACH g GENERATE group AS p, FLATTEN(TOP(3, 0, orders.(o_orderkey, o_custkey))); out = FOREACH t GENERATE p, o_orderkey, o_custkey;", "SELECT o_orderpriority AS p, o_orderkey, o_custkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey DESC) <= 3"),
    "nested_order_limit": ("g = GROUP lineitem BY l_suppkey; out = FOREACH g { o = ORDER lineitem BY l_extendedprice DESC, l_orderkey, l_linenumber; l = LIMIT o 2; GENERATE group AS s, FLATTEN(l.(l_orderkey, l_linenumber)); };", "SELECT l_suppkey AS s, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 2"),
    "nested_filter_count": ("g = GROUP lineitem BY l_shipdate; out = FOREACH g { f = FILTER lineitem BY l_quantity > 25; GENERATE group AS d, COUNT(f) AS n, ROUND_TO(SUM(f.l_tax), 4) AS t; };", "SELECT l_shipdate AS d, count(*) FILTER (l_quantity > 25) AS n, round(sum(l_tax) FILTER (l_quantity > 25), 4) AS t FROM lineitem GROUP BY 1"),
    "nested_distinct": ("g = GROUP lineitem BY l_returnflag; out = FOREACH g { d = DISTINCT lineitem.(l_linestatus, l_linenumber); GENERATE group AS f, FLATTEN(d); };", "SELECT DISTINCT l_returnflag AS f, l_linestatus, l_linenumber FROM lineitem"),
    "corr_cov": ("g = GROUP lineitem BY l_returnflag; out = FOREACH g GENERATE group AS f, ROUND_TO(COR(lineitem.l_quantity, lineitem.l_extendedprice), 6) AS r, ROUND_TO(COV(lineitem.l_quantity, lineitem.l_discount), 6) AS v;", "SELECT l_returnflag AS f, round(corr(l_quantity, l_extendedprice), 6) AS r, round(covar_pop(l_quantity, l_discount), 6) AS v FROM lineitem GROUP BY 1"),
    "cube_rollup": ("c = CUBE lineitem BY CUBE(l_returnflag, l_linestatus); out = FOREACH c GENERATE FLATTEN(group), COUNT_STAR(cube) AS n;", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"),
    "cogroup_counts": ("g = COGROUP customer BY c_custkey, orders BY o_custkey; out = FOREACH g GENERATE group AS k, COUNT(customer) AS c, COUNT(orders) AS o;", "SELECT coalesce(c_custkey, k) AS k, coalesce(c, 0) AS c, coalesce(o, 0) AS o FROM (SELECT c_custkey, count(*) AS c FROM customer GROUP BY 1) FULL JOIN (SELECT o_custkey AS k, count(*) AS o FROM orders GROUP BY 1) ON c_custkey = k"),
    "cogroup_null_keys": ("l = TAP 'null_l' USING ConstantTuples() AS (k:int, v:chararray); r = TAP 'null_r' USING ConstantTuples() AS (k:int, v:chararray); g = COGROUP l BY k, r BY k; out = FOREACH g GENERATE group AS k, SIZE(l) AS a, SIZE(r) AS b;", "SELECT * FROM (VALUES (1,2::BIGINT,1::BIGINT),(2,1,0),(3,0,1),(NULL,2,0),(NULL,0,1)) t(k,a,b)"),
    "cogroup_compound_null": ("l = TAP 'pair_l' USING ConstantTuples() AS (a:int, b:int, v:chararray); r = TAP 'pair_r' USING ConstantTuples() AS (a:int, b:int, v:chararray); g = COGROUP l BY (a, b), r BY (a, b); out = FOREACH g GENERATE FLATTEN(group), SIZE(l) AS l, SIZE(r) AS r;", "SELECT * FROM (VALUES (1,NULL,1::BIGINT,1::BIGINT),(1,1,1,1)) t(a,b,l,r)"),
    "cogroup_inner": ("g = COGROUP nation BY n_nationkey INNER, supplier BY s_nationkey INNER; out = FOREACH g GENERATE group AS k, SIZE(supplier) AS n;", "SELECT s_nationkey AS k, count(*) AS n FROM supplier SEMI JOIN nation ON n_nationkey = s_nationkey GROUP BY 1"),
    "cogroup_three": ("g = COGROUP nation BY n_nationkey, supplier BY s_nationkey, customer BY c_nationkey; out = FOREACH g GENERATE group AS k, SIZE(nation) AS a, SIZE(supplier) AS b, SIZE(customer) AS c;", "SELECT n_nationkey AS k, 1::BIGINT AS a, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS b, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS c FROM nation"),
    # ---- joins
    "join_inner": ("j = JOIN customer BY c_custkey, orders BY o_custkey; out = FOREACH j GENERATE c_custkey, o_orderkey, c_name;", "SELECT c_custkey, o_orderkey, c_name FROM customer JOIN orders ON c_custkey = o_custkey"),
    "join_left": ("j = JOIN documents BY doc_id LEFT OUTER, labels BY doc_id; out = FOREACH j GENERATE documents::doc_id AS doc_id, labels::quality AS q;", "SELECT d.doc_id, quality AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"),
    "join_right": ("j = JOIN labels BY doc_id RIGHT, documents BY doc_id; out = FOREACH j GENERATE documents::doc_id AS doc_id, toxic AS t;", "SELECT d.doc_id, toxic AS t FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"),
    "join_full": ("a = FILTER orders BY o_orderstatus == 'F' AND o_orderpriority == '1-URGENT'; b = FILTER customer BY c_mktsegment == 'BUILDING'; j = JOIN a BY o_custkey FULL, b BY c_custkey; out = FOREACH j GENERATE o_orderkey, c_custkey;", "SELECT o_orderkey, c_custkey FROM (SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') FULL JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') ON o_custkey = c_custkey"),
    "join_replicated": ("j = JOIN lineitem BY l_suppkey, supplier BY s_suppkey USING 'replicated'; out = FOREACH j GENERATE l_orderkey, l_linenumber, s_name;", "SELECT l_orderkey, l_linenumber, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"),
    "join_merge": ("j = JOIN orders BY o_orderkey, lineitem BY l_orderkey USING 'merge'; out = FOREACH j GENERATE o_orderkey, l_linenumber, o_orderstatus;", "SELECT o_orderkey, l_linenumber, o_orderstatus FROM orders JOIN lineitem ON o_orderkey = l_orderkey"),
    "join_merge_sparse": ("j = JOIN orders BY o_orderkey, lineitem BY l_orderkey USING 'merge-sparse'; out = FOREACH j GENERATE o_orderkey, l_linenumber;", "SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey"),
    "join_skewed": ("j = JOIN events BY user_id, customer BY c_custkey USING 'skewed'; out = FOREACH j GENERATE event_id, c_name;", "SELECT event_id, c_name FROM events JOIN customer ON user_id = c_custkey"),
    "join_three_way": ("s2 = FOREACH supplier GENERATE s_suppkey, s_nationkey; j = JOIN nation BY n_nationkey, s2 BY s_nationkey, customer BY c_nationkey; out = FOREACH j GENERATE n_name, s_suppkey, c_custkey;", "SELECT n_name, s_suppkey, c_custkey FROM nation JOIN supplier ON n_nationkey = s_nationkey JOIN customer ON c_nationkey = n_nationkey"),
    "join_multi_key": ("a = FOREACH lineitem GENERATE l_orderkey, l_linenumber, l_partkey; b = FOREACH lineitem GENERATE l_orderkey AS k, l_linenumber AS n, l_suppkey; j = JOIN a BY (l_orderkey, l_linenumber), b BY (k, n); out = FOREACH j GENERATE l_orderkey, l_linenumber, l_partkey, l_suppkey;", "SELECT a.l_orderkey, a.l_linenumber, a.l_partkey, b.l_suppkey FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber"),
    "join_null_key": ("l = TAP 'null_l' USING ConstantTuples() AS (k:int, v:chararray); r = TAP 'null_r' USING ConstantTuples() AS (k:int, v:chararray); j = JOIN l BY k LEFT, r BY k; out = FOREACH j GENERATE l::k AS k, l::v AS v, r::v AS w;", "SELECT * FROM (VALUES (1,'a','x'),(1,'b','x'),(2,'c',NULL),(NULL,'d',NULL),(NULL,'e',NULL)) t(k,v,w)"),
    "join_expr_key": ("j = JOIN nation BY n_nationkey % 5, region BY r_regionkey; out = FOREACH j GENERATE n_name, r_name;", "SELECT n_name, r_name FROM nation JOIN region ON n_nationkey % 5 = r_regionkey"),
    "join_self": ("n2 = FOREACH nation GENERATE *; j = JOIN nation BY n_regionkey, n2 BY n_regionkey; f = FILTER j BY nation::n_nationkey < n2::n_nationkey; out = FOREACH f GENERATE nation::n_nationkey AS a, n2::n_nationkey AS b;", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"),
    "join_cogroup_flatten": ("g = COGROUP customer BY c_custkey, orders BY o_custkey; j = FOREACH g GENERATE FLATTEN(customer), FLATTEN(orders); out = FOREACH j GENERATE c_custkey, o_orderkey;", "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey"),
    "join_cogroup_outer": ("g = COGROUP customer BY c_custkey, orders BY o_custkey; j = FOREACH g GENERATE FLATTEN(customer.c_custkey) AS k, FLATTEN((IsEmpty(orders) ? TOBAG(TOTUPLE((long)null)) : orders.(o_orderkey))) AS o; out = FOREACH j GENERATE k, o;", "SELECT c_custkey AS k, o_orderkey AS o FROM customer LEFT JOIN orders ON c_custkey = o_custkey"),
    "semi_cogroup": ("g = COGROUP customer BY c_custkey, orders BY o_custkey; f = FILTER g BY NOT IsEmpty(orders); out = FOREACH f GENERATE FLATTEN(customer.(c_custkey, c_name));", "SELECT c_custkey, c_name FROM customer SEMI JOIN orders ON c_custkey = o_custkey"),
    "anti_cogroup": ("g = COGROUP documents BY doc_id, labels BY doc_id; f = FILTER g BY IsEmpty(labels); out = FOREACH f GENERATE FLATTEN(documents.doc_id) AS doc_id;", "SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)"),
    "theta_cross_filter": ("c = CROSS region, nation; f = FILTER c BY r_regionkey > n_regionkey; out = FOREACH f GENERATE r_regionkey, n_nationkey;", "SELECT r_regionkey, n_nationkey FROM region, nation WHERE r_regionkey > n_regionkey"),
    "cross": ("out = CROSS region, nation; out = FOREACH out GENERATE r_name, n_name;", "SELECT r_name, n_name FROM region, nation"),
    # ---- sets, order, rank
    "union_dup": ("a = FOREACH nation GENERATE n_regionkey, n_name; b = FOREACH region GENERATE r_regionkey, r_name; out = UNION a, b, a;", "SELECT n_regionkey, n_name FROM nation UNION ALL SELECT * FROM region UNION ALL SELECT n_regionkey, n_name FROM nation"),
    "union_widths": ("a = FOREACH nation GENERATE n_regionkey, n_name; b = FOREACH region GENERATE r_regionkey; out = UNION a, b;", "SELECT n_regionkey, n_name FROM nation UNION ALL SELECT r_regionkey, NULL FROM region"),
    "union_onschema": ("a = FOREACH nation GENERATE n_regionkey AS k, n_name AS n; b = FOREACH region GENERATE r_name AS r, r_regionkey AS k; out = UNION ONSCHEMA a, b;", "SELECT n_regionkey AS k, n_name AS n, NULL AS r FROM nation UNION ALL SELECT r_regionkey, NULL, r_name FROM region"),
    "distinct": ("a = FOREACH lineitem GENERATE l_returnflag, l_linestatus, l_linenumber; out = DISTINCT a;", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem"),
    "split_branches": ("SPLIT customer INTO a IF c_acctbal > 1000, b IF c_acctbal < 5000; x = FOREACH a GENERATE c_custkey, 'a' AS part; y = FOREACH b GENERATE c_custkey, 'b' AS part; out = UNION x, y;", "SELECT c_custkey, 'a' AS part FROM customer WHERE c_acctbal > 1000 UNION ALL SELECT c_custkey, 'b' FROM customer WHERE c_acctbal < 5000"),
    "split_otherwise": ("n = FOREACH customer GENERATE c_custkey, (c_nationkey == 3 ? null : c_nationkey) AS k; SPLIT n INTO a IF k < 5, out OTHERWISE;", "SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer WHERE NOT coalesce(nullif(c_nationkey, 3) < 5, false)"),
    "order_limit": ("o = ORDER lineitem BY l_extendedprice DESC, l_orderkey, l_linenumber; l = LIMIT o 25; out = FOREACH l GENERATE l_orderkey, l_linenumber, l_extendedprice;", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY 3 DESC, 1, 2 LIMIT 25"),
    "order_desc_nulls": ("n = FOREACH customer GENERATE c_custkey, (c_nationkey == 3 ? null : c_nationkey) AS k; o = ORDER n BY k DESC, c_custkey; r = RANK o; out = FOREACH r GENERATE rank_o AS place, c_custkey, k;", "SELECT row_number() OVER (ORDER BY nullif(c_nationkey, 3) DESC NULLS LAST, c_custkey) AS place, c_custkey, nullif(c_nationkey, 3) AS k FROM customer"),
    "order_star": ("o = ORDER nation BY * DESC; r = RANK o; out = FOREACH r GENERATE rank_o AS place, n_name;", "SELECT row_number() OVER (ORDER BY n_nationkey DESC) AS place, n_name FROM nation"),
    "limit_expr": ("g = GROUP region ALL; c = FOREACH g GENERATE COUNT(region) AS n; o = ORDER nation BY n_nationkey; l = LIMIT o c.n * 2L; out = FOREACH l GENERATE n_nationkey;", "SELECT n_nationkey FROM nation ORDER BY 1 LIMIT 10"),
    "rank_rownum": ("o = ORDER orders BY o_orderkey; r = RANK o; out = FOREACH r GENERATE rank_o AS r, o_orderkey;", "SELECT row_number() OVER (ORDER BY o_orderkey) AS r, o_orderkey FROM orders"),
    "rank_gaps": ("r = RANK part BY p_name DESC, p_size; out = FOREACH r GENERATE rank_part AS r, p_partkey;", "SELECT rank() OVER (ORDER BY p_name DESC, p_size) AS r, p_partkey FROM part"),
    "rank_dense": ("r = RANK part BY p_name DENSE; out = FOREACH r GENERATE rank_part AS r, p_partkey;", "SELECT dense_rank() OVER (ORDER BY p_name) AS r, p_partkey FROM part"),
    "rank_nulls": ("t = TAP 'ranks' USING ConstantTuples() AS (name:chararray, score:int); r = RANK t BY score DESC; out = FOREACH r GENERATE rank_t AS r, name;", "SELECT * FROM (VALUES (1::BIGINT,'a'),(1,'b'),(3,'c'),(4,'d')) t(r,name)"),
    "scalar_ref": ("g = GROUP customer ALL; m = FOREACH g GENERATE AVG(customer.c_acctbal) AS avg; f = FILTER customer BY c_acctbal > m.avg; out = FOREACH f GENERATE c_custkey, (c_acctbal > m.avg * 1.5 ? 1 : 0) AS far;", "SELECT c_custkey, CASE WHEN c_acctbal > a * 1.5::DOUBLE THEN 1 ELSE 0 END AS far FROM customer, (SELECT avg(c_acctbal) AS a FROM customer) WHERE c_acctbal > a"),
    "partition_bind_group": ("a = FOREACH customer GENERATE c_nationkey AS k, c_acctbal AS v; b = FOREACH supplier GENERATE s_nationkey AS k, s_acctbal AS v; p = PARTITION a BY k PARALLEL 4; q = PARTITION b BY k PARALLEL 4; both = BIND p, q; g = COGROUP p BY k, q BY k; out = FOREACH g GENERATE group AS k, COUNT(p) AS a, COUNT(q) AS b;", "SELECT n_nationkey AS k, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS a, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS b FROM nation WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey) OR EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey)"),
    "partition_union": ("a = FOREACH customer GENERATE c_nationkey AS k; b = FOREACH supplier GENERATE s_nationkey AS k; p = PARTITION a BY k PARALLEL 3; q = PARTITION b BY k PARALLEL 3; both = BIND p, q; g = GROUP both BY k; out = FOREACH g GENERATE group AS k, COUNT(both) AS n;", "SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1"),
    # ---- windows
    "window_tumbling": ("w = FOREACH events WINDOW 1 HOURS BY event_type ON ts GENERATE event_type, COUNT(events) AS n; out = FOREACH w GENERATE window_start, event_type, n;", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
    "window_multi_agg": ("w = FOREACH events WINDOW 30 MINUTES BY (event_type, user_id) ON ts GENERATE event_type, user_id, ROUND_TO(SUM(value), 2) AS s, MAX(value) AS m, AVG(value) AS a; out = FOREACH w GENERATE window_start, event_type, user_id, s, m, ROUND_TO(a, 4) AS a;", "SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS window_start, event_type, user_id, round(sum(value), 2) AS s, max(value) AS m, round(avg(value), 4) AS a FROM events GROUP BY 1, 2, 3"),
    "window_then_order_limit": ("w = FOREACH events WINDOW 1 HOURS BY event_type ON ts GENERATE event_type, COUNT(events) AS n; o = ORDER w BY n DESC, window_start, event_type; l = LIMIT o 20; out = FOREACH l GENERATE window_start, event_type, n;", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 20"),
    "window_distinct_users": ("w = FOREACH events WINDOW 1 HOURS BY event_type ON ts { d = DISTINCT events.user_id; GENERATE event_type, COUNT(d) AS n; }; out = FOREACH w GENERATE window_start, event_type, n;", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(DISTINCT user_id) AS n FROM events GROUP BY 1, 2"),
    "window_latest": ("w = FOREACH events WINDOW 1 HOURS BY event_type ON ts GENERATE event_type, user_id, COUNT(events) AS n; out = FOREACH w GENERATE window_start, event_type, user_id, n;", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, arg_max(user_id, ts) AS user_id, count(*) AS n FROM events GROUP BY 1, 2"),
    "window_sliding": ("w = FOREACH events WINDOW 2 HOURS SLIDE 1 HOURS BY event_type ON ts GENERATE event_type, COUNT(events) AS n; out = FOREACH w GENERATE window_start, event_type, n;", "SELECT time_bucket(INTERVAL 1 HOUR, ts) - to_hours(k) AS window_start, event_type, count(*) AS n FROM events, (VALUES (0), (1)) t(k) GROUP BY 1, 2"),
    # ---- functions
    "fn_string": ("out = FOREACH customer GENERATE c_custkey, CONCAT(c_name, '-', c_mktsegment) AS c, SUBSTRING(c_name, 3, 6) AS s, INDEXOF(c_name, '#') AS i, LAST_INDEX_OF(c_name, '0') AS l, UPPER(c_name) AS u, LCFIRST(c_name) AS lc, UCFIRST(LOWER(c_name)) AS uc, REPLACE(c_name, '0+', '_') AS r, REGEX_EXTRACT(c_name, '#0*([1-9]\\\\d*)', 1) AS x, STARTSWITH(c_name, 'Cust') AS st, TRIM(CONCAT(' ', c_mktsegment, ' ')) AS t, SIZE(c_name) AS n, EqualsIgnoreCase(c_mktsegment, 'building') AS b;",
        "SELECT c_custkey, c_name || '-' || c_mktsegment AS c, substr(c_name, 4, 3) AS s, instr(c_name, '#')::INT - 1 AS i, (CASE WHEN contains(c_name, '0') THEN length(c_name) - instr(reverse(c_name), '0') ELSE -1 END)::INT AS l, upper(c_name) AS u, lower(c_name[1]) || c_name[2:] AS lc, 'C' || lower(c_name)[2:] AS uc, regexp_replace(c_name, '0+', '_', 'g') AS r, nullif(regexp_extract(c_name, '#0*([1-9]\\d*)', 1), '') AS x, starts_with(c_name, 'Cust') AS st, c_mktsegment AS t, length(c_name)::BIGINT AS n, c_mktsegment = 'BUILDING' AS b FROM customer"),
    "fn_math": ("out = FOREACH part GENERATE p_partkey, ABS(-p_size) AS a, CEIL(p_retailprice) AS c, FLOOR(p_retailprice) AS f, ROUND(p_retailprice) AS r, ROUND(-p_retailprice) AS q, ROUND_TO(SQRT(p_retailprice), 6) AS s, ROUND_TO(LOG(p_retailprice), 6) AS l, ROUND_TO(SIN(p_retailprice), 6) AS n;", "SELECT p_partkey, p_size AS a, ceil(p_retailprice) AS c, floor(p_retailprice) AS f, floor(p_retailprice + 0.5::DOUBLE)::BIGINT AS r, floor(-p_retailprice + 0.5::DOUBLE)::BIGINT AS q, round(sqrt(p_retailprice), 6) AS s, round(ln(p_retailprice), 6) AS l, round(sin(p_retailprice), 6) AS n FROM part"),
    "fn_date": ("out = FOREACH orders GENERATE o_orderkey, GetYear(o_orderdate) AS y, GetMonth(o_orderdate) AS m, GetDay(o_orderdate) AS d, GetWeek(o_orderdate) AS w, DaysBetween(o_orderdate, ToDate('1995-06-17T00:00:00Z')) AS days, MonthsBetween(o_orderdate, ToDate('1995-06-17T00:00:00Z')) AS months, ToString(o_orderdate, 'yyyy/MM/dd') AS t, ToMilliSeconds(AddDuration(o_orderdate, 'P1DT2H')) AS later;",
        "SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, day(o_orderdate)::INT AS d, weekofyear(o_orderdate)::INT AS w, (epoch_ms(o_orderdate) - epoch_ms(TIMESTAMP '1995-06-17')) // 86400000 AS days, CASE WHEN o_orderdate >= TIMESTAMP '1995-06-17' THEN datesub('month', TIMESTAMP '1995-06-17', o_orderdate) ELSE -datesub('month', o_orderdate, TIMESTAMP '1995-06-17') END AS months, strftime(o_orderdate, '%Y/%m/%d') AS t, epoch_ms(o_orderdate + INTERVAL 26 HOUR) AS later FROM orders"),
    "fn_map_bag": ("g = GROUP nation BY n_regionkey; b = FOREACH g { o = ORDER nation BY n_nationkey; GENERATE group AS r, BagToString(o.n_name, '|') AS s, SIZE(SUBTRACT(nation.n_name, TOBAG('CHINA'))) AS n; }; out = FOREACH b GENERATE r, s, n;", "SELECT n_regionkey AS r, string_agg(n_name, '|' ORDER BY n_nationkey) AS s, count(*) FILTER (n_name <> 'CHINA') AS n FROM nation GROUP BY 1"),
    "fn_map_parts": ("m = FOREACH nation GENERATE n_nationkey, TOMAP('a', n_name, 'b', n_name) AS m; out = FOREACH m GENERATE n_nationkey, SIZE(KEYSET(m)) AS k, SIZE(VALUELIST(m)) AS v, SIZE(VALUESET(m)) AS s;", "SELECT n_nationkey, 2::BIGINT AS k, 2::BIGINT AS v, 1::BIGINT AS s FROM nation"),
    # ---- functions that a session registers
    "udf_scalar": ("out = FOREACH nation GENERATE n_nationkey, Shout(n_name) AS s;", "SELECT n_nationkey, upper(n_name) || '!' AS s FROM nation"),
    "udaf_accumulator": ("g = GROUP lineitem BY l_returnflag; out = FOREACH g GENERATE group AS f, SumSquares(lineitem.l_linenumber) AS s;", "SELECT l_returnflag AS f, sum(l_linenumber * l_linenumber)::BIGINT AS s FROM lineitem GROUP BY 1"),
    "udtf_bag": ("out = FOREACH region GENERATE r_regionkey, FLATTEN(Letters(r_name)) AS c;", "SELECT r_regionkey, unnest(string_split(r_name, '')) AS c FROM region"),
    "stream_through": ("s = STREAM orders THROUGH `scale#by=3` AS (o_orderkey:long, v:long); out = FOREACH s GENERATE o_orderkey, v;", "SELECT o_orderkey, o_custkey * 3 AS v FROM orders"),
    "define_macro": ("DEFINE shortest(rel, n) RETURNS best { s = FOREACH $rel GENERATE *, SIZE($1) AS len; o = ORDER s BY len, $1; $best = LIMIT o $n; }; s = FILTER nation BY n_regionkey != 0; a = shortest(s, 4); b = shortest(region, 2); x = FOREACH a GENERATE n_name AS name; y = FOREACH b GENERATE r_name AS name; out = UNION x, y;", "SELECT n_name AS name FROM (SELECT n_name FROM nation WHERE n_regionkey <> 0 ORDER BY length(n_name), n_name LIMIT 4) UNION ALL SELECT r_name FROM (SELECT r_name FROM region ORDER BY length(r_name), r_name LIMIT 2)"),
}

SCRIPTS["order_using"] = ("o = ORDER part BY p_name, p_partkey USING ByLength; r = RANK o; out = FOREACH r GENERATE rank_o AS place, p_partkey, p_name;", "SELECT row_number() OVER (ORDER BY length(p_name), p_name, length(p_partkey::VARCHAR), p_partkey) AS place, p_partkey, p_name FROM part")

CONSTANTS["typed"] = ["(1,true,1.5,(7,x),{(1),(2)},[a#1])", "(2,false,-2.25,(,y),{},[b#2,a#3])", "(3,,,,,)"]
CONSTANTS["moments"] = ["(2024-01-01T00:00:00.000Z,a,1)", "(2024-01-01T00:00:00.900Z,a,2)", "(2024-01-01T00:00:01.000Z,b,3)", "(2024-01-01T00:00:03.500Z,a,4)", "(2024-01-01T00:00:09.000Z,a,)"]
CONSTANTS["pairs"] = ["(1,a)", "(1,b)", "(1,b)", "(,c)", "(,c)", "(2,a)"]
CONSTANTS["deep"] = ["((1,[a#1,b#2]))", "((1,[b#2,a#1]))", "((2,[a#1]))"]

SCRIPTS |= {
    # ---- more of sources and sinks
    "tap_resource": ("t = TAP 'rivulet/sources/data/colours.tsv' USING PackageResource() AS (name:chararray, v:int, t:(a:int, b:chararray)); out = FOREACH t GENERATE name, v, t.b AS b;", "SELECT * FROM (VALUES ('red', 255, 'a'), ('green', 128, 'b'), (NULL, NULL, NULL), ('blue', NULL, NULL)) t(name, v, b)"),
    "tap_custom": ("t = TAP 'ten' USING Counter(10) AS (part:int, n:long); out = FOREACH t GENERATE part, n;", "SELECT p::INT AS part, n::BIGINT AS n FROM range(3) a(p), range(10) b(n)"),
    "tap_ragged_untyped": ("t = TAP 'ragged' USING ConstantTuples(); out = FOREACH t GENERATE (int)$0 AS a, (chararray)$1 AS b, $3 AS d;", "SELECT * FROM (VALUES (1, 'x', NULL), (2, NULL, NULL), (3, '', NULL), (4, 'y', 'extra')) t(a, b, d)"),
    "sample_share": ("s = SAMPLE lineitem 0.25; g = GROUP s ALL; h = GROUP lineitem ALL; n = FOREACH g GENERATE COUNT_STAR(s) AS n; m = FOREACH h GENERATE COUNT_STAR(lineitem) AS n; out = FOREACH n GENERATE n > 0.22 * m.n AND n < 0.28 * m.n AS near;", "SELECT true AS near"),
    # ---- more casts
    "cast_bytes": ("t = TAP 'numbers' USING ConstantTuples() AS (id:int, s:bytearray); out = FOREACH t GENERATE id, (int)s AS i, (double)s AS d, (chararray)s AS c;", "SELECT * FROM (VALUES (1,12,12.0::DOUBLE,' 12 '),(2,1,1.9,'1.9'),(3,-2,-2.5,'-2.5'),(4,1000,1000.0,'1e3'),(5,NULL,NULL,'12L'),(6,1,1.5,'1.5f'),(7,NULL,NULL,'abc'),(8,NULL,2147483648.0,'2147483648'),(9,NULL,NULL,'true'),(10,NULL,NULL,'TRUE'),(11,NULL,NULL,'t')) t(id,i,d,c)"),
    "cast_bool_to_number": ("out = FOREACH nation GENERATE n_nationkey, (int)(n_nationkey > 12) AS i, (long)(n_nationkey > 12) AS l, (double)(n_nationkey > 12) AS d;", "SELECT n_nationkey, (n_nationkey > 12)::INT AS i, (n_nationkey > 12)::BIGINT AS l, (n_nationkey > 12)::INT::DOUBLE AS d FROM nation"),
    "cast_atom_to_text": ("out = FOREACH events GENERATE event_id, (chararray)(event_id % 2L == 0L) AS b, (chararray)((double)(event_id % 7L) / 4.0) AS d, (chararray)((float)(event_id % 5L)) AS f, (chararray)(int)(event_id % 3L) AS i;", "SELECT event_id, (event_id % 2 = 0)::VARCHAR AS b, ((event_id % 7) / 4)::DOUBLE::VARCHAR AS d, (event_id % 5) || '.0' AS f, (event_id % 3)::VARCHAR AS i FROM events"),
    "cast_nested": ("t = TAP 'typed' USING ConstantTuples() AS (id:int, b:boolean, d:double, t:(a:int, s:chararray), g:{(x:int)}, m:map[int]); c = FOREACH t GENERATE id, (tuple(long, chararray))t AS t, (bag{tuple(double)})g AS g, (map[chararray])m AS m; out = FOREACH c GENERATE id, t.$0 AS a, SIZE(g) AS n, m#'a' AS v;", "SELECT * FROM (VALUES (1, 7::BIGINT, 2::BIGINT, '1'), (2, NULL, 0, '3'), (3, NULL, NULL, NULL)) t(id, a, n, v)"),
    # ---- more groups
    "rollup": ("c = CUBE lineitem BY ROLLUP(l_returnflag, l_linestatus, l_linenumber); out = FOREACH c GENERATE FLATTEN(group), COUNT_STAR(cube) AS n, SUM(cube.l_linenumber) AS s;", "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, sum(l_linenumber)::BIGINT AS s FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus, l_linenumber)"),
    "group_collected": ("g = GROUP orders BY o_custkey USING 'collected'; out = FOREACH g GENERATE group AS k, COUNT(orders) AS n, MAX(orders.o_orderkey) AS m;", "SELECT o_custkey AS k, count(*) AS n, max(o_orderkey) AS m FROM orders GROUP BY 1"),
    "cogroup_merge": ("g = COGROUP orders BY o_custkey, customer BY c_custkey USING 'merge'; out = FOREACH g GENERATE group AS k, COUNT(orders) AS n, MIN(customer.c_nationkey) AS c;", "SELECT c_custkey AS k, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n, c_nationkey AS c FROM customer"),
    "group_parallel": ("g = GROUP lineitem BY l_suppkey PARALLEL 3; out = FOREACH g GENERATE group AS k, SUM(lineitem.l_linenumber) AS s;", "SELECT l_suppkey AS k, sum(l_linenumber)::BIGINT AS s FROM lineitem GROUP BY 1"),
    "join_parallel": ("j = JOIN orders BY o_custkey, customer BY c_custkey PARALLEL 5; d = FOREACH j GENERATE o_orderkey, c_nationkey; out = DISTINCT d PARALLEL 2;", "SELECT DISTINCT o_orderkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey"),
    "distinct_of_filtered": ("g = GROUP lineitem BY l_returnflag; out = FOREACH g { f = FILTER lineitem BY l_quantity > 40.0; d = DISTINCT f; p = f.l_suppkey; e = DISTINCT p; GENERATE group AS r, COUNT(d) AS n, COUNT(e) AS s, SUM(e) AS t, MAX(e) AS m; };", "SELECT l_returnflag AS r, count(*) FILTER (l_quantity > 40) AS n, count(DISTINCT l_suppkey) FILTER (l_quantity > 40) AS s, (sum(DISTINCT l_suppkey) FILTER (l_quantity > 40))::BIGINT AS t, max(l_suppkey) FILTER (l_quantity > 40) AS m FROM lineitem GROUP BY 1"),
    "distinct_whole_tuples": ("t = TAP 'pairs' USING ConstantTuples() AS (k:int, v:chararray); g = GROUP t BY v; out = FOREACH g { f = FILTER t BY v != 'z'; d = DISTINCT f; GENERATE group AS v, COUNT(d) AS n, COUNT(t) AS every, COUNT_STAR(t) AS stars; };", "SELECT * FROM (VALUES ('a', 2::BIGINT, 2::BIGINT, 2::BIGINT), ('b', 1, 2, 2), ('c', 0, 0, 2)) t(v, n, every, stars)"),
    "distinct_deep_maps": ("t = TAP 'deep' USING ConstantTuples() AS (t:(k:int, m:map[])); d = DISTINCT t; g = GROUP d ALL; out = FOREACH g GENERATE COUNT_STAR(d) AS n;", "SELECT 2::BIGINT AS n"),
    "approx_distinct": ("g = GROUP lineitem BY l_returnflag; c = FOREACH g { s = lineitem.l_partkey; d = DISTINCT s; GENERATE group AS r, APPROX_COUNT_DISTINCT(lineitem.l_partkey) AS a, COUNT(d) AS n; }; out = FOREACH c GENERATE r, a > 0.85 * n AND a < 1.15 * n AS near;", "SELECT DISTINCT l_returnflag AS r, true AS near FROM lineitem"),
    "stddev": ("g = GROUP part BY p_brand; out = FOREACH g GENERATE group AS b, ROUND_TO(STDDEV(part.p_retailprice), 4) AS d;", "SELECT p_brand AS b, round(stddev_samp(p_retailprice), 4) AS d FROM part GROUP BY 1"),
    "cogroup_three_aggregates": ("g = COGROUP customer BY c_nationkey INNER, supplier BY s_nationkey, nation BY n_nationkey; out = FOREACH g { rich = FILTER customer BY c_acctbal > 5000.0; GENERATE group AS k, COUNT(rich) AS rich, SUM(supplier.s_suppkey) AS s, (IsEmpty(supplier) ? 'none' : 'some') AS e, COUNT(customer) + COUNT(nation) AS both; };", "SELECT n_nationkey AS k, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 5000) AS rich, (SELECT sum(s_suppkey)::BIGINT FROM supplier WHERE s_nationkey = n_nationkey) AS s, CASE WHEN EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey) THEN 'some' ELSE 'none' END AS e, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + 1 AS both FROM nation WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey)"),
    "anti_null_keys": ("l = TAP 'null_l' USING ConstantTuples() AS (k:int, v:chararray); r = TAP 'null_r' USING ConstantTuples() AS (k:int, v:chararray); g = COGROUP l BY k, r BY k; f = FILTER g BY IsEmpty(r) AND NOT IsEmpty(l); out = FOREACH f GENERATE FLATTEN(l);", "SELECT * FROM (VALUES (2, 'c'), (NULL, 'd'), (NULL, 'e')) t(k, v)"),
    "aggregate_registered": ("g = GROUP lineitem BY l_returnflag; out = FOREACH g { f = FILTER lineitem BY l_linenumber > 2; GENERATE group AS f, Squares(lineitem.l_linenumber) AS s, Squares(f.l_linenumber) AS t, Middle(lineitem.l_linenumber) AS m; };", "SELECT l_returnflag AS f, sum(l_linenumber * l_linenumber)::BIGINT AS s, (sum(l_linenumber * l_linenumber) FILTER (l_linenumber > 2))::BIGINT AS t, median(l_linenumber)::DOUBLE AS m FROM lineitem GROUP BY 1"),
    # ---- sets, windows of rows, comparators
    "intersect_rows": ("a = FOREACH customer GENERATE c_nationkey AS k; b = FOREACH supplier GENERATE s_nationkey AS k; out = INTERSECT a, b;", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier"),
    "except_rows": ("a = FOREACH orders GENERATE o_custkey AS k; b = FOREACH customer GENERATE c_custkey AS k; c = FILTER b BY k % 3L == 0L; out = EXCEPT b, a; ", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders"),
    "except_all_rows": ("a = FOREACH customer GENERATE c_nationkey AS k; b = FOREACH supplier GENERATE s_nationkey AS k; out = EXCEPT ALL a, b;", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier"),
    "over_windows": ("out = FOREACH orders GENERATE o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n, LAG(o_orderkey, 1) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before, COUNT(o_orderkey) OVER (PARTITION BY o_custkey) AS all_, SUM(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS 2 PRECEDING) AS three;", "SELECT o_orderkey, row_number() OVER w AS n, lag(o_orderkey) OVER w AS before, count(o_orderkey) OVER (PARTITION BY o_custkey) AS all_, (sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS 2 PRECEDING))::BIGINT AS three FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"),
    "order_comparator": ("o = ORDER part BY p_size, p_partkey USING EvenFirst; r = RANK o; out = FOREACH r GENERATE rank_o AS place, p_partkey;", "SELECT row_number() OVER (ORDER BY p_size % 2, p_size DESC, p_partkey) AS place, p_partkey FROM part"),
    # ---- windows of time
    "window_sum_distinct": ("w = FOREACH events WINDOW 1 HOURS BY event_type ON ts { d = DISTINCT events.user_id; GENERATE event_type, COUNT(d) AS n, SUM(d) AS s, MAX(d) AS m, MIN(d) AS l, ROUND_TO(AVG(d), 6) AS a; }; out = FOREACH w GENERATE window_start, event_type, n, s, m, l, a;", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(DISTINCT user_id) AS n, sum(DISTINCT user_id)::BIGINT AS s, max(user_id) AS m, min(user_id) AS l, round(avg(DISTINCT user_id), 6) AS a FROM events GROUP BY 1, 2"),
    "window_distinct_tuples": ("p = FOREACH events GENERATE event_type, user_id % 3L AS u, ts; q = FOREACH p GENERATE event_type, u, (datetime)(((long)ts) / 86400000L * 86400000L) AS day; w = FOREACH q WINDOW 24 HOURS BY event_type ON day { d = DISTINCT q; GENERATE event_type, COUNT(d) AS n; }; out = FOREACH w GENERATE window_start, event_type, n;", "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(DISTINCT user_id % 3) AS n FROM events GROUP BY 1, 2"),
    "window_session": ("w = FOREACH events WINDOW SESSION 30 MINUTES DELAY 5 MINUTES BY event_type ON ts GENERATE event_type, COUNT(events) AS n; out = FOREACH w GENERATE window_start, window_end, event_type, n;", "SELECT min(ts) AS window_start, max(ts) + INTERVAL 30 MINUTE AS window_end, event_type, count(*) AS n FROM (SELECT *, sum(starts) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS starts FROM events)) GROUP BY event_type, s"),
    "window_all_null": ("t = TAP 'moments' USING ConstantTuples() AS (at:datetime, k:chararray, v:long); w = FOREACH t WINDOW 1 SECONDS BY k ON at GENERATE SUM(v) AS s, MAX(v) AS m; out = FOREACH w GENERATE window_start, s, m;", "SELECT TIMESTAMP '2024-01-01' + to_seconds(k) AS window_start, s, m FROM (VALUES (0, 3::BIGINT, 2::BIGINT), (1, 3, 3), (3, 4, 4)) t(k, s, m)"),
    "window_expressions": ("w = FOREACH events WINDOW 6 HOURS BY event_type ON ts GENERATE UPPER(event_type) AS e, COUNT(events) * 2L + 1L AS n, ROUND_TO(MAX(value) - MIN(value), 4) AS range_, Squares(user_id) AS q; out = FOREACH w GENERATE window_start, e, n, range_, q;", "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, upper(event_type) AS e, count(*) * 2 + 1 AS n, round(max(value) - min(value), 4) AS range_, sum(user_id * user_id)::BIGINT AS q FROM events GROUP BY 1, event_type"),
    # ---- more functions
    "fn_text_more": ("out = FOREACH customer GENERATE c_custkey, LTRIM(CONCAT('  ', c_name)) AS l, RTRIM(CONCAT(c_name, '  ')) AS r, ENDSWITH(c_name, '7') AS e, REVERSE(c_mktsegment) AS v, SIZE(STRSPLIT(c_name, '0', -1)) AS s, REGEX_EXTRACT_ALL(c_name, '(\\\\w+)#0*(\\\\d+)') AS x; out = FOREACH out GENERATE c_custkey, l, r, e, v, s, x._0 AS a, x._1 AS b;", "SELECT c_custkey, c_name AS l, c_name AS r, ends_with(c_name, '7') AS e, reverse(c_mktsegment) AS v, len(string_split(c_name, '0'))::BIGINT AS s, regexp_extract(c_name, '(\\w+)#0*(\\d+)', 1) AS a, regexp_extract(c_name, '(\\w+)#0*(\\d+)', 2) AS b FROM customer"),
    "fn_math_more": ("a = FOREACH part GENERATE p_partkey, (double)p_size / 100.0 AS x; out = FOREACH a GENERATE p_partkey, ROUND_TO(CBRT(x), 6) AS cb, ROUND_TO(EXP(x), 6) AS ex, ROUND_TO(COS(x), 6) AS co, ROUND_TO(TAN(x), 6) AS ta, ROUND_TO(ASIN(x), 6) AS asi, ROUND_TO(ACOS(x), 6) AS aco, ROUND_TO(ATAN(x), 6) AS ata, ROUND_TO(SINH(x), 6) AS sh, ROUND_TO(COSH(x), 6) AS ch, ROUND_TO(TANH(x), 6) AS th, ROUND_TO(LOG10(x), 6) AS l, RANDOM() < 1.0 AS r;", "SELECT p_partkey, round(cbrt(x), 6) AS cb, round(exp(x), 6) AS ex, round(cos(x), 6) AS co, round(tan(x), 6) AS ta, round(asin(x), 6) AS asi, round(acos(x), 6) AS aco, round(atan(x), 6) AS ata, round(sinh(x), 6) AS sh, round(cosh(x), 6) AS ch, round(tanh(x), 6) AS th, round(log10(x), 6) AS l, true AS r FROM (SELECT p_partkey, p_size::DOUBLE / 100 AS x FROM part)"),
    "fn_date_more": ("out = FOREACH events GENERATE event_id, SecondsBetween(ts, ToDate('2024-01-10T00:00:00Z')) AS s, MinutesBetween(ts, ToDate('2024-01-10T00:00:00Z')) AS m, HoursBetween(ts, ToDate('2024-01-10T00:00:00Z')) AS h, WeeksBetween(ts, ToDate('2024-01-10T00:00:00Z')) AS w, MilliSecondsBetween(ts, ToDate('2024-01-10T00:00:00Z')) AS ms, YearsBetween(ts, ToDate('2021-03-01T00:00:00Z')) AS y, GetHour(ts) AS gh, GetMinute(ts) AS gm, GetSecond(ts) AS gs, GetMilliSecond(ts) AS gms, GetWeekYear(ts) AS gy, ToUnixTime(ts) AS u, ToMilliSeconds(SubtractDuration(ts, 'PT90M')) AS b, CurrentTime() > ToDate('2024-01-01T00:00:00Z') AS c;",
        "SELECT event_id, trunc(d / 1000)::BIGINT AS s, trunc(d / 60000)::BIGINT AS m, trunc(d / 3600000)::BIGINT AS h, trunc(d / 604800000)::BIGINT AS w, d AS ms, datesub('year', TIMESTAMP '2021-03-01', ts) AS y, hour(ts)::INT AS gh, minute(ts)::INT AS gm, second(ts)::INT AS gs, (e % 1000)::INT AS gms, isoyear(ts)::INT AS gy, e // 1000 AS u, e - 5400000 AS b, true AS c FROM (SELECT *, epoch_us(ts) // 1000 AS e, epoch_us(ts) // 1000 - epoch_ms(TIMESTAMP '2024-01-10') AS d FROM events)"),
    "fn_bag_more": ("g = GROUP nation BY n_regionkey; b = FOREACH g GENERATE group AS r, SIZE(BagToTuple(nation.(n_nationkey, n_name))) AS t, SIZE(DIFF(nation.n_name, TOBAG('CHINA'))) AS d, INVERSEMAP(TOMAP('x', 'one', 'y', 'one', 'z', 'two')) AS m; out = FOREACH b GENERATE r, t, d, SIZE(m) AS k, SIZE(m#'one') AS o;", "SELECT n_regionkey AS r, 2 * count(*) AS t, count(*) FILTER (n_name <> 'CHINA') + (CASE WHEN bool_or(n_name = 'CHINA') THEN 0 ELSE 1 END) AS d, 2::BIGINT AS k, 2::BIGINT AS o FROM nation GROUP BY 1"),
    "udf_managed": ("out = FOREACH nation GENERATE n_nationkey, Tagged(n_name, n_regionkey) AS t;", "SELECT n_nationkey, 'tag:' || n_name || ':' || n_regionkey AS t FROM nation"),
    "stream_stateful": ("e = FOREACH events GENERATE event_type, user_id; s = STREAM e THROUGH `tally` AS (event_type:chararray, n:long); out = FOREACH s GENERATE event_type, n;", "SELECT event_type, count(*) AS n FROM events GROUP BY 1"),
}


def _scale(frames, by="1"):
    for f in frames:
        yield pd.DataFrame({"o_orderkey": f["o_orderkey"], "v": f["o_custkey"] * int(by)})


def _tally(key, frames, state):
    n = (state.get[0] if state.exists else 0) + sum(map(len, frames))
    state.update((n,))
    yield pd.DataFrame({"event_type": [key[0]], "n": [n]})


def _even_first(a: tuple, b: tuple) -> int:
    x, y = (a[0] % 2, -a[0], a[1]), (b[0] % 2, -b[0], b[1])
    return (x > y) - (x < y)


class _Tagged(Function):
    def prepare(self, config):
        self.tag = config.get("tag", "none")

    def call(self, name, region):
        return f"{self.tag}:{name}:{region}"


class _Counter(Tap):
    """Three tasks that count to what they are told."""

    schema, parallelism = "part int, n bigint", 3

    def open(self, path, args, part):
        self.part, self.end, self.n = part, int(args[0]), 0

    def next(self):
        self.n += 1
        return (self.part, self.n - 1) if self.n <= self.end else None


def session(spark: SparkSession, **how) -> Session:
    """A session with the functions that the registered scripts name."""
    s = Session(spark, out=lambda _: None, config={"functions": {"Tagged": {"tag": "tag"}}}, **how)
    s.register_function("Shout", F.pandas_udf(lambda x: x.str.upper() + "!", "string"))
    s.register_aggregate("SumSquares", lambda c: F.sum(c * c), lambda b: F.aggregate(F.filter(b, lambda x: x.isNotNull()), F.lit(None).cast("long"), lambda a, x: F.coalesce(a, F.lit(0)) + x * x))
    s.register_function("Letters", lambda c: F.transform(F.split(c, ""), lambda x: F.struct(x.alias("c"))))
    s.register_aggregate("Squares", lambda c: F.sum(c * c))
    s.register_aggregate("Middle", lambda c: F.median(c))
    s.register_managed("Tagged", _Tagged, "string")
    s.register_tap("Counter", _Counter)
    s.register_stream("tally", _tally, keys=["event_type"], state="n long")
    s.register_comparator("EvenFirst", compare=_even_first)
    s.register_comparator("ByLength", lambda c: F.struct(F.length(c.cast("string")), c))
    s.register_stream("scale", _scale)
    return s


def prepared(script: str) -> str:
    """The script after loads of the tables that it names."""
    used = [t for t in TABLES if re.search(rf"(?<!['/\w.]){t}\b(?!')", script)]
    return "".join(f"{t} = LOAD '$sf/{t}.parquet';\n" for t in used) + script


def plain(df: DataFrame) -> DataFrame:
    """Timestamps without a zone, as the tables have them."""
    return df.select(*(F.col(f"`{f.name}`").cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f"`{f.name}`") for f in df.schema))


def query(script: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = session(spark).load(prepared(script), {"sf": sf_dir}).relation("out")
        with settings(spark):
            return plain(out)

    return run


def _streamed(spark: SparkSession, sf_dir: str, name: str, alias: str = "events") -> Session:
    """A streaming session in which a table arrives as a stream, and the script of a query is loaded."""
    rows = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/{alias}.parquet").schema).parquet(f"{sf_dir}/{alias}.parque[t]")  # a pattern: the source would take a file's path for a folder's
    s = session(spark, stream=True)
    s.register_frame(alias, rows)
    return s.load(SCRIPTS[name][0])


def _complete(spark: SparkSession, out: DataFrame) -> DataFrame:
    name = f"windows_{uuid.uuid4().hex}"
    q = out.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{shared_dir(spark)}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return plain(spark.table(name))


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly counts as a streaming query over the events, run to its end; all windows, as a batch has them."""
    with settings(spark):
        return _complete(spark, _streamed(spark, sf_dir, "window_tumbling").relation("out"))


def stream_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregates of distinct values in the windows of a stream, where sets are kept."""
    with settings(spark):
        return _complete(spark, _streamed(spark, sf_dir, "window_sum_distinct").relation("out"))


def stream_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables of two rows and more that arrive one after the other: STORE keeps the rows of both batches."""
    where = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    for k, name in enumerate(("region", "nation")):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").selectExpr(f"cast({'r_regionkey' if name == 'region' else 'n_nationkey'} AS bigint) AS k").coalesce(1).write.mode("append").parquet(f"{where}/in")
        with settings(spark):
            s = Session(spark, stream=True, config={"checkpoint": f"{where}/state"})
            s.register_frame("t", spark.readStream.schema("k bigint").parquet(f"{where}/in"))
            s.run(f"f = FILTER t BY k >= 1L; STORE f INTO '{where}/out.parquet';")
            s.wait()
    return spark.read.parquet(f"{where}/out.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written by STORE and read by TAP in each form of files."""
    where, parts = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}", []
    forms = {"TextLines": "", "CSV": ".csv", "JSON": ".json", "ORC": ".orc", "Parquet": ".parquet"}
    s = session(spark)
    s.run(f"n = LOAD '{sf_dir}/nation.parquet'; " + "".join(f"STORE n INTO '{where}/{k}{end}'; " for k, end in forms.items()))
    s.load("".join(f"t_{k} = TAP '{where}/{k}{end}'" + (" AS (n_nationkey:int, n_name:chararray, n_regionkey:int)" if k in ("TextLines", "CSV") else "") + f"; x_{k} = FOREACH t_{k} GENERATE '{k}' AS form, (int)n_nationkey AS n_nationkey, n_name, (int)n_regionkey AS n_regionkey; " for k, end in forms.items()))
    return s.load("out = UNION ONSCHEMA " + ", ".join(f"x_{k}" for k in forms) + ";").relation("out")


def dumped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that DUMP hands to a dumper."""
    kept = sinks.ListDumper()
    s = session(spark)
    s.register_dumper("Keep", lambda: kept)
    s.run(prepared("g = GROUP nation BY n_regionkey; c = FOREACH g GENERATE group, COUNT(nation); DUMP c USING Keep();"), {"sf": sf_dir})
    return spark.createDataFrame(kept.rows, "r int, n bigint")


def inspected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What DESCRIBE, EXPLAIN, the graph and the places of errors say."""
    said: list[str] = []
    s = Session(spark, out=said.append)
    s.run(f"n = LOAD '{sf_dir}/nation.parquet';\ng = GROUP n BY n_regionkey;\nDESCRIBE g; EXPLAIN n;")
    rows = [("describe", said[0]), ("explain", str("Scan parquet" in said[1])), ("dot", str('"n" -> "g"' in s.dot()))]
    for name, script in (("syntax", "x = FILTER n\n  BY;"), ("name", "x = FOREACH n GENERATE nothing;"), ("cast", "x = FOREACH n GENERATE (datetime)(n_name == 'a');"), ("window", "x = FOREACH n WINDOW 1 SECONDS { o = ORDER n BY n_name; GENERATE COUNT(o); };"), ("arity", "x = COGROUP n BY (n_name, n_nationkey), g BY group;")):
        try:
            s.load(script).relation("x")
        except FlowError as e:
            rows.append((name, f"{e.code} {e.line}:{e.column}" if e.line else str(e.code)))
    c = Config({"a": "1", "functions": {"f": {"a": "2", "b": "x, y"}}, "aliases": {"r": {"a": "3"}}})
    rows.append(("config", f"{c.number('a'):g} {c.number('a', function='f'):g} {c.number('a', function='f', alias='r'):g} {','.join(c.names('b', function='f'))} {c.flag('none')}"))
    return spark.createDataFrame(rows, "what string, said string")


def monitored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that a monitor counts of a stream over the events."""
    reports: list[dict] = []
    m = monitor.attach(spark, reports.append)
    try:
        with settings(spark):
            s = _streamed(spark, sf_dir, "window_tumbling")
            q = s.relation("out").writeStream.outputMode("complete").format("noop").queryName(f"counted_{uuid.uuid4().hex}").option("checkpointLocation", f"{shared_dir(spark)}/counted-{uuid.uuid4().hex}").trigger(availableNow=True).start()
            q.awaitTermination()
            for _ in range(100):  # reports come a little later
                if sum(r["rows"] for r in reports if r["query"] == q.name):
                    break
                time.sleep(0.1)
    finally:
        spark.streams.removeListener(m)
    return spark.createDataFrame([(sum(r["rows"] for r in reports if r["query"] == q.name), all(r["ms"] >= 0 for r in reports))], "rows bigint, timed boolean")


#: Queries that aren't one script, and SQL with the same rows.
OTHERS: dict[str, tuple[Callable, str]] = {
    "stream_tumbling_equals_batch": (stream_tumbling, SCRIPTS["window_tumbling"][1]),
    "stream_window_distinct": (stream_distinct, SCRIPTS["window_sum_distinct"][1]),
    "stream_store_batches": (stream_store, "SELECT n_nationkey::BIGINT AS k FROM nation WHERE n_nationkey >= 1 UNION ALL SELECT r_regionkey FROM region WHERE r_regionkey >= 1"),
    "store_and_tap_files": (files, "SELECT form, nation.* FROM nation, (VALUES ('TextLines'), ('CSV'), ('JSON'), ('ORC'), ('Parquet')) t(form)"),
    "dump_rows": (dumped, "SELECT n_regionkey AS r, count(*) AS n FROM nation GROUP BY 1"),
    "inspect": (inspected, "SELECT * FROM (VALUES ('describe', 'g: {group: int, n: {(n_nationkey: int, n_name: chararray, n_regionkey: int)}}'), ('explain', 'True'), ('dot', 'True'), ('syntax', '1000 2:5'), ('name', '1025 1:24'), ('cast', '1052'), ('window', '1010 1:34'), ('arity', '1008 1:1'), ('config', '1 2 3 x,y False')) t(what, said)"),
    "monitor_counts": (monitored, "SELECT count(*) AS rows, true AS timed FROM events"),
}


def queries() -> dict[str, Callable]:
    return {name: query(script) for name, (script, _) in SCRIPTS.items()} | {name: f for name, (f, _) in OTHERS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in SCRIPTS.items() if sql} | {name: sql for name, (_, sql) in OTHERS.items()}
