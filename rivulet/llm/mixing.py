"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Documents fall into BLOCKS blocks of each source by a hash. A source's target in words becomes an exact quota of
blocks: whole passes over all its blocks, and a last pass over the first blocks of a permutation, of which the last may
be taken in part. The tree halves the vector of quotas again and again: at each node the blocks that go left are drawn
source by source from the hypergeometric distribution, until each output shard knows its exact number of blocks of
every source. Each source's permuted blocks are then dealt to the shards in disjoint runs, and a shard orders its
documents by a hash. All of it is DataFrame expressions, and all that looks random is an MD5, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rivulet.llm.common import checkpoint, free, row_hash, shuffle_partitions

#: Blocks of a source: 16 to the power of the hex digits of a hash that name one.
BLOCK_DIGITS = 3
WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
SHARDS = 16
WORD = r"[^\x20\x09-\x0D]+"


def words(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hex(column, digits: int) -> F.Column:
    return F.conv(F.substring(column, 1, digits), 16, 10).cast("long")


def _mark(*columns) -> F.Column:
    """MD5 of the columns as text, null as an empty one."""
    return F.md5(F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)).cast("binary"))


def _text_mark(doc_id, source, text) -> F.Column:
    """What rows that are equal in id, source and text, and no others, have in common."""
    parts = [F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit("|"), c.cast("string")), F.lit("-")) for c in (doc_id, source, text)]
    return F.md5(F.concat(*parts).cast("binary"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """source, source_size, rank and target of each row (source, source_size): one row a source.

    The sources, ordered by code point with null last, weigh as given, repeating. All words are shared by weight; a
    target stops at cap times its source's size, and the excess is shared again. That is one water level: the sources
    ordered by size / weight are full up to some place, and the level follows from what is left beyond it.
    """
    order, n = Window.orderBy(F.col("source").asc_nulls_last()), len(weights)  # one row a source, not one a document
    d = sizes.withColumn("rank", F.row_number().over(order).cast("long"))
    d = d.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % n + 1).cast("int")))
    d = d.withColumn("full", F.lit(cap) * F.col("source_size"))
    up = Window.orderBy(F.col("full") / F.col("weight"), "rank")
    everything = Window.partitionBy()
    d = d.withColumn("below", F.coalesce(F.sum("full").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    d = d.withColumn("left", F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing))).withColumn("total", F.sum("source_size").over(everything).cast("double"))
    d = d.withColumn("level", (F.col("total") - F.col("below")) / F.col("left"))
    d = d.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("full"), F.col("level"))).over(everything))
    d = d.withColumn("target", F.least(F.col("full"), F.coalesce("level", F.lit(float("inf"))) * F.col("weight")))
    return d.select("source", "source_size", "rank", "target")


#: The q-quantile (0 <= q < 1) of the number of good ones among drawn of total, where x has these four. The
#: probabilities, as multiples of the first, are summed within 9 deviations of the mean, beyond which no double shows
#: them. Each let() binds what is used more than once.
_QUANTILE = """
let(named_struct('x', {x}, 'mean', {x}.drawn * {x}.good / greatest({x}.total, 1L)), m ->
let(named_struct('x', m.x, 'mean', m.mean, 'far', 9 + 9 * sqrt(greatest(m.mean * (1 - m.x.good / greatest(m.x.total, 1L)), 0))), f ->
let(named_struct('good', f.x.good, 'drawn', f.x.drawn, 'bad', f.x.total - f.x.good - f.x.drawn, 'q', f.x.q,
    'low', greatest(0L, f.x.drawn - f.x.total + f.x.good, bigint(floor(f.mean - f.far))),
    'high', least(f.x.good, f.x.drawn, bigint(ceil(f.mean + f.far)))), r ->
let(named_struct('r', r, 'steps', if(r.high > r.low, sequence(r.low, r.high - 1), cast(array() as array<bigint>))), s ->
let(named_struct('r', s.r, 'steps', s.steps, 'goal', s.r.q * aggregate(s.steps, named_struct('p', 1D, 's', 1D), (a, k) ->
    let(named_struct('s', a.s, 'p', a.p * ((s.r.good - k) * (s.r.drawn - k) / ((k + 1) * (s.r.bad + k + 1)))), n -> named_struct('p', n.p, 's', n.s + n.p)), a -> a.s)), g ->
g.r.low + aggregate(g.steps, named_struct('p', 1D, 's', 1D, 'passed', 0L), (a, k) ->
    let(named_struct('s', a.s, 'p', a.p * ((g.r.good - k) * (g.r.drawn - k) / ((k + 1) * (g.r.bad + k + 1))), 'passed', a.passed + if(a.s < g.goal, 1L, 0L)), n -> named_struct('p', n.p, 's', n.s + n.p, 'passed', n.passed)), a -> a.passed))))))
"""


def _let(sql: str) -> str:
    """SQL in which each let(value, name -> body) is a transform of a one-element array."""
    out, at = sql, 0
    while (at := out.find("let(", at)) >= 0:
        depth, comma, i = 1, -1, at + 4
        while depth:
            depth += (out[i] == "(") - (out[i] == ")")
            if depth == 1 and out[i] == "," and comma < 0:
                comma = i
            i += 1
        out = f"{out[:at]}get(transform(array({out[at + 4 : comma]}), {out[comma + 1 : i - 1]}), 0){out[i:]}"
    return out


def split(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """rank, source and an array of the blocks that each shard gets, from one row a source with its quota of blocks.

    The tree has one row a node; its vector has one entry a source. Left subtrees get half of a node's blocks, rounded
    down. shards is a power of two.
    """
    if shards < 1 or shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    nodes = quotas.agg(F.array_sort(F.collect_list(F.struct("rank", "quota"))).alias("v")).select(F.lit(1).cast("long").alias("node"), F.transform("v", lambda x: x.quota).alias("v"))
    while shards > 1:
        shards //= 2
        uniform = f"cast(conv(substring(md5(binary(concat_ws('|', 'split {seed}', string(node), string(size(a.left))))), 1, 12), 16, 10) as double) / {16**12}D"
        drawn = _QUANTILE.replace("{x}", "y")
        fold = f"""aggregate(v, let(aggregate(v, 0L, (t, y) -> t + y), t -> named_struct('total', t, 'drawn', bigint(floor(t / 2)), 'left', cast(array() as array<bigint>))), (a, x) ->
            let(named_struct('a', a, 'x', x, 'got', let(named_struct('total', a.total, 'good', x, 'drawn', a.drawn, 'q', {uniform}), y -> {drawn})), z ->
                named_struct('total', z.a.total - z.x, 'drawn', z.a.drawn - z.got, 'left', concat(z.a.left, array(z.got)))), a -> a.left)"""
        nodes = nodes.withColumn("l", F.expr(_let(fold)))
        sides = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("l").alias("v")), F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("v", "l", lambda a, b: a - b).alias("v")))
        nodes = nodes.select(F.explode(sides).alias("x")).select("x.node", "x.v")
    each = nodes.select("node", F.posexplode("v").alias("at", "n"))
    return each.groupBy((F.col("at") + 1).cast("long").alias("rank")).agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "n"))), lambda x: x.n).alias("dealt"))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, shards: int = SHARDS, seed: int = 1, marked: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and shards of every row.

    shards lists the output shard of each time that the mix takes the document; taken is its size times their number.
    Texts of any length are counted whole. Empty and null texts have size 0 and count for nothing; a null source is a source, a null id an id like any other.
    Rows with the same id and source share a block and are taken as often as their place in it says. Other columns of
    docs have no part in it, but that marked adds mark, which rows equal in id, source and text have in common.
    """
    mark = [_text_mark(F.col(doc_id).cast("long"), F.col(source), F.col(text)).alias("mark")] if marked else []
    key = lambda *c: _mark(F.lit(str(seed)), *c)
    sized = checkpoint(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), words(F.col(text)).alias("size"), *mark).withColumn("block", _hex(key(F.col("doc_id")), BLOCK_DIGITS)))
    blocks = checkpoint(sized.groupBy("source", "block").agg(F.sum("size").alias("block_size")))
    goal = targets(blocks.groupBy("source").agg(F.sum("block_size").alias("source_size")), weights, cap)
    goal = goal.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = checkpoint(goal.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")))
    b = blocks.withColumnRenamed("source", "s").join(goal, F.col("s").eqNullSafe(F.col("source"))).drop("s")
    turn = lambda p: Window.partitionBy("rank").orderBy(key(F.col("source"), F.col("block"), p), "block")
    tail = turn(F.col("passes"))
    b = b.withColumn("before", F.coalesce(F.sum("block_size").over(tail.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    b = b.withColumn("room", F.col("rest") - F.col("before")).withColumn("whole", F.col("room") >= F.col("block_size")).withColumn("part", (F.col("room") > 0) & ~F.col("whole"))
    b = b.withColumn("tail_at", F.row_number().over(tail) - 1).withColumn("n_blocks", F.count("*").over(Window.partitionBy("rank")))
    at = [F.when(F.col("passes") == p, F.col("tail_at")).otherwise(F.row_number().over(turn(F.lit(p))) - 1) + F.col("n_blocks") * p for p in range(int(cap) + 1)]
    takes = F.col("passes") + (F.col("whole") | F.col("part")).cast("long")
    b = checkpoint(b.select("rank", "source", "block", "source_size", "target", "passes", "room", "whole", "part", takes.alias("takes"), F.slice(F.array(*at), F.lit(1), takes.cast("int")).alias("at")))
    dealt = split(b.groupBy("rank").agg(F.sum("takes").alias("quota")), shards, seed)
    ends = dealt.withColumn("ends", F.transform("dealt", lambda x, i: F.aggregate(F.slice("dealt", 1, i + 1), F.lit(0).cast("long"), lambda a, y: a + y)))
    b = b.join(ends.select("rank", "ends"), "rank").withColumn("to", F.transform("at", lambda x: F.size(F.filter("ends", lambda e: e <= x))))
    inside = Window.partitionBy("source", "block").orderBy(key(F.col("doc_id")), "doc_id", "size", *(["mark"] if marked else []))
    d = sized.withColumn("before", F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    b = b.select(F.col("source").alias("s"), F.col("block").alias("k"), "source_size", "target", "passes", "room", "whole", "part", "to")
    d = d.join(b, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("k")))
    last = F.col("whole") | (F.col("part") & (F.col("before") + F.col("size") / 2 <= F.col("room")))
    d = d.withColumn("shards", F.slice("to", F.lit(1), (F.col("passes") + last.cast("long")).cast("int")))
    return d.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"), "shards", *(["mark"] if marked else []))


def shuffled(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", shards: int = SHARDS, seed: int = 1, **how) -> DataFrame:
    """The mix itself: all columns of docs and shard, a row for each time that a document is taken.

    Rows meet what mix() says of them by id, source and text. Rows that are equal in all three are told apart by their
    number among them: all of them are in one block, so they are taken equally often but for the last pass, which takes
    some of them. A column of docs that is named shard stays, and the new one is shard_. A shard is ordered by a hash of
    the ids and passes, and is written by as many tasks, each with a range of that order, as there are shuffle partitions
    to a shard.
    """
    often = F.size("shards")
    d = mix(docs, doc_id, source, text, shards=shards, seed=seed, marked=True, **how)
    d = d.groupBy(F.col("mark").alias("of")).agg(F.max_by("shards", often).alias("most"), F.min(often).alias("least"), F.max(often).alias("top"), F.count("*").alias("rows"), F.sum(often).alias("times"))
    d = d.withColumn("last", F.when(F.col("top") > F.col("least"), F.col("times") - F.col("rows") * F.col("least")).otherwise(F.col("rows")))  # rows that are taken top times
    rows = docs.select(_text_mark(F.col(doc_id).cast("long"), F.col(source), F.col(text)).alias("mark"), F.struct(*docs.columns).alias("row"), row_hash(docs).alias("hash"))
    rows = rows.join(d, F.col("mark") == F.col("of")).withColumn("k", F.row_number().over(Window.partitionBy("mark").orderBy("hash")))
    rows = rows.select("mark", "row", "k", F.posexplode(F.slice("most", F.lit(1), F.when(F.col("k") <= F.col("last"), F.col("top")).otherwise(F.col("least")))).alias("turn", "shard"))
    tasks = max(1, -(-shuffle_partitions(docs.sparkSession) // shards))
    rows = rows.withColumn("order", _mark(F.lit(f"order {seed}"), F.col("mark"), F.col("k"), F.col("turn")))
    place = F.col("shard") * tasks + F.floor(_hex(F.col("order"), 8) * tasks / 16**8).cast("int")
    rows = rows.repartitionById(shards * tasks, place.cast("int")).sortWithinPartitions("shard", "order")
    return rows.select("row.*", F.col("shard").alias(free("shard", docs.columns)))


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    from rivulet.llm.common import table

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH sized AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
        ('0x' || substr(md5('1|' || coalesce(doc_id::VARCHAR, '')), 1, 3))::INT AS block
    FROM documents),
blocks AS (SELECT source, block, sum(size)::BIGINT AS block_size FROM sized GROUP BY ALL),
ranked AS (
    SELECT *, [5.0, 2.0, 1.0][(rank - 1) % 3 + 1]::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM (
        SELECT source, sum(block_size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM blocks GROUP BY source)),
levels AS (
    SELECT *, (total - below) / remaining AS level FROM (
        SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS below,
            sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS remaining,
            (sum(source_size) OVER ())::DOUBLE AS total FROM ranked)),
goal AS (
    SELECT *, target - passes * source_size AS rest FROM (
        SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS passes FROM (
            SELECT source, source_size, rank,
                least(cap, coalesce((max(CASE WHEN level * weight <= cap THEN level END) OVER ()), 'inf'::DOUBLE) * weight) AS target FROM levels))),
placed AS (
    SELECT b.block, b.block_size, g.*, coalesce(sum(block_size) OVER (
        PARTITION BY rank ORDER BY md5('1|' || coalesce(g.source, '') || '|' || block || '|' || passes), block
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM blocks b JOIN goal g ON b.source IS NOT DISTINCT FROM g.source),
inside AS (
    SELECT *, coalesce(sum(size) OVER (PARTITION BY source, block ORDER BY md5('1|' || coalesce(doc_id::VARCHAR, '')), doc_id, size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sized)
SELECT i.doc_id, i.size, p.source_size, p.target,
    (i.size * (p.passes + CASE WHEN p.rest - p.before >= p.block_size THEN 1
        WHEN p.rest - p.before > 0 AND i.before + i.size / 2 <= p.rest - p.before THEN 1 ELSE 0 END))::BIGINT AS taken
FROM inside i JOIN placed p ON i.source IS NOT DISTINCT FROM p.source AND i.block = p.block
"""
