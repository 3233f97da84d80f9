"""Joins of any number of inputs. Null keys match nothing, nor does a compound key with a null in it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.types import INTEGRAL

#: Bytes that Spark's estimate of an input may have for it to be sent to every task. Estimates are of files, which are
#: compressed: rows take several times as much.
REPLICATE_LIMIT = 64 << 20

#: Rows of one key that an input may have for its joins to be left to Spark, which deals rows by their bytes.
REPEATS = 64

#: Pairs of rows of one key that a task joins at once.
CELL = 4_000_000


def _size(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, limit: int | None = None) -> bool:
    return _size(df) <= (REPLICATE_LIMIT if limit is None else limit)


def equal(a: list[Column], b: list[Column], null_safe: bool = False) -> Column:
    return reduce(lambda x, y: x & y, (p.eqNullSafe(q) if null_safe else p == q for p, q in zip(a, b, strict=True)))


def join(frames: list[tuple[DataFrame, list[Column]]], kind: str = "inner", how: str | None = None, null_safe: bool = False) -> DataFrame:
    """Joins inputs (frame and key columns, with distinct column names) from the left.

    how: replicated sends every input but the first to all tasks, as long as its estimated size is within
    REPLICATE_LIMIT, and is a plain join beyond it; merge and merge-sparse sort both sides; skewed does as replicated, and
    beyond the limit deals the rows of frequent keys to several tasks; without it hot keys are left to adaptive execution,
    and where both sides repeat their keys (see _repeated) the pairs of a key are dealt by their number.
    """
    out, keys = frames[0]
    known = _size(out) if how is None and len(frames) > 1 and not out.isStreaming else 0  # of the inputs so far: Spark takes a join's size for the product
    for df, other in frames[1:]:
        if how is None and kind in ("inner", "left") and not out.isStreaming and not df.isStreaming:
            sides = [(known, out, keys), (_size(df), df, other)]
            known += sides[1][0]
            if (match := _matched(out, keys, df, other, null_safe)) and _repeated(sides):
                out = dealt(out, df, *match, kind)
                continue
        if how == "skewed" and kind in ("inner", "left") and not null_safe and not out.isStreaming and not df.isStreaming and not small(df):
            out = skewed(out, keys, df, other, kind)
            continue
        if how in ("replicated", "skewed") and small(df):
            df = F.broadcast(df)
        elif how in ("merge", "merge-sparse"):
            df = df.hint("merge")
        out = out.join(df, equal(keys, other, null_safe), {"full": "full_outer"}.get(kind, kind))
    return out


def _matched(left: DataFrame, keys: list[Column], right: DataFrame, other: list[Column], null_safe: bool) -> tuple[list[Column], list[Column]] | None:
    """Both sides' keys in types that are alike, so that equal ones hash alike; None where Spark would compare them in a type of its own."""
    a, b = ([f.dataType for f in df.select(*of).schema] for df, of in ((left, keys), (right, other)))
    whole = [all(isinstance(t, INTEGRAL) for t in pair) for pair in zip(a, b, strict=True)]
    if not all(w or x == y for w, x, y in zip(whole, a, b, strict=True)):
        return None
    sides = [[k.cast("bigint") if w else k for k, w in zip(of, whole, strict=True)] for of in (keys, other)]
    return tuple([F.struct(*(k.alias(f"_{i}") for i, k in enumerate(of)))] if null_safe else of for of in sides)  # a tuple with a null in it equals another


def _repeated(sides: list[tuple[int, DataFrame, list[Column]]]) -> bool:
    """Whether some key has more than REPEATS rows in both sides (size, frame, keys), as far as they are small enough to be counted before the join.

    A side above REPLICATE_LIMIT isn't counted and taken to repeat its keys; if neither is counted the join is left to Spark.
    """
    counted = sorted((s for s in sides if s[0] <= REPLICATE_LIMIT), key=lambda s: s[0])
    for _, df, keys in counted:
        present = reduce(lambda a, b: a & b, (k.isNotNull() for k in keys))
        most = df.where(present).groupBy(*(k.alias(f"__h{i}") for i, k in enumerate(keys))).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        if (most or 0) <= REPEATS:
            return False
    return bool(counted)


def dealt(left: DataFrame, right: DataFrame, keys: list[Column], other: list[Column], kind: str = "inner", cell: int | None = None) -> DataFrame:
    """An inner or left join in which the pairs of a key that has more than cell of them are dealt to several tasks, as a grid.

    Of such a key the left rows are cut into p parts, and the right rows into q, by a hash of all their columns; each left row
    is copied to its row of the grid and each right row to its column. Of a left join the right rows aren't cut, so no copy
    is without its match. A key with over cell pairs has over the root of cell rows on one side, so there are few of them.
    Tasks are as many as spark.sql.shuffle.partitions, as adaptive execution would merge them by what they read.
    """
    cell = cell or CELL
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    l, r, h, g = ([f"__{x}{i}" for i in range(len(keys))] for x in ("l", "r", "h", "g"))
    a, b = (df.withColumns(dict(zip(names, of, strict=True))) for df, names, of in ((left, l, keys), (right, r, other)))
    mine, theirs = (df.groupBy(*(F.col(x).alias(y) for x, y in zip(names, to, strict=True))).agg(F.count("*").alias(n)) for df, names, to, n in ((a, l, h, "__nl"), (b, r, g, "__nr")))
    pairs, cells = F.col("__nl").cast("double") * F.col("__nr"), F.ceil(F.col("__pairs") / cell)
    p = cells if kind == "left" else F.least(cells, F.greatest(F.lit(1), F.round(F.sqrt(cells * F.col("__nl") / F.col("__nr")))))
    hot = mine.join(theirs, equal([F.col(x) for x in h], [F.col(x) for x in g])).withColumn("__pairs", pairs).where(F.col("__pairs") > cell)
    hot = hot.select(*h, p.cast("int").alias("__p"), cells.alias("__cells")).select(*h, "__p", F.ceil(F.col("__cells") / F.col("__p")).cast("int").alias("__q"))

    def placed(df: DataFrame, names: list[str], mine: str, cut: str, copies: str, to: str) -> DataFrame:
        hashed = F.xxhash64(*(F.col(f"`{c}`") for c, t in df.dtypes if "map<" not in t and "variant" not in t))
        d = df.join(F.broadcast(hot), equal([F.col(x) for x in names], [F.col(x) for x in h]), "left")
        d = d.withColumn(mine, F.coalesce(F.pmod(hashed, F.col(cut)).cast("int"), F.lit(0)))
        return d.withColumn(to, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(copies), F.lit(1)) - 1))).drop(*h, "__p", "__q")

    a = placed(a, l, "__li", "__p", "__q", "__lj").repartition(tasks, *l, "__li", "__lj")
    b = placed(b, r, "__rj", "__q", "__p", "__ri").repartition(tasks, *r, "__ri", "__rj")
    out = a.join(b, equal([F.col(x) for x in (*l, "__li", "__lj")], [F.col(x) for x in (*r, "__ri", "__rj")]), kind)
    return out.drop(*l, *r, "__li", "__lj", "__ri", "__rj")


def skewed(left: DataFrame, keys: list[Column], right: DataFrame, other: list[Column], kind: str, parts: int | None = None) -> DataFrame:
    """An inner or left join in which the left rows of a frequent key are dealt to parts tasks, and its right rows copied to each.

    A key is frequent if it has more than a task's share of the left rows, so there are fewer frequent keys than tasks: they
    are what is sent everywhere. Counting them is a pass over the left keys. Rows are dealt by a hash of all their columns,
    so a task that runs again deals them alike.
    """
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = parts or max(2, tasks)
    names = [f"__h{i}" for i in range(len(keys))]
    counts = left.groupBy(*(k.alias(n) for k, n in zip(keys, names, strict=True))).agg(F.count("*").alias("__n"))
    share = left.agg(F.count("*").alias("__all"))
    hot = counts.join(F.broadcast(share), F.col("__n") * tasks > F.col("__all")).select(*names, F.lit(True).alias("__hot"))  # one row; then fewer than tasks

    def marked(df: DataFrame, of: list[Column]) -> DataFrame:
        return df.join(F.broadcast(hot), equal(of, [F.col(n) for n in names]), "left").drop(*names)

    deal = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c, t in left.dtypes if "map<" not in t and "variant" not in t)), F.lit(parts)).cast("int")
    a = marked(left, keys).withColumn("__part", F.when(F.col("__hot"), deal).otherwise(0)).drop("__hot")
    copies = F.sequence(F.lit(0), F.when(F.col("__hot"), parts - 1).otherwise(0))
    b = marked(right, other).withColumn("__copy", F.explode(copies)).drop("__hot")
    return a.join(b, equal(keys, other) & (F.col("__part") == F.col("__copy")), {"left": "left_outer"}.get(kind, kind)).drop("__part", "__copy")


def cross(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.crossJoin(b), frames)
