r"""Chat formatting with Spark expressions only.

A conversation becomes one text: its turns in order, adjacent turns of one role under one header.

    ### role
    text</turn>text</end>

`</turn>` stands between the texts under a header, `</end>` and a line feed after the last. Inside roles and texts a
backslash becomes \b, `<` becomes \l and `#` becomes \h (and a line feed inside a role \n), so that no mark can appear
there and unescaping gives the very text back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD, SEP, END = "### ", "</turn>", "</end>\n"


def _swap(c, *pairs) -> F.Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape(c) -> F.Column:
    return _swap(c, ("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))


def unescape(c) -> F.Column:
    return _swap(c, ("\\l", "<"), ("\\h", "#"), ("\\b", "\\"))


def format_chats(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id and formatted, one row a conversation.

    Turns are ordered by turn (null first), then role and text, so ties have one result; repeated rows are repeated
    turns. A null text or role counts as empty; rows with a null conv_id form one conversation. Texts of any length are
    taken whole; a conversation is one row, so all of it is in one task. Other columns, whatever their names, have no part
    in it. The work on a conversation grows with its length, not with the square of it: the starts of the runs of one
    role are found once and each run is a slice.
    """
    t = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    d = rows.select(F.col(conv).alias("conv_id"), t.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    d = d.withColumn("starts", F.expr("filter(sequence(1, size(turns)), i -> i = 1 OR turns[i - 1].role != turns[i - 2].role)"))
    runs = F.expr("transform(starts, (s, k) -> slice(turns, s, coalesce(get(starts, k + 1), size(turns) + 1) - s))")
    block = lambda r: F.concat(F.lit(HEAD), _swap(escape(F.get(r, F.lit(0)).role), ("\n", "\\n")), F.lit("\n"), F.array_join(F.transform(r, lambda x: escape(x.text)), SEP), F.lit(END))
    return d.withColumn("runs", runs).select("conv_id", F.array_join(F.transform("runs", block), "").alias("formatted"))


def parse_chats(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted and turns (an array of role and text), read back from formatted."""
    blocks = F.split("formatted", END)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)
    line = lambda b: F.locate("\n", b)
    head = lambda b: unescape(_swap(F.substr(b, F.lit(len(HEAD) + 1), line(b) - len(HEAD) - 1), ("\\n", "\n")))
    turns = F.flatten(F.transform(blocks, lambda b: F.transform(F.split(F.substr(b, line(b) + 1), SEP), lambda x: F.struct(head(b).alias("role"), unescape(x).alias("text")))))
    return formatted.select("conv_id", "formatted", turns.alias("turns"))


def _running(array: str) -> str:
    """SQL for the running sums of an array of longs, in as many passes over it as its length has binary digits.

    A fold that appends would copy what it has for each element, and so grow with the square of the length.
    """
    out = array
    for k in range(31):  # an array has fewer than 2^31 elements; passes beyond its length do nothing
        out = f"get(transform(array({out}), q{k} -> if(size(q{k}) > {1 << k}, transform(q{k}, (x, i) -> x + if(i >= {1 << k}, get(q{k}, i - {1 << k}), 0L)), q{k})), 0)"
    return out


def loss(parsed: DataFrame, trained: str = "assistant") -> DataFrame:
    """parsed with mask and loss: the spans of formatted that the loss is taken over, and the text under them.

    mask has start (from 1) and length in code points of each span, which covers one text of the trained role and no
    mark; loss is the unescaped text of the spans, one after the other. Both are read from formatted, block by block, and
    the work grows with a conversation's length, but for the passes of _running().
    """
    blocks = F.split("formatted", END)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)
    piece = "named_struct('skip', if(i = 0, x.head, 0L), 'size', cast(length(y) as bigint), 'hit', x.hit, 'after', if(i = size(x.texts) - 1, %dL, %dL), 'text', if(x.hit, y, ''))" % (len(END), len(SEP))
    d = parsed.withColumn("_b", F.transform(blocks, lambda b: F.struct(F.locate("\n", b).cast("long").alias("head"), F.split(F.substr(b, F.locate("\n", b) + 1), SEP).alias("texts"), F.startswith(b, F.lit(f"{HEAD}{trained}\n")).alias("hit"))))
    d = d.withColumn("_p", F.expr(f"flatten(transform(_b, x -> transform(x.texts, (y, i) -> {piece})))"))
    d = d.withColumn("_ends", F.expr(_running("transform(_p, x -> x.skip + x.size + x.after)")))
    d = d.withColumn("mask", F.expr("transform(filter(arrays_zip(_p, _ends), z -> z._p.hit), z -> named_struct('start', z._ends - z._p.after - z._p.size + 1L, 'length', z._p.size))"))
    under = F.transform(F.filter("_p", lambda x: x.hit), lambda x: unescape(x.text))
    return d.withColumn("loss", F.array_join(under, "")).drop("_b", "_p", "_ends")


def op9_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """Every conversation and one that is full of control strings, formatted and read back."""
    from rivulet.llm.common import table

    hard = "\\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return digest(parse_chats(format_chats(rows)))


def digest(parsed: DataFrame, trained: str = "assistant") -> DataFrame:
    """The contract's columns, read from the formatted text."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    d = loss(parsed, trained)
    return d.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


OP9_SQL = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
marked AS (
    SELECT *, row_number() OVER w AS k, role IS DISTINCT FROM lag(role) OVER w AS starts,
        replace(replace(replace(text, '\', '\b'), '<', '\l'), '#', '\h') AS etext,
        replace(replace(replace(replace(role, '\', '\b'), '<', '\l'), '#', '\h'), chr(10), '\n') AS erole
    FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
    sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY k), '')) AS loss_sha256,
    sum(length(etext) + CASE WHEN starts THEN 4 + length(erole) + 1 + 7 ELSE 7 END)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""
