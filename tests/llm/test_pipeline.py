"""The pipeline's stages on a small table with planted copies, passages, junk and clean documents."""

import random

import pytest

import corpus_pipeline
from pyspark.sql import functions as F
from rivulet.llm import mixing, queries
from tests.llm.test_operators import cut_slowly, prose


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(4)
    passage = prose(40, 99)
    texts = [prose(150 + i % 70, 1000 + i) for i in range(60)]
    texts += [texts[0], texts[1] + " more", texts[2], None, "", "!!! 123 ???", "§§§ ****", f"{prose(80, 5)} {passage} {prose(60, 6)}", f"{prose(90, 7)} {passage} {prose(50, 8)}"]
    rows = [(i, t, "en", r.choice(["a", "b", "c", None]), len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), rows, passage


def test_stages(spark, docs, tmp_path):
    d, rows, passage = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, d, None).write.parquet(f"{tmp_path}/{name}")
        d = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = d.collect()
        if name != "encoded":
            assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    text = {r[0]: r[1] for r in rows}
    kept = {r.doc_id for r in seen["language"]}
    assert kept == set(text) - {63, 64, 65, 66}
    grams = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i in kept for w in [text[i].lower().split()]}
    groups = {}
    for i in sorted(kept):
        if not any(len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]) for j in groups):
            groups[i] = 1
    assert {r.doc_id for r in seen["near_copies"]} == set(groups) and {60, 61, 62}.isdisjoint(groups)
    want = {r[0]: r for r in cut_slowly([(r.doc_id, r.text) for r in seen["near_copies"]])}
    cut = {r.doc_id: r for r in seen["passages"]}
    assert all(len(cut[i].text.encode()) == w[1] - w[2] and cut[i].n_chars == len(cut[i].text) for i, w in want.items() if i in cut)
    assert passage[:200] in cut[67].text and passage[:200] not in cut[68].text
    assert {r.doc_id for r in seen["mixture"]} <= set(cut) and max(sum(x.doc_id == r.doc_id for x in seen["mixture"]) for r in seen["mixture"]) <= 3
    assert all(r.exact and r.n_tokens == len(r.ids) > 0 for r in seen["encoded"]) and len(seen["encoded"]) == len(seen["mixture"])


def test_stages_on_nothing(spark):
    d = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, d, None).collect() == []


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_names():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]


ODD = "doc_id long, text string, lang string, source string, n_chars long, row string, kept string, n_cut long, shard int, ids string, exact string, decoded string, mark string, _id long"


def capitals(text):
    return "".join(c.upper() if c.isascii() else c for c in text)


def odd_rows():
    """Shared and null ids, repeated rows, null columns; the extra columns have names that operators use."""
    t, u, v = prose(120, 21), prose(130, 22), prose(140, 23)
    rows = [(1, t), (2, t + " zz"), (2, u), (3, v), (3, v), (None, v), (None, v), (None, prose(90, 24)), (4, prose(80, 25)), (4, prose(80, 25)), (5, None), (6, ""), (7, capitals(t))]
    return [(i, x, "en", "a", 1, "r", "k", 5, 6, "i", None, "d", "m", 8) for i, x in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), ODD)


def test_near_copies_are_of_rows(spark, odd):
    got = corpus_pipeline.near_copies(spark, odd, None)
    assert got.columns == odd.columns
    r = {(x[0], x[1]) for x in odd_rows()}
    gone = {(2, odd_rows()[1][1]), (None, odd_rows()[3][1]), (7, capitals(odd_rows()[0][1])), (6, "")}
    assert sorted(map(str, ((x.doc_id, x.text) for x in got.collect()))) == sorted(map(str, r - gone))


def test_every_stage_takes_odd_rows(spark, odd):
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd, None)
        rows = got.collect()
        assert got.columns[: len(odd.columns)] == odd.columns and rows and all(x["_id"] == 8 and x["mark"] == "m" for x in rows)
        if name == "language":
            assert len(rows) == len(odd_rows()) - 2
        if name == "encoded":
            assert got.columns[len(odd.columns) :] == ["ids_", "exact_", "n_tokens"] and all(x.exact_ and len(x["ids_"]) == x.n_tokens for x in rows)


def test_the_mix_is_what_is_written(spark):
    texts = [(1, "w " * 60, "a")] * 40 + [(1, "w " * 60, "b")] * 40 + [(None, f"{'x ' * (5 + i % 3)}", "b") for i in range(50)] + [(i, "y " * i, "c") for i in range(30)]
    d = spark.createDataFrame([(*x, i) for i, x in enumerate(texts)], "doc_id long, text string, source string, shard int")
    out = mixing.shuffled(d)
    assert out.columns == [*d.columns, "shard_"]
    rows, said = out.collect(), mixing.mix(d, marked=True).collect()
    for source in "abc":
        assert sum(len(r.text.split()) for r in rows if r.source == source) == sum(r.taken for r in said if r.source == source)
    of = {r.mark: [] for r in said}
    for r in said:
        of[r.mark] += r.shards
    made = {}
    for r in out.withColumn("mark", mixing._text_mark(F.col("doc_id"), F.col("source"), F.col("text"))).collect():
        made.setdefault(r.mark, []).append(r["shard_"])
    assert {k: sorted(v) for k, v in made.items()} == {k: sorted(v) for k, v in of.items() if v}
    times = [sum(r.shard == i for r in rows) for i in range(40)]
    assert max(times) - min(times) <= 1  # of rows that are equal but for other columns


def test_shards_have_their_quotas(spark):
    """Of every source each shard gets the blocks that the tree gave it, and no block twice in a pass."""
    d = spark.createDataFrame([(i, "w " * (1 + i % 9), "ab"[i % 3 // 2], len("x")) for i in range(6000)], "doc_id long, text string, source string, n int")
    said = mixing.mix(d, shards=8).collect()
    assert all(len(r.shards) * r.size == r.taken and set(r.shards) <= set(range(8)) for r in said)
    for source in "ab":
        mine = [r for r in said if r.source == source]
        per = [sum(r.size * r.shards.count(k) for r in mine) for k in range(8)]
        assert abs(sum(per) - mine[0].target) <= 9 and max(per) < 1.5 * min(per)
