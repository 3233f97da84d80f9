"""Language identification by rank-order n-gram profiles.

A profile is the list of the most frequent character n-grams (one to three code points) of a text, most frequent
first. A document is compared to each language's profile by the out-of-place distance: for each n-gram of the
document's profile the difference of the two ranks, and the profile's length where the language lacks it. The language
with the smallest distance wins; ties go to the first language by code point.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: n-grams in a profile.
PROFILE = 400
#: Bound of the sample that profiles are learned from: so many whole documents of each language.
TRAIN_PER_LANGUAGE = 500
#: How many times as many ids as it needs the draw of a language sees, about: too few is as unlikely as a hash that isn't even.
MARGIN = 4
#: Code points whose n-grams are counted at once, so that a very long text needs bounded memory.
PIECE = 1 << 20
BLANK = 1
SCHEMA = "doc_id long, lang_pred string, score double"


@lru_cache(1)
def _letters() -> np.ndarray:
    """The lower-case letter of each code point; BLANK for all that isn't a letter."""
    out = np.full(0x110000, BLANK, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def _grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text and their counts; a run of other characters is one blank, as are both ends."""
    grams, counts, letters = [], [], _letters()
    last = np.array([BLANK], np.uint64)
    for i in range(0, max(1, len(text)), PIECE):
        s = letters[np.frombuffer(text[i : i + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.uint64)
        s = np.concatenate([last, s, np.array([BLANK] * (i + PIECE >= len(text)), np.uint64)])
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != BLANK) | (s[:-1] != BLANK)
        s = s[keep]
        first = len(last) - 1 if i else 0  # what the last piece has counted isn't counted again
        one, two = s[len(last) :], s[:-1] << np.uint64(21) | s[1:]
        three = s[:-2] << np.uint64(42) | two[1:]
        g, c = np.unique(np.concatenate([one[one != BLANK], two[first:], three]), return_counts=True)
        grams.append(g)
        counts.append(c)
        last = s[-2:]
    if len(grams) == 1:
        return grams[0], counts[0]
    g, at = np.unique(np.concatenate(grams), return_inverse=True)
    return g, np.bincount(at, np.concatenate(counts)).astype(np.int64)


def _profile(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    if len(grams) > 4 * size:  # nothing below the size-th count can be in it
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        grams, counts = grams[counts >= least], counts[counts >= least]
    return grams[np.lexsort((grams, -counts))[:size]]


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = TRAIN_PER_LANGUAGE, size: int = PROFILE) -> dict[str, list[int]]:
    """Profiles by language, learned from at most per_language whole documents of each (chosen by a hash of doc_id).

    Rows without a language or a text teach nothing; rows without a doc_id are in no sample. Of rows that repeat a doc_id
    one teaches. A text of any length is counted PIECE code points at a time. What reaches the driver is size n-grams for
    each language.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang IS NOT NULL")
    # ids below a hash that leaves MARGIN times as many as are needed, and of those the smallest: no task sees a common language's ids
    ids = d.where("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "lang", F.shiftrightunsigned(F.xxhash64("doc_id"), 1).alias("h"))
    rows = {r.lang: r.n for r in ids.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language, as profiles have
    bounds = [(k, min((1 << 63) - 1, (MARGIN * per_language << 63) // n)) for k, n in rows.items()]
    below = F.broadcast(docs.sparkSession.createDataFrame(bounds, "of string, bound long"))
    ids = ids.join(below, (F.col("lang") == F.col("of")) & (F.col("h") <= F.col("bound"))).select("doc_id", "lang", "h").distinct()
    chosen = ids.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("k") <= per_language)
    # at most per_language ids of each language are sent everywhere; of rows that repeat an id one text is in the sample, so that it has per_language texts of a language at most
    sample = d.where("text IS NOT NULL").join(F.broadcast(chosen.select("doc_id", "lang")), ["doc_id", "lang"], "left_semi").groupBy("doc_id", "lang").agg(F.min("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                g, c = _grams(t or "")
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(c.astype(np.int64))], ["lang", "gram", "n"])

    grams = sample.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = grams.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("k") <= size)
    out: dict[str, list[int]] = {}
    for r in sorted(best.collect(), key=lambda r: (r.lang, r.k)):
        out.setdefault(r.lang, []).append(r.gram)
    return out


def predict(docs: DataFrame, profiles: dict[str, list[int]], doc_id: str = "doc_id", text: str = "text", size: int = PROFILE, whole: bool = False) -> DataFrame:
    """doc_id, lang_pred and score (1 less the distance as a share of the greatest possible) of every row.

    A null text, one without a letter, and any text where no profile was learned give `und` and 0. Repeated rows are rows
    of their own; equal texts get equal predictions. A text of any length is counted PIECE code points at a time. whole adds
    row, a struct of all columns of docs, whatever their names; without it other columns have no part in it.
    """
    langs = sorted(profiles)
    known = np.unique(np.concatenate([np.array(profiles[x], np.uint64) for x in langs])) if langs else np.zeros(0, np.uint64)
    ranks = np.full((len(known) + 1, max(1, len(langs))), -1, np.int32)  # the last row: an n-gram that no language has
    for j, x in enumerate(langs):
        ranks[np.searchsorted(known, np.array(profiles[x], np.uint64)), j] = np.arange(len(profiles[x]))

    def one(t: str | None) -> tuple[str, float]:
        g, c = _grams(t or "")
        if not langs or not (g < (1 << 21)).any():
            return "und", 0.0
        p = _profile(g, c, size)
        at = np.searchsorted(known, p)
        at[(at == len(known)) | (known[np.minimum(at, len(known) - 1)] != p)] = len(known)
        theirs = ranks[at]
        far = np.where(theirs < 0, size, np.abs(theirs - np.arange(len(p))[:, None])).sum(0)
        best = int(far.argmin())
        return langs[best], float(1 - far[best] / (size * len(p)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [one(t.as_py()) for t in (b.column("row").field(text) if whole else b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), *([b.column("row")] if whole else [])], ["doc_id", "lang_pred", "score", *(["row"] if whole else [])])

    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.struct(*docs.columns).alias("row") if whole else F.col(text).alias("text"))
    schema = T._parse_datatype_string(SCHEMA)
    return d.mapInArrow(run, schema.add(d.schema["row"]) if whole else schema)


def held_out(doc_id) -> F.Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    """Profiles learned from documents that aren't held out, and the prediction for every document."""
    from rivulet.llm.common import table

    docs = table(spark, sf_dir, "documents")
    out = predict(docs, train(docs.where(~held_out("doc_id"))))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
