"""From raw documents to encoded training text: language, near copies, repeated passages, mixture, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of docs; the last one adds the pieces.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm import language_id, mixing, pieces, simhash, suffix_dedup
from rivulet.llm.common import drop_folder, free, shared_dir, table

#: Documents go whose n-grams are this far from those of every language (1: the same profile, 0: nothing in common).
LEAST_SCORE = 0.1
MODEL = "piece_bpe_32k.model"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is known: with a letter, and near to some language's profile."""
    found = language_id.predict(docs, language_id.train(docs), whole=True)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one with the smallest id, of each group whose shingles of five words are 0.8 alike or more.

    Documents without an id come last in their group; of rows that share an id and differ in text each is a document.
    """
    return simhash.one_of_similar(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out what repeats of 100 bytes or more, and drops documents of which nothing stays.

    A cut inside a character's bytes drops the rest of that character. n_chars becomes the length of the new text.
    """
    cut = free("n_cut", docs.columns)
    left = suffix_dedup.cut_text(docs).where((F.length("text") > 0) | (F.col(cut) == 0) | F.col("text").isNull())
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix says, dealt to the output shards and shuffled within each."""
    return mixing.shuffled(docs).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes every text: the columns of docs, ids, n_tokens, and whether decoding gives the text back."""
    ids = free("ids", docs.columns)
    return pieces.encode(docs, public_tokenizers.path(MODEL), check=True).withColumn(free("n_tokens", docs.columns), F.size(ids))


STAGES = [("language", language), ("near_copies", near_copies), ("passages", passages), ("mixture", mixture), ("encoded", encoded)]

#: The mixture and the fingerprints are beyond SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again; what a stage was made from goes when it is there."""
    docs, root, last = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        out = f"{root}/{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if last:
            drop_folder(spark, last)
        last = out
    return docs
