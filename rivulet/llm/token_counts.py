"""Token counts by a two-tier lookup of pre-token lengths, without any shuffle of pre-tokens.

A byte-level BPE never merges over the edge of a pre-token, so a text has as many tokens as its pre-tokens have in
sum. The first tier is a compact table that is broadcast: the tokens of the vocabulary, the strings that were frequent
enough to become tokens, each with its own length. It has at most as many rows as the vocabulary, whatever the corpus.
The second tier is a bounded cache in each Python worker for all other pre-tokens, which the library encodes once. Stretches
of text with characters on whose class regex libraries differ go to the library as they are.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Misses that a worker keeps; the cache starts anew beyond it.
CACHE = 400_000
LIMIT = 1024
#: Pre-tokens that are looked up at once.
PIECE = 1 << 20
#: The pre-token pattern of byte-level BPE files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Any but the code points on whose classes all regex libraries agree; stretches with such are encoded by the library.
UNSURE = re.compile("[^\x00-\x1b\x20-\x84\x86-\x9f\xa1-ɏ‐-‧₠-€]")
#: Where a text can be cut, whatever else is in it: before a space between two of the sure characters that aren't spaces. No
#: pre-token has a space but as its first character, or among spaces.
CUT = re.compile("(?<=[!-~¡-ɏ])(?= [!-~¡-ɏ])")


def stretches(text: str) -> Iterator[tuple[bool, str]]:
    """Whether it is sure, and a stretch of text, by turns; cut where no pre-token goes over the cut."""
    held, sure = [], True
    for word in CUT.split(text):
        now = not UNSURE.search(word)
        if held and now != sure:
            yield sure, "".join(held)
            held = []
        sure = now
        held.append(word)
    if held:
        yield sure, "".join(held)


@lru_cache(2)
def _loaded(path: str, changed: int, size: int):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _tokenizer(path: str):
    """The tokenizer of a file. A process loads a file once, as what the library has cached for a tokenizer stays in memory when that is gone."""
    at = os.stat(path)
    return _loaded(path, at.st_mtime_ns, at.st_size)


def _plan(tokenizer) -> tuple[bool, list[str]]:
    """Whether pre-tokens add up for this file, and its added tokens, which split a text before all else."""
    import json

    spec = json.loads(tokenizer.to_str())
    pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer") and not any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in added)
    return plain, [x["content"] for x in added]


def frequent_lengths(path: str) -> dict[str, int]:
    """Pre-tokens that are tokens of the vocabulary, with the number of tokens that the library makes of them."""
    t = _tokenizer(path)
    _, added = _plan(t)
    whole, texts = regex.compile(PATTERN), []
    for k in range(t.get_vocab_size()):
        s = t.decode([k], skip_special_tokens=False)
        if s and s not in added and "�" not in s and whole.fullmatch(s):
            texts.append(s)
    return {s: len(e.ids) for s, e in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True)}


def count_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT, cache: int = CACHE) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row; a null text counts as empty.

    path: a tokenizers file (.json) or a sentencepiece model (.model). Files whose pre-tokens don't add up, and
    sentencepiece models, are encoded text by text. Repeated rows are rows of their own; other columns have no part in it.
    A text of any length is counted whole, PIECE pre-tokens at a time where its pre-tokens add up.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    plain = path.endswith(".json") and _plan(_tokenizer(path))[0]
    first = spark.sparkContext.broadcast(frequent_lengths(path) if plain else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            count = lambda t: len(sp.encode(t))
        else:
            t = _tokenizer(path)
            added = _plan(t)[1]
            whole = lambda s: len(t.encode(s, add_special_tokens=False).ids)
            cut, find = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None, regex.compile(PATTERN).findall
            known = dict(first.value)
            base = len(known)

            def piece(s: str) -> int:
                total, tokens = 0, find(s)
                while len(tokens) > PIECE:
                    total += looked_up(tokens[-PIECE:])
                    del tokens[-PIECE:]
                return total + looked_up(tokens)

            def looked_up(tokens: list[str]) -> int:
                nonlocal known
                lengths = list(map(known.get, tokens))
                if None in lengths:
                    misses = list({x for x, n in zip(tokens, lengths, strict=True) if n is None})
                    if len(known) > base + cache:
                        known = dict(first.value)
                    new = {x: whole(x) for x in misses}  # not as a batch, for which the library starts a thread for each of the machine's cores
                    lengths = [new[x] if n is None else n for x, n in zip(tokens, lengths, strict=True)]
                    if len(new) <= cache:
                        known.update(new)
                return sum(lengths)

            def count(s: str) -> int:
                if not plain:
                    return whole(s)
                parts = cut.split(s) if cut else [s]
                return len(parts) - 1 + sum(piece(x) if sure else whole(x) for part in parts for sure, x in ([(True, part)] if not UNSURE.search(part) else stretches(part)))

        for b in batches:
            texts = b.column("text")
            n = [count(x.as_py()) for x in texts]
            sizes = pa.compute.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), sizes, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return d.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of every document by the byte-level vocabulary of 50 thousand tokens."""
    import public_tokenizers

    from rivulet.llm.common import table

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
