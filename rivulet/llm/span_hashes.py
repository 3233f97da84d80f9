"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text holds the polynomial of each prefix modulo the prime 2^31-1, for two bases. The hash of any
span is then the difference of two entries, shifted to the origin by an inverse power; equal spans have equal hashes,
whatever text they are in, and a longest common extension is a binary search over such comparisons. A fingerprint is
the hash of the whole text and the SKETCH smallest distinct hashes of its spans of SPAN code points; two of them tell
what share of spans the texts have in common.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import shuffle_partitions

P = (1 << 31) - 1
BASES = (1_103_515_249, 1_664_525_003)
INVERSES = tuple(pow(b, -1, P) for b in BASES)
SPAN, SKETCH = 8, 64
#: Code points that are worked on at once.
PIECE = 1 << 18
#: Most ranges of ids that texts are dealt by; each is streamed, so a range may be of any size.
RANGES = 4096


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31-1, for 0 <= x < 2^62."""
    x = (x & P) + (x >> 31)
    x = (x & P) + (x >> 31)
    return np.where(x >= P, x - P, x)


@lru_cache(8)
def _powers(base: int) -> np.ndarray:
    """The first PIECE powers of a base."""
    out = np.ones(1, np.int64)
    while len(out) < PIECE:
        out = np.concatenate([out, _mod(out * pow(base, len(out), P))])
    return out


def _scaled(base: int, start: int, n: int) -> np.ndarray:
    """n powers of a base, at most PIECE, from the one to the start on."""
    up = _powers(base)[:n]
    return _mod(up * pow(base, start, P)) if start else up


class Prefix:
    """Prefix arrays of a text, given as its code points: four bytes a code point and base, made PIECE code points at a time."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        self.sums = [np.zeros(self.n + 1, np.uint32) for _ in BASES]
        for sums, base in zip(self.sums, BASES, strict=True):
            carry = 0
            for o in range(0, self.n, PIECE):
                c = codes[o : o + PIECE].astype(np.int64) + 1
                s = _mod(np.cumsum(_mod(c * _scaled(base, o, len(c)))) + carry)
                sums[o + 1 : o + 1 + len(c)] = s
                carry = int(s[-1])

    def span(self, start: int, end: int) -> tuple[int, ...]:
        return tuple((int(s[end]) - int(s[start])) % P * pow(inverse, start, P) % P for s, inverse in zip(self.sums, INVERSES, strict=True))

    def spans(self, width: int, low: int = 0, high: int | None = None) -> Iterator[np.ndarray]:
        """Mixed 64-bit hashes of the spans of this width that begin from low on and before high, PIECE at a time; of the whole text if it is shorter."""
        if self.n < width:
            a, b = self.span(0, self.n)
            yield _mixed(np.array([a << 31 | b], np.uint64))
            return
        high = self.n - width + 1 if high is None else min(high, self.n - width + 1)
        for o in range(low, high, PIECE):
            m = min(PIECE, high - o)
            a, b = (_mod(_mod(s[o + width : o + width + m].astype(np.int64) - s[o : o + m] + P) * _scaled(inverse, o, m)) for s, inverse in zip(self.sums, INVERSES, strict=True))
            yield _mixed((a << 31 | b).view(np.uint64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def equal(a: Prefix, i: int, b: Prefix, j: int, length: int) -> bool:
    """Whether two spans are equal, but for a chance of about 2^-62."""
    return a.span(i, i + length) == b.span(j, j + length)


def common_extension(a: Prefix, i: int, b: Prefix, j: int) -> int:
    """Length of the longest common prefix of a from i on and b from j on."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if equal(a, i, b, j, mid) else (low, mid - 1)
    return low


def _least(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """The smallest of two sorted arrays of distinct numbers, each once."""
    if not len(a) or not len(b):
        return a if len(a) else b
    both = np.concatenate([a, b])
    both.sort()
    keep = np.ones(len(both), bool)
    np.not_equal(both[1:], both[:-1], out=keep[1:])
    return both[keep][:size]


def sketch(hashes: Iterable[np.ndarray], size: int = SKETCH) -> np.ndarray:
    """The smallest distinct hashes, cut to 32 bits."""
    out = np.zeros(0, np.uint32)
    for part in hashes:
        h = (part >> np.uint64(32)).astype(np.uint32)
        if len(h) > 4 * size:
            some = np.unique(np.partition(h, 4 * size)[: 4 * size])
            h = some if len(some) >= size else np.unique(h)
        else:
            h = np.unique(h)
        out = _least(out, h[:size], size)
    return out


def likeness(a: np.ndarray, b: np.ndarray, size: int = SKETCH) -> float:
    """Share of common spans, from two sketches: of the smallest hashes of both, those that are in each."""
    both = np.concatenate([a, b])
    both.sort()
    again = np.zeros(len(both), bool)
    np.equal(both[1:], both[:-1], out=again[1:])
    least = both[~again][:size]
    return float(np.searchsorted(both[again], least[-1], side="right") / len(least))


def _text(whole: tuple[int, ...], n: int, s: np.ndarray) -> str:
    return f"{n:x}.{whole[0]:08x}{whole[1]:08x}." + s.astype(">u4").tobytes().hex()


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class _Document:
    """A text with its prefix arrays; front is the sketch of the spans that its edited text has as well."""

    def __init__(self, doc_id: int | None, text: str, span: int = SPAN, size: int = SKETCH):
        self.doc_id, self.text, self.codes = doc_id, text, _codes(text)
        self.prefix, n = Prefix(self.codes), len(self.codes)
        self.kept = n - n // 4
        shared = max(0, self.kept - span + 1) if n >= span else 0
        if n <= PIECE:  # one pass for both parts
            hashes = next(self.prefix.spans(span))
            front, rest = [hashes[:shared]], [hashes[shared:]]
        else:
            front, rest = self.prefix.spans(span, 0, shared), self.prefix.spans(span, shared)
        self.front = sketch(front, size)
        self.sketch = _least(self.front, sketch(rest, size), size)
        self.whole = self.prefix.span(0, self.prefix.n)

    def against(self, other: "_Document", span: int = SPAN, size: int = SKETCH) -> tuple:
        n, kept = len(self.codes), self.kept
        head = other.codes[: n - kept]
        if kept >= span:  # only the spans from the seam on are new
            tail = Prefix(np.concatenate([self.codes[kept - span + 1 : kept], head]))
            edited = _least(self.front, sketch(tail.spans(span), size), size) if tail.n >= span else self.front
        else:
            edited = sketch(Prefix(np.concatenate([self.codes[:kept], head])).spans(span), size)
        whole = tuple((a + b * pow(base, kept, P)) % P for a, b, base in zip(self.prefix.span(0, kept), other.prefix.span(0, len(head)), BASES, strict=True))
        text = self.text[:kept] + other.text[: n - kept]
        common = kept + common_extension(self.prefix, kept, other.prefix, 0)
        return (
            self.doc_id, n, hashlib.sha256(text.encode()).hexdigest(), _text(self.whole, n, self.sketch), _text(whole, len(text), edited),
            likeness(self.sketch, edited, size), likeness(self.sketch, other.sketch, size), common,
        )


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long"


def _tree(edges: list[int], low: int, high: int) -> str:
    if low == high:
        return str(low)
    mid = (low + high) // 2
    return f"if(k < {edges[mid]}L, {_tree(edges, low, mid)}, {_tree(edges, mid + 1, high)})"


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """Fingerprint of every row, of its edited text, and their likenesses (SCHEMA).

    The edited text has the last quarter of the code points (rounded down) replaced by the first as many, or all, of
    the next document by doc_id; after the last comes the first. A null text is empty. A null doc_id comes first; rows
    with one doc_id follow each other by length and hash of their texts, and equal rows by chance, which changes no result.
    A single document is its own next one. common_prefix is the number of code points that text and edited text begin with
    alike. Other columns of docs have no part in it. A text of any length is taken whole: a task holds two of them, with
    twelve bytes a code point besides, and works PIECE code points at a time.

    Texts are shuffled once, by ranges of doc_id; a range is sorted and streamed, two documents at a time, and the
    first document of each range is sent to the range before it as well. What the driver sees is a bound and a first
    id for each range.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    n = min(ranges or 4 * parts, RANGES)
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("k", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")))
    steps = d.agg(F.percentile_approx("k", [i / n for i in range(1, n)] or [0.5], 10 * n)).first()[0] or []
    edges = sorted({x for x in steps if x > -(1 << 62)})
    d = d.withColumn("range", F.expr(_tree(edges, 0, len(edges))).cast("int"))
    first = sorted((r.range, r.k) for r in d.groupBy("range").agg(F.min("k").alias("k")).collect())
    at = spark.createDataFrame([(k, first[i - 1][0]) for i, (_, k) in enumerate(first)], "f long, to int")
    d = d.join(F.broadcast(at), F.col("k") == F.col("f"), "left")  # one row a range
    d = d.withColumn("x", F.explode(F.filter(F.array(F.struct(F.col("range").alias("r"), F.lit(0).alias("late")), F.struct(F.col("to").alias("r"), F.lit(1).alias("late"))), lambda x: x.r.isNotNull())))
    d = d.select("doc_id", "text", "k", F.col("x.r").alias("r"), F.col("x.late").alias("late"))
    d = d.repartition(parts, "r").sortWithinPartitions("r", "late", "k", F.length("text"), F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, last, of = [x.split()[0] for x in SCHEMA.split(", ")], None, None
        for b in batches:
            out = []
            for i, t, r, late in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("r").to_pylist(), b.column("late").to_pylist(), strict=True):
                if r != of:
                    last, of = None, r
                elif last is None:
                    continue  # more rows with the id of the next range's first
                doc = _Document(i, t.as_py())
                if last is not None:
                    out.append(last.against(doc))
                last = None if late else doc
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out, strict=True)), strict=True)), schema=pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((x, pa.string()) for x in names[2:5]), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("common_prefix", pa.int64())]))

    return d.mapInArrow(run, SCHEMA)


def op10_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and likenesses of every document."""
    from rivulet.llm.common import table

    return fingerprints(table(spark, sf_dir, "documents"))
