"""Removal of repeated byte strings by sharded suffix arrays.

1. Shards. Each shard of documents is cut into blocks of BLOCK bytes that overlap by all but one byte of a string, so that
   every string of WIDTH bytes begins in one block. A block's suffixes are sorted by Larsson-Sadakane refinement, which
   doubles the compared depth and sorts only groups that are still tied; Kasai's pass gives the common prefixes of
   neighbours. A run of neighbours with WIDTH common bytes is one repeated string; all but its first occurrence go.
2. Candidates between blocks. In every string the GRAM-byte piece with the smallest hash is its anchor (a minimizer). Equal
   strings have equal anchors, so a string can be in two blocks only if its anchor is. A block reports each anchor hash
   once; a shard finds those that more blocks have in their sorted list by binary search, and sends the text of all
   strings that share such an anchor, one context, to the anchor's task. An anchor with over HOT occurrences is too much
   for one task: its strings go out one by one, by their own hash. A shard sends equal contexts once.
3. Merging. What a task gets of one group of shards is a run of strings, sorted by a 64-bit hash of them. Runs are merged two by two:
   each string of one is located in the other by binary search, and where it is found, byte for byte, the later one goes.
4. The removed intervals go back to the shards of documents, which cut them out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.llm.common import free, shuffle_partitions, utf8_parts, whole_groups

WIDTH, GRAM = 100, 32
#: Occurrences of an anchor beyond which its strings are dealt out one by one.
HOT = 4000
#: Bytes of a suffix array, bytes of contexts that are merged at once, and sorted runs of them.
BLOCK, MERGE, RUNS = 1 << 20, 3 << 19, 8
#: Bytes of a shard of documents, about, by Spark's estimate of its compressed size.
SHARD = 16 << 20
_BITS = 21


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Positions of data in the order of their suffixes (Larsson-Sadakane)."""
    n = len(data)
    padded = np.concatenate([data.astype(np.uint64) + np.uint64(1), np.zeros(4, np.uint64)])  # the end comes before all bytes
    key = np.zeros(n, np.uint64)
    for k in range(4):
        key = key << np.uint64(9) | padded[k : n + k]
    pos = np.arange(n, dtype=np.uint64)
    small, mask = n < 1 << _BITS, np.uint64((1 << _BITS) - 1)
    if small:
        both = np.sort(key << np.uint64(_BITS) | pos)
        sa, key = (both & mask).astype(np.int64), both >> np.uint64(_BITS)
    else:
        sa = np.argsort(key, kind="stable")
        key = key[sa]
    slots, h = np.arange(n), 4
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    rank = np.empty(n + 1, np.int64)
    rank[n] = 0
    while True:
        first = np.maximum.accumulate(np.where(new, slots, 0))
        rank[sa[slots]] = first
        tied = ~new  # members of groups with more than one suffix: those that aren't first, and the firsts before them
        tied[:-1] |= tied[1:] & (first[1:] == first[:-1])
        slots, first = slots[tied], first[tied]
        if h >= n or not len(slots):
            return sa
        at = sa[slots]
        after = rank[np.minimum(at + h, n)] + (at + h < n)
        if small and n < (1 << _BITS) - 1:
            both = np.sort((first.astype(np.uint64) << np.uint64(2 * _BITS)) | (after.astype(np.uint64) << np.uint64(_BITS)) | at.astype(np.uint64))
            sa[slots] = (both & mask).astype(np.int64)
            both >>= np.uint64(_BITS)
            new = np.ones(len(slots), bool)
            new[1:] = both[1:] != both[:-1]
        else:
            order = np.lexsort((after, first))
            sa[slots], first, after = at[order], first[order], after[order]
            new = np.ones(len(slots), bool)
            new[1:] = (first[1:] != first[:-1]) | (after[1:] != after[:-1])
        h *= 2


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number, zeros behind the end."""
    return np.ndarray((len(data),), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))


def common_prefixes(data: np.ndarray, sa: np.ndarray, most: int, stride: int = 64) -> np.ndarray:
    """Bytes that each suffix of sa has in common with the one before it, up to most (Kasai).

    Kasai's bound, that the next position of the text has one byte less in common at least, is carried along stride
    runs of the text at once; eight bytes are compared at a time.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    words, lcp = _words(data), np.zeros(n, np.int64)
    starts = np.arange(0, n, stride)
    length = np.zeros(len(starts), np.int64)
    for t in range(stride):
        i = starts + t
        i = i[i < n]
        length = np.maximum(length[: len(i)] - 1, 0)
        j = before[i]
        room = np.where(j < 0, 0, np.minimum(most, n - np.maximum(i, j)))
        length = np.minimum(length, room)
        on = np.flatnonzero(length < room)
        while len(on):
            at = length[on]
            x = words[i[on] + at] ^ words[j[on] + at]
            same = np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3)
            length[on] = np.minimum(at + same, room[on])
            on = on[(same == 8) & (length[on] < room[on])]
        lcp[i] = length
    return lcp[sa]


def _hashes(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all spans of size bytes, put together from spans of powers of two."""
    with np.errstate(over="ignore"):
        h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xFF51AFD7ED558CCD)
        span, base = 1, np.array([0x9E3779B97F4A7C15], np.uint64)
        left, covered, whole = size, 0, None
        while left:
            if left & 1:
                whole, covered = (h, span) if whole is None else (whole[: len(data) - covered - span + 1] * base + h[covered : len(data) - span + 1], covered + span)
            left >>= 1
            if left:
                h, base, span = h[:-span] * base + h[span:], base * base, span * 2
        h = whole ^ (whole >> np.uint64(29))
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def _fits(n: int, start: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """Whether at each of n positions a string of width bytes begins that ends within the same span."""
    fits = np.zeros(n + 1, np.int64)
    np.add.at(fits, start, 1)
    np.add.at(fits, np.maximum(end - width + 1, start), -1)
    return np.cumsum(fits[:-1]) > 0


def _anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all strings of width bytes within spans: hash of the anchor, and first and last start of the strings that share it.

    data is a block, so that a position has _BITS bits; the rest of a number is the hash.
    """
    if len(data) < width:
        return (np.zeros(0, np.int64),) * 3
    h = _hashes(data, gram)
    low = np.uint64((1 << _BITS) - 1)
    best = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # the smallest hash, the leftmost of equal ones
    span, size = width - gram + 1, 1
    while size * 2 <= span:
        best, size = np.minimum(best[:-size], best[size:]), size * 2
    if span > size:
        best = np.minimum(best[: len(best) - (span - size)], best[span - size :])
    at = (best & low).astype(np.int64)
    fits = np.append(_fits(len(data), starts, ends, width)[: len(at)], False)
    change = np.ones(len(at) + 1, bool)
    change[1:-1] = at[1:] != at[:-1]
    first = np.flatnonzero(fits[:-1] & (change[:-1] | ~np.concatenate([[False], fits[:-2]])))
    last = np.flatnonzero(fits[:-1] & (change[1:] | ~fits[1:]))
    return h[at[first]].view(np.int64), first, last


def _texts(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids (null: the smallest), bytes, starts and ends of a shard's rows in the order of id and text, which is one for every pass, and that order."""
    data, off = utf8_parts(t.column("text"))
    ids = t.column("doc_id").combine_chunks().fill_null(-(1 << 63)).to_numpy()
    order = np.argsort(ids, kind="stable")
    same = np.flatnonzero(ids[order][1:] == ids[order][:-1])
    if len(same):
        order = np.array(sorted(order.tolist(), key=lambda i: (ids[i], data[off[i] : off[i + 1]].tobytes())), np.int64)
    return ids[order], data, off[:-1][order], off[1:][order], order


def _blocks(starts: np.ndarray, ends: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Parts (row, first byte, end) of texts that make up blocks. A text of many blocks is cut; its parts overlap by width - 1 bytes."""
    out, size = [], 0
    for row, n in enumerate((ends - starts).tolist()):
        at = 0
        while n - at >= width:
            end = min(n, at + max(BLOCK - size, width))
            out.append((row, at, end))
            size += end - at
            at = end - width + 1 if end < n else n
            if size >= BLOCK:
                yield np.array(out)
                out, size = [], 0
    if out:
        yield np.array(out)


def _found(t: pa.Table, width: int, gram: int) -> Iterator[tuple]:
    """For each block of a shard: ids, its parts' rows and first bytes, its bytes, the parts' starts and ends in them, and the anchors."""
    ids, data, starts, ends, _ = _texts(t)
    for parts in _blocks(starts, ends, width):
        row, low, high = parts.T
        joined = np.concatenate([data[a:b] for a, b in zip((starts[row] + low).tolist(), (starts[row] + high).tolist(), strict=True)])
        stop = np.cumsum(high - low)
        begin = stop - (high - low)
        yield (ids, row, low, joined, begin, stop, *_anchors(joined, begin, stop, width, gram))


def _later(data: np.ndarray, start: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """Whether at each position a string of width bytes begins within its context that begins earlier in data as well."""
    sa = suffix_array(data)
    cut = np.cumsum(common_prefixes(data, sa, width) < width)
    fits = _fits(len(data), start, end, width)
    ok = fits[sa]
    sa, cut = sa[ok], cut[ok]
    if not len(sa):
        return np.zeros(len(data), bool)
    heads = np.flatnonzero(np.concatenate([[True], cut[1:] != cut[:-1]]))
    least = np.repeat(np.minimum.reduceat(sa, heads), np.diff(np.append(heads, len(sa))))
    out = np.zeros(len(data), bool)
    out[sa[sa > least]] = True
    return out


def _across(data: np.ndarray, start: np.ndarray, end: np.ndarray, run: np.ndarray, width: int) -> np.ndarray:
    """What _later() says, by merging: the strings of each run are sorted by hash, and runs are merged two by two by binary search."""
    out, words, hashes = np.zeros(len(data), bool), _words(data), _hashes(data, width)
    at = np.flatnonzero(_fits(len(data), start, end, width))
    of = run[np.searchsorted(start, at, side="right") - 1]
    steps = [*range(0, width - 7, 8), max(0, width - 8)]

    def same(a: np.ndarray, b: np.ndarray) -> bool:
        """Whether the strings at a and b are equal, byte for byte, each to each."""
        return all((words[a + k] == words[b + k]).all() for k in steps) if width >= 8 else all(data[x : x + width].tobytes() == data[y : y + width].tobytes() for x, y in zip(a, b, strict=True))

    runs = []
    for k in range(RUNS):
        p = at[of == k]
        order = np.argsort(hashes[p], kind="stable")
        p = p[order]
        key = hashes[p]
        head = np.ones(len(p), bool)
        head[1:] = key[1:] != key[:-1]
        again = np.flatnonzero(~head)
        if not same(p[again], p[head][np.cumsum(head)[again] - 1]):
            return _later(data, start, end, width)  # two strings with one hash: the suffix array tells them apart
        out[p[again]] = True
        runs.append((key[head], p[head]))
    while len(runs) > 1:
        (a, p), (b, q) = runs.pop(0), runs.pop(0)
        place = np.searchsorted(a, b)
        hit = place < len(a)
        hit[hit] = a[place[hit]] == b[hit]
        to = place[hit]
        if not same(p[to], q[hit]):
            return _later(data, start, end, width)
        out[np.maximum(p[to], q[hit])] = True
        p[to] = np.minimum(p[to], q[hit])
        runs.append((np.insert(a, place[~hit], b[~hit]), np.insert(p, place[~hit], q[~hit])))
    return out


def _runs(mark: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the bytes that runs of marked strings cover. Runs never cross spans: the last starts of a span aren't strings."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mark, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2] + width - 1


_INTERVALS = "shard int, row int, s long, e long"
_CONTEXTS = f"key long, doc long, {_INTERVALS}, ctx binary"
_SEEN = "h long, n long, doc long, shard int, row int, s long, e long"


def removed(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """shard, row, s and e: intervals to remove from the rows of docs (doc_id, text, shard and more), in the order of _texts."""
    spark = docs.sparkSession
    n = shuffle_partitions(spark)

    def own_key(shard: int, row: int, s: int) -> int:
        """The key that a decided interval travels under, so that it is no burden for any one task."""
        return xxhash.xxh64_intdigest(b"%d %d %d" % (shard, row, s)) - (1 << 63)

    def report(t: pa.Table) -> pa.Table:
        shard, out = t.column("shard")[0].as_py(), [[] for _ in range(7)]
        for ids, row, low, joined, begin, stop, h, _, _ in _found(t, width, gram):
            h, count = np.unique(h, return_counts=True)
            for to, x in zip(out, (h, count, *[np.zeros(len(h), np.int64)] * 5), strict=True):
                to.append(x)
            a, b = _runs(_later(joined, begin, stop, width), width)
            k = np.searchsorted(begin, a, side="right") - 1
            s, e, r = a - begin[k] + low[k], b - begin[k] + low[k], row[k]
            keys = np.array([own_key(shard, x, y) for x, y in zip(r.tolist(), s.tolist(), strict=True)], np.int64)
            for to, x in zip(out, (keys, np.zeros(len(s), np.int64), ids[r], np.full(len(s), shard), r, s, e), strict=True):
                to.append(x)
        h, count, doc, _, row, s, e = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
        return pa.table({"h": h, "n": count, "doc": doc, "shard": pa.array(np.full(len(h), shard, np.int32)), "row": pa.array(row.astype(np.int32)), "s": s, "e": e})

    seen = docs.groupBy("shard").applyInArrow(report, _SEEN)  # a row with an end is an interval, any other a block's anchor
    by = Window.partitionBy("h")
    anchor = (F.col("e") == 0).cast("long")
    often = seen.withColumn("blocks", F.sum(anchor).over(by)).withColumn("total", F.sum("n").over(by)).where("e > 0 OR blocks > 1")
    often = often.select("shard", "h", (F.col("total") > hot).alias("hot"), "doc", "row", "s", "e")

    def contexts(t: pa.Table, known: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in range(6)]
        if not t.num_rows or not known.num_rows:
            return _sent(0, out)
        shard, found = t.column("shard")[0].as_py(), set()
        end = known.column("e").to_numpy()
        gone = known.filter(pa.array(end > 0))
        for to, c in zip(out, ("h", "doc", "row", "s", "e"), strict=False):
            to += gone.column(c).to_pylist()
        out[5] += [None] * gone.num_rows
        known = known.filter(pa.array(end == 0))
        h, at = np.unique(known.column("h").to_numpy(), return_index=True)
        is_hot = known.column("hot").to_numpy(zero_copy_only=False)[at]
        done: list[list[int]] = [[], [], []]
        ids = None
        for ids, row, low, joined, begin, _, got, first, last in _found(t, width, gram) if len(h) else ():
            at = np.searchsorted(h, got)
            at[at == len(h)] = 0
            hit = h[at] == got
            got, first, last, each = got[hit], first[hit], last[hit], is_hot[at[hit]]
            if each.any():  # the strings of hot anchors go one by one
                size = np.where(each, last - first + 1, 1)
                first = np.repeat(first, size) + np.where(np.repeat(each, size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size), 0)
                last, got, each = np.where(np.repeat(each, size), first, np.repeat(last, size)), np.repeat(got, size), np.repeat(each, size)
            k = np.searchsorted(begin, first, side="right") - 1
            s, text = first - begin[k] + low[k], joined.tobytes()
            for key, a, b, r, i, one in zip(got.tolist(), first.tolist(), (last + width).tolist(), row[k].tolist(), s.tolist(), each.tolist(), strict=True):
                ctx = text[a:b]
                if ctx in found:  # all of it began earlier in this very shard
                    for to, x in zip(done, (r, i, i + b - a), strict=True):
                        to.append(x)
                    continue
                found.add(ctx)
                key = xxhash.xxh64_intdigest(ctx) - (1 << 63) if one else key
                for to, x in zip(out, (key, ids[r], r, i, i + b - a, ctx), strict=True):
                    to.append(x)
        for r, a, b in zip(*(x.tolist() for x in _merged(*(np.array(x, np.int64) for x in done))), strict=True):
            for to, x in zip(out, (own_key(shard, r, a), ids[r], r, a, b, None), strict=True):
                to.append(x)
        return _sent(shard, out)

    sent = docs.groupBy("shard").cogroup(often.groupBy("shard")).applyInArrow(contexts, _CONTEXTS)

    def one(t: pa.Table) -> pa.RecordBatch:
        c = {k: t.column(k).combine_chunks() for k in ("doc", "shard", "row", "s", "e")}
        c = {k: v.to_numpy() for k, v in c.items()}
        ctx = t.column("ctx").combine_chunks()
        done = ctx.is_null().to_numpy(zero_copy_only=False)
        order = np.lexsort((c["s"], c["row"], c["doc"]))
        order = order[~done[order]]
        code = ctx.take(pa.array(order)).dictionary_encode()
        which, texts = code.indices.to_numpy(), code.dictionary
        first = np.full(len(texts), len(order))
        np.minimum.at(first, which, np.arange(len(order)))
        again = np.arange(len(order)) > first[which]  # the same context, further on
        new = np.flatnonzero(~again)
        data, off = utf8_parts(texts.take(pa.array(which[new])))
        data = data[off[0] : off[-1]]
        off = off - off[0]
        a, b = _runs(_across(data, off[:-1], off[1:], c["shard"][order[new]] % RUNS, width), width) if len(data) else (np.zeros(0, np.int64),) * 2
        of = np.searchsorted(off, a, side="right") - 1
        o = order[new][of]
        gone = np.concatenate([np.flatnonzero(done), order[again]])
        which = np.concatenate([c["shard"][gone].astype(np.int64) << 32 | c["row"][gone], c["shard"][o].astype(np.int64) << 32 | c["row"][o]])
        each, group = np.unique(which, return_inverse=True)
        s, e = np.concatenate([c["s"][gone], c["s"][o] + a - off[of]]), np.concatenate([c["e"][gone], c["s"][o] + b - off[of]])
        group, s, e = _merged(group.astype(np.int64), s, e)
        return pa.RecordBatch.from_pydict({"shard": pa.array(each[group] >> 32, pa.int32()), "row": pa.array(each[group] & 0xFFFFFFFF, pa.int32()), "s": s, "e": e})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "key", MERGE // (width + 40)):
            yield one(t)

    return sent.repartition(n, "key").sortWithinPartitions("key").mapInArrow(merge, _INTERVALS)


def _sent(shard: int, out: list[list]) -> pa.Table:
    key, doc, row, s, e, ctx = (pa.array(x, kind) for x, kind in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True))
    return pa.table({"key": key, "doc": doc, "shard": pa.array([shard] * len(key), pa.int32()), "row": row, "s": s, "e": e, "ctx": ctx})


def _merged(group: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group numbers, starts and ends of the unions of intervals within each group."""
    if not len(s):
        return group, s, e
    far = 1 << 38  # beyond any text
    s, e = _union(group * far + s, group * far + e)
    return s // far, s % far, e - s // far * far


def _union(s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal intervals that cover the same as these; touching ones are one."""
    order = np.argsort(s, kind="stable")
    s, reach = s[order], np.maximum.accumulate(e[order])
    head = np.concatenate([[True], s[1:] > reach[:-1]])
    return s[head], reach[np.append(np.flatnonzero(head)[1:] - 1, len(s) - 1)]


def _cut(docs: DataFrame, doc_id: str, text: str, schema: str | T.StructType, make, width: int, gram: int, hot: int) -> DataFrame:
    """One row of every row of docs: make(shard's table, its rows in order, and for each the whole text, starts and ends of what goes)."""
    parts = shuffle_partitions(docs.sparkSession)
    estimate = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = max(4 * parts, estimate // SHARD if estimate < 1 << 60 else 0)  # beyond that it is no estimate
    rest = F.struct(F.col(text).isNull().alias("null_text"), *(F.col(c) for c in docs.columns if c != text))
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"), rest.alias("rest"))
    # every step below reads all columns of this one exchange, so that Spark makes it once
    d = d.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")).repartition(parts, "shard")
    gone = removed(d, width, gram, hot)
    none = np.zeros(0, np.int64)

    def cut(t: pa.Table, gone: pa.Table) -> pa.Table:
        ids, data, starts, ends, order = _texts(t)
        row, s, e = (gone.column(c).to_numpy() for c in ("row", "s", "e"))
        by = np.argsort(row, kind="stable")
        row, s, e = row[by], s[by], e[by]
        at = np.searchsorted(row, np.arange(len(ids) + 1))
        each = ((data[starts[i] : ends[i]].tobytes(), *(_union(s[at[i] : at[i + 1]], e[at[i] : at[i + 1]]) if at[i + 1] > at[i] else (none, none))) for i in range(len(ids)))
        return make(t.take(pa.array(order)), each)

    return d.groupBy("shard").cogroup(gone.groupBy("shard")).applyInArrow(cut, schema)


def _kept(whole: bytes, s: np.ndarray, e: np.ndarray) -> bytes:
    return b"".join(whole[p:q] for p, q in zip([0, *e.tolist()], [*s.tolist(), len(whole)], strict=True))


def cut_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row.

    Each byte goes that a string of width bytes covers which also starts earlier: in a smaller doc_id or earlier in the
    same text. A null text is empty. A null doc_id comes before all others; rows with one id are ordered by their text,
    and equal rows by chance, which changes no result.
    """

    def make(t: pa.Table, each: Iterator[tuple]) -> pa.Table:
        rows = [(len(w), int((e - s).sum()), len(s), hashlib.sha256(_kept(w, s, e)).hexdigest()) for w, s, e in each]
        names = ("n_bytes", "n_removed", "n_spans")
        return pa.table({"doc_id": t.column("doc_id")} | {k: pa.array([r[i] for r in rows], pa.int64()) for i, k in enumerate(names)} | {"kept_sha256": pa.array([r[3] for r in rows], pa.string())})

    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return _cut(d, "doc_id", "text", "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", make, width, gram, hot)


def cut_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """All columns of docs, with the text that stays, and n_cut, the bytes that went. Parts of cut characters go too; a null text stays null.

    Where docs has a column n_cut already, the new one is n_cut_.
    """
    names, n_cut = docs.columns, free("n_cut", docs.columns)

    def make(t: pa.Table, each: Iterator[tuple]) -> pa.Table:
        rest = t.column("rest").combine_chunks()
        rows = [(_kept(w, s, e).decode("utf-8", "ignore"), int((e - s).sum())) for w, s, e in each]
        new = pa.array([None if v else r[0] for r, v in zip(rows, rest.field(0).to_pylist(), strict=True)], pa.string())
        at = {k: i + 1 for i, k in enumerate(k for k in names if k != text)}
        return pa.table({k: new if k == text else rest.field(at[k]) for k in names} | {n_cut: pa.array([r[1] for r in rows], pa.int64())})

    return _cut(docs, doc_id, text, T.StructType([*docs.schema.fields, T.StructField(n_cut, T.LongType())]), make, width, gram, hot)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What repeats of 100 bytes cost every document."""
    from rivulet.llm.common import table

    return cut_repeats(table(spark, sf_dir, "documents"))
