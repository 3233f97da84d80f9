"""SimHash near-duplicates by a tiled exact comparison of fingerprints.

Distinct fingerprints are dealt by their blocks of bits, one more than the radius. Two fingerprints within the radius are
equal in one block at least, so only those that share a block meet; a block's value that many have is cut into tiles
within a bound of rows, all pairs of which meet. There numpy compares every fingerprint to every other by exclusive or and
bit count. What is compared at once returns a spanning forest of its links rather than all of them: no more rows than
fingerprints, and the same components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import checkpoint, components, local_roots, row_hash, shuffle_partitions, whole_groups

#: Words of a shingle, and bits in which linked fingerprints may differ.
SHINGLE, RADIUS = 4, 4
#: Fingerprints of a tile, about.
TILE = 8192
#: Of similar(): bits within which texts of that similarity are found, slots of a MinHash sketch, and how far below the
#: similarity a sketch may be for the texts to be compared.
WIDE_RADIUS, SLOTS, SLACK = 20, 64, 0.15
#: Its tiles are of rows that share some slots. All pairs of a key's tiles meet, so fewer and larger ones move less.
WIDE_TILE = 32768
#: Rows of a key, at most, for it to be compared together with other keys.
FEW = 64
#: Shingles of the texts that meet in one task when a group is compared pair by pair, about.
MEET = 1 << 19
SEED = 42
#: Shingles whose bits are counted at once.
PIECE = 1 << 16


def shingles(text: bytes, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """Hashes of a UTF-8 text's shingles, repeats included, PIECE at a time; a text without words has none."""
    low = text.lower()  # of bytes: A-Z only
    words = low.split()  # at \\x20 and \\x09-\\x0d
    if not words:
        return
    line = b" ".join(words)
    n = len(words) - shingle + 1
    if n <= 1:
        yield np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
        return
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    ends, digest = ends[shingle - 1 :].tolist(), xxhash.xxh64_intdigest
    for i in range(0, n, PIECE):
        yield np.array([digest(line[a:b], SEED) for a, b in zip(starts[i : i + PIECE], ends[i : i + PIECE], strict=True)], np.uint64)


def combined(hashes: Iterator[np.ndarray]) -> int:
    """The 64-bit SimHash: a bit is set if it is in over half of the hashes."""
    total, n = np.zeros(64, np.int64), 0
    for h in hashes:
        n += len(h)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):  # sums of at most 255 ones fit a byte
            total += np.add.reduce(bits[k : k + 255], axis=0, dtype=np.uint8)
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    return combined(shingles(text, shingle))


def sketch(distinct: np.ndarray) -> bytes:
    """A byte of the smallest hash in each of SLOTS classes of hashes, 0 for a class without any."""
    out = np.zeros(SLOTS, np.uint8)
    mixed = np.sort((distinct ^ (distinct >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD))
    slot = (mixed >> np.uint64(58)).astype(np.int64)  # the classes are the 64 ranges of mixed hashes
    first = np.concatenate([[True], slot[1:] != slot[:-1]]) if len(slot) else np.zeros(0, bool)
    out[slot[first]] = (mixed[first] * np.uint64(0xC4CEB9FE1A85EC53) >> np.uint64(56)).astype(np.uint8) % 255 + 1
    return out.tobytes()


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row; a null text or one without words has fp 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle) for t in b.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _blocks(radius: int):
    """Keys of fingerprints: their radius + 1 blocks of bits. Two that differ in radius bits at most are equal in a block."""
    cuts = [64 * k // (radius + 1) for k in range(radius + 2)]

    def keys(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        fp = b.column("fp").to_numpy().view(np.uint64)
        each = [(fp >> np.uint64(i) & np.uint64((1 << (j - i)) - 1)) << np.uint64(7) | np.uint64(k % 128) for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)) if i < 64]
        return np.tile(np.arange(len(fp)), len(each)), np.concatenate(each).view(np.int64)

    return keys


def _slots(least: float):
    """Keys of sketches: their runs of so few slots that two sketches as alike as least are equal in a run that isn't empty.

    Of the slots that either fills, more than 1 - least differ in no such pair, and each spoils one run. If every run with an
    equal slot were spoilt, the equal slots would be (length - 1) (1 - least) of them at most, which is less than least.
    """
    length = 1
    while length < 7 and length * (1 - least) < least - 1e-9:
        length += 1

    def keys(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        if least <= 0:  # sketches with nothing in common are as alike
            return np.arange(b.num_rows), np.zeros(b.num_rows, np.int64)
        marks = np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint8).reshape(-1, SLOTS).astype(np.int64)
        rows, found = [], []
        for k, i in enumerate(range(0, SLOTS, length)):
            value = np.zeros(len(marks), np.int64)
            for j in range(i, min(SLOTS, i + length)):
                value = value << 8 | marks[:, j]
            rows.append(np.flatnonzero(value))
            found.append(value[rows[-1]] << 7 | k)
        return np.concatenate(rows), np.concatenate(found)

    return keys


def _dealt(nodes: DataFrame, keys, tile: int) -> DataFrame:
    """key, first, alone, node and fp: a row for every key of a node, sorted by key within partitions.

    Nodes meet that share a key. A key of many rows is cut into tiles of about tile rows, and all pairs of its tiles meet
    under keys of their own: rows that are first with the others, and all rows of a key that is alone with each other.
    """
    spark = nodes.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, key = keys(b)
            for i in range(0, len(at), 1 << 18):
                rows = pa.array(at[i : i + (1 << 18)])
                yield pa.RecordBatch.from_arrays([pa.array(key[i : i + (1 << 18)]), b.column("node").take(rows), b.column("fp").take(rows)], ["key", "node", "fp"])

    d = nodes.mapInArrow(run, "key long, node long, fp long")
    some = max(1, min(16, tile // 64))  # of so many nodes one is counted: that decides how a key is cut and nothing else
    many = d.where(F.pmod(F.xxhash64("node"), F.lit(some)) == 0).groupBy("key").agg((F.count("*") * some).alias("n")).where(F.col("n") > tile)
    many = many.select(F.col("key").alias("cut"), F.ceil(F.col("n") / tile).cast("int").alias("parts"))
    d = d.join(F.broadcast(many), F.col("key") == F.col("cut"), "left")
    d = d.withColumn("own", F.coalesce(F.expr("pmod(xxhash64(node), parts)"), F.lit(0))).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0)))))
    key = F.when(F.col("parts").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
    d = d.select(key.alias("key"), (F.col("own") <= F.col("other")).alias("first"), (F.col("own") == F.col("other")).alias("alone"), "node", "fp")
    return d.repartition(shuffle_partitions(spark), "key").sortWithinPartitions("key", "node")


def _met(t: pa.Table, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of whole keys that meet and whose fingerprints are within the radius, as pairs of indices, many at a time."""
    key, first, alone, fp = (t.column(c).to_numpy() for c in ("key", "first", "alone", "fp"))
    fp = fp.view(np.uint64)
    cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
    sizes = np.diff(cuts)
    few = (sizes <= FEW) & alone[cuts[:-1]].astype(bool)
    end = np.repeat(np.where(few, cuts[1:], 0), sizes)
    at, step = np.arange(len(key)), 1
    while len(at := at[at + step < end[at]]):  # every row and the step-th after it, of all small keys at once
        x = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= radius]
        yield x, x + step
        step += 1
    for k in np.flatnonzero(~few & (sizes > 1)):
        i, j = int(cuts[k]), int(cuts[k + 1])
        to = i + np.argsort(~first[i:j].astype(bool), kind="stable")
        split = 0 if alone[i] else int(first[i:j].sum())
        f, n = fp[to], split or j - i
        rows = max(1, (1 << 21) // (j - i))
        for i in range(0, n if alone[cuts[k]] else split, rows):
            least = split or i  # inside a key only the rows behind are left
            x, y = np.nonzero(np.bitwise_count(f[i : min(n, i + rows), None] ^ f[None, least:]) <= radius)
            x, y = x + i, y + least
            keep = x < y
            yield to[x[keep]], to[y[keep]]


def _alike(marks: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    p, q = marks[x], marks[y]
    return ((p == q) & (p > 0)).sum(1) / np.maximum(((p > 0) | (q > 0)).sum(1), 1)


def _likely(t: pa.Table, radius: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A forest over pairs that meet within the radius and whose sketches are as similar, the most similar pairs first."""
    ids, first, of = np.unique(t.column("node").to_numpy(), return_index=True, return_inverse=True)
    marks = np.frombuffer(b"".join(t.column("sketch").take(pa.array(first)).to_pylist()), np.uint8).reshape(-1, SLOTS)
    n, label = len(ids), np.arange(len(ids))  # label: what pairs that are surely similar join: no further pair is needed there
    found: list[list[np.ndarray]] = [[], [], []]
    for x, y in _met(t, radius):
        x, y = of[x], of[y]
        keep = label[x] != label[y]
        x, y = x[keep], y[keep]
        while len(x):
            a, b = x[:100_000], y[:100_000]
            like = _alike(marks, a, b)
            keep = like >= similarity - SLACK
            for to, v in zip(found, (a[keep], b[keep], like[keep]), strict=True):
                to.append(v)
            sure = like >= similarity + SLACK / 2
            label = local_roots(n, a[sure], b[sure], label)
            x, y = x[100_000:], y[100_000:]
            keep = label[x] != label[y]
            x, y = x[keep], y[keep]
        if sum(map(len, found[0])) > 1 << 21:  # a large group: its forest so far stands for all its pairs
            found = [[v] for v in _best(n, *map(np.concatenate, found))]
    x, y, _ = _best(n, *map(np.concatenate, found)) if found[0] else (np.zeros(0, np.int64),) * 3
    return ids[x], ids[y]


def _best(n: int, x: np.ndarray, y: np.ndarray, like: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs that join what all pairs join, those of greater likeness first, in steps of a twentieth: Boruvka's forest."""
    label, kept = np.arange(n), []
    step = np.floor(like * 20)
    for level in np.unique(step)[::-1]:
        at = np.flatnonzero(step == level)
        while True:
            at = at[label[x[at]] != label[y[at]]]
            if not len(at):
                break
            # each part takes one pair to another part; of two parts that take each other one pair is enough
            part = np.concatenate([label[x[at]], label[y[at]]])
            _, one = np.unique(part, return_index=True)
            some = np.unique(at[one % len(at)])
            new = _tree(n, label, x, y, some)
            kept.append(new)
            label = local_roots(n, x[new], y[new], label)
    kept = np.concatenate(kept) if kept else np.zeros(0, np.int64)
    return x[kept], y[kept], like[kept]


def _tree(n: int, label: np.ndarray, x: np.ndarray, y: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Of these pairs those that close no circle."""
    parent = {}

    def root(i: int) -> int:
        while (p := parent.get(i, i)) != i:
            parent[i] = parent.get(p, p)
            i = p
        return i

    out = []
    for k, a, b in zip(some.tolist(), label[x[some]].tolist(), label[y[some]].tolist(), strict=True):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append(k)
    return np.array(out, np.int64)


def _link(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """a and b: pairs of distinct fingerprints (column fp, each once) within the radius that join what all such pairs join."""
    d = _dealt(fps.select(F.col("fp").alias("node"), "fp"), _blocks(radius), tile)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "key", 1 << 15):
            ids, of = np.unique(t.column("node").to_numpy(), return_inverse=True)
            label = np.arange(len(ids))
            for x, y in _met(t, radius):
                label = local_roots(len(ids), of[x], of[y], label)
            if len(linked := np.flatnonzero(label != np.arange(len(ids)))):
                yield _link(ids[linked], ids[label[linked]])

    return d.mapInArrow(compare, "a long, b long")


def proposed(nodes: DataFrame, similarity: float, radius: int = WIDE_RADIUS, tile: int = WIDE_TILE) -> DataFrame:
    """a and b: pairs of nodes (node, fp, sketch) within the radius, with sketches as similar less SLACK, that join what all such pairs join.

    They meet under the runs of their sketches' slots, in one of which any such pair is equal. Rows that are near to another
    one under their key get their sketches then, so that the others are moved as three numbers.
    """
    d = _dealt(nodes.select("node", "fp", "sketch"), _slots(similarity - SLACK), tile)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "key", 1 << 15):
            some = np.zeros(t.num_rows, bool)
            for x, y in _met(t, radius):
                some[x] = some[y] = True
            yield from t.select(["key", "first", "alone", "node"]).filter(pa.array(some)).combine_chunks().to_batches()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "key", 1 << 15):
            x, y = _likely(t, radius, similarity)
            if len(x):
                yield _link(x, y)

    d = d.mapInArrow(near, "key long, first boolean, alone boolean, node long").withColumnRenamed("node", "n2")
    d = d.join(nodes.select("node", "fp", "sketch"), F.col("n2") == F.col("node")).select("key", "first", "alone", "node", "fp", "sketch")
    return d.repartition(shuffle_partitions(nodes.sparkSession), "key").sortWithinPartitions("key", "node").mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """doc_id, fp, component_id and first of every row.

    component_id is the smallest doc_id reachable over links; first marks the row that stays of each component (the one
    whose doc_id is component_id; of repeated rows with that id all are marked). Documents with one fingerprint are one
    node of the graph, so copies cost one row each and nothing more. Null texts and those without words share the
    fingerprint 0, which links like any other; rows with a null doc_id never give a component its id unless all are null.
    Repeated rows are rows of their own, as are rows that share an id; other columns of docs have no part in it. A text of
    any length is taken whole, PIECE shingles at a time.
    """
    d = checkpoint(fingerprints(docs, doc_id, text, shingle))
    nodes = checkpoint(d.groupBy("fp").agg(F.min("doc_id").alias("least")))
    root = components(links(nodes, radius, tile))
    nodes = nodes.join(root, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    nodes = checkpoint(nodes)
    # read from the shared folder, so that both sides of the join are plain exchanges and a large component can be split
    least = checkpoint(nodes.groupBy("root").agg(F.min("least").alias("component_id")))
    named = checkpoint(nodes.join(least, "root").select("fp", "component_id"))
    return d.join(named, "fp").select("doc_id", "fp", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("first"))


def _linked(grams: list[np.ndarray], part: np.ndarray, split: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what all similar pairs join: pairs of all rows (split 0), or of the first split rows and the others.

    Rows of one part are joined already; every pair of rows that aren't joined yet is compared by its whole sets.
    """
    n, sizes = len(grams), np.array([len(g) for g in grams])
    words = np.unique(np.concatenate(grams), return_inverse=True)[1]
    ends = np.cumsum([0, *sizes])
    _, first, at = np.unique(part, return_index=True, return_inverse=True)
    before = label = first[at]
    seen = np.zeros(int(words.max(initial=-1)) + 1, bool)
    for i in range(split or n):
        to = np.arange(split or i + 1, n)
        to = to[(label[to] != label[i]) & (np.minimum(sizes[to], sizes[i]) >= similarity * np.maximum(sizes[to], sizes[i])) & (sizes[to] > 0)]
        if len(to):
            mine = words[ends[i] : ends[i + 1]]
            seen[mine] = True
            shared = np.add.reduceat(seen[np.concatenate([words[ends[k] : ends[k + 1]] for k in to])], np.cumsum([0, *sizes[to[:-1]]]), dtype=np.int64)
            seen[mine] = False
            to = to[shared >= similarity * (sizes[i] + sizes[to] - shared)]
            label = local_roots(n, np.full(len(to), i), to, label.copy())
    new = np.flatnonzero((before == np.arange(n)) & (label != before))
    return new, label[new]


def _rest(groups: DataFrame, parts: DataFrame, grams: DataFrame, similarity: float) -> DataFrame:
    """a and b: links between the parts of each group of proposed pairs that join what all similar pairs in it join.

    groups and parts: node and root over proposed and over similar pairs; grams: node and its set of shingles. A group of
    one part is done. The others are cut into tiles of MEET shingles; all pairs of tiles meet, but for those of which both
    hold only the group's largest part.
    """
    n = shuffle_partitions(grams.sparkSession)
    m = groups.select("node", F.col("root").alias("grp")).join(parts.select(F.col("node").alias("n2"), F.col("root").alias("part")), F.col("node") == F.col("n2"), "left")
    m = m.select("node", "grp", F.coalesce("part", "node").alias("part")).join(grams.select("node", F.size("grams").alias("size")), "node")
    m = checkpoint(m)
    each = m.groupBy("grp", "part").agg(F.sum("size").alias("size"))
    todo = each.groupBy("grp").agg(F.count("*").alias("parts"), F.sum("size").alias("all"), F.max(F.struct("size", "part")).alias("top")).where("parts > 1")
    apart = F.col("all") > MEET  # a small group is one tile
    todo = todo.select("grp", F.when(apart, F.col("top.part")).alias("main"), F.when(apart, F.ceil(F.col("top.size") / MEET)).otherwise(0).alias("k"), F.greatest(F.lit(1), F.ceil((F.col("all") - F.when(apart, F.col("top.size")).otherwise(0)) / MEET)).alias("j"))
    d = m.join(todo, "grp").withColumn("is_main", F.col("part").eqNullSafe(F.col("main"))).withColumn("h", F.xxhash64("node"))
    d = d.withColumn("own", F.when(F.col("is_main"), F.expr("pmod(h, k)")).otherwise(F.expr("k + pmod(h, j)")))
    d = d.withColumn("other", F.explode(F.sequence(F.when(F.col("is_main"), F.col("k")).otherwise(F.lit(0)), F.expr("k + j - 1"))))
    d = d.select("node", "part", (F.col("own") <= F.col("other")).alias("first"), (F.col("own") == F.col("other")).alias("alone"), F.xxhash64("grp", F.least("own", "other"), F.greatest("own", "other")).alias("key"))
    d = d.join(grams, "node").select("key", "node", "part", "first", "alone", "grams")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "key"):
            t = t.combine_chunks()
            key, node, part, first, alone = (t.column(c).to_numpy() for c in ("key", "node", "part", "first", "alone"))
            lists = t.column("grams").combine_chunks()
            flat, off = lists.values.to_numpy(), lists.offsets.to_numpy()
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                order = i + np.argsort(~first[i:j], kind="stable")
                split = 0 if alone[i] else int(first[i:j].sum())
                if j - i > 1 and (alone[i] or 0 < split < j - i):
                    x, y = _linked([flat[off[k] : off[k + 1]] for k in order], part[order], split, similarity)
                    if len(x):
                        yield pa.RecordBatch.from_arrays([pa.array(node[order[x]]), pa.array(node[order[y]])], ["a", "b"])

    return d.repartition(n, "key").sortWithinPartitions("key").mapInArrow(meet, "a long, b long")


def _mark(doc_id: str, text: str) -> F.Column:
    """What rows that are equal in id and text, and no others, have in common."""
    whole = F.concat(F.coalesce(F.col(doc_id).cast("long").cast("string"), F.lit("null")), F.when(F.col(text).isNull(), "-").otherwise("+"), F.coalesce(F.col(text), F.lit("")))
    return F.md5(whole.cast("binary"))


def _set_of(text: pa.Scalar, shingle: int) -> np.ndarray:
    """The hashes of a text's distinct shingles, sorted."""
    h = list(shingles(text.as_buffer().to_pybytes() if text.is_valid else b"", shingle))
    return np.unique(np.concatenate(h)) if h else np.zeros(0, np.uint64)


def _similar(docs: DataFrame, doc_id: str, text: str, shingle: int, similarity: float, radius: int, tile: int) -> tuple[DataFrame, DataFrame]:
    """Every row's doc_id, mark and digest of its set of shingles; and every set's digest, root and first row.

    The nodes of the graph are the sets, numbered for it, so whatever rows share (an id, a text, or neither of them being
    there) has no part in what links. first: whether the doc_id is null, the doc_id, and the mark, of the least of a set's rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], []]
            for t in b.column("text"):
                h = _set_of(t, shingle)
                out[0].append(combined(h[i : i + PIECE] for i in range(0, len(h), PIECE)))
                out[1].append(sketch(h))
                out[2].append(xxhash.xxh3_128_digest(h.tobytes()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("mark"), pa.array(np.array(out[0], np.uint64).view(np.int64)), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], ["doc_id", "mark", "fp", "sketch", "digest"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [_set_of(t, shingle) for t in b.column("text")]
            ends = np.cumsum([0, *map(len, each)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*each, np.zeros(0, np.uint64)]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("node"), lists], ["node", "grams"])

    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), _mark(doc_id, text).alias("mark"), F.col(text).cast("binary").alias("text"))
    d = checkpoint(plain.mapInArrow(run, "doc_id long, mark string, fp long, sketch binary, digest binary"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "mark"))
    nodes = checkpoint(d.groupBy("digest").agg(least.alias("first"), F.first("fp").alias("fp"), F.first("sketch").alias("sketch")).withColumn("node", F.monotonically_increasing_id()))
    pairs = checkpoint(proposed(nodes, similarity, radius, tile))
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    of = ends.join(nodes, "node").select("node", F.col("first.mark").alias("of"))
    grams = plain.select("mark", "text").join(of, F.col("mark") == F.col("of")).select("node", "text").mapInArrow(sets, "node long, grams array<long>")
    grams = checkpoint(grams.groupBy("node").agg(F.first("grams").alias("grams")))  # a row that is there twice is one set
    left, right = (grams.select(F.col("node").alias(c), F.col("grams").alias(f"of_{c}")) for c in ("a", "b"))
    shared = F.size(F.array_intersect("of_a", "of_b"))
    near = checkpoint(pairs.join(left, "a").join(right, "b").where(shared >= similarity * (F.size("of_a") + F.size("of_b") - shared)).select("a", "b"))
    root = components(near.unionByName(_rest(components(pairs), components(near), grams, similarity))).withColumnRenamed("node", "n2")
    return d, checkpoint(nodes.join(root, F.col("node") == F.col("n2"), "left").select("digest", "first", F.coalesce("root", "node").alias("root")))


def similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, radius: int = WIDE_RADIUS, tile: int = WIDE_TILE) -> DataFrame:
    """doc_id, component_id (its smallest doc_id) and first of every row, where texts link whose shingle sets are similar (Jaccard).

    Fingerprints of these sets (without repeats) within a wide radius propose pairs, MinHash sketches in the same tiles sort out those that can't be
    similar, and each tile pair returns a forest of the others, the most similar first; its pairs are then compared by
    their whole sets of shingles. A forest reaches what all proposed pairs reach, so what it joins is a group that no link
    leaves. Where a pair of it fails, every two texts of the group that similar pairs don't join yet are compared by their
    whole sets too: a group of true copies costs as many comparisons as it has members, others up to all pairs. Texts
    whose sets are equal are copies, one node of the graph. Texts without words, null ones too, are copies of each other.
    Of simulated pairs of equally long texts (random hashes, 1500 pairs a case) at 0.80 alike 99.8% were proposed at 300 and
    at 900 shingles and all at 45; at 0.85 and 0.90 all were.

    first marks the row of each component that comes first: by doc_id, null last, then by a hash of id and text; rows that
    are equal in both are marked together. Rows may share an id, or have none: they link by their texts alone. A text of any
    length is one set of hashes in a task, eight bytes a word. Other columns of docs have no part in it.
    """
    d, nodes = _similar(docs, doc_id, text, shingle, similarity, radius, tile)
    least = checkpoint(nodes.groupBy("root").agg(F.min("first").alias("least")))
    named = checkpoint(nodes.join(least, "root").select(F.col("digest").alias("set"), F.col("least.doc_id").alias("component_id"), F.col("least.mark").alias("kept")))
    out = d.join(named, F.col("digest") == F.col("set"))
    return out.select("doc_id", "component_id", (F.col("mark") == F.col("kept")).alias("first"))


def one_of_similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, radius: int = WIDE_RADIUS, tile: int = WIDE_TILE) -> DataFrame:
    """All columns of docs, and one row of each component of similar(): the first.

    Of rows that are equal in id and text one stays, the one with the least hash of its columns. What a task holds of a
    component is a minimum, however many rows it has.
    """
    _, nodes = _similar(docs, doc_id, text, shingle, similarity, radius, tile)
    kept = nodes.groupBy("root").agg(F.min("first").alias("least")).select(F.col("least.mark").alias("of"))
    rows = docs.select(_mark(doc_id, text).alias("mark"), F.struct(*docs.columns).alias("row"), row_hash(docs).alias("order"))
    return rows.join(kept, F.col("mark") == F.col("of")).groupBy("mark").agg(F.min_by("row", "order").alias("row")).select("row.*")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    from rivulet.llm.common import table

    d = near_duplicates(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
