"""Near-duplicate embeddings by spherical-cap filters.

A vector is cut into BLOCKS blocks of rotated coordinates, and each block has its own random code of unit directions. A
filter is one direction of every block, so a few hundred directions stand for tens of thousands of filters. A vector
belongs to each filter whose direction it exceeds the threshold with; the partial products of its blocks list those
without trying all filters (list decoding). Vectors that share a filter meet and are verified in double precision. The
threshold rises and the code grows with the number of vectors, so that a filter's expected population stays the same.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import checkpoint, components, local_roots, shuffle_partitions, whole_groups

COSINE = 0.95
BLOCKS = 2
#: Vectors that a filter is expected to hold, unless a cluster lies in its cap.
POPULATION = 64
#: Filters that a linked pair at the least cosine is expected to share: all but exp(-SHARED) of such pairs are found.
SHARED = 10.0
#: Rows of a filter that meet in one task; a filter with more is cut into tiles, and every pair of its tiles meets.
TILE = 2048


def _upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _both(z: float, rho: float) -> float:
    """Probability that two standard normals with correlation rho both exceed z, by the trapezoid rule."""
    x = np.linspace(z, z + 8, 4001)
    y = np.exp(-x * x / 2) / math.sqrt(2 * math.pi) * np.array([_upper((z - rho * v) / math.sqrt(1 - rho * rho)) for v in x])
    return float(((y[1:] + y[:-1]) / 2).sum() * (x[1] - x[0]))


class Code:
    """The filters for n vectors of dim numbers: a rotation, the blocks' directions and the threshold."""

    def __init__(self, dim: int, n: int, cosine: float = COSINE, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.dim, blocks = dim, min(BLOCKS, dim)
        z = 0.5
        while _upper(z) * n > POPULATION and z < 5:
            z += 0.05
        self.size = max(2, math.ceil((SHARED / _both(z, cosine)) ** (1 / blocks)))
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.cuts = [x for x in np.array_split(np.arange(dim), blocks)]
        self.directions = []
        for c in self.cuts:
            x = rng.standard_normal((self.size, len(c)))
            self.directions.append(x / np.linalg.norm(x, axis=1, keepdims=True) * math.sqrt(len(c) / dim))
        self.least = z / math.sqrt(dim)

    def decode(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers of v (unit vectors) and the filters that they exceed, as one number each."""
        parts = [(v @ self.rotation)[:, c] @ d.T for c, d in zip(self.cuts, self.directions, strict=True)]
        best = [p.max(1) for p in parts]
        rows, code, score = np.arange(len(v)), np.zeros(len(v), np.int64), np.zeros(len(v))
        for k, p in enumerate(parts):
            rest = sum(best[k + 1 :], np.zeros(len(v)))
            out = [[], [], []]
            step = max(1, (1 << 22) // self.size)
            for i in range(0, len(rows), step):
                s = score[i : i + step, None] + p[rows[i : i + step]]
                x, y = np.nonzero(s + rest[rows[i : i + step], None] >= self.least)
                out[0].append(rows[i : i + step][x])
                out[1].append(code[i : i + step][x] * self.size + y)
                out[2].append(s[x, y])
            rows, code, score = (np.concatenate(o) if o else np.zeros(0, np.int64) for o in out)
        return rows, code


@lru_cache(8)
def _code(dim: int, n: int, cosine: float, seed: int) -> Code:
    return Code(dim, n, cosine, seed)


def _blobs(column: pa.Array, kind: str) -> list[bytes | None]:
    """The numbers of each row as bytes, -0.0 as 0.0; None for rows that can't link: null, empty, zero, or with a number that isn't finite."""
    values = column.flatten().cast(pa.float32() if kind == "<f4" else pa.float64())
    x = values.fill_null(np.nan).to_numpy(zero_copy_only=False) + np.array(0.0, kind)
    size = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    bad, some = (np.concatenate([[0], np.cumsum(m)]) for m in (~np.isfinite(x), x != 0))
    fit = (bad[ends] == bad[ends - size]) & (some[ends] > some[ends - size])
    raw, width = x.astype(kind).tobytes(), np.dtype(kind).itemsize
    return [raw[(e - s) * width : e * width] if f else None for f, s, e in zip(fit.tolist(), size.tolist(), ends.tolist(), strict=True)]


def _units(blobs: pa.Array, kind: str) -> np.ndarray:
    """Unit vectors, in double precision, of blobs of one length."""
    v = np.frombuffer(b"".join(blobs.to_pylist()), kind).reshape(len(blobs), -1).astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


class _Met:
    """Whether two rows of a task share a filter below the one where they meet: then they are counted there."""

    def __init__(self, filters: list[np.ndarray], here: int):
        codes, at, n = np.unique(np.concatenate(filters), return_inverse=True, return_counts=True)
        rows = np.repeat(np.arange(len(filters)), [len(f) for f in filters])
        useful = np.flatnonzero((codes < here) & (n > 1))
        useful = useful[np.argsort(-n[useful], kind="stable")]  # those of many rows tell most pairs apart at once
        self.blocks = []
        for i in range(0, len(useful), 2048):
            place = np.full(len(codes), -1)
            place[useful[i : i + 2048]] = np.arange(len(useful[i : i + 2048]))
            hit = np.flatnonzero(place[at] >= 0)
            has = np.zeros((len(filters), 2048), bool)
            has[rows[hit], place[at[hit]]] = True
            self.blocks.append(np.packbits(has, axis=1).view(np.uint64))

    def new(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for has in self.blocks:
            keep = [~(has[x[i : i + 50_000]] & has[y[i : i + 50_000]]).any(1) for i in range(0, len(x), 50_000)]
            if keep:
                x, y = x[keep := np.concatenate(keep)], y[keep]
        return x, y


def _linked(v: np.ndarray, n: np.ndarray, filters: list, here: int, cosine: float, split: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with links, how many vectors (n of each row) they link with, and the first row that each reaches.

    Links are among all rows (split 0) or between the first split rows and the others; each only at the smallest filter
    that both rows are in.
    """
    a, b = (v, v) if not split else (v[:split], v[split:])
    far, label, met = np.zeros(len(v), np.int64), np.arange(len(v)), None
    for i in range(0, len(a), 512):
        x, y = np.nonzero(a[i : i + 512] @ b.T >= cosine)
        x, y = x + i, y + split
        if not split:
            x, y = x[x < y], y[x < y]
        if not len(x):
            continue
        met = met or _Met(filters, here)
        x, y = met.new(x, y)
        np.add.at(far, x, n[y])
        np.add.at(far, y, n[x])
        label = local_roots(len(v), x, y, label)
    rows = np.flatnonzero(far)
    return rows, far[rows], label[rows]


def links(nodes: DataFrame, kind: str, cosine: float = COSINE, seed: int = 5) -> DataFrame:
    """node, far and root: of vectors that have links with a task's others how many, and one that they reach there.

    nodes: node, blob (numbers of numpy's type kind) and n, the number of vectors that are equal to it. A vector has a row
    for each task where it has links; far adds up to the vectors that it links with, each of which is counted once, and
    the pairs (node, root) join what links join. Vectors of different lengths never meet.
    """
    spark, width = nodes.sparkSession, np.dtype(kind).itemsize
    nodes = nodes.withColumn("dim", (F.length("blob") / width).cast("int"))
    sizes = {r.dim: r.n for r in nodes.groupBy("dim").agg(F.count("*").alias("n")).where("n > 1").collect()}  # a row a length

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Parts of batches, each with the rows of it and the filters that they are in, by row and filter."""
        for b in batches:
            for dim in pa.compute.unique(b.column("dim")).to_pylist():
                if dim not in sizes:
                    continue
                same = b.filter(pa.compute.equal(b.column("dim"), dim))
                code = _code(dim, sizes[dim], cosine, seed)
                for i in range(0, same.num_rows, 4096):
                    part = same.slice(i, 4096)
                    rows, f = code.decode(_units(part.column("blob"), kind))
                    order = np.lexsort((f, rows))
                    yield part, rows[order], f[order], dim

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, f, dim in decoded(batches):
            f, n = np.unique(f, return_counts=True)
            yield pa.RecordBatch.from_pydict({"dim": pa.array([dim] * len(f), pa.int32()), "filter": f, "n": n.astype(np.int64)})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows, f, dim in decoded(batches):
            ends, raw = np.searchsorted(rows, np.arange(part.num_rows + 1)) * 8, f.tobytes()
            lists = pa.array([raw[i:j] for i, j in zip(ends, ends[1:], strict=False)], pa.binary())
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([pa.array([dim] * len(f), pa.int32()), pa.array(f), *(part.column(c).take(at) for c in ("node", "n", "blob")), lists.take(at)], ["dim", "filter", "node", "n", "blob", "filters"])

    big = checkpoint(nodes.select("dim", "blob").mapInArrow(count, "dim int, filter long, n long").groupBy("dim", "filter").agg(F.sum("n").alias("all")).where(F.col("all") > TILE))
    # a filter beyond TILE rows is cut into tiles; a row goes to each pair of tiles that its own is in
    d = nodes.select("dim", "node", "n", "blob").mapInArrow(deal, "dim int, filter long, node long, n long, blob binary, filters binary").join(big, ["dim", "filter"], "left")
    d = d.withColumn("tiles", F.coalesce(F.ceil(F.col("all") / TILE), F.lit(1)).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    d = d.select("dim", "filter", F.least("own", "other").alias("l"), F.greatest("own", "other").alias("r"), (F.col("own") <= F.col("other")).alias("first"), "node", "n", "blob", "filters").withColumn("key", F.xxhash64("dim", "filter", "l", "r"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("key", "dim", "filter", "l", "r")
        for t in whole_groups(batches, "key"):
            t = t.combine_chunks()
            by = [t.column(c).to_numpy() for c in names]
            new = np.any([c[1:] != c[:-1] for c in by], axis=0)
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), t.num_rows]
            node, n = t.column("node").to_numpy(), t.column("n").to_numpy()
            first = t.column("first").to_numpy(zero_copy_only=False)
            out: list[list[np.ndarray]] = [[], [], []]
            for i, j in zip(cuts, cuts[1:], strict=False):
                order = i + np.argsort(~first[i:j], kind="stable")
                split = 0 if by[3][i] == by[4][i] else int(first[i:j].sum())
                if j - i < 2 or by[3][i] != by[4][i] and not 0 < split < j - i:
                    continue
                at = pa.array(order)
                v = _units(t.column("blob").take(at), kind)
                filters = [np.frombuffer(x, np.int64) for x in t.column("filters").take(at).to_pylist()]
                rows, far, root = _linked(v, n[order], filters, int(by[2][i]), cosine, split)
                for to, x in zip(out, (node[order[rows]], far, node[order[root]]), strict=True):
                    to.append(x)
            if sum(map(len, out[0])):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["node", "far", "root"])

    return d.repartition(shuffle_partitions(spark), "key").sortWithinPartitions("key", "dim", "filter", "l", "r").mapInArrow(meet, "node long, far long, root long")


def near_duplicates(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, seed: int = 5) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Equal vectors are one node with as many rows as it has: they link with each other and count for each link of the
    node. A vector that is null, empty, zero, or holds null or non-finite numbers links with nothing; vectors of different
    lengths don't link with each other. Rows that share a vec_id, or have none, are rows like any other; component_id is null only if no row of
    the component has an id. Other columns have no part in it. An array of floats is moved as floats, any other as doubles; cosines are of
    doubles either way. No row stands for a pair of vectors: a task adds up links and returns a forest of them.
    """
    kind = "<f4" if rows.schema[vector].dataType.elementType.typeName() == "float" else "<f8"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = _blobs(b.column("vector"), kind)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array([None if x is None else xxhash.xxh3_128_digest(x) for x in blobs], pa.binary()), pa.array(blobs, pa.binary())], ["vec_id", "digest", "blob"])

    d = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast(f"array<{'float' if kind == '<f4' else 'double'}>").alias("vector"))
    d = d.mapInArrow(read, "vec_id long, digest binary, blob binary")
    nodes = d.where("digest IS NOT NULL").groupBy("digest", "blob").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    nodes = checkpoint(nodes.withColumn("node", F.monotonically_increasing_id()))
    found = checkpoint(links(nodes.select("node", "n", "blob"), kind, cosine, seed))
    far = found.groupBy("node").agg(F.sum("far").alias("far")).withColumnRenamed("node", "n1")
    root = components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "n2")
    named = nodes.drop("blob").join(far, F.col("node") == F.col("n1"), "left").join(root, F.col("node") == F.col("n2"), "left")
    named = checkpoint(named.select(F.col("digest").alias("of"), "least", (F.coalesce("far", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("root", "node").alias("root")))
    least = checkpoint(named.groupBy("root").agg(F.min("least").alias("component")))  # so that a large component can be split
    out = d.select("vec_id", "digest").join(named.join(least, "root").select("of", "links", "component"), F.col("digest") == F.col("of"), "left")
    component = F.when(F.col("of").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op5_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Links and component of every embedding."""
    from rivulet.llm.common import table

    return near_duplicates(table(spark, sf_dir, "embeddings"))
