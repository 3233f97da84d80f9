"""SentencePiece encoding and decoding over a relational lattice of words.

A text is cut into words that no piece crosses. The words of the corpus are counted, and those that are frequent enough
for a table of TABLE rows become a lattice: their substrings up to the longest piece are exploded and joined to the
table of pieces, the edges are grouped by word, and a fold over them (a Spark higher-order aggregate) gives the path.
For a unigram model that is Viterbi's: the best score at each place. A BPE model has no best sum of scores, but merges
in the order of score; there the fold goes over the edges in that order and joins two neighbours whenever an edge spans
just both. The table of encoded words is bounded and broadcast; words that aren't in it get the same fold in the
workers, behind a bounded cache.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.llm.common import checkpoint, free, pieces_of

SPACE = "▁"
#: Rows of the broadcast table of words, at most, and bytes of words and ids that a worker keeps besides.
TABLE, CACHE = 200_000, 24 << 20
#: What a word costs besides, in a dictionary.
ENTRY = 160
#: Bytes of text that are encoded at once, and ids that are looked at at once.
BATCH, IDS = 1 << 21, 1 << 16
#: Code points of a word that the fold takes: its cuts are the bits of a long.
LONGEST = 62
#: A word: spaces and what follows, or a line's end by itself.
WORD = f"{SPACE}*[^{SPACE}\\n\\t]+|{SPACE}+|[\\n\\t]"


class Model:
    """Pieces, scores and settings of a sentencepiece model file with identity normalization."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(sentencepiece.SentencePieceProcessor(model_file=path).serialized_model_proto())
        norm, kinds = proto.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("the model's normalization isn't the identity")
        if any(p.type == kinds.USER_DEFINED for p in proto.pieces):
            raise ValueError("the model has pieces that are matched before all others")
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        self.unigram = proto.trainer_spec.model_type == 1
        self.texts = [p.piece for p in proto.pieces]
        self.normal = {p.piece: (i, p.score) for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        self.longest = max(map(len, self.normal))
        self.unknown = next((i for i, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN), 0)
        self.bytes = [self.texts.index(f"<0x{b:02X}>") for b in range(256)] if any(p.type == kinds.BYTE for p in proto.pieces) else None
        self.of_byte = {i: b for b, i in enumerate(self.bytes or [])}
        self.least = min(s for _, s in self.normal.values())
        if any(re.search("[\n\t]", x) and len(x) > 1 or SPACE in x.lstrip(SPACE) for x in self.normal):
            raise ValueError("the model has pieces that go over the edges of words")

    def normalize(self, text: str) -> str:
        return self.prefix + text.replace(" ", SPACE) if text else ""

    def spell(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode()] if self.bytes else [self.unknown]

    def encode_word(self, word: str) -> list[int]:
        """The fold for one word, of any length."""
        out = []
        for s, e in self._best(word) if self.unigram else self._merged(word):
            piece = self.normal.get(word[s:e])
            out.extend([piece[0]] if piece else self.spell(word[s:e]))
        return out

    def _merged(self, word: str) -> list[tuple[int, int]]:
        n, get = len(word), self.normal.get
        ends, starts = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that begins, or that ends, at each place
        heap = []
        for i in range(n - 1):
            if p := get(word[i : i + 2]):
                heap.append((-p[1], i, i + 1, i + 2))
        heapq.heapify(heap)
        while heap:
            _, a, b, c = heapq.heappop(heap)
            if ends[a] != b or b >= n or ends[b] != c:
                continue
            ends[a], ends[b] = c, -1
            if c < n:
                starts[c] = a
            if a and (p := get(word[starts[a] : c])):
                heapq.heappush(heap, (-p[1], starts[a], a, c))
            if c < n and (p := get(word[a : ends[c]])):
                heapq.heappush(heap, (-p[1], a, c, ends[c]))
        out, i = [], 0
        while i < n:
            out.append((i, ends[i]))
            i = ends[i]
        return out

    def _best(self, word: str) -> list[tuple[int, int]]:
        n = len(word)
        best: list[tuple[float, int]] = [(0.0, 0)] + [(-np.inf, 0)] * n
        for e in range(1, n + 1):
            for s in range(max(0, e - self.longest), e):
                p = self.normal.get(word[s:e])
                score = p[1] if p else self.least - 10 if e - s == 1 else None
                if score is not None and best[s][0] + score > best[e][0]:
                    best[e] = (best[s][0] + score, s)
        out, e = [], n
        while e:
            out.append((best[e][1], e))
            e = best[e][1]
        return out[::-1]

    def decode(self, ids: list[int], first: bool = True) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD, as the unknown piece does. first: whether a text begins here."""
        parts: list[str] = []
        held = bytearray()
        for i in ids:
            b = self.of_byte.get(i)
            if b is not None:
                held.append(b)
                continue
            if held:
                parts.append(held.decode("utf-8", "replace"))
                held.clear()
            parts.append("�" if i == self.unknown else self.texts[i])
        parts.append(held.decode("utf-8", "replace"))
        text = "".join(parts)
        return (text[1:] if first and self.prefix and text.startswith(SPACE) else text).replace(SPACE, " ")


@lru_cache(4)
def load(path: str) -> Model:
    return Model(path)


def word_counts(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """word and n over all rows' texts."""
    norm = F.concat(F.lit(model.prefix), F.replace(F.col(text), F.lit(" "), F.lit(SPACE)))
    words = F.regexp_extract_all(norm, F.lit(WORD), F.lit(0))
    return docs.where(F.length(text) > 0).select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def lattice(words: DataFrame, model: Model) -> DataFrame:
    """word and edges (score, s from 0, len, id) of distinct words: all pieces in them. Edges stay with their word's task."""
    spark = words.sparkSession
    pieces = spark.createDataFrame([(p, i, s) for p, (i, s) in model.normal.items()], "piece string, id int, score double")
    d = words.select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("s"))
    d = d.select("word", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(model.longest), F.length("word") - F.col("s") + 1))).alias("len"))
    d = d.withColumn("piece", F.substring("word", F.col("s"), F.col("len"))).join(F.broadcast(pieces), "piece")  # as many rows as the model has pieces
    edges = d.groupBy("word").agg(F.collect_list(F.struct((-F.col("score")).alias("cost"), (F.col("s") - 1).alias("s"), "len", "id")).alias("edges"))
    none = F.array().cast("array<struct<cost:double,s:int,len:int,id:int>>")
    return words.select("word").join(edges.withColumnRenamed("word", "w"), F.col("word") == F.col("w"), "left").select("word", F.sort_array(F.coalesce("edges", none)).alias("edges"))


#: The cuts of a word as bits: an edge joins two parts if the bits at its ends are set and just one between them is.
_MERGE = """
aggregate(filter(edges, e -> e.len > 1), shiftleft(1L, length(word) + 1) - 1, (m, e) ->
    if((shiftrightunsigned(m, e.s) & 1L) = 1 AND (shiftrightunsigned(m, e.s + e.len) & 1L) = 1
            AND bit_count(shiftrightunsigned(m, e.s) & (shiftleft(1L, e.len + 1) - 1)) = 3,
        m & ~shiftleft(shiftleft(1L, e.len - 1) - 1, e.s + 1), m))
"""
#: The best score at each end and where its last piece starts, then the cuts on the way back.
_VITERBI = """
aggregate(reverse(sequence(1, length(word))), named_struct('at', length(word), 'm', shiftleft(1L, length(word))), (a, k) ->
    if(a.at = k, named_struct('at', best[k].s, 'm', a.m | shiftleft(1L, best[k].s)), a), a -> a.m)
"""
_BEST = """
aggregate(sequence(1, length(word)), array(named_struct('cost', 0D, 's', 0)), (b, k) ->
    concat(b, array(array_min(concat(
        transform(filter(edges, e -> e.s + e.len = k), e -> named_struct('cost', b[e.s].cost + e.cost, 's', e.s)),
        array(named_struct('cost', b[k - 1].cost + if(exists(edges, e -> e.s = k - 1 AND e.len = 1), double('inf'), {unknown}D), 's', k - 1)))))))
"""


def encode_words(words: DataFrame, model: Model) -> DataFrame:
    """word and ids of distinct words of at most LONGEST code points."""
    d = lattice(words, model)
    if model.unigram:
        d = d.withColumn("best", F.expr(_BEST.replace("{unknown}", repr(10 - model.least)))).withColumn("cuts", F.expr(_VITERBI))
    else:
        d = d.withColumn("cuts", F.expr(_MERGE))
    d = d.withColumn("at", F.expr("filter(sequence(0, length(word)), i -> (shiftrightunsigned(cuts, i) & 1L) = 1)"))
    d = d.withColumn("of", F.expr("map_from_entries(transform(edges, e -> struct(e.s * 64 + e.len, e.id)))"))
    spell = "transform(sequence(1, octet_length(piece)), k -> int(conv(substring(hex(binary(piece)), 2 * k - 1, 2), 16, 10)))"
    spelled = f"transform({spell}, b -> array({', '.join(map(str, model.bytes))})[b])" if model.bytes else f"array({model.unknown})"
    found = "try_element_at(of, at[i] * 64 + at[i + 1] - at[i])"
    ids = f"flatten(transform(sequence(0, size(at) - 2), i -> if({found} IS NULL, {spelled.replace('piece', 'substring(word, at[i] + 1, at[i + 1] - at[i])')}, array({found}))))"
    return d.select("word", F.expr(ids).alias("ids"))


def frequent_words(docs: DataFrame, model: Model, text: str = "text", most: int = TABLE) -> pa.Table:
    """word and ids: the encoded words of the corpus, from the most frequent down, as many whole classes of frequency as fit into most rows.

    All texts are counted. Words that are seen once, are too long for the fold or begin with several spaces are left
    to the workers.
    """
    n = word_counts(docs, model, text).where((F.col("n") > 1) & (F.length("word") <= LONGEST) & ~F.startswith("word", F.lit(SPACE * 2)))
    n = checkpoint(n.withColumn("class", F.floor(F.log2("n") * 16).cast("int")))
    fit, least = 0, 1 << 30
    for r in sorted(n.groupBy("class").agg(F.count("*").alias("words")).collect(), key=lambda r: -r["class"]):  # 16 classes to a doubling
        if fit + r.words > most:
            break
        fit, least = fit + r.words, r["class"]
    return encode_words(n.where(F.col("class") >= least).select("word"), model).toArrow()  # most rows at most


def by_word(table: pa.Table) -> dict[str, bytes]:
    """The ids of each word as bytes."""
    out: dict[str, bytes] = {}
    for b in table.to_batches():
        ids = b.column("ids")
        ends, raw = ids.offsets.to_numpy() * 4, ids.values.to_numpy().astype(np.int32).tobytes()
        out.update(zip(b.column("word").to_pylist(), (raw[i:j] for i, j in zip(ends.tolist(), ends[1:].tolist(), strict=False)), strict=True))
    return out


class _Encoder:
    """Encodes texts by the table of words, which grows by the words that it hasn't until they have CACHE bytes."""

    def __init__(self, path: str, table: dict[str, bytes]):
        self.model, self.find, self.known = load(path), re.compile(WORD).findall, table
        self.added: list[str] = []
        self.room = CACHE

    def __call__(self, text: str) -> bytes:
        parts, norm = [], self.model.normalize(text)
        for i in range(0, len(norm), BATCH):  # a long text goes word by word all the same, but not all its words at once
            parts.append(norm[i : i + BATCH])
        if len(parts) < 2:
            return self._words(self.find(norm))
        out, rest = [], ""
        for k, part in enumerate(parts):
            words = self.find(rest + part)
            rest = words.pop() if k + 1 < len(parts) and words else ""  # the last word may go on in the next part
            out.append(self._words(words))
        return b"".join(out)

    def _words(self, words: list[str]) -> bytes:
        ids = list(map(self.known.get, words))
        if None in ids:
            for k, x in enumerate(ids):
                if x is None:
                    ids[k] = self._one(words[k])
        return b"".join(ids)

    def _one(self, word: str) -> bytes:
        out = self.known.get(word)
        if out is None:
            out = np.array(self.model.encode_word(word), np.int32).tobytes()
            if len(word) <= LONGEST:
                if self.room < 0:
                    for w in self.added:
                        del self.known[w]
                    self.added, self.room = [], CACHE
                self.known[word] = out
                self.added.append(word)
                self.room -= 4 * len(word) + len(out) + ENTRY
        return out

    def decode(self, ids: bytes) -> Iterator[str]:
        """The text of ids, in parts of IDS ids at most; none ends inside a run of bytes."""
        all_ids, i = np.frombuffer(ids, np.int32), 0
        while i < len(all_ids):
            j = min(i + IDS, len(all_ids))
            while j < len(all_ids) and int(all_ids[j]) in self.model.of_byte:
                j += 1
            yield self.model.decode(all_ids[i:j].tolist(), first=not i)
            i = j

    def exact(self, ids: bytes, text: str) -> bool:
        """Whether the ids give the text back."""
        at = 0
        for part in self.decode(ids):
            if not text.startswith(part, at):
                return False
            at += len(part)
        return at == len(text)


def _table(docs: DataFrame, path: str, text: str) -> tuple:
    """The table of words for all tasks (TABLE rows at most), and a name of its own."""
    spark: SparkSession = docs.sparkSession
    return uuid.uuid4().hex, spark.sparkContext.broadcast(frequent_words(docs, load(path), text))


_ENCODERS: dict[str, _Encoder] = {}


def _encoder(path: str, table: tuple) -> _Encoder:
    """The encoder of this worker; tasks that follow each other in it share its one copy of the table."""
    name, words = table
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = _Encoder(path, by_word(words.value))
    return _ENCODERS[name]


def encode(docs: DataFrame, path: str, text: str = "text", check: bool = False) -> DataFrame:
    """All rows and columns of docs, and ids (array<int>); a null text counts as empty, and has no ids.

    check adds exact: whether decoding gives the text back. A column of docs that has one of these names stays, and the new
    one has an underscore behind its name. Repeated rows are rows of their own. A text of any length is encoded and decoded
    part by part; what grows with it is its ids.
    """
    table = _table(docs, path, text)
    names = [free("ids", docs.columns), *([free("exact", docs.columns)] if check else [])]
    schema = T.StructType([*docs.schema.fields, *map(T.StructField, names, (T.ArrayType(T.IntegerType()), T.BooleanType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path, table)
        for b in pieces_of(batches, text, BATCH):
            ids, exact = [], []
            for t in b.column(text):
                t = t.as_py() or ""
                ids.append(enc(t))
                if check:
                    exact.append(enc.exact(ids[-1], t))
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32)))
            yield pa.RecordBatch.from_arrays([*b.columns, lists, *([pa.array(exact, pa.bool_())] if check else [])], schema.names)

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """All rows and columns, and decoded (decoded_ where there is a column of that name); null ids give the empty text."""
    name = free("decoded", rows.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([model.decode(x.as_py() or []) for x in b.column(ids)], pa.string())], [*b.schema.names, name])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.StringType())]))


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit numbers), decoded_sha256 and exact of every row.

    exact: whether decoding gives the text back; a null text counts as empty. Repeated rows are rows of their own; other
    columns have no part in it. Encoding and decoding go on in one task, so the ids, which take more room than the text,
    aren't sent anywhere.
    """
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    table = _table(d, path, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path, table)
        for b in pieces_of(batches, "text", BATCH):
            out: list[list] = [[], [], [], []]
            for t in b.column("text"):
                t = t.as_py()
                ids, back, at, same = enc(t), hashlib.sha256(), 0, True
                for part in enc.decode(ids):
                    back.update(part.encode())
                    same = same and t.startswith(part, at)
                    at += len(part)
                for to, v in zip(out, (len(ids) // 4, hashlib.sha256(ids).hexdigest(), back.hexdigest(), same and at == len(t)), strict=True):
                    to.append(v)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string()), pa.array(out[3], pa.bool_())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "exact"])

    return d.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, exact boolean")


def op6_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Every document encoded by the model of 32 thousand pieces and decoded again."""
    import public_tokenizers

    from rivulet.llm.common import table

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
