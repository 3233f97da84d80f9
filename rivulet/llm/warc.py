"""WARC archives as a chunked record table.

Payloads travel as rows of record and chunk number, CHUNK bytes at most each, to the writer and back from the reader.
Both carry a digest from chunk to chunk, so neither holds a whole record of any size. Each task writes one archive
of gzip members to the shared folder, under a name of its own attempt; only archives named in the returned manifest
count, so a task that is run again leaves no trace.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import checkpoint, shared_dir, shuffle_partitions

#: Bytes of a chunk.
CHUNK = 1 << 20
#: Payloads from this size on are stored once.
LEAST = 1000
CRLF = b"\r\n"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"  # one date for all, so that archives are alike from run to run
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
RECORDS = "page_id long, url string, record_type string, refers_to long, chunk_no int, last boolean, payload_bytes long, payload_digest string, chunk binary"


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def _uri(page_id: int | None, mark: str) -> str:
    """A record's name: its page and a mark of address and payload, so that rows that share a page_id, or have none, are told apart."""
    return f"<urn:page:{'' if page_id is None else page_id}:{mark}>"


def _page(uri: str) -> int | None:
    name = uri.strip("<>").split(":")[2]
    return int(name) if name else None


def plan(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST) -> DataFrame:
    """page_id, url, payload, payload_bytes, digest (SHA-1 in hex), mark, revisit, refers_to and refers_mark of every row.

    Of rows with equal payloads of least bytes or more the one with the largest page_id is the response and the others
    revisit it; rows that repeat that page_id are responses as well. A null html is an empty payload. A null page_id is
    never the largest unless all are null, which makes all of them responses. mark is a hash of address and payload: rows
    equal in page_id and both are one record that is there several times. Payloads of any length are kept whole; other
    columns of pages have no part in it.
    """
    d = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    d = d.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1("payload"))
    d = d.withColumn("mark", F.substring(F.sha1(F.concat(F.coalesce(F.col("url"), F.lit("")), F.lit("|"), F.col("digest")).cast("binary")), 1, 16))
    # read from the shared folder, so that both sides of the join are plain exchanges and a payload of very many pages can be split
    keep = checkpoint(d.where(F.col("payload_bytes") >= least).groupBy("digest").agg(F.max(F.struct("page_id", "mark")).alias("last"), F.count("*").alias("n")).where("n > 1 AND last.page_id IS NOT NULL").select(F.col("digest").alias("of"), F.col("last.page_id").alias("keep"), F.col("last.mark").alias("keep_mark")))
    d = d.join(keep, (F.col("digest") == F.col("of")) & (F.col("payload_bytes") >= least), "left")
    revisit = F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep"))
    return d.select("page_id", "url", "payload", "payload_bytes", "digest", "mark", revisit.alias("revisit"), F.when(revisit, F.col("keep")).alias("refers_to"), F.when(revisit, F.col("keep_mark")).alias("refers_mark"))


def write_archives(records: DataFrame, folder: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """Writes the records that plan() gives and returns the manifest: path and records of each archive."""
    root = f"{folder or shared_dir(records.sparkSession)}/warc-{uuid.uuid4().hex}"
    chunks = F.when(F.col("revisit"), F.lit(1)).otherwise(F.greatest(F.ceil(F.col("payload_bytes") / chunk), F.lit(1))).cast("int")
    d = records.withColumn("chunks", chunks).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    piece = F.when(F.col("revisit"), F.lit(b"")).otherwise(F.expr(f"substring(payload, chunk_no * {chunk} + 1, {chunk})"))
    d = d.select("page_id", F.coalesce("url", F.lit("")).alias("url"), "payload_bytes", "digest", "mark", "revisit", "refers_to", "refers_mark", "chunks", "chunk_no", piece.alias("chunk"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, out, done = TaskContext.get(), None, 0
        fs, top = _fs(root)
        path = f"{top}/part-{task.partitionId():05d}-{task.taskAttemptId()}.warc.gz"
        for b in batches:
            for r in (dict(zip(b.schema.names, x, strict=True)) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)):
                if out is None:
                    fs.create_dir(top, recursive=True)
                    out = fs.open_output_stream(path, compression=None)
                if r["chunk_no"] == 0:
                    http = _HTTP % r["payload_bytes"]
                    digest = base64.b32encode(bytes.fromhex(r["digest"])).decode()
                    head = {
                        "WARC-Type": "revisit" if r["revisit"] else "response",
                        "WARC-Record-ID": _uri(r["page_id"], r["mark"]),
                        "WARC-Date": _DATE,
                        "WARC-Target-URI": re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", r["url"].replace("%", "%25") if re.search(r"[\x00-\x20\x7f]", r["url"]) else r["url"]),
                        "WARC-Payload-Digest": f"sha1:{digest}",
                        "Content-Type": "application/http; msgtype=response",
                        "Content-Length": str(len(http) + (0 if r["revisit"] else r["payload_bytes"])),
                    }
                    if r["revisit"]:
                        head |= {"WARC-Profile": _REVISIT, "WARC-Refers-To": _uri(r["refers_to"], r["refers_mark"])}
                    gz, sha = zlib.compressobj(6, zlib.DEFLATED, 31), hashlib.sha1()
                    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode()
                    out.write(gz.compress(b"WARC/1.1\r\n" + lines + CRLF + http))
                sha.update(r["chunk"])
                out.write(gz.compress(r["chunk"]))
                if r["chunk_no"] == r["chunks"] - 1:
                    if not r["revisit"] and sha.hexdigest() != r["digest"]:
                        raise ValueError(f"the chunks of page {r['page_id']} aren't its payload")
                    out.write(gz.compress(CRLF + CRLF) + gz.flush())
                    done += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{root}/{path.rpartition('/')[2]}"], "records": pa.array([done], pa.int64())})

    return checkpoint(d.mapInArrow(write, "path string, records long"))


class _Stream:
    """The text of an archive's gzip members, one after the other, read as it is asked for."""

    def __init__(self, file):
        self.file, self.held, self.gz = file, b"", zlib.decompressobj(31)
        self.raw = b""

    def _more(self) -> bool:
        if self.gz.eof:
            self.raw, self.gz = self.gz.unused_data, zlib.decompressobj(31)
        while True:
            self.raw = self.gz.unconsumed_tail or self.raw or self.file.read(1 << 18)
            if not self.raw:
                return False
            text, self.raw = self.gz.decompress(self.raw, 1 << 20), b""
            if text:
                self.held += text
                return True
            if self.gz.eof:
                self.raw, self.gz = self.gz.unused_data, zlib.decompressobj(31)

    def line(self) -> bytes | None:
        while (k := self.held.find(CRLF)) < 0:
            if not self._more():
                return None
        out, self.held = self.held[:k], self.held[k + 2 :]
        return out

    def some(self, n: int) -> bytes:
        if not self.held and not self._more():
            raise EOFError("a record is cut off")
        out, self.held = self.held[:n], self.held[n:]
        return out


def _head(stream: _Stream) -> dict[str, str]:
    out = {}
    while line := stream.line():
        k, _, v = line.decode().partition(":")
        out[k.strip().lower()] = v.strip()
    return out


def _records(file, payload: bool, chunk: int = CHUNK) -> Iterator[tuple]:
    """The chunk rows of an archive; with payload false only the last row of each record, without its bytes."""
    s = _Stream(file)
    while (version := s.line()) is not None:
        if not version:
            continue
        head = _head(s)
        if head["warc-type"] not in ("response", "revisit"):
            left = int(head["content-length"])
            while left:
                left -= len(s.some(min(left, chunk)))
            continue
        left = int(head["content-length"])
        status = s.line()
        http = _head(s)
        left -= len(status) + 2 + sum(len(k) + len(v) + 4 for k, v in http.items()) + 2
        page, kind, refers = _page(head["warc-record-id"]), head["warc-type"], head.get("warc-refers-to")
        refers = _page(refers) if refers else None
        if kind == "revisit":
            digest = base64.b32decode(head["warc-payload-digest"].partition(":")[2]).hex()
            yield page, head["warc-target-uri"], kind, refers, 0, True, int(http["content-length"]), digest, b""
            continue
        sha, size, k = hashlib.sha1(), 0, 0
        while True:
            part = bytearray()
            while left and len(part) < chunk:
                x = s.some(min(left, chunk - len(part)))
                part += x
                left -= len(x)
            sha.update(part)
            size += len(part)
            if payload or not left:
                yield page, head["warc-target-uri"], kind, refers, k, not left, size, sha.hexdigest(), bytes(part) if payload else None
            k += 1
            if not left:
                break
        if base64.b32encode(sha.digest()).decode() != head["warc-payload-digest"].partition(":")[2]:
            raise ValueError(f"the payload of page {page} isn't what its digest says")


def read_archives(manifest: DataFrame, payload: bool = True, chunk: int = CHUNK) -> DataFrame:
    """The chunk table (RECORDS) of the archives: bytes and digest so far of each chunk, and whether it is the last.

    payload false: only each record's last row, with a null chunk. A revisit is one row, with the size and digest of
    the payload that it refers to.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.binary()]
        names = [x.split()[0] for x in RECORDS.split(", ")]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        for b in batches:
            for path in b.column("path").to_pylist():
                fs, name = _fs(path)
                with fs.open_input_stream(name, compression=None) as file:
                    rows, held = [], 0
                    for r in _records(file, payload, chunk):
                        rows.append(r)
                        held += len(r[-1] or b"") + 200
                        if held > 8 * CHUNK:
                            yield pack(rows)
                            rows, held = [], 0
                    if rows:
                        yield pack(rows)

    n = shuffle_partitions(manifest.sparkSession)
    return manifest.select("path").repartition(n, "path").mapInArrow(read, RECORDS)


def op7_warc(spark, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back."""
    from rivulet.llm.common import table

    back = read_archives(write_archives(plan(table(spark, sf_dir, "pages"))), payload=False).where("last")
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest FROM p),
k AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS keep FROM d)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN keep IS NULL OR page_id IS NOT DISTINCT FROM keep THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id IS DISTINCT FROM keep THEN keep END AS refers_to
FROM k
"""
