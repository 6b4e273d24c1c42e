"""WARC archives: a writer of one gzip member per record and a sequential, streaming reader.

Writing: payloads are digested natively; of payloads of equal digest and length, and at least
``min_bytes`` bytes, the record of the smallest page id is a ``response``, the others are ``revisit``
records that refer to it (profile identical-payload-digest) and carry HTTP headers only. Each task
appends its records to an archive of its own and starts another beyond ``ARCHIVE_BYTES``. An archive is
written under a name that no other attempt has and is listed, by the task that ends well, in a
manifest; files of lost attempts are in no manifest and are never read.

Reading: an archive is read in blocks and inflated incrementally, one gzip member after another. A
record is framed by its Content-Length; block and payload digests are verified as the bytes pass, so
memory holds a block, not a record (the payload itself is kept only on request).

Files go through the file system of the folder's URI (a bare path, ``file:/``, HDFS or an object store
that Arrow knows), so executors need no local folder. ``report`` removes its folder once it has read it.

Only digests, sizes, ids and URLs are shuffled to find equal payloads. Their groups of two or more are
broadcast where they are few (counted first); beyond, a filter of their digests lets the pages without
an equal pass unshuffled, and the rest is joined.

Defined cases: a null payload is an empty one; rows of equal page id are a record each, and the
response of a group is then the one whose URL comes first, null before all (all of them, if they tie); a
null page id is written with a record id of its own kind and read back as null, it comes after all
others, and where a group has no other ids all its rows are responses; null URLs become ``urn:page:``
targets; an empty table gives no archives and no rows; page ids that are no whole numbers raise ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagoon.llm.common import arrow_uri, bloom, cut, lean, remove, shared_dir, whole_number

ARCHIVE_BYTES = 256 << 20
BROADCAST_ROWS = 100_000  # groups of equal payloads: a digest, a size, an id and a URL each
BLOCK = 1 << 16
DATE = "2024-01-01T00:00:00Z"
NULL_ID = 1 << 64  # bit 64 of a record's uuid: the page had no id


def base32(raw: bytes) -> str:
    return base64.b32encode(raw).decode()


def record_id(page_id: int | None) -> str:
    number = NULL_ID if page_id is None else page_id & (2**64 - 1)
    return f"<urn:uuid:{uuid.UUID(int=number | 1 << 126)}>"


def page_of(record: str) -> int | None:
    number = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    if number & NULL_ID:
        return None
    low = number & (2**64 - 1)
    return low - 2**64 if low >> 63 else low


def _target(url: str | None, page_id: int | None) -> str:
    if not url:
        return f"urn:page:{page_id}"
    # a header holds no white space or control characters
    return "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def member(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, level: int = 4) -> bytes:
    """A whole record as one gzip member; a revisit where ``refers_to`` is given."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_target(url, page_id)}"]
    if refers_to is None:
        block += payload
    else:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).digest())}", f"Content-Length: {len(block)}",
    ]
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress("\r\n".join(lines).encode() + b"\r\n\r\n") + c.compress(block) + c.compress(b"\r\n\r\n") + c.flush()


class Members:
    """The bytes of a file of gzip members, one member after another, inflated as they are asked for."""

    def __init__(self, stream):
        self.stream, self.rest = stream, b""

    def begin(self) -> bool:
        """Whether there is another member."""
        self.rest = self.rest or self.stream.read(BLOCK)
        self.inflate, self.ready = zlib.decompressobj(31), b""
        return bool(self.rest)

    def _more(self) -> bool:
        while not self.inflate.eof:
            self.rest = self.rest or self.stream.read(BLOCK)
            if not self.rest:
                raise ValueError("archive ends within a gzip member")
            self.ready += self.inflate.decompress(self.rest, BLOCK)
            self.rest = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            if self.ready:
                return True
        return False

    def line(self) -> bytes:
        while b"\r\n" not in self.ready:
            if len(self.ready) > 1 << 20:
                raise ValueError("a header line without end")
            held, self.ready = self.ready, b""
            if not self._more():
                raise ValueError("record ends within its header")
            self.ready = held + self.ready
        out, _, self.ready = self.ready.partition(b"\r\n")
        return out

    def headers(self) -> dict[str, str]:
        out: dict[str, str] = {}
        while line := self.line():
            name, colon, value = line.decode().partition(":")
            if not colon:
                raise ValueError(f"no header: {line[:80]!r}")
            out[name.strip().lower()] = value.strip()
        return out

    def take(self, size: int):
        """Exactly ``size`` bytes, in parts."""
        while size:
            if not self.ready and not self._more():
                raise ValueError("record is shorter than its Content-Length")
            part, self.ready = self.ready[:size], self.ready[size:]
            size -= len(part)
            yield part

    def end(self) -> None:
        """The two line ends after the block, and the member's own checks."""
        if b"".join(self.take(4)) != b"\r\n\r\n":
            raise ValueError("record does not end after its Content-Length")
        if self.ready or self._more():
            raise ValueError("bytes after the record in its gzip member")


def read_records(stream, with_payload: bool = False):
    """Yields a dict for each record of an archive; raises ValueError where framing or a digest fails."""
    members = Members(stream)
    while members.begin():
        version = members.line()
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no record: {version[:40]!r}")
        head = members.headers()
        block_sha, payload_sha = hashlib.sha1(), hashlib.sha1()
        http = b""
        body_bytes, body = 0, []
        in_body = False
        for part in members.take(int(head["content-length"])):
            block_sha.update(part)
            if not in_body:
                http += part
                if b"\r\n\r\n" not in http:
                    continue
                http, _, part = http.partition(b"\r\n\r\n")
                in_body = True
            payload_sha.update(part)
            body_bytes += len(part)
            if with_payload:
                body.append(part)
        members.end()
        fields = dict(x.decode().lower().split(":", 1) for x in http.split(b"\r\n")[1:] if b":" in x)
        size = int(fields["content-length"])
        if "sha1:" + base32(block_sha.digest()) != head["warc-block-digest"]:
            raise ValueError(f"block digest of {head['warc-record-id']}")
        kind = head["warc-type"]
        if kind == "response" and (body_bytes != size or "sha1:" + base32(payload_sha.digest()) != head["warc-payload-digest"]):
            raise ValueError(f"payload of {head['warc-record-id']}")
        refers = head.get("warc-refers-to")
        yield {
            "page_id": page_of(head["warc-record-id"]), "payload_bytes": size, "payload_digest": head["warc-payload-digest"].removeprefix("sha1:"),
            "record_type": kind, "refers_to": page_of(refers) if kind == "revisit" and refers else None,
            "target": head["warc-target-uri"], "payload": b"".join(body) if with_payload and kind == "response" else None,
        }


def _open(folder: str):
    fs, path = pafs.FileSystem.from_uri(folder)
    return fs, path


def _writer(folder: str, archive_bytes: int):
    def run(batches):
        fs, path = _open(folder)
        fs.create_dir(path, recursive=True)
        out, name, written, count = None, "", 0, 0

        def close():
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64()), pa.array([written], pa.int64())], names=["file", "records", "bytes"])

        for batch in batches:
            ids, urls, payloads, digests, first = (batch.column(k) for k in range(5))
            for i in range(batch.num_rows):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, written, count = fs.open_output_stream(f"{path}/{name}", compression=None), 0, 0
                revisit = first[i].as_py()
                payload = (payloads[i].as_py() or "").encode()
                raw = member(ids[i].as_py(), urls[i].as_py(), b"" if revisit is not None else payload, len(payload), base32(bytes.fromhex(digests[i].as_py())), revisit)
                out.write(raw)
                written += len(raw)
                count += 1
                if written >= archive_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return run


def _with_refers(keyed: DataFrame, min_bytes: int, most_broadcast: int) -> DataFrame:
    """``keyed(id, url, payload, digest, size)`` with ``refers``, the id that a revisit refers to."""
    rank = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("url").alias("url"))
    firsts = cut(
        keyed.where(F.col("size") >= min_bytes).groupBy("digest", "size").agg(F.min(rank).alias("first"), F.count("*").alias("n"))
        .where("n > 1 and first.id is not null").select(F.col("digest").alias("_d"), F.col("size").alias("_s"), F.col("first.id").alias("first_id"), F.col("first.url").alias("first_url"))
    )
    n = firsts.count()
    same = (F.col("digest") == F.col("_d")) & (F.col("size") == F.col("_s"))
    alone = None
    if n <= most_broadcast:
        joined = keyed.join(F.broadcast(firsts), same, "left")
    else:
        may = bloom(firsts.select(F.xxhash64("_d")), n)
        flag = F.pandas_udf(lambda h: pd.Series(may(h.to_numpy())), "boolean")
        keyed = keyed.withColumn("_may", flag(F.xxhash64("digest")))
        alone = keyed.where(~F.col("_may")).withColumn("refers", F.lit(None).cast("long"))
        # a hot digest has one row in ``firsts``; the pages' side of the join is split where it is hot
        joined = keyed.where("_may").join(firsts, same, "left")
    is_first = (F.col("id") == F.col("first_id")) & F.col("url").eqNullSafe(F.col("first_url"))
    out = joined.withColumn("refers", F.when(F.col("first_id").isNotNull() & ~F.coalesce(is_first, F.lit(False)), F.col("first_id")))
    cols = ["id", "url", "payload", "digest", "refers"]
    return out.select(*cols) if alone is None else out.select(*cols).union(alone.select(*cols))


def write(
    pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0,
    archive_bytes: int = ARCHIVE_BYTES, most_broadcast: int = BROADCAST_ROWS,
) -> DataFrame:
    """Writes a record for each row; the manifest ``file, records, bytes`` (materialised)."""
    whole_number(pages, id_col)
    base = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload")
    )
    keyed = base.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    rows = _with_refers(keyed, min_bytes, most_broadcast)
    return cut(rows.mapInArrow(lean(_writer(arrow_uri(pages.sparkSession, folder), archive_bytes)), "file string, records long, bytes long"))


def read(manifest: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The records of the archives in ``manifest``, each archive read by one task from start to end."""
    folder = arrow_uri(manifest.sparkSession, folder)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target"] + ["payload"] * with_payload
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def run(batches):
        fs, path = _open(folder)
        for batch in batches:
            for name, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, size, seen = [], 0, 0
                with fs.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for r in read_records(stream, with_payload):
                        rows.append(r)
                        seen += 1
                        size += len(r["payload"] or b"")
                        if len(rows) >= 4096 or size > 1 << 24:
                            yield _batch(rows)
                            rows, size = [], 0
                if seen != records:
                    raise ValueError(f"{name}: {seen} of {records} records")
                if rows:
                    yield _batch(rows)

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=False)], names=names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target string" + ", payload binary" * with_payload
    files = manifest.select("file", "records").repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism))
    return files.mapInArrow(lean(run), schema)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` into a new folder under the shared one, reads the archives back (materialised)
    and removes the folder."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    out = cut(read(write(pages, folder, min_bytes=min_bytes), folder))
    remove(spark, folder)
    return out


def report(pages: DataFrame) -> DataFrame:
    return round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# base32 of a SHA-1: 40 hexadecimal digits are 32 groups of five bits, four in each run of five digits
REPORT_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY html ORDER BY page_id ASC NULLS LAST, url ASC NULLS FIRST) AS n FROM p),
g AS (SELECT html, page_id AS first, url AS first_url, sha1(html) AS hex FROM r WHERE n = 1),
b AS (SELECT html, i, list_reduce(list_prepend(0, list_transform(string_split(substr(hex, CAST(1 + 5 * (i // 4) AS BIGINT), 5), ''), lambda x: instr('0123456789abcdef', x) - 1)), lambda a, x: a * 16 + x) AS run
  FROM g, range(32) AS r(i)),
d AS (SELECT html, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((run >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS BIGINT), 1), '' ORDER BY i) AS digest FROM b GROUP BY html)
SELECT p.page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
  CASE WHEN g.first IS NULL OR (p.page_id = g.first AND p.url IS NOT DISTINCT FROM g.first_url) THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id = g.first AND p.url IS NOT DISTINCT FROM g.first_url THEN NULL ELSE g.first END AS refers_to
FROM p JOIN g ON p.html = g.html JOIN d ON d.html = p.html
"""
