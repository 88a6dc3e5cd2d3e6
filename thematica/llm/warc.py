"""WARC writing and reading over a chunked record table.

Writing.  Each row becomes a record.  Of rows with equal payloads (SHA-1 and
length) of at least ``min_revisit`` bytes the one with the smallest id is the
``response``, the others are ``revisit`` records without a block.  A payload
longer than ``chunk`` bytes is cut: the record table then has rows (record,
chunk number), and each is written as a WARC segment (``response`` with
WARC-Segment-Number 1, then ``continuation`` records), so no writer or reader
holds more than one chunk of it.  Spark's text sink writes the archives, one
record a line, with CR LF CR LF, the end of a WARC record, as line separator.
Any file system that Spark writes to will do; files are gzip-compressed.

Reading.  Archives are inflated and parsed as a stream.  A payload that is
whole in one record is digested in the same pass; segments become rows
(record, chunk number, bytes), are brought together by record and digested in
order with a running SHA-1, one chunk in memory at a time.

Defined results: a null payload is empty; equal ids with equal payloads are
each a response if they are the smallest; rows without an id are revisits of
the smallest id, or responses if no row of the payload has one; a null address
is left out; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import pick, workdir

CHUNK = 64 << 10
RECORDS_PER_FILE = 8192
MIN_REVISIT = 0
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: fixed values: the digits of a base-32 number and the base-32 alphabet in the same order
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n\r\n"


def base32(hex40: Column) -> Column:
    """A SHA-1 in hex as upper-case base32: five hex digits are four of base 32."""
    parts = [F.lpad(F.conv(F.substring(hex40, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), DIGITS, BASE32)


def _urn(*parts) -> Column:
    h = F.md5(F.concat_ws("/", *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def record_table(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html",
                 chunk: int = CHUNK, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest,
    segment, segments, data): a row for each record, or segment of a long one."""
    x = pick(pages, page_id=page_id, url=url, _p=payload)
    x = x.withColumn("_p", F.coalesce(F.col("_p").cast("binary"), F.lit(b"").cast("binary")))
    x = x.withColumns({"payload_bytes": F.octet_length("_p").cast("long"), "_sha": F.sha1("_p")})
    first = (x.groupBy(F.col("_sha").alias("_s"), F.col("payload_bytes").alias("_n"))
             .agg(F.min("page_id").alias("_first")))
    x = x.join(first, (F.col("_sha") == F.col("_s")) & (F.col("payload_bytes") == F.col("_n")))
    again = ((F.col("payload_bytes") >= min_revisit) & F.col("_first").isNotNull()
             & ~F.col("page_id").eqNullSafe(F.col("_first")))
    x = x.withColumns({"record_type": F.when(again, "revisit").otherwise("response"),
                       "refers_to": F.when(again, F.col("_first"))})
    n = F.when(again, F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil(F.col("payload_bytes") / chunk))).cast("int")
    x = x.withColumn("segments", n).select("*", F.explode(F.sequence(F.lit(1), F.col("segments"))).alias("segment"))
    part = F.substring("_p", (F.col("segment") - 1) * chunk + 1, F.lit(chunk))
    return x.select("page_id", "url", "record_type", "refers_to", "payload_bytes", base32(F.col("_sha")).alias("payload_digest"),
                    "segment", "segments", F.when(F.col("record_type") == "response", part).otherwise(F.lit(b"")).alias("data"))


def _record(c: DataFrame) -> Column:
    """The bytes of a record without its closing CR LF CR LF."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    opt = lambda when, text: F.when(when, text).otherwise(F.lit(""))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    uri = F.translate(F.col("url"), "\r\n", "")
    origin = _urn(page, "payload_digest", F.lit("1"))
    revisit, later = F.col("record_type") == "revisit", F.col("segment") > 1
    cut = F.col("segments") > 1
    http = F.when(revisit | later, "").otherwise(F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("payload_bytes").cast("string"), F.lit(END)))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(later, "continuation").otherwise(F.col("record_type"))),
        line("WARC-Record-ID", _urn(page, "payload_digest", F.col("segment").cast("string"))),
        line("WARC-Date", F.lit(DATE)),
        opt(F.col("url").isNotNull(), line("WARC-Target-URI", uri)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("X-Page-ID", page),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        opt(revisit, F.concat(
            line("WARC-Profile", F.lit(PROFILE)),
            line("WARC-Refers-To", _urn(F.col("refers_to").cast("string"), "payload_digest", F.lit("1"))),
            line("X-Refers-To-Page", F.col("refers_to").cast("string")))),
        opt(cut, line("WARC-Segment-Number", F.col("segment").cast("string"))),
        opt(cut & later, line("WARC-Segment-Origin-ID", origin)),
        opt(cut & (F.col("segment") == F.col("segments")), line("WARC-Segment-Total-Length", F.col("payload_bytes").cast("string"))),
        opt(~revisit & ~later, line("Content-Type", F.lit("application/http; msgtype=response"))),
        line("Content-Length", (F.length(http) + F.octet_length("data")).cast("string")),
        F.lit("\r\n"), http)
    head = F.coalesce(head, F.lit("")).cast("binary")
    return F.concat(head, F.col("data")).cast("string")  # bytes pass through unchanged


def write_archives(records: DataFrame, path: str, per_file: int = RECORDS_PER_FILE) -> str:
    """Writes the record table as .warc files (gzip) below ``path``."""
    (records.select(_record(records).alias("value")).write.option("lineSep", END).option("compression", "gzip")
     .option("maxRecordsPerFile", per_file).text(path))
    return path


class _Stream:
    """Takes bytes of an inflated archive in order; never holds more than asked for."""

    def __init__(self, data, step: int = 1 << 18):
        self.data, self.at, self.step = memoryview(data), 0, step
        self.buf = b""
        gz = bytes(self.data[:2]) == b"\x1f\x8b"
        self.inflate = zlib.decompressobj(31) if gz else None

    def _more(self) -> bool:
        while self.at < len(self.data) or (self.inflate and self.inflate.unconsumed_tail):
            if not self.inflate:
                new = bytes(self.data[self.at:self.at + self.step])
                self.at += self.step
            else:
                raw = self.inflate.unconsumed_tail
                if not raw:
                    raw = bytes(self.data[self.at:self.at + self.step])
                    self.at += len(raw)
                new = self.inflate.decompress(raw, self.step)
                if self.inflate.eof:  # the next member of the file
                    self.at -= len(self.inflate.unused_data)
                    self.inflate = zlib.decompressobj(31)
            if new:
                self.buf += new
                return True
        return False

    def head(self) -> bytes | None:
        """Up to the next empty line, without it; None at the end."""
        while (i := self.buf.find(b"\r\n\r\n")) < 0:
            if not self._more():
                return None
        out, self.buf = self.buf[:i], self.buf[i + 4:]
        return out

    def take(self, n: int):
        """The next n bytes, in parts."""
        while n:
            if not self.buf and not self._more():
                raise ValueError("archive ends within a record")
            part, self.buf = self.buf[:n], self.buf[n:]
            n -= len(part)
            yield part


def _fields(head: bytes) -> dict[str, str]:
    rows = head.decode("utf-8", "replace").split("\r\n")
    return {k.lower(): v for k, _, v in (r.partition(": ") for r in rows[1:])}


_CHUNKS = pa.schema([("record", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                     ("segment", pa.int32()), ("bytes", pa.int64()), ("sha1", pa.string()), ("whole", pa.bool_()),
                     ("data", pa.binary())])
_CHUNKS_DDL = ("record string, page_id long, record_type string, refers_to long, segment int, bytes long, sha1 string, "
               "whole boolean, data binary")


def _b32(h) -> str:
    return base64.b32encode(h.digest()).decode()


def _parse(content):
    """Rows of ``_CHUNKS`` for the records of one archive."""
    s = _Stream(content)
    number = lambda v: int(v) if v else None
    while (head := s.head()) is not None:
        f = _fields(head)
        size, page, kind = int(f["content-length"]), number(f.get("x-page-id")), f["warc-type"]
        declared = f.get("warc-payload-digest", "").removeprefix("sha1:")
        if kind == "revisit":
            for _ in s.take(size):
                pass
            row = (f["warc-record-id"], page, kind, number(f.get("x-refers-to-page")), 1, number(f["x-payload-length"]), declared, True, None)
        else:
            if kind == "response":
                http = s.head()
                size -= len(http) + 4
            if "warc-segment-number" in f:
                data = b"".join(s.take(size))  # one chunk
                row = (f.get("warc-segment-origin-id", f["warc-record-id"]), page, "response", None,
                       int(f["warc-segment-number"]), size, declared, False, data)
            else:
                h = hashlib.sha1()
                for part in s.take(size):
                    h.update(part)
                row = (f["warc-record-id"], page, kind, None, 1, size, _b32(h), True, None)
        yield row
        if b"".join(s.take(4)) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")


def read_chunks(spark, path: str) -> DataFrame:
    """The record table read back.  ``data`` holds the bytes of segments only."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                rows, size = [], 0
                for r in _parse(b.column(0)[i].as_buffer()):
                    rows.append(r)
                    size += len(r[-1] or b"")
                    if size > 8 << 20 or len(rows) >= 4096:
                        yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows), _CHUNKS)], schema=_CHUNKS)
                        rows, size = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows), _CHUNKS)], schema=_CHUNKS)

    return files.mapInArrow(run, _CHUNKS_DDL)


def digests(chunks: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): segments
    of a record are met in order and digested with one running SHA-1."""
    out = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                     ("record_type", pa.string()), ("refers_to", pa.int64())])
    ddl = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def run(batches):
        now = None  # [record, running SHA-1, bytes, page, last segment, rows of the same record]

        def close(rows):
            rows.extend([(now[3], now[2], _b32(now[1]), "response", None)] * now[5])

        def batch(rows):
            return pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows), out)], schema=out)

        for b in batches:
            rows = []
            data = b.column(b.schema.get_field_index("data"))
            small = b.drop_columns(["data"]).to_pydict()
            for i, (rec, page, kind, ref, seg, size, sha, whole) in enumerate(
                    zip(*(small[f.name] for f in _CHUNKS if f.name != "data"))):
                if now and rec != now[0]:
                    close(rows)
                    now = None
                if whole:
                    rows.append((page, size, sha, kind, ref))
                elif now and seg == now[4]:  # a row of the input that repeats id and payload
                    now[5] += seg == 1
                else:
                    now = now or [rec, hashlib.sha1(), 0, page, 0, 1]
                    part = data[i].as_buffer()
                    now[1].update(part)
                    now[2] += part.size
                    now[4] = seg
            if rows:
                yield batch(rows)
        if now:
            rows = []
            close(rows)
            yield batch(rows)

    return chunks.repartition(F.col("record")).sortWithinPartitions("record", "segment").mapInArrow(run, ddl)


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", chunk: int = CHUNK,
               min_revisit: int = MIN_REVISIT, path: str | None = None) -> DataFrame:
    """Writes the archives and reads them back, digesting what was read."""
    path = path or f"{workdir(pages.sparkSession)}/warc"
    write_archives(record_table(pages, page_id, url, payload, chunk, min_revisit), path)
    return digests(read_chunks(pages.sparkSession, path))
