"""WARC archives: write, read, and resolve revisits.

Headers are shuffled by payload digest; of equal payloads the record with the smallest id is the response, others become
revisit records that refer to it, and the archives are written anew with fresh headers. A record is a text (headers, the
HTTP header block, the payload) and the two line ends that close a record are the writer's line separator, so Spark's own
text writer makes the archive: with its commit protocol, on any store that Spark writes to, gzip-compressed.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

CRLF = "\r\n"
#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32_PLAIN, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def payload_digest(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: ten hexadecimal digits at a time are eight base-32 digits."""
    x = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(x, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), BASE32_PLAIN, BASE32)


def resolve_revisits(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """records (id, url, payload) with payload_bytes, payload_digest, record_type, refers_to, refers_url.

    Only (digest, length, id, url) is aggregated, on the map side first; the payload moves once, in the join by digest,
    whose hot digests AQE splits. Payloads shorter than min_bytes are always responses. A null payload is empty. Rows that
    repeat the smallest id of their payload are all responses. A null id is a revisit if any row of that payload has an id,
    else a response. Other columns are not read; an empty table gives no rows.
    """
    full = records.select("id", "url", F.coalesce("payload", F.lit("")).alias("payload"))
    full = full.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": payload_digest(F.col("payload"))})
    heads = full.filter((F.col("payload_bytes") >= min_bytes) & F.col("id").isNotNull())
    first = heads.groupBy("payload_digest", "payload_bytes").agg(F.min(F.struct("id", "url")).alias("first"))
    out = full.join(first, ["payload_digest", "payload_bytes"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("first.id").eqNullSafe(F.col("id")) & (F.col("payload_bytes") >= min_bytes)
    return out.select(
        "id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first.id")).alias("refers_to"),
        F.when(revisit, F.col("first.url")).alias("refers_url"),
    )


def _line(name: str, value: Column) -> Column:
    """A header line; no line at all where the value is null. Line ends inside a value would end the header."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), "[\r\n]+", " "), F.lit(CRLF)), F.lit(""))


def _urn(value: Column) -> Column:
    """A record id in brackets: our own ids are numbers or plain names of pages, those of other writers are whole and hold a colon."""
    text = value.cast("string")
    return F.concat(F.lit("<"), F.when(text.contains(":"), text).otherwise(F.concat(F.lit("urn:page:"), text)), F.lit(">"))


def record_head(fields: list[tuple[str, Column]]) -> Column:
    return F.concat(F.lit(VERSION + CRLF), *[_line(k, v) for k, v in fields], F.lit(CRLF))


def write_warc(resolved: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", records_per_file: int = 10_000, others: DataFrame | None = None) -> None:
    """An archive for each partition, of records_per_file records at most. Revisits hold no payload; their HTTP header block says its length.

    resolved: what resolve_revisits gives. A null url has no header, a null payload is empty, a null id gets a fresh one; a null
    payload_bytes has no length; an empty table gives no record. others (value): whole records of other types, written as they are.
    """
    length = F.coalesce(F.concat(F.lit(f"{CRLF}Content-Length: "), F.col("payload_bytes").cast("string")), F.lit(""))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=UTF-8"), length, F.lit(CRLF * 2))
    is_revisit = F.col("record_type") == "revisit"
    block = F.concat(http, F.when(is_revisit, "").otherwise(F.coalesce("payload", F.lit(""))))
    head = record_head([
        ("WARC-Type", F.col("record_type")),
        ("WARC-Record-ID", F.coalesce(_urn(F.col("id")), F.concat(F.lit("<urn:page-uuid:"), F.uuid(), F.lit(">")))),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", F.col("url")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        ("WARC-Refers-To", _urn(F.col("refers_to"))),
        ("WARC-Refers-To-Target-URI", F.col("refers_url")),
        ("WARC-Profile", F.when(is_revisit, PROFILE)),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", F.octet_length(block)),
    ])
    records = resolved.select(F.concat(head, block).alias("value"))
    records = records if others is None else records.unionByName(others.select("value"))
    records.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


class Archive:
    """The records of one gzip-compressed archive, in turn; only the current record is held."""

    def __init__(self, data: bytes, piece: int = 1 << 20):
        self.data, self.piece, self.at, self.buffer = data, piece, 0, bytearray()
        self.inflate = zlib.decompressobj(31)

    def more(self) -> bool:
        if self.at >= len(self.data):
            return False
        chunk = self.data[self.at : self.at + self.piece]
        self.at += len(chunk)
        while chunk:
            self.buffer += self.inflate.decompress(chunk)
            chunk = self.inflate.unused_data
            if self.inflate.eof and chunk:  # archives may be several gzip members
                self.inflate = zlib.decompressobj(31)
        return True

    def until(self, mark: bytes) -> bytes:
        found, seen = self.buffer.find(mark), 0
        while found < 0:
            seen = max(0, len(self.buffer) - len(mark))
            if not self.more():
                raise ValueError("the archive ends inside a header")
            found = self.buffer.find(mark, seen)
        out = bytes(self.buffer[:found])
        del self.buffer[: found + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self.more():
                raise ValueError("the archive ends inside a block")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        while self.buffer or self.more():
            if not self.buffer:
                continue
            text = self.until(b"\r\n\r\n").decode("utf-8")
            head = text.split(CRLF)
            if not head[0].startswith("WARC/"):
                raise ValueError(f"no record starts here: {head[0][:40]!r}")
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head[1:])} | {"": text}
            block = self.take(int(fields["content-length"]))
            if self.take(4) != b"\r\n\r\n":
                raise ValueError("a record does not end with two line ends")
            yield fields, block


def _id_of(urn: str | None) -> str | None:
    """Our own ids without their prefix (none where a page had none), others whole, without brackets."""
    found = (urn or "").strip("<> ")
    return found.removeprefix("urn:page:") if found and not found.startswith("urn:page-uuid:") else None


def _sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _length(head: bytes) -> int | None:
    """Content-Length of an HTTP header block, if it has one."""
    found = [v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")) if k.strip().lower() == b"content-length"]
    return int(found[0]) if found and found[0].isdigit() else None


def parse_record(fields: dict[str, str], block: bytes) -> tuple:
    """(id, url, payload_bytes, payload_digest, record_type, refers_to, payload, refers_url).

    A response or revisit is an HTTP header block and a payload; a response whose payload does not match its SHA-1 digest or
    the block's length is an error. The length of a revisit's payload is null where its block has none; a response without a
    digest gets one. Of other types (warcinfo, request, metadata, resource …) the whole block counts as payload.
    """
    kind = fields["warc-type"]
    http = kind in ("response", "revisit") and "http" in fields.get("content-type", "http")
    head, _, payload = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
    length = _length(head)
    scheme, _, digest = fields.get("warc-payload-digest", "").rpartition(":")
    if kind == "response":
        own = _sha1(payload)
        if scheme == "sha1" and digest != own or length is not None and length != len(payload):
            raise ValueError(f"{fields.get('warc-record-id')}: the payload is not what its digest or length says")
        digest, length = own, len(payload)
    elif kind != "revisit":
        digest, length = _sha1(payload), len(payload)
    return _id_of(fields.get("warc-record-id")), fields.get("warc-target-uri"), length, digest or None, kind, _id_of(fields.get("warc-refers-to")), None if kind == "revisit" else payload, fields.get("warc-refers-to-target-uri")


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """(id, url, payload_bytes, payload_digest, record_type, refers_to[, payload, refers_url, value]) of every record; ids are strings.

    value is the whole record where it is neither response nor revisit. Payloads are texts in UTF-8; other bytes are an error
    where payloads are asked for. An archive, gzip-compressed as a whole or by record, is read by one task, record by record; a
    folder without archives gives no rows.
    """
    types = [pa.string(), pa.string(), pa.int64(), *[pa.string()] * (6 if payloads else 3)]
    names = ["id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload", "refers_url", "value"] * payloads]

    def texts(fields: dict[str, str], block: bytes, r: tuple) -> tuple:
        other = r[4] not in ("response", "revisit")
        value = "".join([fields[""], CRLF * 2, block.decode("utf-8", "surrogatepass")]) if other else None
        return (r[6].decode("utf-8", "surrogatepass") if r[4] == "response" else None, r[7], value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            cols = zip(*rows, strict=True) if rows else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], names=names)

        for b in batches:
            for data in b.column(0):
                rows, held = [], 0
                for fields, block in Archive(data.as_py()):
                    r = parse_record(fields, block)
                    rows.append((*r[:6], *(texts(fields, block, r) if payloads else ())))
                    held += len(block) if payloads else 100
                    if held > 1 << 23:
                        yield out(rows)
                        rows, held = [], 0
                yield out(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return c.map_arrow(files, run, "id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string" + ", payload string, refers_url string, value string" * payloads)


def deduplicate_archives(spark: SparkSession, source: str, target: str, min_bytes: int = 0) -> None:
    """Archives of another folder, rewritten with fresh headers.

    Revisits are joined by digest to the responses there and resolved anew with the other records; revisits whose original is
    not there stay as they are, and records of other types too. Ids are compared as numbers if all are whole numbers. Records
    without an id count as responses, as resolve_revisits says.
    """
    records = read_warc(spark, source, payloads=True)
    others = records.filter(~F.col("record_type").isin("response", "revisit"))
    records = records.filter(F.col("record_type").isin("response", "revisit")).drop("value")
    if records.filter("id is not null and not id rlike '^(0|[1-9][0-9]{0,17})$' or refers_to is not null and not refers_to rlike '^(0|[1-9][0-9]{0,17})$'").isEmpty():
        records = records.withColumns({x: F.col(x).cast("long") for x in ("id", "refers_to")})
    held = records.filter("record_type = 'response'")
    texts = held.groupBy("payload_digest").agg(F.min("payload").alias("found"))
    whole = records.join(texts, "payload_digest", "left").withColumn("payload", F.coalesce("payload", "found"))
    resolved = resolve_revisits(whole.filter("payload is not null").select("id", "url", "payload"), min_bytes)
    write_warc(resolved.unionByName(whole.filter("payload is null").select(*resolved.columns)), target, others=others)
