"""WARC archives: written with revisits and segmented records, read back by segment reassembly.

A record's block is an HTTP response in chunked transfer framing. A block beyond
the segment size is written as a first segment and continuation records, which may
be in any archive. Reading groups continuation records by their origin's
identifier, orders them by segment number, verifies the total length and then
decodes the framing.

Archives are written by Spark's text writer, whose line end is a record's: so
the committer makes them whole or absent on any file system. As segments bound a
record, a number of records bounds an archive. They are compressed as a whole, or
plain.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n"

#: Bytes of a payload from which an equal one is a revisit; of an archive before compression, at most; of a segment; of a chunk of the transfer framing.
LEAST_REVISIT, ARCHIVE, SEGMENT, FRAME = 100, 1 << 26, 1 << 14, 1 << 12


def record_id(*parts) -> str:
    """An identifier that follows from what it names, so that a task that is run again writes the same."""
    named = "\0".join("-" if p is None else f"+{p}" for p in parts)
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(named.encode('utf-8', 'surrogatepass')).digest()[:16])}>"


def _record(fields: dict[str, object], block: bytes) -> bytes:
    """A record without its end; null fields are left out, control characters in values become spaces."""
    fields = fields | {"WARC-Block-Digest": "sha256:" + hashlib.sha256(block).hexdigest(), "Content-Length": len(block)}
    head = [VERSION]
    for name, value in fields.items():
        if value is not None:
            head.append(f"{name}: {''.join(c if c >= ' ' and c != chr(127) else ' ' for c in str(value))}".encode("utf-8", "surrogatepass"))
    return _END.join(head) + _END * 2 + block


def framed(payload: bytes, size: int = FRAME) -> bytes:
    """An HTTP response with the payload in chunked transfer framing."""
    out = [b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"]
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        out += [b"%x\r\n" % len(part), part, _END]
    return b"".join([*out, b"0\r\n\r\n"])


def unframed(block: bytes) -> bytes:
    """The payload of an HTTP response: chunked framing (extensions and trailers are allowed) or the rest of the block; a fault is a ValueError."""
    head, gap, body = block.partition(_END * 2)
    if not gap:
        raise ValueError("no HTTP header")
    fields = [line.partition(b":") for line in head.split(_END)[1:]]
    if not any(k.strip().lower() == b"transfer-encoding" and v.strip().lower().split(b",")[-1].strip() == b"chunked" for k, _, v in fields):
        return body
    out, at = [], 0
    while True:
        end = body.find(_END, at)
        size = body[at:end].partition(b";")[0].strip() if end >= 0 else b""
        if not size or size.strip(b"0123456789abcdefABCDEF"):
            raise ValueError("bad chunk size")
        n, at = int(size, 16), end + 2
        if not n:
            return b"".join(out)  # trailers carry no payload
        if body[at + n : at + n + 2] != _END:
            raise ValueError("bad chunk")
        out.append(body[at : at + n])
        at += n + 2


def _records_of(page_id, url, payload: bytes, digest: str, first_id, first_url, revisit: bool, date: str, segment: int, frame: int) -> Iterator[bytes]:
    fields = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": record_id("revisit" if revisit else "response", page_id, url, digest), "WARC-Date": date, "WARC-Target-URI": url, "X-Page-ID": page_id, "WARC-Payload-Digest": f"sha256:{digest}"}
    http = {"Content-Type": "application/http;msgtype=response"}
    if revisit:
        yield _record(fields | {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id("response", first_id, first_url, digest)} | http, framed(b"", frame).partition(_END * 2)[0] + _END * 2)
        return
    block = framed(payload, frame)
    if len(block) <= segment:
        yield _record(fields | http, block)
        return
    origin, count = fields["WARC-Record-ID"], -(-len(block) // segment)
    for k in range(count):
        part = block[k * segment : (k + 1) * segment]
        if not k:
            yield _record(fields | http | {"WARC-Segment-Number": 1}, part)
        else:
            more = {"WARC-Type": "continuation", "WARC-Record-ID": record_id(origin, k), "WARC-Date": date, "WARC-Target-URI": url, "WARC-Segment-Origin-ID": origin, "WARC-Segment-Number": k + 1}
            yield _record(more | {"WARC-Segment-Total-Length": len(block) if k == count - 1 else None}, part)


def with_first(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``page_id, url, payload, digest, first_id, first_url, revisit`` of rows ``page_id, url, payload``: whose payload a page repeats.

    Of equal payloads of ``least`` bytes the one with the smallest page id is
    stored (nulls last, then by url; rows that repeat that id are all stored).
    Groups are summed up before they are shuffled, and meet the pages in a join
    whose large side Spark splits where a digest is hot; pages below the limit are
    dealt by their own id.
    """
    rows = pages.withColumn("digest", F.sha2("payload", 256))
    rows = rows.withColumn("key", F.when(F.octet_length("payload") >= least, F.col("digest")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("page_id").cast("string"), "url", F.lit("")))))
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.col("url").isNull().alias("no_url"), "url")
    heads = rows.where(F.octet_length("payload") >= least).groupBy("key").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    out = rows.join(heads, "key", "left")
    same = F.col("page_id").eqNullSafe(F.col("first.page_id"))
    return out.select("page_id", "url", "payload", "digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"), (F.col("first").isNotNull() & ~same).alias("revisit"))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z", least: int = LEAST_REVISIT, archive: int = ARCHIVE, segment: int = SEGMENT, frame: int = FRAME, compression: str = "gzip") -> None:
    """A record for each row, in archives of at most ``archive`` bytes (fields of a KB a record allowed for) in a new folder ``path``.

    A null html is an empty payload, null ids and urls leave their fields out.
    Rows alike in id, url and html get records alike, identifier included. An
    empty table gives a folder without records. Further columns are not looked at.
    """
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).cast("binary").alias("payload"))

    def write(batches):
        for batch in batches:
            got, size = [], 0
            for row in zip(*(batch.column(k) for k in range(7)), strict=True):
                page_id, url, payload, digest, first_id, first_url, revisit = (x.as_py() for x in row)
                for record in _records_of(page_id, url, payload, digest, first_id, first_url, revisit, date, segment, frame):
                    got.append(record)
                    size += len(record)
                if size >= 1 << 22:
                    yield pa.record_batch([pa.array(got, pa.binary())], ["record"])
                    got, size = [], 0
            yield pa.record_batch([pa.array(got, pa.binary())], ["record"])

    records = with_first(rows, least).mapInArrow(write, "record binary")
    # bytes as they are: the cast changes none of them, and the line end ends a record
    lines = records.select(F.col("record").cast("string").alias("value")).write
    lines.option("lineSep", "\r\n\r\n").option("compression", compression).option("maxRecordsPerFile", max(1, archive // (segment + 1024))).text(path)


# ---- reading ----------------------------------------------------------------------


def _inflated(data: bytes) -> bytes:
    """A plain archive, or one of one or more gzip members."""
    out = []
    while data[:2] == b"\x1f\x8b":
        one = zlib.decompressobj(31)
        out.append(one.decompress(data))
        if not one.eof:
            break
        data = one.unused_data
    return b"".join(out) if out else data


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """Fields (names in lower case), block and fault of each record; what follows a record that can't be delimited is lost, and said so."""
    data, at = _inflated(data), 0
    while at < len(data):
        if data.startswith(_END, at):  # ends of records
            at += 2
            continue
        head = data.find(_END * 2, at)
        lines = data[at:head].split(_END) if head >= 0 else []
        if not lines or not lines[0].startswith(b"WARC/"):
            yield {}, b"", "bad record header"
            return
        fields: dict[str, str] = {}
        for line in lines[1:]:
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        size = fields.get("content-length", "")
        if not (size.isascii() and size.isdigit()):
            yield fields, b"", "no content length"
            return
        at = head + 4 + int(size)
        block = data[head + 4 : at]
        fault = "truncated record" if len(block) < int(size) else None
        said = fields.get("warc-block-digest", "")
        if not fault and said.startswith("sha256:") and said[7:] != hashlib.sha256(block).hexdigest():
            fault = "wrong block digest"
        yield fields, block, fault


#: What reading returns, and what goes between parsing and reassembly.
READ = "record_id string, type string, page_id string, url string, date string, refers_to string, payload_digest string, payload binary, problem string"
_PARTS = "origin string, number int, total long, type string, page_id string, url string, date string, payload_digest string, block binary, problem string"
_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _batches(rows: Iterator[tuple], schema: str, weigh: int) -> Iterator[pa.RecordBatch]:
    """Rows in batches of a few MB; ``weigh`` is the column with the bytes."""
    names = [x.split() for x in schema.split(", ")]
    make = lambda got: pa.record_batch([pa.array(c, _TYPES[t]) for c, (_, t) in zip(zip(*got, strict=True), names, strict=True)], [n for n, _ in names])
    got, size = [], 0
    for row in rows:
        got.append(row)
        size += 1000 + len(row[weigh] or b"")
        if size >= 1 << 22:
            yield make(got)
            got, size = [], 0
    if got:
        yield make(got)


def _decoded(kind: str, said: str | None, block: bytes, fault: str | None) -> tuple[bytes | None, str | None]:
    if fault:
        return None, fault
    if kind != "response":
        return None, None
    try:
        payload = unframed(block)
    except ValueError as e:
        return None, str(e)
    if said and said != hashlib.sha256(payload).hexdigest():
        return None, "wrong payload digest"
    return payload, None


def _bare(digest: str | None) -> str | None:
    return digest[7:] if digest and digest.startswith("sha256:") else None


def _whole(batches):
    """Records in one piece, decoded where they are parsed; of others' faults those that hide a record's kind."""

    def rows():
        for batch in batches:
            for x in batch.column(0):
                for f, block, fault in parse_records(x.as_py()):
                    kind = f.get("warc-type", "")
                    if "warc-segment-number" in f or (kind not in ("response", "revisit") and not (fault and not f)):
                        continue
                    said = _bare(f.get("warc-payload-digest"))
                    payload, problem = _decoded(kind, said, block, fault)
                    yield f.get("warc-record-id"), kind or None, f.get("x-page-id"), f.get("warc-target-uri"), f.get("warc-date"), f.get("warc-refers-to"), said, payload, problem

    return _batches(rows(), READ, 7)


def _segments(batches):
    def rows():
        for batch in batches:
            for x in batch.column(0):
                for f, block, fault in parse_records(x.as_py()):
                    number = f.get("warc-segment-number", "")
                    if not number:
                        continue
                    if not (number.isascii() and number.isdigit()) or int(number) >= 1 << 31:
                        number, fault = "0", "bad segment number"
                    total = f.get("warc-segment-total-length", "")
                    yield f.get("warc-segment-origin-id") or f.get("warc-record-id"), int(number), int(total) if total.isascii() and total.isdigit() else None, f.get("warc-type"), f.get("x-page-id"), f.get("warc-target-uri"), f.get("warc-date"), _bare(f.get("warc-payload-digest")), block, fault

    return _batches(rows(), _PARTS, 8)


def _assembled(batches):
    """Runs of segments of one origin, in order: joined, verified, decoded. One record's segments are held at a time."""

    def finish(parts: list[tuple]) -> Iterator[tuple]:
        first = parts[0]
        copies = sum(p[1] == first[1] for p in parts)  # records alike share an identifier, so each segment is there as often
        own = parts[::copies]
        block = b"".join(p[8] for p in own)
        total = own[-1][2]
        fault = next((p[9] for p in parts if p[9]), None)
        if not fault:
            if first[1] != 1 or first[3] == "continuation":
                fault = "no first segment"
            elif len(parts) != copies * len(own) or [p[1] for p in parts] != [k + 1 for k in range(len(own)) for _ in range(copies)]:
                fault = "missing segment"
            elif total is None:
                fault = "no last segment"
            elif total != len(block):
                fault = "wrong total length"
        payload, problem = _decoded("response", first[7], block, fault)
        for _ in range(copies):
            yield first[0], first[3], first[4], first[5], first[6], None, first[7], payload, problem

    def rows():
        parts: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(k) for k in range(10)), strict=True):
                part = tuple(x.as_py() for x in row)
                if parts and parts[0][0] != part[0]:
                    yield from finish(parts)
                    parts = []
                parts.append(part)
        if parts:
            yield from finish(parts)

    return _batches(rows(), READ, 7)


def read_warc(spark: SparkSession, path) -> DataFrame:
    """A row for each response and revisit of the archives at ``path``; see ``READ``.

    ``payload`` is that of a response, decoded; it is null where ``problem`` says
    what is wrong with the record: its header, length, digests, segments or
    framing. Other types of records are passed over. Records in one piece are
    decoded where they are parsed; segments alone are shuffled, by origin, and
    sorted, so one record's are held at a time. A task holds one archive.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    parts = files.mapInArrow(_segments, _PARTS)
    sorted_ = parts.repartition("origin").sortWithinPartitions("origin", "number")
    return files.mapInArrow(_whole, READ).unionAll(sorted_.mapInArrow(_assembled, READ))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to``: revisits with the payload facts and the page of the response that they refer to.

    ``records`` are rows ``record_id, type, page_id, refers_to, payload_bytes,
    payload_digest`` and written already, as they are read twice. A revisit whose
    response isn't there has nulls. Only a few bytes a record are shuffled;
    Spark splits the revisits of a hot response.
    """
    held = records.where("type = 'response'")
    known = held.groupBy("record_id").agg(F.first("page_id").alias("own"), F.first("payload_bytes").alias("bytes"), F.first("payload_digest").alias("digest"))
    again = records.where("type = 'revisit'").select("page_id", "refers_to").join(known.withColumnRenamed("record_id", "refers_to"), "refers_to", "left")
    none = F.lit(None).cast("string")
    return held.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), none.alias("refers_to")).unionAll(again.select("page_id", "bytes", "digest", F.lit("revisit"), "own"))
