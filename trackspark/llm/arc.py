"""Legacy ARC archives to WARC.

ARC files are parsed by the header line of their version (1: five fields, 2: ten) and the
declared length of each document; every document becomes a WARC/1.1 record with a
synthesised identifier, date, type and digests. Archives are written and read by Spark's
text and binary-file sources, so they may lie in any store that Spark knows: the text
writer's line separator is the end mark of a record.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackspark.llm.common import settled, shared_dir

# The field names of the two ARC versions and the profile of a revisit.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ID_HEADER = "X-Page-Id"
RECORDS = ("url string, ip string, date string, media string, http binary, payload binary, "
           "payload_bytes long, payload_digest string, page_id long, at long, fault string")
BATCH_BYTES = 8 << 20


def _batches(rows: Iterable[tuple], schema: pa.Schema, weigh) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += weigh(row)
        if weight >= BATCH_BYTES or len(held) >= 5000:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _arc_line(version: int, url: str, ip: str, date: str, media: str, length: int) -> bytes:
    middle = {1: "", 2: " 200 - - 0 -"}[version]
    return f"{url} {ip} {date} {media}{middle} {length}\n".encode()


def write_arc(pages: DataFrame, path: str, date: str = "20240229120000", ip: str = "192.0.2.1") -> None:
    """ARC files of (page_id, url, html), one per partition, versions 1 and 2 in turn.

    White space in an address is escaped, an absent one becomes ``urn:absent``; the document
    is an HTTP response whose head carries the page's id.
    """
    rows = pages.select(F.spark_partition_id().alias("part"), F.col("page_id").cast("long"), "url",
                        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("body"))
    schema = pa.schema([("value", pa.binary())])

    def documents(batches):
        begun = False
        for batch in batches:
            parts, ids, urls, bodies = (batch.column(i).to_pylist() for i in range(4))
            for part, page, url, body in zip(parts, ids, urls, bodies):
                version = 1 + part % 2
                if not begun:
                    begun = True
                    head = f"{version} 0 crawl\n{ARC_FIELDS[version]}\n".encode()
                    yield (_arc_line(version, f"filedesc://pages-{part:05}.arc", ip, date,
                                     "text/plain", len(head)) + head,)
                url = "".join(f"%{ord(c):02X}" if c <= " " else c for c in url or "") or "urn:absent"
                mark = "" if page is None else f"{ID_HEADER}: {page}\r\n"
                http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{mark}"
                        f"Content-Length: {len(body)}\r\n\r\n").encode()
                yield (_arc_line(version, url, ip, date, "text/html", len(http) + len(body)) + http + body,)

    def write(batches):
        yield from _batches(documents(batches), schema, lambda r: len(r[0]))

    (rows.mapInArrow(write, "value binary").select(F.col("value").cast("string"))
     .write.option("lineSep", "\n").option("compression", "gzip").text(path))


def _opened(content: bytes) -> io.BufferedIOBase:
    return gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)


def _iso(date: str) -> str:
    """14 digits (or a prefix of them) as a WARC date; anything else is the epoch."""
    digits = (date + "00000101000000"[len(date):]) if date.isdigit() and 4 <= len(date) <= 14 else "19700101000000"
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:14]}Z"


def _headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if v}


def _number(text: str | None) -> int | None:
    return int(text) if text is not None and text.lstrip("-").isdigit() else None


def parse_arc(content: bytes) -> Iterator[tuple]:
    """The documents of one ARC file, as rows of RECORDS.

    The version block names the fields; without one, a header line of ten or more words is
    version 2. A document shorter than declared is kept with ``fault`` truncated; a line
    that is no header ends the file with one row of ``fault`` malformed.
    """
    file, fields, at = _opened(content), None, 0
    while line := file.readline():
        if not line.strip():
            continue
        words = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        n = fields or (10 if len(words) >= 10 else 5)
        if len(words) < n or not words[-1].isdigit():
            yield (None, None, None, None, None, b"", 0, hashlib.sha256(b"").hexdigest(), None, at, "malformed")
            return
        length = int(words[-1])
        body = file.read(length)
        fault = None if len(body) == length else "truncated"
        if words[0].startswith("filedesc://"):
            names = body.decode("utf-8", "replace").split("\n")
            version = _number(names[0].split(" ")[0])
            fields = len(names[1].split()) if len(names) > 1 and names[1].strip() else {2: 10}.get(version, 5)
            continue
        url, ip, date, media = " ".join(words[:len(words) - n + 1]), *words[len(words) - n + 1:len(words) - n + 4]
        http, payload, page = None, body, None
        if body.startswith(b"HTTP/"):
            head, mark, payload = body.partition(b"\r\n\r\n")
            http = head + mark
            page = _number(_headers(http).get(ID_HEADER.lower()))
        yield (url, ip, _iso(date), media, http, payload, len(payload),
               hashlib.sha256(payload).hexdigest(), page, at, fault)
        at += 1


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the ARC files under ``path``, with its file."""
    schema = pa.schema([
        ("file", pa.string()), ("url", pa.string()), ("ip", pa.string()), ("date", pa.string()),
        ("media", pa.string()), ("http", pa.binary()), ("payload", pa.binary()),
        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("page_id", pa.int64()),
        ("at", pa.int64()), ("fault", pa.string())])

    def parse(batches):
        def rows():
            for batch in batches:
                for file, content in zip(batch.column(0), batch.column(1)):
                    name = file.as_py().rsplit("/", 1)[-1]
                    for row in parse_arc(content.as_py()):
                        yield (name, *row)
        yield from _batches(rows(), schema, lambda r: len(r[6]))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(parse, f"file string, {RECORDS}")


def _uuid(*columns: Column) -> Column:
    """A stable record id: the first 128 bits of a digest over what identifies the record."""
    h = F.sha2(F.concat_ws("\n", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), 256)
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in cuts])


def with_revisits(records: DataFrame, least_bytes: int = 100) -> DataFrame:
    """Adds record_id, and refers_id/refers_page/refers_url/refers_date of revisits.

    Among records with equal payloads of at least ``least_bytes`` bytes the one with the
    smallest page id (absent ids last, then place) is the original.
    """
    records = records.withColumn("record_id", _uuid(F.col("file"), F.col("at"), F.col("url"), F.col("payload_digest")))
    rank = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "file", "at", "record_id", "url", "date")
    groups = (records.filter(F.col("payload_bytes") >= least_bytes)
              .groupBy(F.col("payload_digest").alias("digest"))
              .agg(F.min(rank).alias("first"), F.count("*").alias("copies")).filter("copies > 1"))
    groups = settled(groups.select("digest", "first"), "arc-groups")
    joined = records.join(groups, (F.col("payload_digest") == F.col("digest"))
                          & (F.col("payload_bytes") >= least_bytes), "left")
    revisit = F.col("first").isNotNull() & (F.col("first.record_id") != F.col("record_id"))
    return joined.withColumns({
        f"refers_{k}": F.when(revisit, F.col(f"first.{v}"))
        for k, v in (("id", "record_id"), ("page", "page_id"), ("url", "url"), ("date", "date"))
    }).drop("digest", "first")


def write_warc(records: DataFrame, path: str) -> None:
    """WARC/1.1 files of records that :func:`with_revisits` has marked."""
    schema = pa.schema([("value", pa.binary())])
    names = ["url", "date", "ip", "media", "http", "payload", "payload_bytes", "payload_digest", "record_id",
             "refers_id", "refers_page", "refers_url", "refers_date", "fault"]

    def record(kind: str, record_id: str, date: str | None, block: bytes, extra: list[tuple[str, object]]) -> bytes:
        head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{record_id}>"),
                ("WARC-Date", date or "1970-01-01T00:00:00Z"), *[(k, v) for k, v in extra if v not in (None, "")],
                ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
                ("Content-Length", len(block))]
        return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block

    def records_of(batches):
        begun = False
        for batch in batches:
            for (url, date, ip, media, http, payload, size, digest, rid, to, page, to_url, to_date,
                 fault) in zip(*(batch.column(i).to_pylist() for i in range(len(names)))):
                if not begun:
                    begun = True
                    block = b"format: WARC File Format 1.1\r\n"
                    yield (record("warcinfo", str(uuid.uuid5(uuid.NAMESPACE_URL, f"warcinfo {rid}")), date, block,
                                  [("Content-Type", "application/warc-fields")]),)
                kind = "revisit" if to else "response" if http is not None else "resource"
                block = (http or b"") + (b"" if to else payload)
                yield (record(kind, rid, date, block, [
                    ("WARC-Target-URI", url), ("WARC-IP-Address", ip),
                    ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Identified-Payload-Type", media),
                    ("WARC-Truncated", "length" if fault == "truncated" else None),
                    ("WARC-Profile", REVISIT_PROFILE if to else None),
                    ("WARC-Refers-To", f"<urn:uuid:{to}>" if to else None),
                    ("WARC-Refers-To-Target-URI", to_url), ("WARC-Refers-To-Date", to_date),
                    ("X-Refers-To-Page-Id", page), ("X-Payload-Length", size if to else None),
                    ("Content-Type", "application/http;msgtype=response" if http is not None else media),
                ]),)

    def write(batches):
        yield from _batches(records_of(batches), schema, lambda r: len(r[0]))

    (records.filter("fault is null or fault = 'truncated'").select(*names)
     .mapInArrow(write, "value binary").select(F.col("value").cast("string"))
     .write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path))


def parse_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of one WARC file."""
    file = _opened(content)
    while line := file.readline():
        if not line.startswith(b"WARC/"):
            continue
        lines = [line]
        while (line := file.readline()).strip():
            lines.append(line)
        head = _headers(b"".join(lines))
        yield head, file.read(_number(head.get("content-length")) or 0)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per captured page: page_id, payload_bytes, payload_digest, record_type, refers_to.

    The digest and length of a response are taken anew from its payload, those of a revisit
    from its header, since its payload is stored with the record it refers to. ``intact``
    tells whether the digest in the header agrees.
    """
    schema = pa.schema([
        ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()),
        ("url", pa.string()), ("date", pa.string()), ("intact", pa.bool_())])

    def rows(batches):
        for batch in batches:
            for content in batch.column(0):
                for head, block in parse_warc(content.as_py()):
                    kind = head.get("warc-type")
                    if kind == "warcinfo":
                        continue
                    told = head.get("warc-payload-digest", "").removeprefix("sha256:")
                    http, mark, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
                    page = _number(_headers(http).get(ID_HEADER.lower()))
                    size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                    if kind == "revisit":
                        size, digest = _number(head.get("x-payload-length")), told
                    yield (page, size, digest, kind, _number(head.get("x-refers-to-page-id")),
                           head.get("warc-record-id", "")[10:-1], head.get("warc-target-uri"),
                           head.get("warc-date"), digest == told)

    def parse(batches):
        yield from _batches(rows(batches), schema, lambda r: 200)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(
        parse, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
               "record_id string, url string, date string, intact boolean")


def convert(spark: SparkSession, arc_path: str, warc_path: str, least_bytes: int = 100) -> None:
    """All ARC files under ``arc_path`` as WARC files under ``warc_path``."""
    write_warc(with_revisits(read_arc(spark, arc_path), least_bytes), warc_path)


def fresh_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder of archives that has been converted."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
