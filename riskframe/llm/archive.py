"""Legacy web archives (ARC) converted to WARC, written and read by Spark."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskframe.llm.common import Workspace
from riskframe.session import scratch_path

#: Records per archive file; files are read whole, one row each.
RECORDS = 1000
CRLF = b"\r\n"
#: The first lines of both versions of the old format.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
CHUNK = 8 << 20


def _sha1(*parts: bytes) -> str:
    digest = hashlib.sha1()
    for part in parts:
        digest.update(part)
    return base64.b32encode(digest.digest()).decode()


def _position() -> Column:
    """Number of the row inside its task, from 0: the writer keeps this order."""
    return F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))


def _write(records: DataFrame, folder: str, end: str) -> None:
    """One text column to gzip files of ``RECORDS`` records, each followed by ``end``."""
    (
        records.write.option("lineSep", end).option("compression", "gzip").option("maxRecordsPerFile", RECORDS)
        .option("zlib.compress.level", "BEST_SPEED").text(folder)
    )


def write_legacy(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Pages as legacy archives, version 1 and 2 by turns of the task.

    Every record is a declared header line and an HTTP response of that length; the
    page's key travels in an HTTP header. A null html is an empty payload; a null
    url is written as ``urn:page:`` and the key, white space in urls is encoded.
    """
    body = F.coalesce(F.col(html).cast("string"), F.lit(""))
    page = F.coalesce(F.col(key).cast("string"), F.lit(""))
    link = F.coalesce(F.col(url).cast("string"), F.concat(F.lit("urn:page:"), page))
    for blank, code in ((" ", "%20"), ("\t", "%09"), ("\n", "%0A"), ("\r", "%0D")):
        link = F.replace(link, F.lit(blank), F.lit(code))
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: "), page,
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    size = (F.octet_length(head) + F.octet_length(body)).cast("string")
    second = F.spark_partition_id() % 2 == 1
    fields = F.concat_ws(
        " ", link, F.lit("0.0.0.0"), F.lit("19990101000000"), F.lit("text/html"),
        F.when(second, F.concat_ws(" ", F.lit("200"), F.lit("-"), F.lit("-"), F.lit("0"), F.lit("pages"), size)).otherwise(size),
    )

    def opening(version: int) -> Column:
        block = f"{version} 0 riskframe\n{FIELDS[version]}\n"
        first = "filedesc://pages.arc 0.0.0.0 19990101000000 text/plain "
        return F.lit(first + ("200 - - 0 pages " if version == 2 else "") + f"{len(block)}\n{block}\n")

    start = F.when(_position() % RECORDS != 0, F.lit("")).when(second, opening(2)).otherwise(opening(1))
    _write(pages.select(F.concat(start, fields, F.lit("\n"), head, body).alias("value")), folder, "\n")


class Stream:
    """Bytes of a gzip file (one member or many) or a plain one, unpacked as they are asked for."""

    def __init__(self, content: bytes):
        self.rest, self.plain = content, content[:2] != b"\x1f\x8b"
        self.unzip, self.buffer = None, bytearray()
        if self.plain:
            self.buffer, self.rest = bytearray(content), b""

    def _more(self) -> bool:
        while self.rest:
            self.unzip = self.unzip or zlib.decompressobj(31)
            data = self.unzip.decompress(self.rest, CHUNK)
            if self.unzip.eof:
                self.rest, self.unzip = self.unzip.unused_data, None
            else:
                self.rest = self.unzip.unconsumed_tail
            if data:
                self.buffer += data
                return True
        return False

    def line(self) -> bytes | None:
        """Up to and without the next line feed; None at the end."""
        seen = 0
        while (at := self.buffer.find(b"\n", seen)) < 0:
            seen = len(self.buffer)
            if not self._more():
                if not self.buffer:
                    return None
                at = len(self.buffer)
                break
        out = bytes(self.buffer[:at])
        del self.buffer[: at + 1]
        return out

    def take(self, size: int) -> bytes:
        while len(self.buffer) < size and self._more():
            pass
        if len(self.buffer) < size:
            raise ValueError(f"a record declares {size} bytes, the archive has {len(self.buffer)} left")
        out = bytes(self.buffer[:size])
        del self.buffer[:size]
        return out


def read_arc(content: bytes) -> Iterator[dict]:
    """Records of one legacy archive, by its own field line and declared lengths.

    The opening record names the version and the fields of the lines that follow;
    dates have 8 to 14 digits. Blank lines between records are passed over.
    """
    stream, fields = Stream(content), None
    while (line := stream.line()) is not None:
        if not line.strip():
            continue
        parts = line.rstrip(b"\r").decode("utf-8", "surrogateescape").split(" ")
        if line.startswith(b"filedesc://"):
            block = stream.take(int(parts[-1])).decode("ascii").split("\n")
            version = int(block[0].split(" ")[0])
            fields = block[1].split(" ")
            if fields != FIELDS.get(version, "").split(" "):
                raise ValueError(f"unknown version or field line: {block[:2]}")
            continue
        if fields is None or len(parts) != len(fields):
            raise ValueError(f"no archive header line: {line[:200]!r}")
        entry = dict(zip(fields, parts))
        yield {
            "uri": entry["URL"], "ip": entry["IP-address"], "date": entry["Archive-date"],
            "mime": entry["Content-type"], "block": stream.take(int(entry["Archive-length"])),
        }


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """Header section (with its blank line) and payload of an HTTP response; no header: all payload."""
    end = block.find(b"\r\n\r\n") if block.startswith(b"HTTP/") else -1
    return (block[: end + 4], block[end + 4 :]) if end >= 0 else (b"", block)


def iso_date(date: str) -> str:
    """Legacy date of 8 to 14 digits as a WARC timestamp."""
    full = (date + "19700101000000"[len(date) :])[:14]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def parsed_arc(spark: SparkSession, folder: str, bodies: bool) -> DataFrame:
    """Records of all legacy archives: place, synthesised id and digests, and the texts if asked for."""
    schema = "place string, page long, digest string, size long"
    if bodies:
        schema += ", uri string, ip string, moment string, record string, whole string, head string, body string, head_digest string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.strip().split(" ")[0] for part in schema.split(",")]
        kinds = [pa.int64() if n in ("page", "size") else pa.binary() if n in ("head", "body") else pa.string() for n in names]
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, held = [], 0
                for number, entry in enumerate(read_arc(content.as_py())):
                    head, body = http_parts(entry["block"])
                    found = re.search(rb"(?im)^X-Page-Id: *(-?[0-9]+)", head)
                    place = f"{path.rsplit('/', 1)[-1]}:{number:09d}"
                    row = [place, int(found[1]) if found else None, _sha1(body), len(body)]
                    if bodies:
                        stem = hashlib.sha1(f"{place} {entry['date']} {entry['uri']}".encode("utf-8", "surrogateescape")).hexdigest()
                        record = f"urn:uuid:{stem[:8]}-{stem[8:12]}-5{stem[13:16]}-8{stem[17:20]}-{stem[20:32]}"
                        uri = entry["uri"].encode("utf-8", "surrogateescape").decode("utf-8", "replace")
                        row += [uri, entry["ip"], iso_date(entry["date"]), record, _sha1(entry["block"]), head, body, _sha1(head)]
                        held += len(body)
                    rows.append(row)
                    if held > CHUNK:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInArrow(run, schema.replace("head string, body string", "head binary, body binary"))


def convert(spark: SparkSession, legacy: str, folder: str) -> None:
    """Legacy archives to WARC archives in ``folder``.

    Of records with equal payloads the one with the smallest page (then place) stays
    a response; the others become revisits that refer to it and carry the HTTP
    header only. Duplicates are found on digests; payloads are shuffled once, by
    their unique place.
    """
    space = Workspace(spark, "warc")
    index = space.settle(parsed_arc(spark, legacy, False), "index")
    order = F.struct(F.coalesce("page", F.lit((1 << 63) - 1)).alias("page"), F.col("place").alias("place"))
    firsts = space.settle(index.groupBy("digest", "size").agg(F.min(order).alias("first")), "firsts")
    target = space.settle(
        index.join(firsts, ["digest", "size"]).filter(F.col("first.place") != F.col("place"))
        .select("place", F.col("first.place").alias("origin")),
        "target",
    )
    full = parsed_arc(spark, legacy, True)
    # what a revisit says about its origin: one row per origin, read from the archives again
    origins = space.settle(
        full.select(F.col("place").alias("origin"), F.col("record").alias("o_record"), F.col("uri").alias("o_uri"), F.col("moment").alias("o_moment"))
        .join(target.select("origin").distinct(), "origin", "left_semi"),
        "origins",
    )
    refers = space.settle(target.join(origins, "origin").drop("origin"), "refers")
    rows = full.join(refers, "place", "left")
    again = F.col("o_record").isNotNull()
    block = F.when(again, F.col("head").cast("string")).otherwise(F.concat(F.col("head").cast("string"), F.col("body").cast("string")))
    size = F.octet_length("head") + F.when(again, 0).otherwise(F.octet_length("body"))
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(again, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <"), F.col("record"), F.lit(">\r\nWARC-Date: "), F.col("moment"),
        F.lit("\r\nWARC-Target-URI: "), F.col("uri"), F.lit("\r\nWARC-IP-Address: "), F.col("ip"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\nWARC-Block-Digest: sha1:"),
        F.when(again, F.col("head_digest")).otherwise(F.col("whole")),
        F.when(again, F.concat(
            F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <"),
            F.col("o_record"), F.lit(">\r\nWARC-Refers-To-Target-URI: "), F.col("o_uri"),
            F.lit("\r\nWARC-Refers-To-Date: "), F.col("o_moment"),
        )).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n"),
    )
    about = "software: riskframe\r\nformat: WARC File Format 1.1\r\n"
    info = (
        "WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:00000000-0000-5000-8000-000000000000>\r\n"
        "WARC-Date: 1999-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\n"
        f"Content-Length: {len(about)}\r\n\r\n{about}\r\n\r\n"
    )
    start = F.when(_position() % RECORDS == 0, F.lit(info)).otherwise("")
    _write(rows.select(F.concat(start, header, block).alias("value")), folder, "\r\n\r\n")
    space.release()


def read_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of one WARC archive, by declared lengths."""
    stream = Stream(content)
    while (line := stream.line()) is not None:
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:200]!r}")
        headers = {}
        while (line := stream.line()) is not None and line.strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, stream.take(int(headers["content-length"]))


def read_back(spark: SparkSession, folder: str) -> DataFrame:
    """Responses and revisits of all WARC archives: record, type, page, digest, size, refers.

    The payload's digest and size are computed anew for responses; a revisit has
    them from its own headers.
    """
    names = ["record", "record_type", "page", "digest", "size", "refers", "uri", "intact"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for headers, block in read_warc(content.as_py()):
                    kind = headers["warc-type"]
                    if kind == "warcinfo":
                        continue
                    head, body = http_parts(block)
                    page = re.search(rb"(?im)^X-Page-Id: *(-?[0-9]+)", head)
                    told = headers["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response":
                        digest, size = _sha1(body), len(body)
                    else:
                        length = re.search(rb"(?im)^Content-Length: *([0-9]+)", head)
                        digest, size = told, int(length[1]) if length else None
                    intact = digest == told and _sha1(block) == headers["warc-block-digest"].removeprefix("sha1:")
                    rows.append((
                        headers["warc-record-id"], kind, int(page[1]) if page else None, digest, size,
                        headers.get("warc-refers-to"), headers["warc-target-uri"], intact,
                    ))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(
        run, "record string, record_type string, page long, digest string, size long, refers string, uri string, intact boolean"
    )


def archive_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write pages as legacy archives, convert these to WARC, read the WARC back.

    Returns per page: the key, payload_bytes, payload_digest (bare base32 SHA-1),
    record_type, refers_to (the response's key for revisits) and intact (digests
    checked on reading). Null html is an empty payload; rows repeating a key are
    archived each, the first of equal ones as response; null keys stay and sort
    last; other columns are ignored; no rows give no rows.
    """
    spark = pages.sparkSession
    legacy, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    write_legacy(pages, legacy, key, url, html)
    convert(spark, legacy, warc)
    space = Workspace(spark, "warc")
    rows = space.settle(read_back(spark, warc), "rows")
    space.paths |= {"legacy": legacy, "archives": warc}
    first = rows.filter("record_type = 'response'")
    revisit = rows.filter("record_type = 'revisit'").join(
        first.select(F.col("record").alias("refers"), F.col("page").alias("refers_to")), "refers", "left"
    )
    columns = [
        F.col("page").alias(key), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        "record_type", "refers_to", "intact",
    ]
    space.release("rows")
    return first.withColumn("refers_to", F.lit(None).cast("long")).select(*columns).union(revisit.select(*columns))
