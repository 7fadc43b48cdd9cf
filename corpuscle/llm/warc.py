"""Legacy archives to WARC: ARC files are read, their records written as WARC/1.1 records.

``parse_arc`` reads both ARC versions.  A version-1 record line has five fields
(URL, IP, date, content type, length), a version-2 line has ten (then result code,
checksum, location, offset and file name before the length).  The version block at
the head of a file says which; its declared length covers the field names.  A record
of a web page holds the HTTP header and the body, which is the payload.
``to_warc`` gives a record the WARC identifiers that the ARC record lacks: a
name-based UUID of URL, date, digest and key, the date in ISO form, the type and
the SHA-1 digests of payload and block in base32.

``write_arc`` makes ARC files of a table, of either version; ``convert`` turns the ARC
files of a folder into WARC files; ``read_archive`` reads these by their declared
lengths.  A file holds about ``FILE_BYTES`` of records in gzip members, or one record
if that is longer.  Files are written by Spark's text writer, a file a row, so that
they reach any store that Spark writes to and are committed once, whichever executors
are lost; a zero byte, padding in gzip, ends each.  Payloads may be any bytes.

The conversion reads the records' digests first; the decisions, a row for each file,
meet the files as they are stored.  Of records with equal payloads of ``least`` bytes
or more, the one with the largest key is a response and the others revisit it; one
without a key is always a response.  Null payloads count as empty.  Repeated rows give
repeated records.  An empty table gives an empty archive.  Extra columns are left out.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from urllib.parse import quote

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, scratch_dir
from .exact_dedup import KEY, tree_keep

# Field names of the two versions of ARC record lines.
ARC_V1 = ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"]
ARC_V2 = ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"]
END = "\r\n\r\n"
NO_DATE = "19700101000000"
FILE_BYTES = 8 << 20
KEY_FIELD = b"X-Source-Key: "


@dataclass
class ArcRecord:
    fields: dict[str, str]
    payload: bytes


def arc_line(url: str | None, length: int, date: str = NO_DATE, kind: str = "text/html", ip: str = "0.0.0.0", version: int = 1) -> str:
    """A record line; white space and control characters of the URL are escaped."""
    shown = quote(url or "unknown:", safe="".join(map(chr, range(33, 127))))
    more = ["200", "-", "-", "0", "-"] if version == 2 else []
    return " ".join([shown, ip, date, kind, *more, str(length)]) + "\n"


def arc_head(version: int = 1, name: str = "pages.arc", date: str = NO_DATE) -> bytes:
    """The version block that opens an ARC file."""
    body = f"{version} 0 corpuscle\n{' '.join(ARC_V2 if version == 2 else ARC_V1)}\n".encode()
    return arc_line(f"filedesc://{name}", len(body), date, "text/plain", version=version).encode() + body + b"\n"


def parse_arc(raw: bytes, version: int | None = None) -> Iterator[ArcRecord]:
    """The records of ARC bytes; ``version`` is needed only where no version block leads."""
    at, n = 0, len(raw)
    while at < n:
        if raw[at : at + 1] in (b"\n", b"\r"):  # blank lines stand between records
            at += 1
            continue
        end = raw.find(b"\n", at)
        if end < 0:
            raise ValueError("an ARC record line without an end")
        words = raw[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        head = words[0].startswith("filedesc://")
        if version is None and not head:
            version = 2 if len(words) >= 10 else 1
        names = (ARC_V2 if len(words) >= 10 else ARC_V1) if head else ARC_V2 if version == 2 else ARC_V1
        extra = len(words) - len(names)  # a content type may hold blanks
        if extra < 0 or not words[-1].isdigit():
            raise ValueError(f"a malformed ARC record line: {words}")
        words = [*words[:3], " ".join(words[3 : 4 + extra]), *words[4 + extra :]]
        length = int(words[-1])
        payload = raw[end + 1 : end + 1 + length]
        if len(payload) != length:
            raise ValueError("an ARC record shorter than it declares")
        at = end + 1 + length
        if head:
            version = int(payload.split(b" ", 1)[0] or b"1")
            continue
        yield ArcRecord(dict(zip(names, words, strict=True)), payload)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_date(date: str) -> str:
    """ISO form of an ARC date of 4 to 14 digits; what it lacks is the earliest."""
    digits = (date + NO_DATE[len(date) :])[:14]
    try:
        return datetime.strptime(digits, "%Y%m%d%H%M%S").replace(tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def record_id(url: str, date: str, digest: str, key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {digest} {key}')}>"


def http_message(payload: bytes, key: str) -> bytes:
    """The payload as the answer of a server, which carries the source's key."""
    return b"HTTP/1.1 200 OK\r\n" + KEY_FIELD + key.encode() + b"\r\nContent-Length: %d" % len(payload) + END.encode() + payload


def split_http(message: bytes) -> tuple[bytes, bytes]:
    """Header and body of an HTTP message; what is none is all body."""
    end = message.find(END.encode()) if message.startswith(b"HTTP/") else -1
    return (message[: end + 4], message[end + 4 :]) if end >= 0 else (b"", message)


def source_key(header: bytes) -> str:
    return next((x[len(KEY_FIELD) :].decode() for x in header.split(b"\r\n") if x.startswith(KEY_FIELD)), "")


def to_warc(arc: ArcRecord, refers_key: str | None = None) -> bytes:
    """The WARC record and its separator; a revisit, of the header alone, if ``refers_key`` names its response."""
    f = arc.fields
    header, payload = split_http(arc.payload)
    key, digest = source_key(header), payload_digest(payload)
    url, date = f["URL"], warc_date(f["Archive-date"])
    revisit = refers_key is not None
    block = header if revisit else arc.payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(url, date, digest, key)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {url}",
        f"WARC-IP-Address: {f['IP-address']}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{payload_digest(block)}",
        f"WARC-Source-Key: {key}",
        f"WARC-Source-Bytes: {len(payload)}",
        f"WARC-Identified-Payload-Type: {f['Content-type']}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Source-Key: {refers_key}"]
    lines += [f"Content-Type: {'application/http; msgtype=response' if header else f['Content-type']}", f"Content-Length: {len(block)}"]
    return b"".join(["\r\n".join(lines).encode(), END.encode(), block, END.encode()])


def parse_warc(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record, by declared lengths."""
    at = 0
    while at < len(raw):
        if raw[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = raw.find(END.encode(), at)
        lines = raw[at:end].decode().split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        at = end + 4
        block = raw[at : at + int(fields["content-length"])]
        if len(block) != int(fields["content-length"]):
            raise ValueError("a WARC record shorter than it declares")
        at += len(block)
        yield fields, block


def to_files(records: Iterator[bytes], head: bytes = b"", most: int = FILE_BYTES) -> Iterator[bytes]:
    """Records joined to gzip files of about ``most`` bytes, each led by ``head``."""
    held, size = [head], len(head)
    for r in records:
        held.append(r)
        size += len(r)
        if size >= most:
            yield gzip.compress(b"".join(held), 4, mtime=0)
            held, size = [head], len(head)
    if len(held) > 1:
        yield gzip.compress(b"".join(held), 4, mtime=0)


def write_files(rows: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[bytes]], folder: str) -> None:
    """A file for each string of bytes that ``make`` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for raw in make(batches):
            yield pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], ["value"])

    files = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))  # the bytes as they are
    files.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(folder)


def stored(raw: pa.Scalar) -> bytes:
    """A file's bytes, unpacked if they are gzip; zeros at the end are padding."""
    data = memoryview(raw.as_buffer()).cast("B")
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data.tobytes()


def write_arc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", version: int = 1) -> None:
    """ARC files of the rows; a page is the body of an HTTP message."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                for key, url, page in zip(*batch.columns, strict=True):
                    message = http_message(page.as_py() or b"", "" if key.as_py() is None else str(key.as_py()))
                    yield arc_line(url.as_py(), len(message), version=version).encode() + message + b"\n"

        return to_files(records(), arc_head(version))

    write_files(pages.select(F.col(id_col).cast("long").alias("key"), F.col(url_col).alias("url"), F.col(html_col).cast("binary").alias("html")), make, folder)


def arc_files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(folder).select(F.col("path").alias("file"), "content")


def read_arc(spark: SparkSession, folder: str) -> DataFrame:
    """file, seq, key, url, date, payload_bytes and digests of every record of the ARC files of a folder."""
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
    names = ["file", "seq", "key", "url", "date", *KEY]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for seq, arc in enumerate(parse_arc(stored(raw))):
                    header, payload = split_http(arc.payload)
                    key = source_key(header)
                    second = int.from_bytes(xxhash.xxh64_digest(payload), "big", signed=True)
                    rows.append((file, seq, int(key) if key else None, arc.fields["URL"], arc.fields["Archive-date"], hashlib.sha1(payload).digest(), len(payload), second))
                cols = list(zip(*rows, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return arc_files(spark, folder).mapInArrow(run, f"file string, seq long, key long, url string, date string, {KEY[0]} binary, {KEY[1]} long, {KEY[2]} long")


def convert(spark: SparkSession, arc_folder: str, warc_folder: str, least: int = 0) -> None:
    """Writes the records of the ARC files of a folder as WARC files."""
    records = cut(read_arc(spark, arc_folder).drop("url", "date"), "records")
    rows = tree_keep(records, "key").where((F.col(KEY[1]) >= least) & F.col("key").isNotNull() & (F.col("key") != F.col("keep_id")))
    refers = rows.groupBy("file").agg(F.collect_list(F.struct("seq", "keep_id")).alias("refers"))  # no more than a file has records
    files = arc_files(spark, arc_folder).join(refers, "file", "left").select("content", "refers")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        def converted() -> Iterator[bytes]:
            for batch in batches:
                for raw, refers in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                    to = {r["seq"]: str(r["keep_id"]) for r in refers or ()}
                    for seq, arc in enumerate(parse_arc(stored(raw))):
                        yield to_warc(arc, to.get(seq))

        return to_files(converted())

    write_files(files, make, warc_folder)


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """key, url, payload_bytes, payload_digest, record_type, refers_to, record_id, date of each record."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "date"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                rows = []
                for f, block in parse_warc(stored(raw)):
                    kind, digest = f["warc-type"], f["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and payload_digest(split_http(block)[1]) != digest:
                        raise ValueError("a payload that differs from its digest")
                    refers = f.get("warc-refers-to-source-key")
                    key = f["warc-source-key"]
                    rows.append((int(key) if key else None, f["warc-target-uri"], int(f["warc-source-bytes"]), digest, kind, int(refers) if refers else None, f["warc-record-id"], f["warc-date"]))
                cols = list(zip(*rows, strict=True)) or [()] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    raw = spark.read.format("binaryFile").load(folder).select("content")
    return raw.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, date string")


def archived_pages(pages: DataFrame, least: int = 0, version: int = 1) -> DataFrame:
    """``pages`` written to the shared folder as ARC files, converted to WARC files and read back."""
    spark, folder = pages.sparkSession, scratch_dir(pages.sparkSession)
    write_arc(pages, f"{folder}/arc", version=version)
    convert(spark, f"{folder}/arc", f"{folder}/warc", least)
    return read_archive(spark, f"{folder}/warc")
