"""Legacy web archives (ARC, versions 1 and 2) converted to WARC, and both read as streams.

1. ``write_arc`` writes records under the header line of the chosen version, ``read_arc`` reads such files: the
   version block at the head of a file names the fields of its header lines, and the declared length, not any
   separator, says where a record ends.
2. ``convert`` gives every record its WARC type, an identifier made from its place in the archives, an ISO
   timestamp and SHA-1 digests. Of records with equal payloads (SHA-256) of at least ``LEAST`` bytes the last in a
   given order is the response, and the others become revisits without payload. Payload texts never
   meet in one group: only digests are grouped, and a payload that very many records share is broadcast.
3. ``write_warc`` and ``read_warc`` write the records and read them again, payload digests checked.

Files go through Spark's own text source and sink, gzip-compressed as a whole, so every store that Spark reaches
will do. The sink's line end is the record's end; the reader hands over lines, of which the parser takes as many
bytes as declared, one record at a time. Compressed files are never split; ``whole=True`` reads plain files.

Results: a null payload is empty; equal rows are records of their own, of equal order values the one later in
the archives is the response; null keys and addresses stay null, blanks and control characters in them are
percent-encoded. Header lines that do not parse are passed over. A record that ends before its declared length is
marked truncated. The last line of a file may lack its line end. No records give no files and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sensorloom.llm.common import bounded_batches, join_back
from sensorloom.session import materialize

#: Payloads below this many bytes are never revisits.
LEAST = 1000
#: Bytes of records that the parsers hand on at once.
OUT_BYTES = 1 << 20
KEY_FIELD = "X-Record-Key"
AGENT = "sensorloom"

# Fixed values of the two formats: fields of an ARC header line by version, and the revisit profile of WARC.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_ARC_ROW = "file long, offset long, version int, key string, url string, ip string, date string, mime string, http binary, payload binary, truncated boolean"
_WARC_ROW = "file long, type string, record_id string, refers_to_id string, key string, url string, date string, mime string, payload binary, payload_bytes long, payload_digest string, digest_ok boolean, truncated boolean"


class Feed:
    """Lines and byte ranges of one file that comes in chunks."""

    def __init__(self, chunks: Iterable[bytes]):
        self.chunks, self.held, self.at, self.place = iter(chunks), b"", 0, 0

    def _more(self) -> bool:
        chunk = next(self.chunks, None)
        if chunk is None:
            return False
        self.held, self.at = self.held[self.at :] + chunk, 0
        return True

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the file."""
        end = self.held.find(b"\n", self.at)
        while end < 0:
            known = len(self.held) - self.at
            if not self._more():
                rest, self.at = self.held[self.at :], len(self.held)
                self.place += len(rest)
                return rest or None
            end = self.held.find(b"\n", known)
        found, self.place, self.at = self.held[self.at : end], self.place + end + 1 - self.at, end + 1
        return found

    def take(self, size: int) -> bytes:
        """The next ``size`` bytes, fewer at the end of the file."""
        parts, missing = [], size
        while True:
            part = self.held[self.at : self.at + missing]
            parts.append(part)
            self.at, self.place, missing = self.at + len(part), self.place + len(part), missing - len(part)
            if not missing or not self._more():
                return b"".join(parts)


def _http_parts(block: bytes) -> tuple[bytes, bytes]:
    """The header of an HTTP response with its blank line, and the payload; no header, if it is none."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    blank = re.search(rb"\r\n\r\n|\n\n", block)
    cut = blank.end() if blank else len(block)
    return block[:cut], block[cut:]


def _http_field(header: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*(.*?)[ \t]*\r?$", header)
    return found.group(1).decode("utf-8", "replace") if found else None


def _escaped(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7F]", lambda m: f"%{ord(m.group()):02X}", value)


def _address(url: str | None) -> str:
    return _escaped(url) if url else "-"


def _text(value: bytes) -> str | None:
    return None if value == b"-" else value.decode("utf-8", "replace")


# --- ARC ----------------------------------------------------------------------------------------


def arc_head(version: int, date: str, name: str = "records.arc") -> bytes:
    """The version block at the head of a file, without the line end that follows it."""
    body = f"{version} 0 {AGENT}\n{ARC_FIELDS[version]}\n\n"
    more = "" if version == 1 else f"200 - - 0 {name} "
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {more}{len(body)}\n{body}".encode()


def arc_record(version: int, key: str | None, url: str | None, date: str, payload: bytes) -> bytes:
    named = "" if key is None else f"{KEY_FIELD}: {_escaped(key)}\r\n"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{named}Content-Length: {len(payload)}\r\n\r\n".encode()
    more = "" if version == 1 else f"200 {hashlib.md5(payload).hexdigest()} - 0 records.arc "
    head = f"{_address(url)} 0.0.0.0 {date} text/html {more}{len(http) + len(payload)}\n"
    return head.encode() + http + payload


def write_arc(df: DataFrame, path: str, version: int = 1, *, key_col: str, url_col: str, payload_col: str, date: str = "20240101000000") -> None:
    """One archive record a row, as captured at ``date`` (14 digits)."""
    bounded_batches(df.sparkSession)
    rows = df.select(F.col(f"`{key_col}`").cast("string"), F.col(f"`{url_col}`").cast("string"), F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b"")))

    def run(batches: Iterator[pa.RecordBatch]):
        first = [arc_head(version, date)]
        for batch in filter(len, batches):
            made = [arc_record(version, k, u, date, p) for k, u, p in zip(*(batch.column(i).to_pylist() for i in range(3)))]
            yield pa.RecordBatch.from_arrays([pa.array(first + made, pa.binary())], names=["value"])
            first = []

    _write(rows.mapInArrow(run, "value binary"), path, "\n")


def _write(records: DataFrame, path: str, end: str) -> None:
    """One file a task, each record followed by ``end``; the fastest gzip level, as archives are read soon."""
    records.select(F.col("value").cast("string")).write.option("lineSep", end).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def _streams(spark: SparkSession, paths: list[str], whole: bool, parse, schema: str) -> DataFrame:
    """``parse(feed)`` over every file; its tuples become rows after the file's number."""
    bounded_batches(spark)
    lines = spark.read.text(paths, wholetext=whole, lineSep=None if whole else "\n").select(F.xxhash64(F.col("_metadata.file_path")).alias("file"), F.col("value").cast("binary"))
    end = b"" if whole else b"\n"
    kinds = pa.schema([(f.split()[0], {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}[f.split()[1]]) for f in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]):
        rows = ((f, v) for b in batches for f, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        held: list[tuple] = []
        size = 0
        for file, chunks in groupby(rows, key=lambda r: r[0]):
            for row in parse(Feed(v + end for _, v in chunks)):
                held.append((file, *row))
                size += 200 + sum(len(v) for v in row if isinstance(v, bytes))
                if size > OUT_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds.types)], schema=kinds)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds.types)], schema=kinds)

    return lines.mapInArrow(run, schema)


def parse_arc(feed: Feed) -> Iterator[tuple]:
    """Records of one file, its version block aside: all of ``_ARC_ROW`` but the file."""
    version, fields = 1, ARC_FIELDS[1].split()
    while True:
        offset, line = feed.place, feed.line()
        if line is None:
            return
        parts = line.rstrip(b"\r").rsplit(b" ", len(fields) - 1)
        head = line.startswith(b"filedesc://")
        if head and not offset:
            parts = line.rstrip(b"\r").split(b" ")
        if len(parts) < 5 or (len(parts) != len(fields) and (offset or not head)) or not parts[-1].isdigit() or not re.fullmatch(rb"\d{12}(\d\d)?", parts[2]):
            continue
        block = feed.take(int(parts[-1]))
        if head and not offset:
            told = block.split(b"\n")
            version = int(told[0].split(b" ")[0]) if told[0][:1].isdigit() else 1
            fields = told[1].decode("utf-8", "replace").split() if len(told) > 1 and told[1].strip() else ARC_FIELDS.get(version, ARC_FIELDS[1]).split()
            continue
        http, payload = _http_parts(block)
        date = parts[2].decode().ljust(14, "0")
        short = len(block) < int(parts[-1])
        yield offset, version, _http_field(http, KEY_FIELD), _text(parts[0]), _text(parts[1]), date, _text(parts[3]), http, payload, short


def read_arc(spark: SparkSession, paths: list[str], whole: bool = False) -> DataFrame:
    """The records of ARC files with their place (``file``, ``offset``), HTTP header and payload."""
    return _streams(spark, paths, whole, parse_arc, _ARC_ROW)


# --- WARC ---------------------------------------------------------------------------------------


def record_id(file: int, offset: int) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{file}:{offset}'.encode()).digest()[:16], version=5)}>"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _warc(kind: str, fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *[f"{name}: {value}" for name, value in fields if value is not None], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def warc_record(file: int, offset: int, url: str | None, ip: str | None, date: str, mime: str | None, http: bytes, payload: bytes, truncated: bool, response: tuple[int, int] | None) -> bytes:
    """A record as WARC; with ``response``, the place of another record, as a revisit of that one."""
    kind = "revisit" if response else "response" if http else "resource"
    block = http if response else http + payload
    stamp = f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"
    fields = [
        ("WARC-Record-ID", record_id(file, offset)),
        ("WARC-Date", stamp),
        ("WARC-Target-URI", url),
        ("WARC-IP-Address", ip if ip != "0.0.0.0" else None),
        ("WARC-Profile", REVISIT_PROFILE if response else None),
        ("WARC-Refers-To", record_id(*response) if response else None),
        ("WARC-Payload-Digest", _sha1(payload)),
        ("WARC-Block-Digest", _sha1(block)),
        ("WARC-Truncated", "length" if truncated or response and payload else None),
        ("Content-Type", "application/http; msgtype=response" if http else mime or "application/octet-stream"),
    ]
    return _warc(kind, fields, block)


def convert(spark: SparkSession, paths: list[str], path: str, order: Column, least: int = LEAST, whole: bool = False) -> None:
    """Write the ARC files ``paths`` as WARC to ``path``; ``order`` (over ``read_arc``) decides which equal payload stays."""
    place = F.struct(order.alias("o"), "file", "offset")
    strong = F.sha2("payload", 256).alias("same")
    long = read_arc(spark, paths, whole).filter(F.octet_length("payload") >= least)
    index = materialize(long.select("file", "offset", place.alias("place"), strong), "arc-index")
    groups = materialize(index.groupBy("same").agg(F.max("place").alias("last"), F.count(F.lit(1)).alias("m")).filter("m > 1"), "arc-equal")
    shared = join_back(index, groups, ["same"], "m", index.count())
    revisits = shared.filter("place <> last").select("file", "offset", F.col("last.file").alias("to_file"), F.col("last.offset").alias("to_offset"))
    # A shuffle between the parser and the writer keeps them in tasks, and so in Python workers, of their own.
    records = read_arc(spark, paths, whole).hint("merge").join(materialize(revisits, "arc-revisits"), ["file", "offset"], "left")
    columns = ("file", "offset", "url", "ip", "date", "mime", "http", "payload", "truncated", "to_file", "to_offset")

    def run(batches: Iterator[pa.RecordBatch]):
        first = [_warc("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("Content-Type", "application/warc-fields")], f"software: {AGENT}\r\nformat: WARC File Format 1.1\r\n".encode())]
        for batch in filter(len, batches):
            made = [warc_record(*row[:9], None if row[9] is None else row[9:]) for row in zip(*(batch.column(i).to_pylist() for i in range(11)))]
            yield pa.RecordBatch.from_arrays([pa.array(first + made, pa.binary())], names=["value"])
            first = []

    _write(records.select(*columns).mapInArrow(run, "value binary"), path, "\r\n\r\n")


def parse_warc(feed: Feed) -> Iterator[tuple]:
    """Records of one file: all of ``_WARC_ROW`` but the file."""
    while (line := feed.line()) is not None:
        if not line.startswith(b"WARC/"):
            continue
        fields: dict[str, str] = {}
        while (line := feed.line()) is not None and (line := line.rstrip(b"\r")):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        if not fields.get("content-length", "").isdigit():
            continue
        block = feed.take(int(fields["content-length"]))
        kind = fields.get("warc-type", "")
        http, payload = _http_parts(block) if fields.get("content-type", "").startswith("application/http") else (b"", block)
        declared = fields.get("warc-payload-digest", "")
        told = base64.b32decode(declared[5:]).hex() if re.fullmatch(r"sha1:[A-Z2-7]{32}", declared) else None
        if kind == "revisit":
            size = _http_field(http, "Content-Length")
            of_payload = (None, int(size) if size and size.isdigit() else None, told, None)
        else:
            digest = hashlib.sha1(payload).hexdigest()
            of_payload = (payload, len(payload), digest, None if told is None else told == digest)
        short = len(block) < int(fields["content-length"]) or (kind != "revisit" and "warc-truncated" in fields)
        yield (kind, fields.get("warc-record-id"), fields.get("warc-refers-to"), _http_field(http, KEY_FIELD), fields.get("warc-target-uri"), fields.get("warc-date"), fields.get("content-type"), *of_payload, short)


def read_warc(spark: SparkSession, paths: list[str], whole: bool = False) -> DataFrame:
    """The records of WARC files. Revisits have no payload, but the size and digest of the full one.

    ``digest_ok``: the payload has the declared digest; null where either is missing.
    """
    return _streams(spark, paths, whole, parse_warc, _WARC_ROW)


def with_targets(records: DataFrame) -> DataFrame:
    """``records`` (all but their payloads) with ``refers_to``, the key of the record that a revisit names."""
    rows = materialize(records.drop("payload"), "warc-rows")
    known = rows.filter("type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("key").alias("refers_to"))
    revisits = rows.filter("type = 'revisit'").withColumn("refers_to_id", F.coalesce("refers_to_id", F.lit("")))
    counts = revisits.groupBy("refers_to_id").agg(F.count(F.lit(1)).alias("m"))
    targets = materialize(counts.join(known, "refers_to_id", "left"), "warc-targets")
    named = join_back(revisits, targets, ["refers_to_id"], "m", revisits.count())
    return named.unionByName(rows.filter("type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("string")))
