r"""Web archives inside ZIP files.

The writer makes one ZIP a task: gzip members of WARC records gathered into stored ZIP
members of bounded size, then a member with their index, the central directory and its ZIP64
records. Spark's text sink writes the bytes (its line feed falls between ZIP members, where
the format allows it), so files are committed as any Spark output and reach any file system.

The reader lists archives, reads the end records (ZIP64 where given) and the central
directory from the tail of each, finds stored members and the index, and reads records by
byte range. Archives without an index are scanned member by member. File systems that only
Spark reads go through the ``binaryFile`` source.

``revisits`` decides which record of equal payloads is the response.

Defined cases: a null payload is empty; rows with an equal id are records each, and the
digest gives one row for each; of equal payloads under one id all are responses or all refer to the same other one; a null id is
written as such, comes back null and refers to nothing; a null address is empty; a record longer than ``MEMBER_BYTES`` is a member of its own;
archives without records are empty; an empty table writes none; other columns are ignored. The ``binaryFile`` source reads a whole
archive, of 2 GB at most, so on file systems that Arrow does not open there are no range reads: write more, smaller archives there.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, small_slices, table

LEAST_BYTES = 1000  # payloads from which equal ones are revisited
MEMBER_BYTES = 8 << 20
SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
ARROW = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
GAP = b"\n"  # what the text sink writes after each value


def revisits(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Add ``refers_to``: the largest id with an equal payload of at least ``least`` bytes, null for that record itself."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("html"), F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).cast("long").alias("size"))
    keys = rows.select("page_id", "digest", "size").where(F.col("size") >= least)
    last = keys.groupBy("digest", "size").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = keys.join(last, ["digest", "size"]).where("page_id < last").select("page_id", "digest", F.col("last").alias("refers_to")).distinct()
    # payloads are dealt by page, never by digest: many copies of one payload do not meet in a task
    return rows.join(later, ["page_id", "digest"], "left")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    heads = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {size}"]
    if refers_to is not None:
        heads += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    heads += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(heads).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class ZipWriter:
    """Bytes of a ZIP file of stored members, value by value; ``gap`` follows each value."""

    def __init__(self, gap: bytes = GAP):
        self.at, self.gap, self.entries = 0, gap, []

    def member(self, name: str, data: bytes) -> bytes:
        crc, raw = zlib.crc32(data), name.encode()
        head = struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0x800, 0, 0, 0x21, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(raw), 20)
        out = head + raw + struct.pack("<HHQQ", 1, 16, len(data), len(data)) + data
        self.entries.append((raw, crc, len(data), self.at))
        self.at += len(out) + len(self.gap)
        return out

    def end(self) -> bytes:
        """Central directory, its ZIP64 records and the end record, whose comment is the gap."""
        out = b""
        for raw, crc, size, at in self.entries:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, at)
            out += struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0x800, 0, 0, 0x21, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(raw), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + raw + extra
        n, size, far = len(self.entries), len(out), self.at + len(out)
        out += struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, size, self.at)
        out += struct.pack("<IIQI", 0x07064B50, 0, far, 1)
        return out + struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, len(self.gap))


def _write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    archive, held, size, index, n = ZipWriter(), [], 0, [], 0
    value = lambda b: pa.RecordBatch.from_arrays([pa.array([b], pa.binary())], names=["value"])

    def flush() -> bytes:
        return archive.member(f"archive/data-{n:05}.warc.gz", b"".join(held))

    for batch in small_slices(batches, 64):
        for row in batch.to_pylist():
            data = _gzip(record(row["page_id"], row["url"], row["html"].encode("utf-8", "surrogatepass"), row["digest"], row["size"], row["refers_to"]))
            if held and size + len(data) > MEMBER_BYTES:
                yield value(flush())
                held, size, n = [], 0, n + 1
            index.append(f"{n} {size} {len(data)} {row['page_id']} {row['digest']}")
            held.append(data)
            size += len(data)
    if index:
        yield value(flush())
        yield value(archive.member("indexes/index.cdx", "\n".join(index).encode()))
        yield value(archive.end())


def write_archives(rows: DataFrame, path: str) -> None:
    """rows: ``page_id, url, html, digest, size, refers_to``; one ZIP file a partition."""
    chunks = rows.select("page_id", "url", "html", "digest", "size", "refers_to").mapInArrow(_write, "value binary")
    chunks.select(F.col("value").cast("string").alias("value")).write.option("lineSep", GAP.decode()).option("compression", "none").text(path)


class Ranges:
    """Byte ranges of a file: through Arrow's file systems, or of bytes already in hand."""

    def __init__(self, path: str, data: bytes | None = None):
        if data is not None:
            self.file, self.size = pa.BufferReader(data), len(data)
        else:
            from pyarrow import fs

            system, inner = fs.FileSystem.from_uri(quote(path, safe=":/%"))
            self.file = system.open_input_file(unquote(inner))
            self.size = self.file.size()

    def read(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at)


def directory(ranges: Ranges) -> list[tuple[str, int, int, int]]:
    """(name, method, stored bytes, offset of the local header) of each member."""
    tail = ranges.read(max(0, ranges.size - 65_557), min(ranges.size, 65_557))
    found = tail.rfind(b"PK\x05\x06")
    if found < 0:
        raise ValueError("no end record: not a ZIP file")
    n, size, at = struct.unpack("<10xHII", tail[found : found + 20])
    end = ranges.size - len(tail) + found
    locator = ranges.read(end - 20, 20) if end >= 20 else b""
    if locator[:4] == b"PK\x06\x07":
        far = struct.unpack("<8xQ4x", locator)[0]
        n, size, at = struct.unpack("<32xQQQ", ranges.read(far, 56))
    raw, out, p = ranges.read(at, size), [], 0
    for _ in range(n):
        sign, method, packed, whole, names, extras, comments, start = struct.unpack("<I6xH8xIIHHH8xI", raw[p : p + 46])
        if sign != 0x02014B50:
            raise ValueError("broken central directory")
        name = raw[p + 46 : p + 46 + names].decode()
        extra, q = raw[p + 46 + names : p + 46 + names + extras], 0
        while q + 4 <= len(extra):
            kind, length = struct.unpack("<HH", extra[q : q + 4])
            if kind == 1:  # ZIP64: only the fields that are full above, in this order
                wide = list(struct.unpack(f"<{length // 8}Q", extra[q + 4 : q + 4 + length // 8 * 8]))
                whole = wide.pop(0) if whole == 0xFFFFFFFF else whole
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                start = wide.pop(0) if start == 0xFFFFFFFF else start
            q += 4 + length
        out.append((name, method, packed, start))
        p += 46 + names + extras + comments
    return out


def data_offset(ranges: Ranges, start: int) -> int:
    names, extras = struct.unpack("<26xHH", ranges.read(start, 30))
    return start + 30 + names + extras


def records(ranges: Ranges) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of an archive: by its index where it has one, else by walking its members."""
    members = {name: (data_offset(ranges, at), size) for name, method, size, at in directory(ranges) if method == 0}
    data = sorted(n for n in members if n.startswith("archive/") and n.endswith(".warc.gz"))
    if index := members.get("indexes/index.cdx"):
        for line in ranges.read(*index).decode().split("\n"):
            n, at, size = map(int, line.split(" ")[:3])
            yield parse_record(zlib.decompress(ranges.read(members[f"archive/data-{n:05}.warc.gz"][0] + at, size), 31))
        return
    for name in data:
        at, size = members[name]
        source, raw = io.BytesIO(ranges.read(at, size)), b""
        raw = source.read()
        while raw:
            z = zlib.decompressobj(31)
            yield parse_record(z.decompress(raw))
            raw = z.unused_data


def _page(fields: dict[str, str], name: str) -> int | None:
    digits = fields.get(name, "")[len("<urn:page:") : -1]
    return int(digits) if digits else None


def _read(with_bytes: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if not row["length"]:
                    continue
                rows: list[tuple] = []
                for fields, payload in records(Ranges(row["path"], row["content"] if with_bytes else None)):
                    whole = fields["WARC-Type"] == "response"
                    size = len(payload) if whole else int(fields["WARC-Payload-Length"])
                    digest = hashlib.sha1(payload).hexdigest() if whole else fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    rows.append((_page(fields, "WARC-Record-ID"), size, digest, fields["WARC-Type"], _page(fields, "WARC-Refers-To")))
                    if len(rows) >= 5000:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every record."""
    from pyarrow import fs

    try:
        fs.FileSystem.from_uri(path)
        with_bytes = False
    except (pa.ArrowInvalid, OSError, ImportError):
        with_bytes = True
    files = spark.read.format("binaryFile").load(path).select("path", "length", *(["content"] if with_bytes else []))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (files if with_bytes else files.repartition(parts)).mapInArrow(_read(with_bytes), SCHEMA)


def round_trip(pages: DataFrame) -> DataFrame:
    path = fresh_path(pages.sparkSession, "op2-archives")
    write_archives(revisits(pages), path)
    return read_archives(pages.sparkSession, path)


def op2_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table("pages")(spark, sf_dir))


SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
l AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
FROM l
"""
