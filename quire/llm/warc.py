"""WARC records in ZIP-packaged archives: writer, and a reader without extraction.

An archive is a ZIP of stored members: ``archive/data.warc.gz`` with the
records, each a gzip member of its own, ``indexes/index.cdxj`` with one line
per record (target, date, offset, length, digest) and ``datapackage.json``. Each writing task
fills archives of bounded size in the session's shared folder and returns a
manifest row per finished archive; files of failed attempts are in no
manifest. The manifest is a written table, so archives are written once.

The reader parses the end-of-central-directory record (ZIP64 locator and
record included), the central directory (ZIP64 extra fields included) and the
local headers to find where stored members lie, reads the index member, cuts
the records into byte ranges, deals the ranges to tasks, and reads and parses
each range. Nothing is unpacked and no task needs a whole archive.

Files go through ``pyarrow.fs``, so the folder may be local (shared), HDFS or
an object store.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.llm.common import id_key, id_of, table
from quire.session import checkpoint_root, cut_lineage

MIN_REVISIT = 100          # bytes; smaller payloads are always stored
GZIP_LEVEL = 1
ARCHIVE_BYTES = 64 << 20   # bytes of records after which a task starts the next archive
ARCHIVE_RECORDS = 50_000
RANGE_BYTES = 4 << 20      # bytes of records per read
DATE = "1970-01-01T00:00:00Z"  # pages have no crawl date
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_fs(uri: str):
    """(filesystem, path) of a folder or file, from a URI or an absolute path."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


# -- records -------------------------------------------------------------------

def page_uri(page_id: int | None) -> str:
    return f"urn:page:{'null' if page_id is None else page_id}"


def page_of(uri: str | None) -> int | None:
    name = (uri or "").strip("<>").rpartition(":")[2]
    return int(name) if name.lstrip("-").isdigit() else None


def target(url: str | None, page_id: int | None) -> str:
    """The URL as one header-safe word; pages without one get their page URI."""
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~-._") if url else page_uri(page_id)


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One response record, or a revisit whose block is the HTTP header only;
    the header's Content-Length is that of the full payload in both."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <{page_uri(page_id)}>", f"WARC-Target-URI: {target(url, page_id)}", f"WARC-Date: {DATE}",
            f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{page_uri(refers_to)}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def parse_record(raw: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url); a
    response's payload is measured and hashed, and must match its digest."""
    end = raw.index(b"\r\n\r\n")
    head = _headers(raw[:end])
    block = raw[end + 4:end + 4 + int(head["content-length"])]
    at = block.index(b"\r\n\r\n")
    stated = head["warc-payload-digest"].partition(":")[2]
    if head["warc-type"] == "revisit":
        size, digest = int(_headers(block[:at])["content-length"]), stated
    else:
        payload = memoryview(block)[at + 4:]
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
        if digest != stated:
            raise ValueError(f"payload of {head['warc-record-id']} does not match its digest")
    return (page_of(head["warc-record-id"]), size, digest, head["warc-type"], page_of(head.get("warc-refers-to")),
            head["warc-target-uri"])


# -- ZIP reader ------------------------------------------------------------------

def read_at(f, start: int, length: int) -> bytes:
    f.seek(start)
    data = f.read(length)
    if len(data) != length:
        raise ValueError("the archive is shorter than its directory says")
    return data


def directory(f, size: int) -> dict[str, tuple[int, int]]:
    """Stored members of a ZIP: name -> (first byte of the data, length)."""
    tail = read_at(f, max(0, size - 65_557), min(size, 65_557))  # 22 bytes and the longest comment
    end = tail.rfind(b"PK\5\6", 0, max(0, len(tail) - 18))
    while end >= 0 and struct.unpack_from("<H", tail, end + 20)[0] != len(tail) - end - 22:
        end = tail.rfind(b"PK\5\6", 0, end)
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if (count, length, start) != (0, 0, 0) and (count == 0xFFFF or 0xFFFFFFFF in (length, start)):
        where = size - len(tail) + end - 20
        sig, _, at, _ = struct.unpack("<4sIQI", read_at(f, where, 20))
        if sig != b"PK\6\7":
            raise ValueError("no ZIP64 locator")
        sig, count, length, start = struct.unpack("<4s20x8xQQQ", read_at(f, at, 56))
        if sig != b"PK\6\6":
            raise ValueError("no ZIP64 end of central directory")
    listing, at, out = read_at(f, start, length), 0, {}
    for _ in range(count):
        (sig, flags, method, packed, plain, n_name, n_extra, n_note, local) = struct.unpack_from(
            "<4s4xHH8xIIHHH8xI", listing, at)
        if sig != b"PK\1\2":
            raise ValueError("broken central directory")
        name = listing[at + 46:at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = listing[at + 46 + n_name:at + 46 + n_name + n_extra]
        plain, packed, local = _zip64(extra, plain, packed, local)
        if method == 0:
            sig, names, extras = struct.unpack("<4s22xHH", read_at(f, local, 30))
            if sig != b"PK\3\4":
                raise ValueError("broken local header")
            out[name] = (local + 30 + names + extras, plain)
        at += 46 + n_name + n_extra + n_note
    return out


def _zip64(extra: bytes, *values: int) -> list[int]:
    """Values of the central directory, those at 2**32 - 1 from the ZIP64 field."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
            return [next(wide) if v == 0xFFFFFFFF else v for v in values]
        at += 4 + n
    return list(values)


# -- Spark -----------------------------------------------------------------------

class _Archive:
    """One archive being written; the index is kept until it is closed, the
    records are not."""

    def __init__(self, root: str):
        self.path = f"{root}/{uuid.uuid4().hex}.wacz"
        fs, path = open_fs(self.path)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = fs.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.index, self.at = io.StringIO(), 0
        self.records = 0

    def add(self, page_id, url, payload, digest, refers_to):
        raw = gzip.compress(record(page_id, url, payload, digest, refers_to), GZIP_LEVEL, mtime=0)
        self.data.write(raw)
        entry = {"offset": self.at, "length": len(raw), "digest": f"sha256:{digest}"}
        self.index.write(f"{target(url, page_id)} 19700101000000 {json.dumps(entry)}\n")
        self.at += len(raw)
        self.records += 1

    def close(self):
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), self.index.getvalue())
        self.zip.writestr(zipfile.ZipInfo("datapackage.json"), json.dumps(
            {"profile": "data-package", "resources": [{"name": "data", "path": DATA}, {"name": "index", "path": INDEX}]}))
        self.zip.close()
        self.out.close()
        return self.path, self.records, self.at


def _write(root: str):
    def run(batches):
        archive = None

        def closed():
            path, records, size = archive.close()
            return pa.RecordBatch.from_pydict({"path": [path], "records": [records], "bytes": [size]})

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                archive = archive or _Archive(root)
                archive.add(*row)
                if archive.at >= ARCHIVE_BYTES or archive.records >= ARCHIVE_RECORDS:
                    yield closed()
                    archive = None
        if archive:
            yield closed()
    return run


def with_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): of equal payloads of at
    least ``min_bytes``, all but the smallest page_id refer to it."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"),
                        id_key("page_id").alias("id"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    # Small payloads get a key of their own page: they never revisit.
    key = F.when(F.octet_length("payload") >= min_bytes, F.col("digest")).otherwise(
        F.concat(F.lit("page "), F.col("id").cast("string")))
    slim = (pages.select(id_key("page_id").alias("id"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("p"))
            .where(F.octet_length("p") >= min_bytes)
            .groupBy(F.sha2("p", 256).alias("key")).agg(F.min("id").alias("first"), F.max("id").alias("last"))
            .where("first < last").select("key", "first"))
    return (rows.withColumn("key", key).join(slim, "key", "left")
            .select("page_id", "url", "payload", "digest", F.when(F.col("id") > F.col("first"), F.col("first")).alias("refers_to")))


def write_archives(pages: DataFrame, root: str | None = None) -> DataFrame:
    """Writes all pages; the manifest (path, records, bytes), one row per archive."""
    root = root or f"{checkpoint_root(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return cut_lineage(with_revisits(pages).mapInArrow(_write(root), "path string, records long, bytes long"),
                       "warc-manifest")


def _ranges(batches):
    """Archives -> byte ranges of whole records, from directory and index."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            fs, name = open_fs(path)
            with fs.open_input_file(name) as f:
                members = directory(f, f.size())
                base, _ = members[DATA]
                lines = read_at(f, *members[INDEX]).decode().splitlines()
            out, start, sizes = [], None, []
            for entry in (json.loads(x.split(" ", 2)[2]) for x in lines):
                if start is None:
                    start = base + entry["offset"]
                sizes.append(entry["length"])
                if sum(sizes) >= RANGE_BYTES:
                    out.append((start, sizes))
                    start, sizes = None, []
            if sizes:
                out.append((start, sizes))
            yield pa.RecordBatch.from_arrays(
                [pa.array([path] * len(out), pa.string()), pa.array([s for s, _ in out], pa.int64()),
                 pa.array([n for _, n in out], pa.list_(pa.int64()))], names=["path", "start", "lengths"])


_PARSED = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def _parse(batches):
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])
    for batch in batches:
        for path, start, lengths in zip(*(c.to_pylist() for c in batch.columns)):
            fs, name = open_fs(path)
            rows = []
            with fs.open_input_file(name) as f:
                data, at = read_at(f, start, sum(lengths)), 0
            for n in lengths:
                rows.append(parse_record(gzip.decompress(data[at:at + n])))
                at += n
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


def read_archives(manifest: DataFrame) -> DataFrame:
    """Every record of the archives listed in ``manifest`` (column path)."""
    ranges = cut_lineage(manifest.select("path").mapInArrow(_ranges, "path string, start long, lengths array<long>"),
                         "warc-ranges")
    spark: SparkSession = manifest.sparkSession
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return ranges.repartition(tasks, "path", "start").mapInArrow(_parse, _PARSED)


def round_trip(pages: DataFrame) -> DataFrame:
    """Records of ``pages`` (page_id, url, html) after writing and reading back.

    A null html is an empty payload; a null page_id counts as the largest; a
    null url is replaced by the page's URI. Rows that repeat a page_id and its
    payload are records of their own, and of one type. An empty table gives
    no archive and no rows. Other columns are ignored.
    """
    return read_archives(write_archives(pages))


def op8(spark, sf_dir):
    null = id_of(F.col("refers_to"))
    return round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", null.alias("refers_to"))


OP8_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest AS d, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON d = payload_digest AND payload_bytes >= 100
"""
