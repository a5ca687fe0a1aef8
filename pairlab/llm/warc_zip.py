"""WARC records in ZIP packages: a writer, and a reader that range-reads
records without extracting anything.

A package (one for each written partition) is a ZIP file with two stored,
uncompressed members: ``archive/data.warc.gz``, one gzip member a record, and
``indexes/index.cdxj``, one line a record with its offset and length in the
archive member. The reader finds the central directory from the end of the
file (through the ZIP64 records where they are used), takes the members' places
from it and then reads byte ranges only.

Files are reached through file-system URIs (file:, hdfs:, s3:, gs:); a package
is written under a name of its own for each task attempt, and the manifest that
the successful attempts return says which packages count."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from pairlab.llm.storage import scratch_folder, stored

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Records of one package at most; a partition goes on in the next package.
PACKAGE_RECORDS = 50_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RANGE_BYTES = 4 << 20
#: ZIP signatures and the size of the fixed part of each structure.
END, END64_LOCATOR, END64, CENTRAL, LOCAL = b"PK\5\6", b"PK\6\7", b"PK\6\6", b"PK\1\2", b"PK\3\4"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_kinds(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, digest, first): of records with equal payloads of at least
    ``min_bytes`` bytes, ``first`` is the least page_id; null for shorter ones.
    One row for each distinct (page_id, digest)."""
    firsts = pages.where(F.col("payload_bytes") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"))
    return pages.select("page_id", "digest").distinct().join(firsts, "digest", "left")


# -- records

def _line(name: str, value: object) -> bytes:
    text = str(value).replace("\r", "%0D").replace("\n", "%0A")
    return f"{name}: {text}\r\n".encode("utf-8", "surrogatepass")


def record(page_id, url: str | None, payload: bytes, payload_digest: str, first) -> bytes:
    """A response record, or a revisit record (HTTP headers only) where
    ``first`` names another page."""
    revisit = first is not None and first != page_id
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + _line("Content-Length", len(payload))
    block = http + b"\r\n" + (b"" if revisit else payload)
    head = b"WARC/1.1\r\n" + _line("WARC-Type", "revisit" if revisit else "response")
    head += _line("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>")
    head += _line("WARC-Target-URI", url or f"urn:page:{page_id}") + _line("WARC-Date", DATE)
    head += _line("X-Page-ID", json.dumps(page_id)) + _line("WARC-Payload-Digest", f"sha1:{payload_digest}")
    if revisit:
        head += _line("WARC-Profile", PROFILE) + _line("X-Refers-To-Page-ID", json.dumps(first))
        head += _line("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{first}')}>")
    head += _line("Content-Type", "application/http; msgtype=response") + _line("Content-Length", len(block))
    return head + b"\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a record."""
    def headers(data: bytes) -> dict[str, str]:
        lines = data.decode("utf-8", "surrogatepass").split("\r\n")[1:]
        return {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}

    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = headers(head)
    block = rest[:int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, headers(http), payload


# -- writing

class _Sink:
    """What zipfile needs of a file that is only written forward."""

    def __init__(self, stream):
        self.stream = stream

    def write(self, data) -> int:
        self.stream.write(data)
        return len(data)

    def flush(self) -> None:
        self.stream.flush()


def write_package(uri: str, records: Iterator[tuple[object, bytes]]) -> int:
    """Write (page id, record) pairs as one package; the number of records."""
    system, path = fs.FileSystem.from_uri(uri)
    index, at = [], 0
    with system.open_output_stream(path) as stream, zipfile.ZipFile(_Sink(stream), "w", zipfile.ZIP_STORED) as z:
        with z.open(ARCHIVE, "w", force_zip64=True) as member:
            for page_id, raw in records:
                packed = gzip.compress(raw, 4, mtime=0)
                member.write(packed)
                index.append(json.dumps({"page_id": page_id, "offset": at, "length": len(packed)}))
                at += len(packed)
        z.writestr(INDEX, "".join(line + "\n" for line in index))
    return len(index)


def write_packages(pages: DataFrame, folder: str) -> DataFrame:
    """Write rows (page_id, url, payload, digest, first) as packages into
    ``folder``, each partition on its own; rows (package, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ([c[k].as_py() for c in b.columns] for b in batches for k in range(b.num_rows))
        context = TaskContext.get()
        row = next(rows, None)
        part = 0
        while row is not None:
            name = f"{folder}/part-{context.partitionId():06d}-{part:04d}-{context.taskAttemptId()}.zip"

            def records() -> Iterator[tuple[object, bytes]]:
                nonlocal row
                for _ in range(PACKAGE_RECORDS):
                    page_id, url, payload, payload_digest, first = row
                    yield page_id, record(page_id, url, payload or b"", payload_digest, first)
                    row = next(rows, None)
                    if row is None:
                        return

            n = write_package(name, records())
            part += 1
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["package", "records"])

    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    return pages.select("page_id", "url", "payload", "digest", "first").mapInArrow(run, "package string, records long")


# -- reading

def members(f, size: int) -> dict[str, tuple[int, int]]:
    """(offset of the data, length) of each stored member of a ZIP file, read
    from its end: end record, ZIP64 locator and end record if there, central
    directory, and each member's local header for where its data begin."""
    def read(at: int, n: int) -> bytes:
        f.seek(at)
        return f.read(n)

    tail_at = max(0, size - 22 - FULL16)  # a comment of 64 KB at most follows the end record
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(END)
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no ZIP end record")
    entries, length, begin = struct.unpack_from("<HII", tail, at + 10)
    if FULL16 == entries or FULL32 in (length, begin):
        locator = read(tail_at + at - 20, 20)
        if locator[:4] != END64_LOCATOR:
            raise ValueError("no ZIP64 locator")
        end64 = read(struct.unpack_from("<Q", locator, 8)[0], 56)
        if end64[:4] != END64:
            raise ValueError("no ZIP64 end record")
        entries, length, begin = struct.unpack_from("<QQQ", end64, 32)
    directory, out, at = read(begin, length), {}, 0
    for _ in range(entries):
        if directory[at:at + 4] != CENTRAL:
            raise ValueError("broken central directory")
        method, = struct.unpack_from("<H", directory, at + 10)
        packed, full, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, at + 20)
        place, = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46:at + 46 + n_name].decode()
        extra, k = directory[at + 46 + n_name:at + 46 + n_name + n_extra], 0
        while k + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, k)
            if tag == 1:  # ZIP64: only the fields that are full in the entry, in this order
                wide = list(struct.unpack_from(f"<{n // 8}Q", extra, k + 4))
                full = wide.pop(0) if full == FULL32 else full
                packed = wide.pop(0) if packed == FULL32 else packed
                place = wide.pop(0) if place == FULL32 else place
            k += 4 + n
        if method == 0:
            local = read(place, 30)
            if local[:4] != LOCAL:
                raise ValueError("broken local header")
            out[name] = place + 30 + sum(struct.unpack_from("<HH", local, 26)), packed
        at += 46 + n_name + n_extra + n_comment
    return out


def read_records(uri: str) -> Iterator[bytes]:
    """The records of a package by its index, in ranges of a few MB."""
    system, path = fs.FileSystem.from_uri(uri)
    size = system.get_file_info(path).size
    with system.open_input_file(path) as f:
        places = members(f, size)
        at, n = places[INDEX]
        f.seek(at)
        lines = [json.loads(x) for x in f.read(n).decode().splitlines()]
        begin, _ = places[ARCHIVE]
        k = 0
        while k < len(lines):
            low, last = lines[k]["offset"], k
            while last + 1 < len(lines) and lines[last + 1]["offset"] + lines[last + 1]["length"] - low <= RANGE_BYTES:
                last += 1
            f.seek(begin + low)
            data = f.read(lines[last]["offset"] + lines[last]["length"] - low)
            for x in lines[k:last + 1]:
                yield zlib.decompress(data[x["offset"] - low:x["offset"] - low + x["length"]], 31)
            k = last + 1


def read_packages(manifest: DataFrame, id_type: T.DataType) -> DataFrame:
    """The records of the packages in ``manifest``, one task a package at
    most: page_id, url, payload_bytes (of the full payload), payload_digest,
    record_type, refers_to, payload (null for revisits). Ids may be of any
    integer type or strings. A response whose payload does not have its digest
    is an error."""
    schema = T.StructType([
        T.StructField("page_id", id_type), T.StructField("url", T.StringType()),
        T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()), T.StructField("refers_to", id_type),
        T.StructField("payload", T.BinaryType())])
    id_arrow = to_arrow_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            kinds = [id_arrow, pa.string(), pa.int64(), pa.string(), pa.string(), id_arrow, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                              names=schema.names)

        rows, held = [], 0
        for b in batches:
            for uri in b.column(0):
                for raw in read_records(uri.as_py()):
                    warc, http, payload = parse_record(raw)
                    kind = warc["warc-type"]
                    said = warc["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and digest(payload) != said:
                        raise ValueError(f"{uri}: payload digest of {warc['warc-record-id']} differs")
                    refers = json.loads(warc["x-refers-to-page-id"]) if kind == "revisit" else None
                    rows.append((json.loads(warc["x-page-id"]), warc["warc-target-uri"], int(http["content-length"]), said,
                                 kind, refers, payload if kind == "response" else None))
                    held += len(payload)
                    if held > RANGE_BYTES or len(rows) >= 5000:
                        yield batch(rows)
                        rows, held = [], 0
        if rows:
            yield batch(rows)

    packages = manifest.select("package")
    return packages.repartitionByRange(max(1, packages.count()), "package").mapInArrow(run, schema)


def archive_pages(spark: SparkSession, pages: DataFrame, min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write one record for each row of ``pages`` (page_id, url, html) into
    packages under ``folder`` (default: shared scratch) and return the
    manifest. Of equal payloads (null html: empty) the row with the least
    page_id is the response, the others revisit it; rows that share that least
    id and payload are all responses, and so are rows without an id whose
    payload no row with an id has. Texts are not collected by payload: only
    (page_id, digest) pairs are, and the html meets its decision by page_id."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"),
                        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn(
        "digest", _base32(F.sha1("payload")))
    kinds = record_kinds(rows, min_bytes).toDF("kind_digest", "kind_id", "first")
    marked = rows.join(kinds, rows["page_id"].eqNullSafe(kinds["kind_id"]) & (rows["digest"] == kinds["kind_digest"]))
    return stored(write_packages(marked, folder or scratch_folder(spark, "warc")), "warc-manifest")


def _base32(hexed: F.Column) -> F.Column:
    """Upper-case base32 of 40 hex digits: each five of them are four letters."""
    groups = [F.lpad(F.lower(F.conv(F.substring(hexed, k, 5), 16, 32)), 4, "0") for k in range(1, 41, 5)]
    return F.translate(F.concat(*groups), "0123456789abcdefghijklmnopqrstuv", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
