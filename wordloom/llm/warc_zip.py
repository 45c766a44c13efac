"""WARC records in ZIP packages: written by tasks, found through central directories, read by byte ranges.

A package holds ``archive/data.warc.gz`` and ``indexes/index.cdx``, both *stored*, so that a record's place in the
package is the member's place plus the record's offset in the index. Readers parse the end record, the ZIP64 end record
and locator, the central directory with its ZIP64 fields, and the member's local header; then they read the index, and
ranges of neighbouring records. No member is ever extracted. Records are gzip members of their own.

Files are reached through ``pyarrow.fs`` in the tasks, so any shared store that has a URI will do. A package is written
under a name of its attempt and renamed when whole: a task that is tried again replaces it.

Defined results: a null payload is empty; equal payloads of at least ``least_bytes`` bytes are one response (the largest
id) and revisits of it; of rows alike in id, url and payload, one is the response and the others revisit it; an empty table gives no packages and no records; a null id is written as an empty id, is the smallest, and reads back null.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import tune, work_dir, written

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdx"

#: Compressed bytes of an archive member after which a new package begins; bytes read at once.
PACKAGE_BYTES, RANGE_BYTES = 128 << 20, 4 << 20

#: A WARC extension field: the length of the payload that a revisit refers to.
LENGTH_FIELD = "X-Payload-Length"

SALTS = 1024


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit has no block; its fields name the payload that it repeats."""
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"),
        (LENGTH_FIELD, str(len(payload))),
        ("Content-Type", "text/html; charset=utf-8"),
    ]
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{'' if refers_to is None else refers_to}>")]
    block = payload if kind == "response" else b""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))]) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


class PackageWriter:
    """Packages of one task. ``stream(name)`` opens a file to write, ``done(name)`` puts it in place."""

    def __init__(self, stream: Callable[[str], io.RawIOBase], done: Callable[[str], None], name: str, zip64: bool = False):
        self.stream, self.done, self.name, self.zip64 = stream, done, name, zip64
        self.number = 0
        self.zip: zipfile.ZipFile | None = None

    def add(self, page_id: int | None, data: bytes) -> None:
        if self.zip is None:
            self.out = self.stream(f"{self.name}-{self.number:05d}.wacz")
            self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
            self.member = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)
            self.index: list[str] = []
            self.at = 0
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        packed = packer.compress(data) + packer.flush()
        self.member.write(packed)
        self.index.append(f"{'' if page_id is None else page_id} {self.at} {len(packed)}\n")
        self.at += len(packed)
        if self.at >= PACKAGE_BYTES:
            self.close()

    def close(self) -> None:
        if self.zip is not None:
            self.member.close()
            with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=self.zip64) as f:
                f.write("".join(self.index).encode())
            self.zip.close()
            self.out.close()
            self.done(f"{self.name}-{self.number:05d}.wacz")
            self.number += 1
            self.zip = None


class Members:
    """The stored members of a ZIP package, from its central directory. ``read(at, n)`` reads a range of the file."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read = read
        tail_at = max(0, size - 65_557)
        tail = read(tail_at, size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        if end < 0:
            raise ValueError("not a ZIP package: no end record")
        count, length, start = struct.unpack("<HII", tail[end + 10 : end + 20])
        if (count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF) and end + tail_at >= 20:
            locator = read(tail_at + end - 20, 20)
            if locator[:4] == b"PK\x06\x07":
                (at,) = struct.unpack("<Q", locator[8:16])
                if (wide := read(at, 56))[:4] != b"PK\x06\x06":
                    raise ValueError("ZIP64 locator without an end record")
                count, length, start = struct.unpack("<QQQ", wide[32:56])
        self.entries: dict[str, tuple[int, int, int]] = {}
        directory, at = read(start, length), 0
        for _ in range(count):
            if directory[at : at + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            method, packed, whole, names, extras, comment = *struct.unpack("<H", directory[at + 10 : at + 12]), *struct.unpack("<IIHHH", directory[at + 20 : at + 34])
            (header,) = struct.unpack("<I", directory[at + 42 : at + 46])
            name = directory[at + 46 : at + 46 + names].decode("utf-8", "replace")
            extra = directory[at + 46 + names : at + 46 + names + extras]
            while len(extra) >= 4:
                kind, n = struct.unpack("<HH", extra[:4])
                if kind == 1:  # those of the three that don't fit above, in this order
                    wide_ = iter(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                    whole = next(wide_) if whole == 0xFFFFFFFF else whole
                    packed = next(wide_) if packed == 0xFFFFFFFF else packed
                    header = next(wide_) if header == 0xFFFFFFFF else header
                extra = extra[4 + n :]
            self.entries[name] = (method, header, packed)
            at += 46 + names + extras + comment

    def place(self, name: str) -> tuple[int, int]:
        """Where a stored member's bytes begin in the package, and how many they are."""
        method, header, size = self.entries[name]
        if method != 0:
            raise ValueError(f"{name} is compressed as a whole; only stored members can be read by ranges")
        local = self.read(header, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError(f"no local header for {name}")
        names, extras = struct.unpack("<HH", local[26:30])
        return header + 30 + names + extras, size


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _of_largest(pages: DataFrame, key: Column, id_: str) -> DataFrame:
    """``pages`` with ``lead``, true of the one row of largest (id, row hash) among rows of equal key, and ``first``, its id.

    Two steps over salted keys, so that a payload of a third of all pages is spread over many tasks. Rows that are the same in
    all columns can't be told apart: where such rows are the largest, one of them stands for all and is then repeated.
    """
    salted = pages.withColumns({"_key": key, "_salt": F.pmod(F.xxhash64(id_), F.lit(SALTS))})
    parts = salted.groupBy("_key", "_salt", F.col(id_).alias("id"), F.col("_row").alias("row")).agg(F.count("*").alias("n"))
    parts = written(parts.groupBy("_key", "_salt").agg(F.max(F.struct("id", "row", "n")).alias("m")), "payload-parts")
    spread = parts.select("_key", "_salt").join(parts.groupBy("_key").agg(F.max("m").alias("_m")), "_key")
    largest = F.col(id_).eqNullSafe(F.col("_m.id")) & (F.col("_row") == F.col("_m.row"))
    rows = salted.join(spread, ["_key", "_salt"]).withColumns({"lead": largest, "first": F.col("_m.id")})
    if not parts.filter("m.n > 1").isEmpty():
        same = F.col("lead") & (F.col("_m.n") > 1)
        one = rows.filter(same).dropDuplicates(["_key"]).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_m.n"))))
        rows = rows.filter(~same).unionByName(one.withColumn("lead", F.col("_copy") == 1).drop("_copy"))
    return rows.drop("_key", "_salt", "_m")


def write_packages(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Writes page_id, url and html of ``pages`` as WARC records in packages under the URI ``path``."""
    spark = pages.sparkSession
    tune(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    # a row's hash tells rows of equal id apart; small payloads get keys of their own
    rows = rows.withColumn("_row", F.xxhash64("page_id", "url", "payload"))
    own = F.concat_ws("/", F.lit(""), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), "_row")
    rows = _of_largest(rows, F.concat(F.sha2("payload", 256), F.when(F.octet_length("payload") < least_bytes, own).otherwise("")), "page_id")
    rows = rows.select("page_id", "url", "payload", "lead", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = _filesystem(path)
        filesystem.create_dir(base, recursive=True)
        context = TaskContext.get()
        attempt = f".{context.taskAttemptId()}-"
        made: list[str] = []

        def done(name: str) -> None:
            filesystem.move(f"{base}/{attempt}{name}", f"{base}/{name}")
            made.append(name)

        writer = PackageWriter(lambda name: filesystem.open_output_stream(f"{base}/{attempt}{name}"), done, f"part-{context.partitionId():05d}")
        for b in batches:
            for page_id, url, payload, lead, first in zip(*[b.column(c).to_pylist() for c in ("page_id", "url", "payload", "lead", "first")], strict=True):
                writer.add(page_id, record(page_id, url, payload, "response" if lead else "revisit", None if lead else first))
        writer.close()
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], ["name"])

    names = rows.mapInArrow(run, "name string")
    names.write.parquet(f"{path}/manifest")


def _reader(filesystem, name: str) -> tuple[Callable[[int, int], bytes], int, object]:
    f = filesystem.open_input_file(name)

    def read(at: int, n: int) -> bytes:
        f.seek(at)
        return f.read(n)

    return read, f.size(), f


def record_ranges(spark: SparkSession, path: str) -> DataFrame:
    """(name, at, size, lengths): ranges of neighbouring records of all packages, by their directories and indexes."""
    names = spark.read.parquet(f"{path}/manifest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = _filesystem(path)
        for b in batches:
            for name in b.column("name").to_pylist():
                read, size, f = _reader(filesystem, f"{base}/{name}")
                members = Members(read, size)
                start, _ = members.place(ARCHIVE)
                rows = [[int(x) for x in line.rsplit(" ", 2)[1:]] for line in read(*members.place(INDEX)).decode().splitlines()]
                f.close()
                at, lengths = 0, []
                out: list[tuple[int, list[int]]] = []
                for offset, n in rows:
                    if lengths and sum(lengths) + n > RANGE_BYTES:
                        out.append((start + at, lengths))
                        lengths = []
                    if not lengths:
                        at = offset
                    lengths.append(n)
                if lengths:
                    out.append((start + at, lengths))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(out)), pa.array([a for a, _ in out], pa.int64()), pa.array([x for _, x in out], pa.list_(pa.int64()))], ["name", "at", "lengths"])

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return names.repartition(tasks).mapInArrow(run, "name string, at long, lengths array<bigint>")


RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read_packages(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Every record of the packages under ``path``. Responses are held against their digest; revisits carry no payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = _filesystem(path)
        for b in batches:
            for name, at, lengths in zip(*[b.column(c).to_pylist() for c in ("name", "at", "lengths")], strict=True):
                read, _, f = _reader(filesystem, f"{base}/{name}")
                data, rows, offset = read(at, sum(lengths)), [], 0
                f.close()
                for n in lengths:
                    fields, block = parse_record(zlib.decompress(data[offset : offset + n], 31))
                    offset += n
                    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
                    if kind == "response" and (payload_digest(block) != digest or len(block) != int(fields[LENGTH_FIELD])):
                        raise ValueError(f"{name}: a record's payload differs from its digest")
                    ids = [x if x is None else (int(x[10:-1]) if x[10:-1] else None) for x in (fields["WARC-Record-ID"], fields.get("WARC-Refers-To"))]
                    rows.append((ids[0], fields["WARC-Target-URI"], kind, ids[1], int(fields[LENGTH_FIELD]), digest, block if with_payload and kind == "response" else None))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])

    ranges = written(record_ranges(spark, path), "record-ranges")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartition(tasks).mapInArrow(run, RECORD)


def archived(pages: DataFrame) -> DataFrame:
    """Writes packages of all pages and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    path = work_dir(pages.sparkSession, "packages")
    write_packages(pages, path)
    return read_packages(pages.sparkSession, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
