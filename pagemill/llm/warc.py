"""WARC records in ZIP packages, read back by ranges.

Writing: each partition packs its records into packages of about PACKAGE_BYTES.
A package is a ZIP file in the shared folder whose members are stored, not
deflated: ``archive/data.warc.gz`` (one gzip member a record),
``indexes/index.cdx`` (a line a record: page id, type, digest, offset, length),
and ZIP64 structures where sizes ask for them.  A table names the files of the
tasks that came through, so what a lost executor left behind is never read.
Where the folder is on a store that pyarrow can't open, packages are cells of
that table instead.

Reading: a package is seen through ``read(offset, length)`` alone, ranges of
its file.  The reader finds the end record, follows the ZIP64 locator if there
is one, walks the central directory, locates the stored members by their local
headers, and range-reads the index and then each record.  Nothing is extracted,
and no package is ever whole in memory.

Of records with equal payloads of REVISIT_BYTES or more the smallest page_id
is the response, the others are revisits without a payload block, naming it.
Rows that repeat that smallest id with the same payload are responses too.  A
null html is an empty payload; a null page_id can be a response but is never
chosen as the one referred to unless it stands alone.  A payload of any length
that a Spark string holds is one record.  An empty table gives no packages and
no records; columns besides page_id, url and html don't matter, whatever they
are called.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, table, text_or_empty, written

PACKAGE_BYTES = 4 << 20
#: Bytes of packages that a reading task gets, about.
TASK_BYTES = 32 << 20
REVISIT_BYTES = 100

# ZIP signatures and field layouts (PKWARE APPNOTE 6.3).
_LOCAL, _CENTRAL, _END, _END64, _LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
_LOCAL_F, _CENTRAL_F, _END_F, _END64_F, _LOCATOR64_F = "<4s5H3I2H", "<4s6H3I5H2I", "<4s4H2IH", "<4sQ2H2I4Q", "<4sIQI"
_FULL16, _FULL32 = 0xFFFF, 0xFFFFFFFF

Read = Callable[[int, int], bytes]


def zip_package(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP of stored members; zip64 forces the 64-bit structures that large files need."""
    body, central = [], []
    at = 0
    for name, data in members:
        raw, crc, n = name.encode(), zlib.crc32(data), len(data)
        wide = zip64 or n >= _FULL32 or at >= _FULL32
        local_extra = struct.pack("<2H2Q", 1, 16, n, n) if wide else b""
        central_extra = struct.pack("<2H3Q", 1, 24, n, n, at) if wide else b""
        size, where, version = (_FULL32, _FULL32, 45) if wide else (n, at, 20)
        head = struct.pack(_LOCAL_F, _LOCAL, version, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(local_extra)) + raw + local_extra
        central.append(struct.pack(_CENTRAL_F, _CENTRAL, version, version, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(central_extra), 0, 0, 0, 0, where) + raw + central_extra)
        body += [head, data]
        at += len(head) + n
    directory = b"".join(central)
    wide = zip64 or at >= _FULL32 or len(members) >= _FULL16
    tail = b""
    if wide:
        tail = struct.pack(_END64_F, _END64, 44, 45, 45, 0, 0, len(members), len(members), len(directory), at) + struct.pack(_LOCATOR64_F, _LOCATOR64, 0, at + len(directory), 1)
    count = _FULL16 if wide else len(members)
    return b"".join([*body, directory, tail, struct.pack(_END_F, _END, 0, 0, count, count, _FULL32 if wide else len(directory), _FULL32 if wide else at, 0)])


def zip_members(read: Read, size: int) -> dict[str, tuple[int, int]]:
    """name -> (offset of its bytes, length) of each stored member, from the directories alone."""
    back = min(size, 22 + 0xFFFF + 20)
    tail = read(size - back, back)
    i = tail.rfind(_END)
    # the signature may also stand in a comment: the right one's comment ends with the file
    while i >= 0 and (i + 22 > len(tail) or i + 22 + struct.unpack_from("<H", tail, i + 20)[0] != len(tail)):
        i = tail.rfind(_END, 0, i)
    if i < 0:
        raise ValueError("no end of central directory")
    _, _, _, _, count, length, start, _ = struct.unpack_from(_END_F, tail, i)
    if (count == _FULL16 or length == _FULL32 or start == _FULL32) and i >= 20 and tail[i - 20 : i - 16] == _LOCATOR64:
        where = struct.unpack_from(_LOCATOR64_F, tail, i - 20)[2]
        end = struct.unpack(_END64_F, read(where, 56))
        if end[0] != _END64:
            raise ValueError("no ZIP64 end record")
        count, length, start = end[7:10]
    directory, at, found = read(start, length), 0, {}
    for _ in range(count):
        f = struct.unpack_from(_CENTRAL_F, directory, at)
        if f[0] != _CENTRAL:
            raise ValueError("broken central directory")
        method, packed, plain, n_name, n_extra, n_note, where = f[4], f[8], f[9], f[10], f[11], f[12], f[16]
        name = directory[at + 46 : at + 46 + n_name].decode()
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            tag, n = struct.unpack_from("<2H", extra)
            if tag == 1:
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                plain = next(wide) if plain == _FULL32 else plain
                packed = next(wide) if packed == _FULL32 else packed
                where = next(wide) if where == _FULL32 else where
            extra = extra[4 + n :]
        if method == 0:
            head = struct.unpack(_LOCAL_F, read(where, 30))
            found[name] = (where + 30 + head[9] + head[10], packed)
        at += 46 + n_name + n_extra + n_note
    return found


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has the full payload's digest and length but no block."""
    block = payload if refers_to is None else b""
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}:{digest}')}>", f"WARC-Payload-Digest: sha256:{digest}", f"X-Page-Id: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}"]
    head += [f"WARC-Target-URI: {' '.join((url or '').split())}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Page: {refers_to}"]
    head += [f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("record of a wrong length")
    return fields, rest[:n]


def package_records(read: Read, size: int) -> Iterator[tuple[dict[str, str], bytes]]:
    members = zip_members(read, size)
    data = members["archive/data.warc.gz"][0]
    at, n = members["indexes/index.cdx"]
    for line in read(at, n).decode().splitlines():
        _, offset, length = line.split(" ")
        yield parsed(zlib.decompress(read(data + int(offset), int(length)), 31))


def write_packages(pages: DataFrame) -> DataFrame:
    """page_id, url, html in; (package, size, content) out, a row a package; content only where the package is no file."""
    payload = text_or_empty("html").cast("binary")
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    # only ids and digests of repeated payloads are grouped; the payloads cross one shuffle, by page_id
    small = keyed.where(F.length("payload") >= REVISIT_BYTES).select("page_id", F.unhex(F.sha2("payload", 256)).alias("digest"))
    first = small.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    revisits = small.join(first, "digest").where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()
    marked = keyed.withColumn("digest", F.unhex(F.sha2("payload", 256))).join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "payload", "refers_to")

    folder = scratch(pages.sparkSession, "warc-files")
    by_file = files_of(folder) is not None

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, index, at = [], [], 0

        def package() -> pa.RecordBatch:
            content = zip_package([("archive/data.warc.gz", b"".join(records)), ("indexes/index.cdx", "\n".join(index).encode())])
            name = f"{folder}/{uuid.uuid4().hex}.zip"
            if by_file:
                store, path = files_of(name)
                store.create_dir(path.rpartition("/")[0], recursive=True)
                with store.open_output_stream(path) as f:
                    f.write(content)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(content)], pa.int64()), pa.array([None if by_file else content], pa.binary())], ["package", "size", "content"])

        for batch in batches:
            for row in zip(*(c for c in batch.columns), strict=True):
                page_id, url, payload, refers_to = (x.as_py() for x in row)
                digest = hashlib.sha256(payload).hexdigest()
                squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
                raw = squeeze.compress(record(page_id, url, payload, digest, refers_to)) + squeeze.flush()
                records.append(raw)
                index.append(f"{page_id} {at} {len(raw)}")
                at += len(raw)
                if at >= PACKAGE_BYTES:
                    yield package()
                    records, index, at = [], [], 0
        if records:
            yield package()

    return written(marked.mapInArrow(pack, "package string, size long, content binary"), "warc")


def files_of(path: str) -> tuple[fs.FileSystem, str] | None:
    """(file system, path there) of a path of Spark's, None if pyarrow has no such file system."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    try:
        return fs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return None


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, block binary"


def read_packages(packages: DataFrame, blocks: bool = True) -> DataFrame:
    """The records of packages; block is the stored payload (null for a revisit or if not asked for)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, size, content in zip(*(batch.column(c) for c in ("package", "size", "content")), strict=True):
                if content.is_valid:
                    source = pa.BufferReader(content.as_buffer())
                else:
                    store, path = files_of(name.as_py())
                    source = store.open_input_file(path)
                rows = []
                for f, block in package_records(lambda at, n, s=source: s.read_at(n, at), size.as_py()):
                    kind, digest, n = f["WARC-Type"], f["WARC-Payload-Digest"].removeprefix("sha256:"), int(f["X-Payload-Length"])
                    if kind == "response":  # both figures are taken from what is stored
                        digest, n = hashlib.sha256(block).hexdigest(), len(block)
                    rows.append((int(f["X-Page-Id"]) if f["X-Page-Id"] else None, n, digest, kind, int(f["WARC-Refers-To-Page"]) if kind == "revisit" else None, block if blocks and kind == "response" else None))
                source.close()
                columns = list(zip(*rows, strict=True)) or [[]] * 6
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in _READ.split(", ")])

    # the table of names is small, what they name isn't: tasks by bytes
    total = packages.agg(F.sum("size")).first()[0] or 0
    n = min(100_000, max(packages.sparkSession.sparkContext.defaultParallelism, total // TASK_BYTES))
    return packages.select("package", "size", "content").repartition(n).mapInArrow(run, _READ)


def op8_warc(spark, sf_dir: str) -> DataFrame:
    return read_packages(write_packages(table(spark, sf_dir, "pages")), blocks=False).drop("block")


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
     f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN f.first_id IS NULL OR f.first_id = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.first_id <> d.page_id THEN f.first_id END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest AND d.payload_bytes >= 100
"""
