"""Web archives: pages written as WARC records, and a reader that salvages what damaged archives still hold.

Writing finds equal payloads by one aggregate over digests: the smallest page id of a payload keeps it as a response, the
others become revisits that name it. Each task writes archives of bounded size, one gzip member (or plain record) per
page, under a name of its own until complete, so a task that runs again replaces its files.

Reading takes one archive per row. Each record is checked: member checksum, version line, header, length, closing
line ends and digests. After a failed check the reader looks for the next place where a whole member or version line passes all
checks, goes on there, and reports the bytes between as a gap. Work and memory of a task are bounded by the archive
and by its longest record.

NULL payloads count as empty, NULL addresses are left out of the record, NULL ids sort last and are read back as NULL. Of
rows that repeat the smallest id of a payload exactly one is the response. Texts may be of any length. An empty table gives no
archives, and these no records. Columns other than the three named ones are left out, so their names do not matter.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from farpoint.session import materialize, scratch_dir

# A task begins a new archive beyond this size.
ARCHIVE_BYTES = 64 << 20
READ_BYTES = 4 << 20
# Longest header that is taken for one.
HEADER_BYTES = 1 << 20
# Rows of one payload are dealt over this many keys (bits of a long) when they learn its first page.
SALTS = 64
# Tasks that read archives, at most; further archives share them.
READERS = 20_000

VERSION = b"WARC/1.1"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.\d")
_VERSION_LINE = re.compile(rb"WARC/1\.\d+")


# Writing -------------------------------------------------------------------------------------


def _bare(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _open_folder(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path behind an address that all executors reach."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "/", folder))


def _record(kind: bytes, record_id: str, fields: list[tuple[bytes, bytes]], block: bytes) -> bytes:
    head = [(b"WARC-Type", kind), (b"WARC-Record-ID", record_id.encode()), *fields]
    head += [(b"WARC-Block-Digest", b"sha1:" + _bare(hashlib.sha1(block).digest()).encode()), (b"Content-Length", b"%d" % len(block))]
    return VERSION + b"\r\n" + b"".join(b"%s: %s\r\n" % f for f in head) + b"\r\n" + block + b"\r\n\r\n"


def _page_record(page: int | None, uri: str | None, payload: bytes, digest: str, refers: int | None, revisit: bool, date: bytes) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = [(b"WARC-Date", date), (b"Content-Type", b"application/http;msgtype=response")]
    if uri is not None:
        fields.append((b"WARC-Target-URI", re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], uri.encode())))
    fields.append((b"WARC-Payload-Digest", b"sha1:" + digest.encode()))
    if revisit:
        fields += [(b"WARC-Profile", PROFILE), (b"WARC-Refers-To", _urn(refers).encode())]
    return _record(b"revisit" if revisit else b"response", _urn(page), fields, http if revisit else http + payload)


def _urn(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


class _Archives:
    """Archives of one task, each under a name of the attempt until it is complete."""

    def __init__(self, folder: str, compress: bool, limit: int, date: bytes):
        self.fs, self.path = _open_folder(folder)
        self.compress, self.limit, self.date = compress, limit, date
        self.task = TaskContext.get()
        self.number, self.out, self.done = 0, None, []

    def add(self, record: bytes) -> None:
        if self.out is None:
            name = f"part-{self.task.partitionId():06d}-{self.number:05d}.warc{'.gz' if self.compress else ''}"
            self.name, self.temporary = f"{self.path}/{name}", f"{self.path}/.{name}-{self.task.taskAttemptId()}"
            self.out, self.bytes, self.records = self.fs.open_output_stream(self.temporary, compression=None), 0, 0
            self._put(_record(b"warcinfo", f"<urn:archive:{name}>", [(b"WARC-Date", self.date), (b"Content-Type", b"application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        self._put(record)
        self.records += 1
        if self.bytes >= self.limit:
            self.close()

    def _put(self, record: bytes) -> None:
        if self.compress:
            packer = zlib.compressobj(6, zlib.DEFLATED, 31)
            record = packer.compress(record) + packer.flush()
        self.out.write(record)
        self.bytes += len(record)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temporary, self.name)
            self.done.append((self.name, self.bytes, self.records))
            self.out, self.number = None, self.number + 1


def with_first_pages(pages: DataFrame, id_column: str, uri: str, payload: str, min_bytes: int = 0) -> DataFrame:
    """Rows of record fields: id, address, payload, its digest, and for revisits the page that keeps the payload."""
    column = lambda name: F.col(f"`{name}`")
    rows = pages.select(
        column(id_column).cast("long").alias("id"),
        column(uri).cast("string").alias("uri"),
        F.coalesce(column(payload).cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumns(
        {"digest": F.sha1("payload"), "check": F.xxhash64("payload"), "salt": F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")}
    )
    payloads = (
        rows.where(F.octet_length("payload") >= min_bytes)
        .groupBy("digest", "check")
        .agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("first"), F.count("*").alias("n"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts"))
        .where("n > 1")
    )
    salts = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: F.getbit("salts", s) == 1)
    firsts = payloads.select("digest", "check", F.explode(salts).alias("salt"), F.col("first.id").alias("first"), F.lit(True).alias("shared"))
    # Rows of one id and payload have the same salt, so one of them can be told from the others here.
    order = Window.partitionBy("digest", "check", "salt").orderBy(F.col("id").asc_nulls_last())
    marked = rows.join(firsts, ["digest", "check", "salt"], "left").withColumn("_nth", F.row_number().over(order))
    keeps = F.col("id").eqNullSafe(F.col("first")) & (F.col("_nth") == 1)
    revisit = F.coalesce(F.col("shared"), F.lit(False)) & ~keeps
    return marked.select("id", "uri", "payload", "digest", F.when(revisit, F.col("first")).alias("first"), revisit.alias("revisit"))


def write_archives(
    pages: DataFrame,
    folder: str | None = None,
    id_column: str = "page_id",
    uri: str = "url",
    payload: str = "html",
    min_bytes: int = 0,
    compress: bool = True,
    archive_bytes: int = ARCHIVE_BYTES,
    date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Write one record per page and return the archives: file, bytes, records.

    ``folder`` must be reached by all executors; by default it is a new one beside the intermediate tables. Payloads of fewer
    than ``min_bytes`` bytes are always written as responses.
    """
    folder = folder or f"{scratch_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    opened, path = _open_folder(folder)
    opened.create_dir(path, recursive=True)
    stamp = date.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archives = _Archives(folder, compress, archive_bytes, stamp)
        for batch in batches:
            for row in range(batch.num_rows):
                page, address, body, digest, first, revisit = (column[row].as_py() for column in batch.columns)
                archives.add(_page_record(page, address, body, _bare(bytes.fromhex(digest)), first, revisit, stamp))
        archives.close()
        yield pa.record_batch(
            [pa.array([d[i] for d in archives.done], type=t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["file", "bytes", "records"]
        )

    rows = with_first_pages(pages, id_column, uri, payload, min_bytes)
    written = rows.mapInArrow(run, "file string, bytes long, records long")
    if "://" in folder and not folder.startswith("file:"):
        written = written.withColumn("file", F.concat(F.lit(f"{folder.split('://')[0]}://"), "file"))
    return materialize(written, "archives")


# Reading -------------------------------------------------------------------------------------


class Damage(Exception):
    """A check that failed."""


@dataclass
class Tape:
    """Random reads of a file, a few MB at a time."""

    file: object
    size: int
    start: int = 0
    held: bytes = b""

    def read(self, at: int, n: int) -> bytes:
        if not self.start <= at <= at + n <= self.start + len(self.held):
            self.file.seek(at)
            self.start, self.held = at, self.file.read(min(max(n, READ_BYTES), self.size - at))
        return self.held[at - self.start : at - self.start + n]


@dataclass
class Unpacked:
    """The same reads of bytes in memory."""

    held: bytes

    @property
    def size(self) -> int:
        return len(self.held)

    def read(self, at: int, n: int) -> bytes:
        return self.held[at : at + n]


def next_start(source: Tape | Unpacked, at: int) -> int:
    """The next place from ``at`` on that may begin a member or a record, or the end."""
    while at < source.size:
        some = source.read(at, READ_BYTES)
        found = _START.search(some)
        if found:
            return at + found.start()
        at += max(len(some) - 7, 1)
    return source.size


def _member(source: Tape, at: int) -> tuple[bytes, int]:
    """Contents and end of the gzip member at ``at``."""
    unpacker, parts, here = zlib.decompressobj(31), [], at
    try:
        while not unpacker.eof:
            some = source.read(here, min(1 << 16, source.size - here))
            if not some:
                raise Damage("member is cut off")
            parts.append(unpacker.decompress(some))
            here += len(some)
    except zlib.error as error:
        raise Damage(f"member: {error}") from None
    return b"".join(parts), here - len(unpacker.unused_data)


def _fields(head: bytes) -> dict[bytes, bytes]:
    lines = re.sub(rb"\r\n[ \t]+", b" ", head).split(b"\r\n")[1:]
    pairs = (line.partition(b":") for line in lines)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def _verify(fields: dict[bytes, bytes], name: bytes, data: bytes) -> None:
    kind, _, value = fields.get(name, b"").partition(b":")
    if kind.lower() == b"sha1" and value.upper() != _bare(hashlib.sha1(data).digest()).encode():
        raise Damage(f"{name.decode()} differs")


def read_record(source: Tape | Unpacked, at: int) -> tuple[dict, int]:
    """The record at ``at`` and its end."""
    for size in (1 << 13, 1 << 16, HEADER_BYTES):
        head, found, _ = source.read(at, min(size, source.size - at)).partition(b"\r\n\r\n")
        if found:
            break
    else:
        raise Damage("header has no end")
    if not _VERSION_LINE.fullmatch(head.split(b"\r\n", 1)[0]):
        raise Damage("no version line")
    fields = _fields(head)
    length = fields.get(b"content-length", b"")
    if not length.isdigit():
        raise Damage("no length")
    start, end = at + len(head) + 4, at + len(head) + 4 + int(length)
    if end + 4 > source.size:
        raise Damage("record is cut off")
    block = source.read(start, end - start)
    if source.read(end, 4) != b"\r\n\r\n":
        raise Damage("record does not end where it should")
    _verify(fields, b"warc-block-digest", block)
    text = lambda name: fields[name].decode("utf-8", "replace") if name in fields else None
    kind = text(b"warc-type")
    payload, size = block, len(block)
    if b"application/http" in fields.get(b"content-type", b""):
        http, _, payload = block.partition(b"\r\n\r\n")
        headers = _fields(http)
        size = len(payload)
        if kind == "revisit":
            said = headers.get(b"content-length", b"")
            payload, size = None, int(said) if said.isdigit() else None
        elif b"transfer-encoding" not in headers:
            _verify(fields, b"warc-payload-digest", payload)
    digest = text(b"warc-payload-digest")
    return {
        "record_type": kind, "record_id": text(b"warc-record-id"), "target_uri": text(b"warc-target-uri"), "date": text(b"warc-date"),
        "refers_to": text(b"warc-refers-to"), "payload_digest": digest and digest.partition(":")[2].upper(), "payload_bytes": size, "payload": payload,
    }, end + 4


def salvage(source: Tape | Unpacked) -> Iterator[dict]:
    """Sound records of an archive and the gaps between them, in order, with offset and length in bytes."""
    at, lost, reason = 0, None, ""

    def gap(end: int) -> Iterator[dict]:
        if lost is not None:
            yield {"offset": lost, "length": end - lost, "reason": reason}

    while at < source.size:
        try:
            start = source.read(at, min(5, source.size - at))
            if start[:3] == b"\x1f\x8b\x08":
                data, end = _member(source, at)
                # A sound member: its own gaps are reported by its place in the file.
                found = [{**f, "offset": at, "length": end - at} for f in salvage(Unpacked(data))]
            elif start == b"WARC/":
                record, end = read_record(source, at)
                found = [{**record, "offset": at, "length": end - at}]
            else:
                raise Damage("no member or version line")
        except Damage as damage:
            if lost is None:
                lost, reason = at, str(damage)
            at = next_start(source, at + 1)
            continue
        yield from gap(at)
        lost, at = None, end
        yield from found
    yield from gap(source.size)


_FOUND = pa.schema(
    [("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("reason", pa.string())]
    + [(c, pa.string()) for c in ("record_type", "record_id", "target_uri", "date", "refers_to", "payload_digest")]
    + [("payload_bytes", pa.int64()), ("payload", pa.binary())]
)


def list_archives(spark: SparkSession, path: str) -> DataFrame:
    """Archives under a path or pattern: file, bytes. Contents are not read."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"))


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """All sound records of the archives (column ``file``) and their gaps; a gap has a ``reason`` and no record fields.

    Without ``payloads`` the bytes are checked but not returned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                source, path = _open_folder(file)
                with source.open_input_file(path) as opened:
                    held, size = [], 0
                    for found in salvage(Tape(opened, opened.size())):
                        size += len(found.get("payload") or b"")
                        if not payloads:
                            found.pop("payload", None)
                        held.append({**found, "file": file})
                        if size >= READ_BYTES or len(held) >= 10_000:
                            yield pa.RecordBatch.from_pylist(held, schema=_FOUND)
                            held, size = [], 0
                    yield pa.RecordBatch.from_pylist(held, schema=_FOUND)

    ddl = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'binary' if f.type == pa.binary() else 'string'}" for f in _FOUND)
    readers = max(1, min(archives.count(), READERS))
    return archives.select("file").repartition(readers).mapInArrow(run, ddl)


def records(found: DataFrame) -> DataFrame:
    return found.where("reason IS NULL").drop("reason")


def gaps(found: DataFrame) -> DataFrame:
    """The quarantine log: file, offset, length and the check that failed."""
    return found.where("reason IS NOT NULL").select("file", "offset", "length", "reason")


def page_of(urn: str):
    """Page id inside a record id of this writer."""
    return F.regexp_extract(urn, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
