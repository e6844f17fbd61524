"""WARC archives: a writer with revisit records, and a reader that salvages what it can.

Writing: the first page (smallest page_id) of each payload gets a response record, the others revisit records that name
it; payloads smaller than MIN_PAYLOAD are always responses. First pages are found by a grouped minimum of digests, and
joined back by digest (the rows of a hot payload are dealt over parts). Each task writes archives of up to
ARCHIVE_BYTES, one gzip member for a record, into a folder of the shared store, under the name of its attempt first, and
renames them when whole; a task that runs again writes the same records. What was written is listed in a stored table,
so nothing is written twice, and reading starts from that list.

Reading: archives are streamed in blocks, member by member. A member whose checks fail (header, deflate stream, CRC,
length, record syntax, block or payload digest) is left: the reader searches for the next gzip magic that begins a valid
member, or in plain archives for the next version line that begins a valid record, goes on from there, and logs the gap
(archive, offset, length, reason) as quarantined. Memory holds one record, as long as its header says, and a block at a
time; a record is called broken as soon as its bytes are there and do not fit. A header is HEADER bytes long at most.

Nulls: a null html is the empty payload; a null url is an empty target. A null page_id is written and read as null; it
is chosen as first only where all page_ids of a payload are null, and then no revisit is made. Rows that share the first
page_id and the payload are all responses. Extra columns are ignored.
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
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ready
from .common import join_by_class, new_path, stored

ARCHIVE_BYTES, BLOCK, MIN_PAYLOAD, HEADER = 64 << 20, 1 << 20, 0, 1 << 16
#: Fixed values of the WARC 1.1 format.
VERSION, REVISIT_PROFILE = b"WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
MAGIC = b"\x1f\x8b\x08"
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _one_line(text: str | None) -> str:
    return re.sub(r"[\r\n]", "", text or "")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as written; a revisit has the payload's digest and length but not the payload."""
    digest = digest_of(payload)
    block = b"" if refers_to is not None else payload
    name = lambda k: f"<urn:uuid:{uuid.uuid5(NAMES, str(k))}>"
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", _one_line(url)),
        ("Content-Type", "text/html; charset=utf-8"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{digest_of(block)}"),
        ("X-Page-ID", "" if page_id is None else str(page_id)), ("X-Payload-Length", str(len(payload))),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", name(refers_to)), ("X-Refers-To-Page", str(refers_to))]
    fields.append(("Content-Length", str(len(block))))
    head = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"
    return head + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


@dataclass
class Parsed:
    fields: dict[str, str]
    block: bytes
    end: int  # offset behind the record


class Broken(ValueError):
    pass


class Short(Broken):
    """The data end before the record does."""


def parse(data: bytes | bytearray, at: int = 0, whole: bool = False) -> Parsed:
    """The record that begins at ``at``; Broken if it isn't valid, Short if ``data`` may go on. ``whole``: data is known to
    hold all of it."""
    if not re.match(rb"WARC/1\.[01]\r\n", data[at : at + 10]):
        raise (Short if len(data) - at < 10 else Broken)("no version line")
    stop = data.find(b"\r\n\r\n", at, at + HEADER)
    if stop < 0:
        raise (Short if len(data) - at < HEADER else Broken)("header without end")
    fields = {}
    for line in bytes(data[at + 10 : stop]).split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or not name:
            raise Broken("bad header line")
        fields[name.decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    if not (length := fields.get("content-length", "")).isascii() or not length.isdigit() or len(length) > 18:
        raise Broken("no length")
    end = stop + 4 + int(length) + 4
    if end > len(data):
        raise Short("wrong length")
    if data[end - 4 : end] != b"\r\n\r\n" or whole and end != len(data):
        raise Broken("wrong length")
    block = bytes(data[stop + 4 : end - 4])
    for kind in ("block", "payload"):
        said = fields.get(f"warc-{kind}-digest", "")
        if said.startswith("sha1:") and (kind == "block" or fields.get("warc-type") == "response" and fields.get("content-type", "").startswith("text/html")) and said[5:] != digest_of(block):
            raise Broken(f"{kind} digest differs")
    return Parsed(fields, block, end)


class Source:
    """A window over a stream: ``data`` from ``at`` on is not used up yet; ``at`` lies at offset ``base`` of the stream."""

    def __init__(self, stream):
        self.stream, self.data, self.at, self.base, self.ended = stream, bytearray(), 0, 0, False

    def __len__(self) -> int:
        return len(self.data) - self.at

    def more(self) -> bool:
        got = b"" if self.ended else self.stream.read(BLOCK)
        self.ended = not got
        if 2 * self.at > len(self.data):  # what is used up goes once it is the larger part
            del self.data[: self.at]
            self.at = 0
        self.data += got
        return bool(got)

    def drop(self, n: int) -> None:
        self.at += n
        self.base += n


def _inflate(source: Source) -> tuple[bytes, int]:
    """The member at the window's begin, unpacked, and its length; Broken if a check fails."""
    unpacker, out, fed = zlib.decompressobj(31), [], 0
    try:
        while not unpacker.eof:
            if fed == len(source) and not source.more():
                raise Broken("member without end")
            part = bytes(source.data[source.at + fed : source.at + fed + BLOCK])
            out.append(unpacker.decompress(part))
            fed += len(part)
    except zlib.error as e:
        raise Broken(f"member: {e}"[:60]) from None
    return b"".join(out), fed - len(unpacker.unused_data)


def _begins_record(source: Source, ahead: int) -> bool:
    """Whether the member ``ahead`` bytes on unpacks to a version line; looks at its first bytes only."""
    try:
        return zlib.decompressobj(31).decompress(bytes(source.data[source.at + ahead : source.at + ahead + 4096]), 16).startswith(b"WARC/1.")
    except zlib.error:
        return False


def _next_record(source: Source) -> tuple[Parsed, int]:
    """The record at the window's begin, and the bytes that it takes there."""
    if source.data.startswith(MAGIC, source.at):
        data, size = _inflate(source)
        return parse(data, whole=True), size
    while True:
        try:
            found = parse(source.data, source.at)
            return found, found.end - source.at
        except Short:
            if not source.more():
                raise


def salvage(stream, lost: list[tuple[int, int, str]]) -> Iterator[Parsed]:
    """Every valid record of an archive, gzipped by record or plain; gaps (offset, length, reason) go to ``lost``."""
    source = Source(stream)
    gap_at, reason = None, ""
    while True:
        while len(source) < 16 and source.more():
            pass
        if not len(source):
            break
        try:
            found, size = _next_record(source)
        except Broken as e:
            if gap_at is None:
                gap_at, reason = source.base, str(e)
            _seek(source)
            continue
        if gap_at is not None:
            lost.append((gap_at, source.base - gap_at, reason))
            gap_at = None
        source.drop(size)
        yield found
    if gap_at is not None:
        lost.append((gap_at, source.base - gap_at, reason))


BEGINS = re.compile(re.escape(MAGIC) + rb"|WARC/1\.[01]\r\n")


def _seek(source: Source) -> None:
    """Moves on to the next place, one byte on or later, where a member or a record seems to begin."""
    source.drop(1)
    while True:
        while m := BEGINS.search(source.data, source.at):
            source.drop(m.start() - source.at)
            if m[0][:4] == b"WARC":
                return
            m = None  # a match holds the window, which could not grow then
            while len(source) < 4096 and source.more():
                pass
            if _begins_record(source, 0):
                return
            source.drop(1)
        if len(source) > 16:  # a place may begin in the last bytes
            source.drop(len(source) - 16)
        if not source.more():
            source.drop(len(source))
            return


def _filesystem(path: str):
    """The file system of a path or uri and the path within it."""
    from pyarrow import fs

    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


def with_first(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, refers_to): refers_to is the first page of an equal payload, null for responses."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html")).withColumn("digest", F.unhex(F.sha1(html.cast("binary"))))
    first = stored(narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")), "first-pages")
    again = (F.col("page_id") != F.col("first")) | (F.col("page_id").isNull() & F.col("first").isNotNull())
    return join_by_class(narrow, first, "digest", F.xxhash64("page_id", "url")).select("page_id", "url", "html", F.when(again & (F.octet_length("html") >= MIN_PAYLOAD), F.col("first")).alias("refers_to"))


def write(pages: DataFrame, folder: str, packed: bool = True) -> DataFrame:
    """Writes the archives of ``pages`` (page_id, url, html) into ``folder``; stored rows (path, n_records, n_bytes)."""
    ready(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        store, root = _filesystem(folder)
        store.create_dir(root, recursive=True)
        done: list[tuple[str, int, int]] = []
        stream, names, n, size = None, ("", ""), 0, 0

        def close() -> None:
            stream.close()
            store.move(*names)
            done.append((f"{folder}/{names[1].rsplit('/', 1)[1]}", n, size))

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if stream is None:
                    name = f"{context.partitionId():06d}-{len(done):04d}.warc" + ".gz" * packed
                    # the last attempt's file takes the place of an earlier one's
                    names = (f"{root}/.{name}.{context.taskAttemptId()}", f"{root}/{name}")
                    stream, n, size = store.open_output_stream(names[0], compression=None), 0, 0
                data = record(page_id, url, html.encode(), refers_to)
                data = member(data) if packed else data
                stream.write(data)
                n, size = n + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    close()
                    stream = None
        if stream is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "n_records", "n_bytes"])

    return stored(with_first(pages).mapInArrow(run, "path string, n_records long, n_bytes long"), "archives")


SCHEMA = "path string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, html binary, gap_offset long, gap_bytes long, gap_reason string"


def read(spark: SparkSession, archives: DataFrame, payload: bool = True) -> DataFrame:
    """Records and gaps of the archives named in column ``path``. A row is either a record or a quarantined gap (with
    gap_offset); html is the payload of responses, or null without ``payload``."""

    ready(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string()]
        names = [p.split(" ")[0] for p in SCHEMA.split(", ")]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, inner = _filesystem(path)
                rows, held, lost = [], 0, []
                with store.open_input_stream(inner, compression=None) as stream:
                    for found in salvage(stream, lost):
                        f = found.fields
                        number = lambda k: int(f[k]) if re.fullmatch(r"-?\d+", f.get(k, "")) else None  # noqa: B023, E731
                        size = number("x-payload-length")
                        rows.append((path, number("x-page-id"), f.get("warc-target-uri"), f.get("warc-type"), len(found.block) if size is None else size, f.get("warc-payload-digest", "").removeprefix("sha1:"), number("x-refers-to-page"), found.block if payload and f.get("warc-type") == "response" else None, None, None, None))
                        held += len(found.block) + 500
                        if held > 4 << 20:
                            yield pack(rows)
                            rows, held = [], 0
                yield pack(rows + [(path, *[None] * 7, *gap) for gap in lost])

    # an archive is a unit of work: one partition for each few of them
    n = max(1, archives.count())
    paths = archives.select("path").repartition(min(n, 10_000), F.col("path"))
    return paths.mapInArrow(run, SCHEMA)


def op5_warc(pages: DataFrame) -> DataFrame:
    """Writes the archives of ``pages``, reads them back and returns the contract's rows."""
    spark = pages.sparkSession
    archives = write(pages, new_path(spark, "warc"))
    return read(spark, archives, payload=False).where(F.col("gap_offset").isNull()).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
