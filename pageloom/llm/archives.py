"""Legacy ARC archives and their conversion to WARC.

ARC: a version block (``filedesc://``), then records of one header line, whose
fields depend on the version, and as many bytes as the line declares.
WARC: named headers, a block, and for equal payloads ``revisit`` records that
point to the one ``response``.  Both are gzipped record by record.

Work is dealt out by archive: a task streams one archive after another and holds
one record.  Which record of equal payloads is the response is settled by an
aggregate over an index without payloads; decisions then go to the task of their
archive, so payloads are never exchanged.  Archives are written under a temporary
name and renamed, so a repeated task replaces its file.

Identifiers, types and digests are functions of the records alone.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import table
from pageloom.skew import checkpoint, shared_folder

# -- fixed values of the two formats
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset",
        "Filename", "Archive-length"),
}
WARC_VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:arc-record")
FIRST_DATE = datetime(2000, 1, 1)
#: an archive is closed after this many bytes
ARCHIVE_BYTES = 16 << 20
#: partitions of archives, at most
MOST_TASKS = 100_000
READ_BYTES = 1 << 18


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    if folder.startswith("file:"):
        folder = "file:///" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder)


def _member(data: bytes) -> bytes:
    """One gzip member."""
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Writer:
    """Archives of one task: ``<folder>/<stem>-<n>.gz``, renamed when whole."""

    def __init__(self, folder: str, stem: str, head: Callable[[str], bytes]):
        self.fs, self.root = _open(folder)
        self.stem, self.head, self.n, self.out = stem, head, 0, None
        self.fs.create_dir(self.root, recursive=True)

    def write(self, record: bytes) -> tuple[str, int]:
        """(archive, offset) of the record."""
        if self.out is None:
            self.name = f"{self.stem}-{self.n:05d}.gz"
            self.part = f"{self.root}/.{self.name}.{TaskContext.get().taskAttemptId()}"
            self.out, self.size = self.fs.open_output_stream(self.part, compression=None), 0
            self._put(_member(self.head(self.name)))
        at = self.size
        self._put(_member(record))
        name = self.name
        if self.size >= ARCHIVE_BYTES:
            self.close()
        return name, at

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.part, f"{self.root}/{self.name}")
            self.out, self.n = None, self.n + 1


def members(folder: str, name: str) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of every gzip member of an archive."""
    filesystem, root = _open(folder)
    with filesystem.open_input_stream(f"{root}/{name}", compression=None) as source:
        at, start, pending = 0, 0, b""
        z, parts = zlib.decompressobj(31), []
        while True:
            data = pending or source.read(READ_BYTES)
            if not data:
                break
            parts.append(z.decompress(data))
            pending = z.unused_data
            at += len(data) - len(pending)
            if z.eof:
                yield start, b"".join(parts)
                start, z, parts = at, zlib.decompressobj(31), []


# ---------------------------------------------------------------------------
# ARC
# ---------------------------------------------------------------------------

def _field(value: str | None) -> str:
    """A header field: no spaces or controls, never empty."""
    text = "".join(f"%{b:02X}" if b <= 0x20 or b == 0x7F else chr(b) for b in (value or "").encode("ascii", "backslashreplace"))
    return text or "-"


def arc_head(version: int, name: str) -> bytes:
    body = f"{version} 0 archive\n{' '.join(ARC_FIELDS[version])}\n".encode()
    fixed = "0 0 0 0 0 0" if version == 2 else ""
    middle = "200 - - 0 " + _field(name) + " " if fixed else ""
    return f"filedesc://{name} 0.0.0.0 {FIRST_DATE:%Y%m%d%H%M%S} text/plain {middle}{len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, url: str | None, date: str, block: bytes, name: str = "-", offset: int = 0) -> bytes:
    fields = [_field(url), "0.0.0.0", date, "text/html"]
    if version == 2:
        fields += ["200", hashlib.md5(block).hexdigest(), "-", str(offset), _field(name)]
    return " ".join([*fields, str(len(block))]).encode() + b"\n" + block + b"\n"


def parse_arc(records: Iterator[tuple[int, bytes]]) -> Iterator[dict]:
    """Records after the version block: its fields by name, plus offset and block."""
    names: tuple[str, ...] = ()
    for offset, data in records:
        head, _, rest = data.partition(b"\n")
        if head.startswith(b"filedesc://"):
            names = ARC_FIELDS[int(rest[:rest.index(b" ")])]
            continue
        values = head.decode("utf-8").split(" ")
        if len(values) != len(names):
            raise ValueError(f"a header line at {offset} has {len(values)} fields, not {len(names)}")
        size = int(values[-1])
        if len(rest) < size:
            raise ValueError(f"a record at {offset} is cut off")
        yield dict(zip(names, values)) | {"offset": offset, "block": rest[:size]}


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """(headers with the empty line, payload)."""
    at = block.find(b"\r\n\r\n")
    return (block[:at + 4], block[at + 4:]) if at >= 0 else (b"", block)


_PAGE = re.compile(rb"\r\nX-Page-Id: (-?\d+)\r\n")


def page_of(headers: bytes) -> int | None:
    found = _PAGE.search(headers)
    return int(found[1]) if found else None


def record_uri(archive: str, offset: int) -> str:
    return f"urn:uuid:{uuid.uuid5(RECORD_SPACE, f'{archive}:{offset}')}"


def _arc_writer(folder: str, version: int | None) -> Callable:
    """pages (page_id, url, html) -> (archive, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        v = version or 1 + task % 2
        out = _Writer(folder, f"arc{v}-{task:06d}", lambda name: arc_head(v, name))
        counts: dict[str, int] = {}
        for batch in batches:
            for page, url, html in zip(*(batch.column(c) for c in ("page_id", "url", "html"))):
                page, payload = page.as_py(), html.as_buffer()
                payload = b"" if payload is None else payload.to_pybytes()
                known = f"X-Page-Id: {page}\r\n" if page is not None else ""
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{known}Content-Length: {len(payload)}\r\n\r\n"
                date = FIRST_DATE + timedelta(seconds=(page or 0) % 10**9)
                name, _ = out.write(arc_record(v, url.as_py(), f"{date:%Y%m%d%H%M%S}", head.encode() + payload))
                counts[name] = counts.get(name, 0) + 1
        out.close()
        yield pa.RecordBatch.from_pydict({"archive": pa.array(list(counts), pa.string()), "records": pa.array(list(counts.values()), pa.int64())})

    return run


def write_arc(pages: DataFrame, folder: str, version: int | None = None) -> DataFrame:
    """Write pages as ARC archives; (archive, records).  Without a version tasks take 1 and 2 in turn."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return checkpoint(rows.mapInArrow(_arc_writer(folder, version), "archive string, records long"))


def _index(folder: str) -> Callable:
    """archives -> (archive, at, page_id, digest, bytes) of each record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                rows = []
                for r in parse_arc(members(folder, name)):
                    headers, payload = split_http(r["block"])
                    rows.append((name, r["offset"], page_of(headers), sha1_base32(payload), len(payload)))
                names = ("archive", "at", "page_id", "digest", "bytes")
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_pydict(
                    {n: pa.array([x[i] for x in rows], k) for i, (n, k) in enumerate(zip(names, kinds))})

    return run


# ---------------------------------------------------------------------------
# WARC
# ---------------------------------------------------------------------------

def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [WARC_VERSION, *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_warc(records: Iterator[tuple[int, bytes]]) -> Iterator[tuple[dict[str, str], bytes]]:
    for offset, data in records:
        head, _, rest = data.partition(b"\r\n\r\n")
        first, *lines = head.decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at {offset}")
        fields = dict(line.split(": ", 1) for line in lines)
        yield fields, rest[:int(fields["Content-Length"])]


def _iso(date: str) -> str:
    return f"{datetime.strptime(date, '%Y%m%d%H%M%S'):%Y-%m-%dT%H:%M:%SZ}"


def _convert(arcs: str, warcs: str) -> Callable:
    """(archive, others: offset -> the response's archive and offset) -> (archive, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, others in zip(batch.column("archive").to_pylist(), batch.column("others").to_pylist()):
                points = {o["at"]: (o["to_archive"], o["to_at"]) for o in others or ()}
                stem = name.removesuffix(".gz").replace("arc", "warc", 1)
                out = _Writer(warcs, stem, lambda own: warc_record([
                    ("WARC-Type", "warcinfo"), ("WARC-Date", _iso(f"{FIRST_DATE:%Y%m%d%H%M%S}")),
                    ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(RECORD_SPACE, own)}>"), ("WARC-Filename", own),
                    ("Content-Type", "application/warc-fields")], b"conformsTo: WARC/1.1\r\n"))
                counts: dict[str, int] = {}
                for r in parse_arc(members(arcs, name)):
                    headers, payload = split_http(r["block"])
                    to = points.get(r["offset"])
                    fields = [
                        ("WARC-Type", "revisit" if to else "response"),
                        ("WARC-Target-URI", r["URL"]), ("WARC-Date", _iso(r["Archive-date"])),
                        ("WARC-IP-Address", r["IP-address"]),
                        ("WARC-Record-ID", f"<{record_uri(name, r['offset'])}>"),
                        ("WARC-Payload-Digest", "sha1:" + sha1_base32(payload)),
                    ]
                    if to:
                        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{record_uri(*to)}>")]
                    block = headers if to else r["block"]
                    fields += [("WARC-Block-Digest", "sha1:" + sha1_base32(block)),
                               ("Content-Type", "application/http; msgtype=response")]
                    own, _ = out.write(warc_record(fields, block))
                    counts[own] = counts.get(own, 0) + 1
                out.close()
                yield pa.RecordBatch.from_pydict({"archive": pa.array(list(counts), pa.string()), "records": pa.array(list(counts.values()), pa.int64())})

    return run


def numbered(archives: DataFrame) -> DataFrame:
    """archive, no: different archives, numbered from 0.  Names only: one for each ``ARCHIVE_BYTES`` of payload."""
    names = archives.select("archive").distinct()
    return checkpoint(names.withColumn("no", F.row_number().over(Window.orderBy("archive")) - 1))


def dealt(names: DataFrame) -> DataFrame:
    """Rows of numbered archives, an archive a partition (``MOST_TASKS`` at most): the names are few, the work behind them is not.

    Archives are closed at ``ARCHIVE_BYTES``, so their number is the measure of the work.
    """
    tasks = min(MOST_TASKS, max(1, (names.agg(F.max("no")).first()[0] or 0) + 1))
    return names.repartitionById(tasks, F.col("no").cast("int"))


def convert(arc_index: DataFrame, arcs: str, warcs: str, least: int = 0) -> DataFrame:
    """Convert ARC archives; (archive, records) of the WARC archives.

    Of records with equal payloads of at least ``least`` bytes the one with the
    smallest page id (a null id last, ties by archive and offset) is the response.
    """
    place = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "archive", "at")
    leaders = arc_index.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.min(place).alias("to"))
    others = arc_index.join(leaders, ["digest", "bytes"]).where(
        (F.col("to.archive") != F.col("archive")) | (F.col("to.at") != F.col("at"))
    ).groupBy("archive").agg(F.collect_list(F.struct(
        "at", F.col("to.archive").alias("to_archive"), F.col("to.at").alias("to_at"))).alias("others"))
    work = dealt(checkpoint(numbered(arc_index).join(others, "archive", "left"))).drop("no")
    return checkpoint(work.mapInArrow(_convert(arcs, warcs), "archive string, records long"))


def _read_warc(folder: str) -> Callable:
    """archives -> one row per response or revisit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                rows = []
                for fields, block in parse_warc(members(folder, name)):
                    kind = fields["WARC-Type"]
                    if kind not in ("response", "revisit"):
                        continue
                    headers, payload = split_http(block)
                    size, digest = len(payload), sha1_base32(payload)
                    if kind == "revisit":
                        size = int(re.search(rb"Content-Length: (\d+)", headers)[1])
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    elif "sha1:" + digest != fields["WARC-Payload-Digest"]:
                        raise ValueError(f"digest of {fields['WARC-Record-ID']} does not hold")
                    rows.append((page_of(headers), size, digest, kind, fields["WARC-Record-ID"],
                                 fields.get("WARC-Refers-To"), fields["WARC-Target-URI"], fields["WARC-Date"]))
                names = ("page_id", "payload_bytes", "payload_digest", "record_type", "record_id", "refers_to_record", "uri", "date")
                kinds = (pa.int64(), pa.int64(), *[pa.string()] * 6)
                yield pa.RecordBatch.from_pydict(
                    {n: pa.array([x[i] for x in rows], k) for i, (n, k) in enumerate(zip(names, kinds))})

    return run


_WARC_ROW = ("page_id long, payload_bytes long, payload_digest string, record_type string, record_id string, "
             "refers_to_record string, uri string, date string")


def warc_from_pages(pages: DataFrame) -> DataFrame:
    """Pages -> ARC -> WARC -> records read back, one row per page row.

    Null html is an empty payload, a null or odd url is percent-encoded (``-`` if
    empty), repeated page ids are separate records, other columns are ignored.
    """
    folder = f"{shared_folder(pages.sparkSession)}/archives-{uuid.uuid4().hex}"
    arcs, warcs = f"{folder}/arc", f"{folder}/warc"
    written = write_arc(pages, arcs)
    index = checkpoint(dealt(numbered(written)).select("archive").mapInArrow(
        _index(arcs), "archive string, at long, page_id long, digest string, bytes long"))
    converted = convert(index, arcs, warcs)
    back = checkpoint(dealt(numbered(converted)).select("archive").mapInArrow(_read_warc(warcs), _WARC_ROW))
    # only responses that something refers to: one row per group of copies
    wanted = back.where("refers_to_record is not null").select(F.col("refers_to_record").alias("record_id")).distinct()
    targets = back.join(wanted, "record_id", "left_semi").select(
        F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to"))
    return back.join(targets, "refers_to_record", "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "uri", "date")


def op4_warc(spark, sf_dir: str) -> DataFrame:
    return warc_from_pages(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
