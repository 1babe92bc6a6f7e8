"""WARC archives: member-wise compressed writing through Spark's text sink, and a salvage reader."""
from __future__ import annotations

import base64
import hashlib
import re
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from popweave.llm.common import in_slices, new_folder

ARCHIVE_BYTES = 24_000_000     # payload bytes that an archive is planned for
FEED = 1 << 16                 # bytes handed to the decompressor at a time
SPREAD = 64                    # parts into which the records of one payload are dealt
# Fixed values of the format.
VERSION = b"WARC/1.1"
VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
MEMBER_START = re.compile(rb"\x1f\x8b\x08[\x00-\x1f]")
PROFILE_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"

RECORDS = ("archive string, offset bigint, compressed boolean, record_type string, record_id string, target_uri string, "
           "refers_to string, payload_digest string, payload_bytes bigint, payload binary, error string, gap_start bigint, gap_end bigint")


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: str, url: str | None, payload: bytes, own_digest: str, refers_to: str | None) -> bytes:
    """One response record, or a revisit record whose block keeps the HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [("WARC-Type", "revisit" if refers_to is not None else "response"), ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", DATE),
            ("WARC-Target-URI", uri), ("WARC-Payload-Digest", "sha1:" + own_digest), ("WARC-Block-Digest", "sha1:" + digest(block)),
            ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE_REVISIT), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in head)
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, payload: str = "html", page_id: str = "page_id", url: str = "url", archive_bytes: int = ARCHIVE_BYTES,
                   smallest_shared: int = 0) -> str:
    """Write one record per row of ``pages`` and return the folder of the archives.

    Each record is its own gzip member; members are joined by a zero byte, which gzip readers take as padding. Spark's
    text sink writes the members, so archives reach any store that Spark writes to, and an attempt that is lost is
    written anew. Of rows with equal payloads (``smallest_shared`` bytes or more) that with the smallest id is the
    response; others are revisits of it. Groups are made from digests alone; groups of several rows are dealt to
    ``SPREAD`` parts, so the payload that a third of all rows share is written by many tasks. Archives are planned for
    ``archive_bytes`` of payload.

    Nulls: a null payload is empty; a null url is empty; rows without an id are written as responses under the name
    ``null`` and never as anyone's original. Rows that repeat the smallest id of their payload are all responses. Other
    columns are not read. An empty table writes no archive.
    """
    spark = pages.sparkSession
    body = F.coalesce(F.col(payload), F.lit(""))
    base = pages.select(F.col(page_id).cast("bigint").alias("id"), F.col(url).cast("string").alias("url"), body.alias("body"))
    base = base.withColumn("sha", F.sha1(F.col("body").cast("binary"))).withColumn("size", F.octet_length("body").cast("bigint"))
    base = base.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(SPREAD)).cast("int"))
    total = base.agg(F.sum("size")).first()[0] or 0
    parts = max(1, -(-total // archive_bytes))
    per = base.where(F.col("size") >= smallest_shared).groupBy("sha", "part").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    whole = per.groupBy("sha").agg(F.min("first").alias("first"), F.sum("n").alias("n")).where("n > 1").select("sha", "first")
    shared = per.select("sha", "part").join(whole, "sha")
    rows = base.repartition(int(parts), "sha", "part").join(shared, ["sha", "part"], "left")
    rows = rows.select("id", "url", "body", F.when((F.col("size") >= smallest_shared) & (F.col("first") != F.col("id")), F.col("first")).alias("refers"))

    def members(batches):
        for part in in_slices(batches, "body"):
            out = []
            for i, u, b, r in zip(*(part.column(c).to_pylist() for c in ("id", "url", "body", "refers")), strict=True):
                data = b.encode("utf-8", "surrogatepass")
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                out.append(pack.compress(record("null" if i is None else str(i), u, data, digest(data), None if r is None else str(r))) + pack.flush())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])

    folder = new_folder(spark, "warc")
    rows.mapInArrow(members, "member binary").select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").text(folder)
    return folder


@dataclass
class _Gap:
    start: int
    end: int
    why: str


def _headers(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return out


def _parse(data: bytes, at: int) -> tuple[dict, int]:
    """The record that begins at ``at`` and where it ends; ValueError names the failed check."""
    if not VERSION_LINE.match(data, at):
        raise ValueError("no version line")
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        raise ValueError("header without end")
    head = _headers(data[data.find(b"\r\n", at) + 2:stop])
    length = head.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        raise ValueError("no content length")
    begin, end = stop + 4, stop + 4 + int(length)
    if data[end:end + 4] != b"\r\n\r\n":
        raise ValueError("record does not end where its length says")
    block = data[begin:end]
    if (want := head.get("warc-block-digest")) and want != "sha1:" + digest(block):
        raise ValueError("block digest differs")
    kind, payload, size, own = head.get("warc-type", ""), block, len(block), head.get("warc-payload-digest", "").removeprefix("sha1:")
    if head.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        size = len(payload)
        if kind == "revisit":                              # its block has the header of the full answer
            full = _headers(http).get("content-length", "")
            size, payload = int(full) if full.isdigit() else size, None
    if kind == "response":
        if own and own != digest(payload):
            raise ValueError("payload digest differs")
        own = own or digest(payload)
    name = lambda x: head[x].removeprefix("<urn:page:").removesuffix(">") if x in head else None       # noqa: E731
    return {"record_type": kind, "record_id": name("warc-record-id"), "target_uri": head.get("warc-target-uri"), "refers_to": name("warc-refers-to"),
            "payload_digest": own or None, "payload_bytes": size, "payload": payload}, end + 4


def _inflate(data: bytes, at: int) -> tuple[bytes, int]:
    """The gzip member at ``at`` and where it ends."""
    one, out, to = zlib.decompressobj(31), [], at
    try:
        while not one.eof and to < len(data):
            piece = data[to:to + FEED]
            out.append(one.decompress(piece))
            to += len(piece)
    except zlib.error as fault:
        raise ValueError(f"member: {fault}") from fault
    if not one.eof:
        raise ValueError("member without end")
    return b"".join(out), to - len(one.unused_data)


def salvage(data: bytes):
    """Records ``(offset, compressed, dict)`` and gaps of an archive, whatever its bytes are.

    At each place stands a gzip member, whose content must be whole records, or a plain record. Where a check fails,
    the search goes on behind that place for the next member or version line from which a record can be read; the
    bytes in between are one gap with the first fault. Zero bytes and line ends between records are padding. A member
    that holds good records and then a bad one gives the good ones, and a gap over the member for the rest.
    """
    at, n, gap = 0, len(data), None
    while at < n:
        if data[at] in b"\0\r\n":
            at += 1
            continue
        try:
            if data[at:at + 2] == b"\x1f\x8b":
                inner, end = _inflate(data, at)
                got, inside, fault = [], 0, None
                while inside < len(inner):
                    try:
                        one, inside = _parse(inner, inside)
                        got.append(one)
                    except ValueError as why:
                        fault = fault or str(why)
                        found = VERSION_LINE.search(inner, inside + 1)
                        inside = found.start() if found else len(inner)
                if not got:
                    raise ValueError(fault or "empty member")
                extra = _Gap(at, end, "in member: " + fault) if fault else None
            else:
                one, end = _parse(data, at)
                got, extra = [one], None
        except ValueError as why:
            if gap is None:
                gap = _Gap(at, at, str(why))
            later = [m.start() for m in (MEMBER_START.search(data, at + 1), VERSION_LINE.search(data, at + 1)) if m]
            at = min(later, default=n)
            gap.end = at
            continue
        if gap:
            yield gap
            gap = None
        for one in got:
            yield at, data[at:at + 2] == b"\x1f\x8b", one
        if extra:
            yield extra
        at = end
    if gap:
        yield gap


def read_archives(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """All records of the archives in ``folder`` and the byte gaps that were quarantined (``error`` not null).

    One row per record with its payload (null for revisits, and
    throughout without ``with_payload``), or per gap with ``gap_start`` and ``gap_end``. An archive
    is read by one task, whole; archives that ``write_archives`` makes are of bounded size. Empty and damaged files
    give what can be saved. A revisit has the size of its full payload from the HTTP header that it keeps.
    """
    def run(batches):
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows: list[tuple] = []
                held = 0
                for got in salvage(data.as_py()):
                    if isinstance(got, _Gap):
                        rows.append((path, got.start, None, None, None, None, None, None, None, None, got.why, got.start, got.end))
                        continue
                    at, packed, r = got
                    rows.append((path, at, packed, r["record_type"], r["record_id"], r["target_uri"], r["refers_to"], r["payload_digest"], r["payload_bytes"], r["payload"] if with_payload else None, None, None, None))
                    held += len(r["payload"] or b"") + 200
                    if held > 8_000_000:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")
    return files.mapInArrow(run, RECORDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.bool_(), *[pa.string()] * 5, pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64()]
    names = ["archive", "offset", "compressed", "record_type", "record_id", "target_uri", "refers_to", "payload_digest", "payload_bytes", "payload", "error", "gap_start", "gap_end"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
