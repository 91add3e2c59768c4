"""WARC archives: a writer with revisit records, and a salvage reader.

Tasks write gzip archives of one member per record straight to shared storage and report what they wrote;
the report is a written table, and only archives in it are read, so files of lost attempts do no harm.

The reader checks every record (gzip CRC, version line, length, digest). Where a check fails it searches
for the next gzip member or version line that passes, goes on from there, and reports the bytes between
as a gap. A member may hold several records: they are read the same way from its inflated bytes, which are held in
memory, and a gap among them is reported with the member's place.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import materialize, qualified, scratch_path

GZIP = b"\x1f\x8b\x08"
#: Version lines begin with one of these; all have one length.
VERSIONS = (b"WARC/1.", b"WARC/0.")
READ_BYTES = 1 << 18
OUT_BYTES = 4 << 20
#: Payloads shorter than this never become revisits.
MIN_REVISIT_BYTES = 1000
ARCHIVE_BYTES = 256 << 20
MAX_HEADER_BYTES = 1 << 20

REPORT = "path string, records bigint, bytes bigint"
FOUND = (
    "path string, offset bigint, length bigint, problem string, warc_type string, record_id string, "
    "refers_to string, payload_digest string, payload_length bigint, payload binary"
)


class Damaged(Exception):
    """A record that fails a check."""


def digest_header(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(raw).decode()


def record_bytes(kind: str, record_id: str, uri: str | None, payload: bytes, length: int, sha1: bytes, refers: str | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if kind == "revisit" else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{record_id}>",
        "WARC-Date: 2020-01-01T00:00:00Z",
        f"WARC-Payload-Digest: {digest_header(sha1)}",
        f"WARC-Block-Digest: {digest_header(hashlib.sha1(block).digest())}",
        f"X-Payload-Length: {length}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if uri is not None:
        lines.append("WARC-Target-URI: " + quote(uri, safe="!#$%&'()*+,/:;=?@[]~"))
    if refers is not None:
        lines.append(f"WARC-Refers-To: <{refers}>")
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(raw: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def store_of(home: str, path: str) -> tuple[fs.FileSystem, str]:
    """File system of ``path`` and the path in it. Without a scheme it is taken as Spark takes it: in the store of ``home``,
    the qualified working folder of the driver, and below that folder unless it starts with a slash."""
    if path.startswith("file:/"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    scheme, authority, folder = urlsplit(home)[:3]
    whole = path if path.startswith("/") else f"{folder}/{path}"
    return (fs.LocalFileSystem(), whole) if scheme == "file" else fs.FileSystem.from_uri(f"{scheme}://{authority}{whole}")


def _writer(home: str, folder: str, limit: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(home, folder)
        out, name, count, size, done = None, "", 0, 0, []
        for batch in batches:
            for row in range(batch.num_rows):
                record_id, kind, uri, refers, length, sha1, payload = (c[row].as_py() for c in batch.columns)
                if out is None:
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    store.create_dir(base, recursive=True)
                    out, count, size = store.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                member = gzip_member(record_bytes(kind, record_id, uri, payload, length, bytes.fromhex(sha1), refers))
                out.write(member)
                count, size = count + 1, size + len(member)
                if size >= limit:
                    out.close()
                    out, done = None, [*done, (f"{folder}/{name}", count, size)]
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", count, size))
        for path, records, written in done:
            yield pa.RecordBatch.from_pylist([{"path": path, "records": records, "bytes": written}])

    return kernel


def decide_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page as the writer takes it. Of equal payloads of at least ``MIN_REVISIT_BYTES`` the row with
    the largest id is the response (of rows with that id, one), and the others revisit it.

    Null html is an empty payload, a null url has no target header, a null id comes after all others.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    flat = pages.select(
        F.monotonically_increasing_id().alias("uid"),
        F.col(id_col).cast("string").alias("id"),
        F.col(id_col).alias("rank"),
        F.col(url_col).alias("uri"),
        payload.alias("payload"),
    ).select("*", F.sha2("payload", 256).alias("content"), F.length("payload").cast("long").alias("length"))
    best = F.max(F.struct(F.col("rank").isNotNull().alias("known"), F.col("rank").alias("rank"), F.col("uid").alias("uid"), F.col("id").alias("id")))
    groups = flat.where(F.col("length") >= MIN_REVISIT_BYTES).groupBy("content", "length")
    groups = groups.agg(best.alias("best"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    # Written first: the adaptive plan cuts a large group only where the join reads two plain exchanges.
    joined = flat.join(materialize(groups, "copies"), ["content", "length"], "left")
    revisit = F.col("best.uid") != F.col("uid")
    return joined.select(
        _urn(F.col("id"), F.col("uid")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("kind"),
        "uri",
        F.when(revisit, _urn(F.col("best.id"), F.col("best.uid"))).alias("refers"),
        "length",
        F.sha1("payload").alias("sha1"),
        F.when(revisit, F.lit("").cast("binary")).otherwise(F.col("payload")).alias("payload"),
    )


def _urn(page, uid):
    return F.concat(F.lit("urn:page:"), F.coalesce(page, F.lit("")), F.lit(":"), uid.cast("string"))


def page_of(record_id):
    """The page id in a record id; null where the page had none."""
    return F.nullif(F.regexp_extract(record_id, "^urn:page:(-?[0-9]*):", 1), F.lit("")).cast("long")


def write_archives(records: DataFrame, folder: str, limit: int = ARCHIVE_BYTES) -> DataFrame:
    """Write rows of ``decide_revisits`` as archives of about ``limit`` bytes at most into ``folder`` (a path or URI that
    all executors reach); the report of finished archives (``path, records, bytes``), as a written table."""
    home = qualified(records.sparkSession, ".")
    return materialize(records.mapInArrow(_writer(home, folder, limit), REPORT), "archives")


# --- reading ---------------------------------------------------------------------------------------------


def parse_record(raw: bytes) -> dict:
    """Headers and payload of one whole record, after all checks."""
    if not raw.startswith(VERSIONS):
        raise Damaged("no version line")
    head, found, rest = raw.partition(b"\r\n\r\n")
    if not found:
        raise Damaged("headers do not end")
    headers = {}
    for line in head.split(b"\r\n")[1:]:
        key, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            raise Damaged("header without colon")
        headers[key.strip().lower()] = value.strip()
    length = headers.get("content-length", "")
    if not length.isdigit() or len(rest) != int(length) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise Damaged("length does not fit")
    block = rest[:-4]
    if (want := headers.get("warc-block-digest")) and want != digest_header(hashlib.sha1(block).digest()):
        raise Damaged("block digest does not fit")
    payload = block.partition(b"\r\n\r\n")[2] if "http" in headers.get("content-type", "") else block
    if headers.get("warc-type") == "response" and (want := headers.get("warc-payload-digest")):
        if want != digest_header(hashlib.sha1(payload).digest()):
            raise Damaged("payload digest does not fit")
    return {"headers": headers, "payload": payload}


def read_member(source, at: int, size: int) -> tuple[int, bytes]:
    """End and bytes of the gzip member at ``at``."""
    unpack, out, place = zlib.decompressobj(31), [], at
    while not unpack.eof:
        piece = source.read_at(min(READ_BYTES, size - place), place) if place < size else b""
        if not piece:
            raise Damaged("member is cut off")
        try:
            out.append(unpack.decompress(piece))
        except zlib.error as x:
            raise Damaged("member does not inflate") from x
        place += len(piece)
    return place - len(unpack.unused_data), b"".join(out)


def read_plain(source, at: int, size: int) -> tuple[int, bytes]:
    """End and bytes of the uncompressed record at ``at``."""
    head = b""
    while b"\r\n\r\n" not in head:
        if at + len(head) >= size or len(head) > MAX_HEADER_BYTES:
            raise Damaged("headers do not end")
        head += source.read_at(min(8192, size - at - len(head)), at + len(head))
    top = head[: head.index(b"\r\n\r\n") + 4]
    length = next((x.partition(b":")[2].strip() for x in top.split(b"\r\n") if x.lower().startswith(b"content-length:")), b"")
    if not length.isdigit() or at + len(top) + int(length) + 4 > size:
        raise Damaged("length does not fit")
    whole = len(top) + int(length) + 4
    return at + whole, source.read_at(whole, at)


class Inflated:
    """The bytes of a member as a source."""

    def __init__(self, raw: bytes):
        self.raw = raw

    def read_at(self, count: int, at: int) -> bytes:
        return self.raw[at : at + count]


def records_in(raw: bytes) -> list[tuple[str | None, dict | None]]:
    """``(problem, record)`` of the records and gaps in the inflated bytes of a member, which hold one record at least."""
    try:
        return [(None, parse_record(raw))]
    except Damaged as x:
        found = [(problem, record) for _, _, problem, record in walk(Inflated(raw), len(raw), read_record, VERSIONS)]
        if not any(record for _, record in found):
            raise x
        return found


def read_record(source, at: int, size: int) -> tuple[int, list[tuple[str | None, dict | None]]]:
    """End and content of the uncompressed record at ``at``."""
    if not source.read_at(min(8, size - at), at).startswith(VERSIONS):
        raise Damaged("no version line")
    end, raw = read_plain(source, at, size)
    return end, [(None, parse_record(raw))]


def read_any(source, at: int, size: int) -> tuple[int, list[tuple[str | None, dict | None]]]:
    """End and content of the member or uncompressed record at ``at``."""
    start = source.read_at(min(8, size - at), at)
    if start.startswith(GZIP):
        end, raw = read_member(source, at, size)
        return end, records_in(raw)
    if start.startswith(VERSIONS):
        return read_record(source, at, size)
    raise Damaged("neither a member nor a version line")


def next_start(source, at: int, size: int, marks: tuple[bytes, ...]) -> int:
    """The next byte at which one of ``marks`` stands; ``size`` without one."""
    while at < size:
        piece = source.read_at(min(READ_BYTES, size - at), at)
        hits = [x for x in map(piece.find, marks) if x >= 0]
        if hits:
            return at + min(hits)
        if at + len(piece) >= size:
            return size
        at += len(piece) - len(VERSIONS[0]) + 1
    return size


def walk(source, size: int, read, marks: tuple[bytes, ...]) -> Iterator[tuple[int, int, str | None, dict | None]]:
    """``(offset, length, problem, record)`` in order of what ``read`` finds; gaps have a problem and no record."""
    at, gap, problem = 0, None, None
    while at < size:
        try:
            end, found = read(source, at, size)
        except Damaged as x:
            if gap is None:
                gap, problem = at, str(x)
            at = next_start(source, at + 1, size, marks)
            continue
        if gap is not None:
            yield gap, at - gap, problem, None
            gap = None
        for trouble, record in found:
            yield at, end - at, trouble, record
        at = end
    if gap is not None:
        yield gap, size - gap, problem, None


def salvage(source, size: int) -> Iterator[tuple[int, int, str | None, dict | None]]:
    """``(offset, length, problem, record)`` in file order; gaps have a problem and no record. What a member of several
    records holds has the member's offset and length."""
    return walk(source, size, read_any, (GZIP, *VERSIONS))


def _reader(home: str):
    def row_of(path: str, offset: int, length: int, problem: str | None, record: dict | None) -> dict:
        row = {"path": path, "offset": offset, "length": length, "problem": problem}
        if record is None:
            return row
        headers = record["headers"]
        digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
        try:
            sha1 = base64.b32decode(digest).hex()
        except ValueError:
            sha1 = digest
        whole = headers.get("x-payload-length", "")
        return row | {
            "warc_type": headers.get("warc-type"),
            "record_id": headers.get("warc-record-id", "").strip("<>"),
            "refers_to": headers["warc-refers-to"].strip("<>") if "warc-refers-to" in headers else None,
            "payload_digest": sha1,
            "payload_length": int(whole) if whole.isdigit() else None,
            "payload": record["payload"],
        }

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, number = pa.string(), pa.int64()
        schema = pa.schema(
            [("path", text), ("offset", number), ("length", number), ("problem", text), ("warc_type", text), ("record_id", text)]
            + [("refers_to", text), ("payload_digest", text), ("payload_length", number), ("payload", pa.binary())]
        )
        rows, held = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, place = store_of(home, path)
                with store.open_input_file(place) as source:
                    for found in salvage(source, source.size()):
                        rows.append(row_of(path, *found))
                        held += len(rows[-1].get("payload", b""))
                        if held >= OUT_BYTES or len(rows) >= 2000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return kernel


def read_archives(paths: DataFrame) -> DataFrame:
    """Records and gaps of the archives in column ``path`` (schema ``FOUND``); ``problem`` is null for records.

    An archive is one task's work at most; its records are streamed. An empty archive gives no rows.
    """
    tasks = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return paths.select("path").repartition(tasks, "path").mapInArrow(_reader(qualified(paths.sparkSession, ".")), FOUND)


def records_of(found: DataFrame) -> DataFrame:
    return found.where("problem is null")


def gaps_of(found: DataFrame) -> DataFrame:
    """The log of quarantined bytes: ``path, offset, length, problem``."""
    return found.where("problem is not null").select("path", "offset", "length", "problem")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write all pages, read the archives back: per page ``payload_bytes, payload_digest, record_type, refers_to``."""
    folder = scratch_path(pages.sparkSession, "warc")
    report = write_archives(decide_revisits(pages, id_col, url_col, html_col), folder)
    read = records_of(read_archives(report))
    whole = F.col("warc_type") == "response"
    return read.select(
        page_of(F.col("record_id")).alias(id_col),
        F.when(whole, F.length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(whole, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        page_of(F.col("refers_to")).alias("refers_to"),
    )
