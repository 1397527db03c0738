"""WARC archives: writing pages as gzip members, and a reader that splits archives by bytes.

Each record is a gzip member of its own, so an archive can be read from any member on. The reader
deals byte ranges to tasks. A task looks for the gzip magic in its range, takes a place for a
member only if what it inflates to begins like a WARC record whose header parses, and reads every
record that starts inside its range, also where it ends beyond.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from migraspark.llm.common import kept_table
from migraspark.session import scratch_path

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 8 << 20
READ_BYTES = 1 << 18
HEADER_BYTES = 1 << 16
LEAST_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = (
    "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, "
    "refers_to bigint, payload binary"
)


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(text: str | None) -> str:
    """A header value on one line."""
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in text or "")


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def encoded_record(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    """One record as a gzip member. A revisit keeps the length of its payload, not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if revisit else payload)
    header = [
        VERSION.decode(),
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        header.append(f"WARC-Target-URI: {_line(url)}")
    if revisit:
        header += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    data = "\r\n".join(header).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def _page(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def decoded_record(data: bytes) -> tuple:
    """The row (see RECORDS) of an inflated record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields["warc-type"]
    if kind == "response":
        found = (len(payload), base32_digest(payload), kind, None, payload)
    else:
        digest = fields["warc-payload-digest"].removeprefix("sha1:")
        size = int(_fields(http)["content-length"])
        found = (size, digest, kind, _page(fields["warc-refers-to"]), None)
    return (_page(fields["warc-record-id"]), fields.get("warc-target-uri"), *found)


def plausible(start: bytes) -> bool:
    """Whether bytes at a gzip magic inflate to the header of a record."""
    inflater = zlib.decompressobj(31)
    try:
        head = inflater.decompress(start, HEADER_BYTES)
    except zlib.error:
        return False
    if not head.startswith(VERSION + b"\r\n"):
        return False
    fields = _fields(head.partition(b"\r\n\r\n")[0])
    return fields.get("content-length", "").isdigit() and "warc-type" in fields


def member_at(source, at: int) -> tuple[bytes, int] | None:
    """The inflated member that starts at ``at`` and the place after it; None if there is none.

    Inflating checks the member's own checksum, so a magic inside other data is not taken.
    """
    source.seek(at)
    piece = source.read(READ_BYTES)
    if not piece.startswith(MAGIC) or not plausible(piece):
        return None
    inflater, parts = zlib.decompressobj(31), []
    try:
        while True:
            parts.append(inflater.decompress(piece))
            if inflater.eof:
                return b"".join(parts), source.tell() - len(inflater.unused_data)
            piece = source.read(READ_BYTES)
            if not piece:
                return None
    except zlib.error:
        return None


def records_starting_in(source, start: int, end: int) -> Iterator[bytes]:
    """The inflated records whose first byte lies in start:end, in order."""
    at = start
    while at < end:
        member = member_at(source, at)
        if member is not None:
            data, at = member
            yield data
            continue
        at = _next_magic(source, at + 1, end)


def _next_magic(source, at: int, end: int) -> int:
    """The next place before ``end`` that begins with the magic, else ``end``."""
    while at < end:
        source.seek(at)
        piece = source.read(min(READ_BYTES, end - at) + len(MAGIC) - 1)
        found = piece.find(MAGIC)
        if found >= 0:
            return at + found
        at += max(len(piece) - len(MAGIC) + 1, 1)
    return end


def _filesystem(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def planned(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload (binary) and refers_to for every page.

    refers_to is the smallest page_id among the payloads equal to a page's, of ``least`` bytes or
    more, if another one; such a page becomes a revisit. Only digests seen more than once are
    joined back to the pages.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("sha", F.sha1("payload"))
    firsts = kept_table(
        rows.where(F.octet_length("payload") >= least)
        .groupBy("sha")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1 AND first IS NOT NULL")
        .select("sha", "first"),
        "repeated-payloads",
    )
    other = F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    return rows.join(firsts, "sha", "left").select("page_id", "url", "payload", other.alias("refers_to"))


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Writes planned rows, one archive per task, and returns (path, bytes, records) of each.

    A repeated attempt writes a file of its own; only the list that Spark commits is to be read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _filesystem(folder)
        store.create_dir(at, recursive=True)
        path = f"{at}/{uuid.uuid4().hex}.warc.gz"
        size = count = 0
        out = None
        for batch in batches:
            for k in range(batch.num_rows):
                page_id, url, payload, refers_to = (batch.column(c)[k].as_py() for c in range(4))
                record = encoded_record(
                    page_id, url, payload, base32_digest(payload), refers_to, refers_to is not None
                )
                out = out or store.open_output_stream(path, compression=None)
                out.write(record)
                size, count = size + len(record), count + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict(
                {"path": [f"{folder}/{path.rsplit('/', 1)[1]}"], "bytes": [size], "records": [count]}
            )

    written = rows.select("page_id", "url", "payload", "refers_to").mapInArrow(
        run, "path string, bytes bigint, records bigint"
    )
    return kept_table(written, "archive-list")


def read_archives(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """All records of the files (path, bytes), in the columns of RECORDS.

    A response's size and digest are those of the payload read, a revisit's those it states.
    """
    begins = F.sequence(F.lit(0), F.greatest("bytes", F.lit(1)) - 1, F.lit(split_bytes))
    splits = files.select("path", F.explode(begins).alias("start"))
    # Rows of a few bytes stand for megabytes: a stated number keeps them from being merged.
    splits = splits.repartition(max(splits.count(), 1), "path", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
             ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
             ("payload", pa.binary())]
        )

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
            )

        for batch in batches:
            for path, start in zip(*(batch.column(c).to_pylist() for c in range(2)), strict=True):
                store, at = _filesystem(path)
                rows, held = [], 0
                with store.open_input_file(at) as source:
                    end = min(start + split_bytes, source.size())
                    for data in records_starting_in(source, start, end):
                        rows.append(decoded_record(data))
                        held += len(data)
                        if held > split_bytes:
                            yield packed(rows)
                            rows, held = [], 0
                if rows:
                    yield packed(rows)

    return splits.mapInArrow(run, RECORDS)


def archived(pages: DataFrame, least: int = LEAST_BYTES, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Writes a record per row of ``pages`` (page_id, url, html) and reads all records back.

    A NULL html is an empty payload, a NULL url gives no target, control signs in a url are
    percent-encoded. Of equal payloads of ``least`` bytes or more the smallest page_id is the
    response and the others revisit it; rows repeating that page_id are responses as well. Rows
    without a page_id revisit too if any equal payload has one. Other columns are ignored, an
    empty table gives an empty result. The archives lie in the shared folder.
    """
    folder = scratch_path(pages.sparkSession, "archives")
    return read_archives(write_archives(planned(pages, least), folder), split_bytes)
