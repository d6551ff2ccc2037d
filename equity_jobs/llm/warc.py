"""WARC archives: a writer that stores equal payloads once, and a splittable reader.

Every record is a gzip member. The reader's tasks take byte ranges: a task scans its
range for gzip magic, accepts a candidate member only if it decodes to a WARC header,
and owns the records that start inside its range, reading past its end for the last one.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equity_jobs.llm.common import shared_dir

MAGIC = b"\x1f\x8b\x08"
READ = 1 << 20  # bytes read at once beyond a range
FEED = 1 << 15  # bytes decoded at once
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "path string, offset bigint, record_id string, record_type string, target_uri string, payload_digest string, refers_to string, payload_length bigint, payload binary"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the payload's SHA-1: each 10 hex digits are 8 characters."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_revisits(pages: DataFrame, id_col: str, payload_col: str, least_bytes: int = 0) -> DataFrame:
    """pages (id, url, payload) with digest, bytes and refers_to, the smallest id of equal payloads.

    refers_to is null on the rows to be stored: those of the smallest id (all of them if
    it repeats), of payloads under least_bytes, and where no equal payload has an id.
    """
    sized = pages.withColumns({"digest": base32_sha1(F.col(payload_col)), "bytes": F.octet_length(payload_col).cast("bigint")})
    firsts = sized.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.min(id_col).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    joined = sized.join(firsts, "digest", "left")
    refers = F.when((F.col("bytes") >= least_bytes) & ~F.col(id_col).eqNullSafe(F.col("first")), F.col("first"))
    return joined.withColumn("refers_to", refers).drop("first")


def _field(value: object) -> str:
    """A header value on one line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", str(value))


def record(record_id: str, uri: str | None, digest: str, payload: bytes, size: int, refers_to: str | None, date: str) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {_field(uri)}")
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"Payload-Length: {size}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    block = HTTP + (payload if refers_to is None else b"")
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def _open(uri: str):  # noqa: ANN202
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes a record per row below folder and returns the files written (path, bytes).

    Payloads are stored in UTF-8, null as empty. Each task writes files under names of
    its own attempt; the returned table, itself written below folder, lists those of
    finished attempts only, so a lost executor leaves no record twice. Null ids are
    written as "null". An empty table gives no files.
    """
    spark = pages.sparkSession
    source = pages.select(pages[id_col].alias("id"), pages[url_col].cast("string").alias("url"), F.coalesce(pages[payload_col].cast("binary"), F.lit("").cast("binary")).alias("payload"))
    ready = with_revisits(source, "id", "payload", least_bytes).select("id", "url", "digest", "bytes", "refers_to", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _open(f"{folder}/{uuid.uuid4().hex}.warc.gz")
        out, size = None, 0
        for batch in batches:
            if out is None and batch.num_rows:
                files.create_dir(path.rpartition("/")[0], recursive=True)
                out = files.open_output_stream(path, compression=None)
            for row in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "digest", "payload", "bytes", "refers_to")), strict=True):
                own, url, digest, payload, length, refers = row
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = record(f"urn:page:{'null' if own is None else own}", url, digest, payload or b"", length, None if refers is None else f"urn:page:{refers}", date)
                size += out.write(packer.compress(data)) + out.write(packer.flush())
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{path.rpartition('/')[2]}"]), pa.array([size], pa.int64())], names=["path", "bytes"])

    ready.mapInArrow(run, "path string, bytes bigint").write.parquet(f"{folder}/files")
    return spark.read.schema("path string, bytes bigint").parquet(f"{folder}/files")


@dataclass
class _Range:
    """The bytes of a file from start on, read as needed."""

    file: object
    size: int
    start: int
    data: bytearray

    def upto(self, end: int) -> bool:
        """Whether the bytes before end are there."""
        while (have := self.start + len(self.data)) < min(end, self.size):
            self.data += self.file.read_at(min(max(READ, end - have), self.size - have), have)
        return end <= self.size

    def member(self, at: int, whole: bool = True) -> tuple[bytes, int] | None:
        """The member that begins at offset at, decoded, and its end; None if there is none that holds a WARC record."""
        unpack, out, pos = zlib.decompressobj(31), bytearray(), at
        while not unpack.eof:
            self.upto(pos + FEED)
            piece = memoryview(self.data)[pos - self.start : pos - self.start + FEED].tobytes()
            if not piece:
                return None
            try:
                out += unpack.decompress(piece)
            except zlib.error:
                return None
            pos += len(piece)
            if len(out) >= 5 and not out.startswith(b"WARC/"):
                return None
            if not whole and len(out) >= 5:
                return bytes(out), pos
        return (bytes(out), pos - len(unpack.unused_data)) if out.startswith(b"WARC/") else None


def parse(raw: bytes) -> dict[str, object]:
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
    block = block[: int(fields["content-length"])]
    if fields.get("content-type", "").startswith("application/http"):
        block = block.partition(b"\r\n\r\n")[2]
    revisit = fields["warc-type"] == "revisit"
    return {
        "record_id": fields["warc-record-id"].strip("<>"), "record_type": fields["warc-type"], "target_uri": fields.get("warc-target-uri"), "payload_digest": fields.get("warc-payload-digest"),
        "refers_to": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None, "payload_length": int(fields.get("payload-length", 0)) if revisit else len(block), "payload": None if revisit else block,
    }


def records(file: object, size: int, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """offset and decoded bytes of the records that start from start to before end.

    A candidate must decode to a WARC header, and what follows it must be the end of the
    file or another such member: gzip data inside a stored payload is not mistaken for one.
    """
    held, at = _Range(file, size, start, bytearray()), start
    while at < end:
        held.upto(min(end + len(MAGIC) - 1, size))
        at = held.data.find(MAGIC, at - held.start, min(end, size) - held.start + len(MAGIC) - 1)
        at = held.start + at if at >= 0 else end
        while at < end and (found := held.member(at)) and (found[1] >= size or held.member(found[1], whole=False)):
            yield at, found[0]
            at = found[1]
            if at - held.start > 4 * READ:  # forget what is behind
                del held.data[: at - held.start]
                held.start = at
        at += 1 if at < end else 0


def read_warc(files: DataFrame, split_bytes: int = 16 << 20) -> DataFrame:
    """The records of all files (path, bytes), read in ranges of split_bytes.

    Columns: path, offset, record_id, record_type, target_uri, payload_digest, refers_to,
    payload_length and payload. A revisit has no payload; its payload_length is that of
    the record it refers to. No files: no rows.
    """
    ranges = files.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bytes") - 1, F.lit(split_bytes).cast("bigint"))).alias("start"))
    count = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split(" ")[0] for part in RECORD.split(", ")]
        kinds = {"offset": pa.int64(), "payload_length": pa.int64(), "payload": pa.binary()}

        def packed(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names=names)

        for batch in batches:
            for path, size, start in zip(*(batch.column(c).to_pylist() for c in ("path", "bytes", "start")), strict=True):
                store, place = _open(path)
                rows, held = [], 0
                with store.open_input_file(place) as file:
                    for offset, raw in records(file, size, start, min(start + split_bytes, size)):
                        rows.append({"path": path, "offset": offset} | parse(raw))
                        held += len(raw)
                        if held > 4 * READ:
                            yield packed(rows)
                            rows, held = [], 0
                if rows:
                    yield packed(rows)

    return ranges.repartition(count, "path", "start").mapInArrow(run, RECORD)


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, split_bytes: int = 16 << 20) -> DataFrame:
    """Writes pages to archives in the shared folder, reads them back, and returns per page its id,
    payload_bytes, payload_digest, record_type and refers_to, all taken from the archives.

    Null payloads count as empty; see with_revisits() for repeats and null ids. Other columns are not read.
    """
    files = write_warc(pages, shared_dir(pages.sparkSession, "warc"), id_col, url_col, payload_col, least_bytes)
    kind = pages.schema[id_col].dataType
    number = lambda c: F.expr(f"try_cast(nullif(regexp_extract({c}, '^urn:page:(.*)$', 1), '') as {kind.simpleString()})")
    digest = F.when(F.col("record_type") == "response", base32_sha1(F.col("payload"))).otherwise(F.regexp_replace("payload_digest", "^sha1:", ""))
    return read_warc(files, split_bytes).select(number("record_id").alias(id_col), F.col("payload_length").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))
