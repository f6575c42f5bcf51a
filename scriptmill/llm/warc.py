"""WARC: writes pages as record archives and reads archives back, salvaging what damage leaves."""

import base64
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from hashlib import sha1

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from scriptmill.llm.common import bounded, stage, table
from scriptmill.session import new_path

#: payloads of at least so many bytes are stored once, their copies become revisit records
REVISIT_BYTES = 1000
#: an archive is closed when it has so many bytes
ARCHIVE_BYTES = 64 << 20
#: bytes read from an archive at a time
READ_BYTES = 1 << 20
#: archives are read by at most so many tasks
READERS = 20_000
#: bytes a search for the next record holds at most
HEADER_BYTES = 1 << 16
#: a record that claims more is damaged; bounds what one record may hold in memory
RECORD_BYTES = 256 << 20

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = ("archive string, offset long, kind string, page_id string, url string, payload_bytes long, "
           "payload_digest string, refers_to string, payload binary, gap_bytes long, reason string")
ARCHIVES = "archive string, records long, bytes long"


def _open(path: str, mode: str):
    system, name = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    if mode == "r":
        return system.open_input_stream(name, compression=None)
    system.create_dir(name.rpartition("/")[0], recursive=True)
    return system.open_output_stream(name, compression=None)


def _clean(value: str | None) -> str:
    """A header value without control characters."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value or "")


def encode_record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One record as a gzip member. The block is an HTTP answer; a revisit's has the head alone."""
    base32 = base64.b32encode(bytes.fromhex(digest)).decode()
    head = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
            ).encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Target-URI: {_clean(url)}",
             "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{base32}",
             f"WARC-Block-Digest: sha1:{base64.b32encode(sha1(block).digest()).decode()}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    data = "\r\n".join(lines).encode() + block + b"\r\n\r\n"
    if len(data) > RECORD_BYTES:
        raise ValueError(f"the record of page {page_id} has {len(data)} bytes, more than {RECORD_BYTES}, and could not be read again")
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes (page_id, url, payload binary, digest, refers_to) as archives; returns their manifest, staged.

    A retried task writes files with other names, and the manifest only names those of the tasks whose rows
    arrived, so lost executors leave no doubled records. Empty partitions write nothing.
    """
    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, count, size, done = None, "", 0, 0, []
        for batch in batches:
            for row in zip(*(batch.column(c) for c in names), strict=True):
                data = encode_record(*(v.as_py() for v in row))
                if out is None:
                    path, count, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = _open(path, "w")
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= archive_bytes:
                    out.close()
                    out, done = None, [*done, (path, count, size)]
        if out is not None:
            out.close()
            done.append((path, count, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["archive", "records", "bytes"])

    names = ["page_id", "url", "payload", "digest", "refers_to"]
    return stage(records.select(names).mapInArrow(write, ARCHIVES), "archives")


class _Bytes:
    """A stream with a buffer in front: `at` is the offset of the buffer's first byte."""

    def __init__(self, stream):
        self.stream, self.held, self.at, self.ended = stream, b"", 0, False

    def fill(self, n: int) -> bool:
        """Holds at least n bytes, if there are so many."""
        while len(self.held) < n and not self.ended:
            more = self.stream.read(max(READ_BYTES, n - len(self.held)))
            self.ended, self.held = not more, self.held + more
        return len(self.held) >= n

    def drop(self, n: int) -> None:
        self.held, self.at = self.held[n:], self.at + n


def _parse(data: bytes) -> tuple[dict, str]:
    """A whole record's fields, or why it is damaged. `data` ends with the record."""
    head, found, block = data.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"WARC/1."):
        return {}, "no record header"
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            fields[name.strip().lower()] = value.strip()
    length = fields.get("content-length", "")
    if not length.isdigit() or len(block) != int(length) + 4 or not block.endswith(b"\r\n\r\n"):
        return {}, "wrong length"
    block = block[:-4]
    told = fields.get("warc-block-digest", "")
    if told.startswith("sha1:") and told[5:] != base64.b32encode(sha1(block).digest()).decode():
        return {}, "wrong block digest"
    payload, size = block, None
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        if m := re.search(rb"(?im)^content-length:\s*(\d+)", http):
            size = int(m[1])
    revisit = fields.get("warc-type") == "revisit"
    told = fields.get("warc-payload-digest", "")
    if not revisit and told.startswith("sha1:") and told[5:] != base64.b32encode(sha1(payload).digest()).decode():
        return {}, "wrong payload digest"
    try:
        digest = base64.b32decode(told[5:]).hex() if told.startswith("sha1:") else sha1(payload).hexdigest()
    except ValueError:
        return {}, "wrong payload digest"

    def page(name: str) -> str | None:
        m = re.fullmatch(r"<urn:page:(.*)>", fields.get(name, ""))
        return (None if m[1] == "None" else m[1]) if m else fields.get(name)

    return {"kind": fields.get("warc-type", "unknown"), "page_id": page("warc-record-id"),
            "url": fields.get("warc-target-uri"), "payload_digest": digest, "refers_to": page("warc-refers-to"),
            "payload_bytes": size if revisit and size is not None else len(payload),
            "payload": None if revisit else payload}, ""


def _plain_length(source: _Bytes) -> int:
    """Bytes of the uncompressed record at the front; 0 where none begins or it is cut off."""
    source.fill(HEADER_BYTES)
    end = source.held.find(b"\r\n\r\n", 0, HEADER_BYTES)
    m = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", source.held[:max(end, 0)])
    if not m or int(m[1]) > RECORD_BYTES:
        return 0
    n = end + 8 + int(m[1])
    return n if source.fill(n) else 0


def _member(source: _Bytes) -> tuple[bytes, int]:
    """The gzip member at the front and its compressed length; (b'', 0) where it is damaged or cut off."""
    unpack, parts, size, at = zlib.decompressobj(31), [], 0, 0
    try:
        while not unpack.eof:
            if not source.fill(at + 1):
                return b"", 0
            chunk = source.held[at:at + READ_BYTES]
            at += len(chunk)
            parts.append(unpack.decompress(chunk, RECORD_BYTES - size + 1))
            size += len(parts[-1])
            if size > RECORD_BYTES or unpack.unconsumed_tail:
                return b"", 0
    except zlib.error:
        return b"", 0
    return b"".join(parts), at - len(unpack.unused_data)


def salvage(stream) -> Iterator[dict]:
    """Records of one archive in order; every span of bytes that gave none is a row of kind `gap`.

    Gzip members and uncompressed records may be mixed. A record counts if its length, block digest and
    payload digest hold; else the search goes on one byte later for the next member or version line.
    """
    source, gap, why = _Bytes(stream), None, ""
    while source.fill(1):
        record, n, reason = {}, 0, "no record starts here"
        if source.fill(3) and source.held[:3] == b"\x1f\x8b\x08":
            data, n = _member(source)
            record, reason = _parse(data) if n else ({}, "damaged member")
        elif source.held.startswith(b"WARC/1."):
            n = _plain_length(source)
            record, reason = _parse(source.held[:n]) if n else ({}, "damaged header or cut off")
        if record:
            if gap is not None:
                yield {"kind": "gap", "offset": gap, "gap_bytes": source.at - gap, "reason": why}
                gap = None
            yield record | {"offset": source.at}
            source.drop(n)
            continue
        if gap is None:
            gap, why = source.at, reason
        source.fill(HEADER_BYTES)
        m = re.compile(rb"\x1f\x8b\x08|WARC/1\.").search(source.held, 1)
        source.drop(m.start() if m else max(1, len(source.held) - 6) if not source.ended else len(source.held))
    if gap is not None:
        yield {"kind": "gap", "offset": gap, "gap_bytes": source.at - gap, "reason": why}


def read_archives(archives: DataFrame, with_payload: bool = True, whole: bool = False) -> DataFrame:
    """All records and quarantined gaps of the archives named in column `archive`.

    As many tasks as there are archives, READERS at most, read them; a table of names is counted for that.
    Streams each archive, holding one record at a time. Null names are skipped, an empty archive gives no
    rows, one that cannot be opened fails the job; with `whole` so does one that gives another number of records than its column
    `records` says. Record ids other than page ids are kept as they stand.
    """
    columns = [f.split()[0] for f in RECORDS.split(", ")]
    kinds = {"offset": pa.int64(), "payload_bytes": pa.int64(), "gap_bytes": pa.int64(), "payload": pa.binary()}

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, told in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                count = 0
                with _open(name, "r") as stream:
                    rows, size = [], 0
                    for row in salvage(stream):
                        size += len(row.get("payload") or b"") + 500
                        count += row["kind"] != "gap"
                        rows.append(row | {"archive": name} if with_payload else row | {"archive": name, "payload": None})
                        if size > 4 << 20:
                            yield batch_of(rows)
                            rows, size = [], 0
                    if rows:
                        yield batch_of(rows)
                if told is not None and count != told:
                    raise ValueError(f"{name} gave {count} of {told} records")

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r.get(c) for r in rows], kinds.get(c, pa.string())) for c in columns], columns)

    names = archives.select("archive", (F.col("records") if whole else F.lit(None)).cast("long").alias("records")).where("archive is not null")
    # An explicit number, which AQE keeps; it would join a few names to one task.
    spread = names.repartition(max(1, min(names.count(), READERS)))
    return spread.mapInArrow(read, RECORDS)


def revisits(pages: DataFrame, key: str = "page_id", url: str = "url", text: str = "html",
             least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, digest, refers_to: of equal payloads of at least `least` bytes the row with the
    largest key is the response, the others refer to it.

    Null text is an empty payload. A null key counts as smallest; rows that share the largest key are all
    responses. Only narrow rows (digests, keys) are grouped, after partial sums. The repeated digests are staged:
    where a count proves that they are few they are broadcast, and no payload moves; otherwise AQE can split a
    payload that most rows share. Payloads below `least` bytes find nothing in the join.
    """
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"),
                        F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("payload")).select(
        "*", F.octet_length("payload").alias("size"), F.sha1("payload").alias("digest"))
    large = F.col("size") >= least
    first = stage(rows.where(large).groupBy(F.col("digest").alias("same"), F.col("size").alias("length")).agg(
        F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "responses")
    refers = F.when(F.col("first").eqNullSafe(F.col("page_id")), None).otherwise(F.col("first"))
    # Small payloads have no digest to meet, so that the many empty ones are not one key.
    same = (F.when(large, F.col("digest")) == F.col("same")) & (F.col("size") == F.col("length"))
    return rows.join(bounded(first), same, "left").select(
        "page_id", "url", "payload", "digest", refers.alias("refers_to"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = revisits(table(spark, sf_dir, "pages"))
    kind = records.schema["page_id"].dataType
    archives = write_archives(records, new_path(spark, "warc"))
    return read_archives(archives, with_payload=False, whole=True).where("kind <> 'gap'").select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest",
        F.col("kind").alias("record_type"), F.col("refers_to").cast(kind).alias("refers_to"))


SQL = """
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
d as (select page_id, octet_length(b) as n, sha1(b) as digest from p),
g as (select *, max(page_id) over (partition by digest, n) as top from d)
select page_id, n as payload_bytes, digest as payload_digest,
  case when n >= 1000 and top <> page_id then 'revisit' else 'response' end as record_type,
  case when n >= 1000 and top <> page_id then top end as refers_to from g
"""
