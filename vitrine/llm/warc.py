"""WARC archives and revisit resolution.

Plan
----
1. ``mapInArrow`` writes every page as a response record into archives of
   bounded size (one gzip member a record; a file is written under an
   attempt's own name and moved in place, so a repeated task replaces it).
2. The archives are read back as headers only: place, length and SHA-1 of the
   payload. Headers, not payloads, are shuffled by digest: per digest a partial
   ``max`` over (record id, place) picks the response, so a payload that a third
   of all pages share never meets in one task; the join that hands the response
   to the other records is one that adaptive execution may split.
3. The decisions go back to their archives, each of which is copied once more
   with fresh headers: a revisit record has no payload and names the response
   (WARC-Refers-To, -Target-URI, -Date, payload digest).

Equal payloads are payloads of one length and one SHA-1.

Cases: a null payload is empty; payloads below ``least_bytes`` are never revisits;
of records with equal payload and equal id (repeated rows) the one in the last
place of the last archive is the response and the others refer to its id; a
null url is written as an empty URI, bytes of a url that are not UTF-8 are replaced (a
payload keeps its bytes, whatever they are); a null id ranks below every other; a
payload of any length is one record, held by its task while it is written or read;
other columns are ignored; an empty table writes no archive.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import common as C

VERSION = b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST_BYTES = 1000
ARCHIVE_BYTES = 1 << 26
LEVEL = 1
ARCHIVES = "archive string, records bigint"
HEADERS = ("archive string, place bigint, record_type string, record_id bigint, record_name string, uri string, "
           "date string, payload_bytes bigint, payload_digest string, refers_to bigint")
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


# --- records ---------------------------------------------------------------------

def record_name(archive: str, place: int) -> str:
    """The same for every attempt at the same record."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{os.path.basename(archive)}#{place}')}>"


def _clean(value: str) -> str:
    return " ".join(value.split())


def record(headers: dict[str, str], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    lines = [VERSION] + [f"{k}: {_clean(v)}".encode() for k, v in headers.items()]
    lines += [b"Content-Length: %d" % len(block), b"", b""]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(b"\r\n".join(lines) + block + b"\r\n\r\n") + packer.flush()


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    headers = {}
    for line in lines[1:]:
        name, _, value = line.decode("utf-8", "replace").partition(":")
        headers[name.lower()] = value.strip()
    return headers, rest[:int(headers["content-length"])]


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """The HTTP body of a response; a revisit has none."""
    return block.partition(b"\r\n\r\n")[2] if headers["warc-type"] == "response" else b""


def read_records(path: str, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive, one after the other."""
    system, name = C.file_system(path)
    with system.open_input_stream(name, compression=None) as source:
        rest, unpack, parts = b"", zlib.decompressobj(31), []
        while True:
            data = rest or source.read(chunk)
            if not data:
                if parts:
                    raise ValueError(f"cut record in {path}")
                return
            parts.append(unpack.decompress(data))
            rest = unpack.unused_data
            if unpack.eof:
                yield b"".join(parts)
                unpack, parts = zlib.decompressobj(31), []


def _response(archive: str, place: int, record_id: int | None, uri: str, date: str, digest: str, body: bytes) -> bytes:
    return record({"WARC-Type": "response", "WARC-Record-ID": record_name(archive, place), "WARC-Date": date,
                   "WARC-Target-URI": uri, "WARC-Payload-Digest": f"sha1:{digest}",
                   "X-Record-Number": "" if record_id is None else str(record_id),
                   "X-Payload-Length": str(len(body)),
                   "Content-Type": "application/http; msgtype=response"}, HTTP + body)


# --- writing and reading archives ----------------------------------------------------

def _archives_schema() -> pa.Schema:
    return pa.schema([("archive", pa.string()), ("records", pa.int64())])


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[bytes] = []
        size = number = 0

        def name() -> str:
            return os.path.join(folder, f"pages-{part:06d}-{number:06d}.warc.gz")

        def flush() -> pa.RecordBatch:
            C.write_file(name(), lambda out: out.write(b"".join(held)))
            return pa.RecordBatch.from_pylist([{"archive": name(), "records": len(held)}], _archives_schema())

        for batch in batches:
            for record_id, uri, body in zip(*(batch.column(c) for c in ("record_id", "uri", "body"))):
                body = body.as_py()
                held.append(_response(name(), len(held), record_id.as_py(), uri.as_py().decode("utf-8", "replace"), DATE,
                                      hashlib.sha1(body).hexdigest(), body))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
                    held, size, number = [], 0, number + 1
        if held:
            yield flush()
    return run


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write pages (record_id, uri, body) as response records; returns the
    table of archives."""
    return C.through_table(pages.select("record_id", F.col("uri").cast("binary").alias("uri"), "body").mapInArrow(
        _write(folder), ARCHIVES), "archives")


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def number(value: str | None) -> int | None:
        return int(value) if value else None

    for batch in batches:
        for archive in batch.column("archive").to_pylist():
            rows = []
            for place, raw in enumerate(read_records(archive)):
                h, block = parse(raw)
                body = payload_of(h, block)
                full = h["warc-type"] == "response"
                digest = h["warc-payload-digest"].partition(":")[2]
                if full and hashlib.sha1(body).hexdigest() != digest:
                    raise ValueError(f"payload digest differs in {archive}, record {place}")
                rows.append((archive, place, h["warc-type"], number(h.get("x-record-number")), h["warc-record-id"],
                             h.get("warc-target-uri", ""), h["warc-date"],
                             len(body) if full else int(h["x-payload-length"]), digest,
                             number(h.get("x-refers-to-number"))))
            names = [x.split()[0] for x in HEADERS.split(", ")]
            kinds = [pa.string() if x.endswith("string") else pa.int64() for x in HEADERS.split(", ")]
            for at in range(0, len(rows), 10_000):
                columns = list(zip(*rows[at:at + 10_000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def read_headers(archives: DataFrame) -> DataFrame:
    """One row per record of the archives (column ``archive``), without payloads."""
    n = max(1, min(archives.count(), 10_000))
    return archives.select("archive").repartition(n, "archive").mapInArrow(_headers, HEADERS)


# --- revisits ------------------------------------------------------------------------

def resolve(headers: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Per record the response it repeats: columns ``to_id``, ``to_name``,
    ``to_uri`` and ``to_date``, null for responses."""
    large = headers.where(F.col("payload_bytes") >= least_bytes)
    kept = large.groupBy("payload_digest", "payload_bytes").agg(
        F.max(F.struct("record_id", "archive", "place", "record_name", "uri", "date")).alias("to"),
        F.count("*").alias("n")).where("n > 1").drop("n")
    kept = kept.withColumnsRenamed({"payload_digest": "d", "payload_bytes": "b"})
    joined = headers.join(kept, (F.col("payload_digest") == F.col("d")) & (F.col("payload_bytes") == F.col("b")), "left")
    other = (F.col("to.archive") != F.col("archive")) | (F.col("to.place") != F.col("place"))
    return joined.select(*headers.columns, *[
        F.when(other, F.col(f"to.{c}")).alias(a) for c, a in (
            ("record_id", "to_id"), ("record_name", "to_name"), ("uri", "to_uri"), ("date", "to_date"))])


def _copy(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_archive, source, held, count = None, None, None, 0

        def finish() -> pa.RecordBatch:
            name = os.path.join(folder, os.path.basename(open_archive))
            C.write_file(name, lambda out: out.write(b"".join(held)))
            return pa.RecordBatch.from_pylist([{"archive": name, "records": count}], _archives_schema())

        for batch in batches:
            for row in batch.to_pylist():
                if row["archive"] != open_archive:
                    if open_archive is not None:
                        yield finish()
                    open_archive, source, held, count = row["archive"], read_records(row["archive"]), [], 0
                headers, block = parse(next(source))
                body = payload_of(headers, block)
                base = {"WARC-Date": row["date"], "WARC-Target-URI": row["uri"],
                        "WARC-Payload-Digest": f"sha1:{row['payload_digest']}",
                        "X-Record-Number": "" if row["record_id"] is None else str(row["record_id"]),
                        "X-Payload-Length": str(row["payload_bytes"])}
                if row["to_name"] is None:
                    out = record({"WARC-Type": "response", "WARC-Record-ID": row["record_name"], **base,
                                  "Content-Type": "application/http; msgtype=response"}, HTTP + body)
                else:
                    out = record({"WARC-Type": "revisit", "WARC-Record-ID": row["record_name"], **base,
                                  "WARC-Profile": PROFILE, "WARC-Refers-To": row["to_name"],
                                  "WARC-Refers-To-Target-URI": row["to_uri"], "WARC-Refers-To-Date": row["to_date"],
                                  "X-Refers-To-Number": "" if row["to_id"] is None else str(row["to_id"]),
                                  "Content-Type": "application/http; msgtype=response"}, HTTP)
                held.append(out)
                count += 1
        if open_archive is not None:
            yield finish()
    return run


def deduplicate(archives: DataFrame, folder: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Copy archives of responses below ``folder`` with repeated payloads as
    revisit records; returns the table of new archives."""
    plan = resolve(read_headers(archives), least_bytes)
    dealt = plan.repartition("archive").sortWithinPartitions("archive", "place")
    return C.through_table(dealt.mapInArrow(_copy(folder), ARCHIVES), "archives")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = C.read_table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("bigint").alias("record_id"), F.coalesce("url", F.lit("")).alias("uri"),
        C.text_bytes("html").alias("body"))
    raw = write_archives(pages, C.work_dir(spark, "warc"))
    done = deduplicate(raw, C.work_dir(spark, "warc-dedup"))
    return C.few_files(read_headers(done).select(
        F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"))
