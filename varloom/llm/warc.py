"""WARC archives with segmented records: writing, and reassembly of records from their continuations.

Reading: every archive file is parsed record by record by Content-Length; continuation records are grouped by
WARC-Segment-Origin-ID and put in the order of their segment numbers; the total length is verified; the HTTP
message is split from its head and chunked framing is decoded. A record that isn't segmented is whole where it is
read; only segments are shuffled. Archives are written by Spark's text writer
with the record end as line separator, so any file system that Spark can write will do. Segments and records
per file are bounded, so a file fits in a task's memory whatever the size of a payload.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm import common

SEGMENT_BYTES = 64 << 10
RECORDS_PER_FILE = 256
CHUNK = 8 << 10
#: Fixed text of the formats.
VERSION = b"WARC/1.1"
RECORD_END = "\r\n\r\n"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
REVISIT_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing."""
    parts = [b"%X\r\n%s\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes | None:
    """Payload of a chunked body (extensions and trailers are skipped); None if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            size = int(body[at:end].split(b";")[0].strip(), 16)
        except ValueError:
            return None
        if size < 0 or end + 2 + size > len(body):
            return None
        if size == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size
        if body[at : at + 2] != b"\r\n":
            return None
        at += 2


#: Payload digests that may be broadcast after they have been counted; beyond it the join shuffles the pages.
BROADCAST_DIGESTS = 125_000


def record_name(page_id: object, digest: str, occurrence: str = "") -> str:
    """Name of a page's record by its page_id and payload; rows that may share both have an occurrence besides."""
    return f"urn:x-page:{'null' if page_id is None else page_id}:{digest}" + (f":{occurrence}" if occurrence else "")


def _segment_id(name: str, segment: int = 1) -> str:
    return f"<{name}>" if segment == 1 else f"<{name}#{segment}>"


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))])
    return b"%s\r\n%s\r\n%s" % (VERSION, head.encode(), block)


def page_records(name: str, url: str | None, payload: bytes, digest: str, refers_to: str | None, segment_bytes: int) -> Iterator[bytes]:
    """A page's record, followed by its continuations where the block is longer than a segment."""
    target = "".join((url or "urn:x-no-address").split()) or "urn:x-no-address"
    fields = [("WARC-Record-ID", _segment_id(name)), ("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}")]
    fields.append(("Content-Type", "application/http; msgtype=response"))
    if refers_to is not None:
        yield _record([("WARC-Type", "revisit"), *fields, ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _segment_id(refers_to))], REVISIT_HEAD)
        return
    block = HTTP_HEAD + chunked(payload)
    if len(block) <= segment_bytes:
        yield _record([("WARC-Type", "response"), *fields], block)
        return
    pieces = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    yield _record([("WARC-Type", "response"), *fields, ("WARC-Segment-Number", 1)], pieces[0])
    for n, piece in enumerate(pieces[1:], 2):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", _segment_id(name, n)), ("WARC-Date", DATE), ("WARC-Target-URI", target)]
        more += [("WARC-Segment-Origin-ID", _segment_id(name)), ("WARC-Segment-Number", n)]
        if n == len(pieces):
            more.append(("WARC-Segment-Total-Length", len(block)))
        yield _record(more, piece)


def shared_payloads(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(sha, bytes, least, alone) of payloads that several rows have: the smallest page_id, and whether one row only has both.

    Payloads under min_bytes bytes have a null least: each of their rows is a response. A null page_id comes last.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select("page_id", F.unhex(F.sha1(payload)).alias("sha"), F.length(payload).cast("long").alias("bytes"))
    rows = rows.groupBy("sha", "bytes", "page_id").agg(F.count("*").alias("m"))
    least = F.min(F.struct(F.col("page_id").isNull().alias("missing"), "page_id", "m"))
    found = rows.groupBy("sha", "bytes").agg(least.alias("least"), F.sum("m").alias("n")).where("n > 1")
    known = F.col("bytes") >= min_bytes
    return found.select("sha", "bytes", F.when(known, F.col("least.page_id")).alias("least"), (known & (F.col("least.m") == 1)).alias("alone"), known.alias("merged"))


def write(pages: DataFrame, path: str, min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Archive every row of pages (page_id, url, html); null html is an empty payload.

    Of rows with equal payloads those with the smallest page_id are responses and the others revisits of it. Rows may
    repeat, and page_id may be null or stand for several payloads: every row has a record of its own. Rows that have both
    page_id and payload in common are all responses if that page_id is the smallest; null is greater than any.
    The pages themselves are not shuffled while payloads that occur twice are few enough to be broadcast.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    shared = common.materialise(shared_payloads(pages, min_bytes))
    rows = pages.select("page_id", "url", "html", F.unhex(F.sha1(payload)).alias("sha"), F.length(payload).cast("long").alias("bytes"))
    rows = rows.join(F.broadcast(shared) if shared.count() <= BROADCAST_DIGESTS else shared, ["sha", "bytes"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, written = TaskContext.get().partitionId(), 0
        for chunk in common.text_chunks(batches, "html"):
            out = []
            for row in chunk.to_pylist():
                key, digest = row["page_id"], base64.b32encode(row["sha"]).decode()
                revisit = bool(row["merged"]) and key != row["least"]
                single = row["merged"] is None or (row["alone"] and not revisit)
                name = record_name(key, digest, "" if single else f"{task}.{written}")
                body = (row["html"] or "").encode()
                out += page_records(name, row["url"], body, digest, record_name(row["least"], digest) if revisit else None, segment_bytes)
                written += 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    lines = rows.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", RECORD_END).option("maxRecordsPerFile", records_per_file).option("compression", "gzip").text(path)


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record of an archive; gzip (one member or many) is undone."""
    if archive[:2] == b"\x1f\x8b":
        archive = gzip.decompress(archive)
    at = 0
    while (at := archive.find(b"WARC/", at)) >= 0:
        end = archive.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = archive[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(head.get("content-length", 0))
        yield head, archive[end + 4 : end + 4 + size]
        at = end + 4 + size


def records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of all archives: kind, id, origin (of a continuation, else itself), segment (null where the record
    isn't segmented), total, digest, refers_to, block.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    schema = "kind string, id string, origin string, segment int, total bigint, digest string, refers_to string, block binary"
    kinds = [("kind", pa.string()), ("id", pa.string()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64())]
    kinds += [("digest", pa.string()), ("refers_to", pa.string()), ("block", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for head, block in parse(content.as_buffer().to_pybytes()):
                    name, number, total = head.get("warc-record-id"), head.get("warc-segment-number"), head.get("warc-segment-total-length")
                    rows.append(
                        {
                            "kind": head.get("warc-type"),
                            "id": name,
                            "origin": head.get("warc-segment-origin-id", name),
                            "segment": int(number) if number else None,
                            "total": int(total) if total else None,
                            "digest": head.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                            "refers_to": head.get("warc-refers-to"),
                            "block": block,
                        }
                    )
                yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds))

    return files.mapInArrow(run, schema)


def reassemble(parts: DataFrame) -> DataFrame:
    """One row per origin: kind, refers_to, digest as stored, payload (null if broken) and whole.

    whole is false where a segment is missing or twice with other bytes, the total length differs, the chunked
    framing is broken or a response's payload has another digest than the record says. Equal copies of a
    segment count once. A continuation without its origin gives a row with null kind. The group is one record;
    a record that isn't segmented is decoded where it is, and copies of it stay copies.
    """
    piece = F.struct(F.coalesce("segment", F.lit(1)).alias("segment"), "block", "total", "kind", "digest", "refers_to")
    segments = parts.where("segment is not null").groupBy("origin").agg(F.collect_list(piece).alias("pieces"))
    alone = parts.where("segment is null").select("origin", F.array(piece).alias("pieces"))
    kinds = [("origin", pa.string()), ("kind", pa.string()), ("digest", pa.string()), ("refers_to", pa.string())]
    kinds += [("payload", pa.binary()), ("whole", pa.bool_())]

    def one(origin: str | None, pieces: list[dict]) -> dict:
        first = next((p for p in pieces if p["kind"] != "continuation"), {"kind": None, "digest": None, "refers_to": None})
        by_number: dict[int, set[bytes]] = {}
        for p in pieces:
            by_number.setdefault(p["segment"], set()).add(p["block"])
        numbers = sorted(by_number)
        total = max((p["total"] for p in pieces if p["total"] is not None), default=None)
        block = b"".join(min(by_number[n]) for n in numbers)
        good = first["kind"] is not None and numbers == list(range(1, len(numbers) + 1)) and all(len(x) == 1 for x in by_number.values())
        good &= total == len(block) if len(numbers) > 1 else total in (None, len(block))
        head, _, body = block.partition(b"\r\n\r\n")
        payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
        if first["kind"] == "response":
            good &= payload is not None and first["digest"] in (None, digest32(payload))
        told = {c: first[c] for c in ("kind", "digest", "refers_to")}
        return {"origin": origin, **told, "payload": payload if good else None, "whole": good}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64).to_pylist()
                yield pa.RecordBatch.from_pylist([one(r["origin"], r["pieces"]) for r in part], pa.schema(kinds))

    schema = "origin string, kind string, digest string, refers_to string, payload binary, whole boolean"
    return alone.mapInArrow(run, schema).unionAll(segments.mapInArrow(run, schema))


def page_summary(reassembled: DataFrame) -> DataFrame:
    """Per archived page: page_id, payload_bytes, payload_digest, record_type, refers_to, whole.

    A revisit's payload size and digest are those of the response it refers to (its own page_id and digest tell which).
    """
    name = "^<urn:x-page:(-?[0-9]+|null):([A-Z2-7]{32})"

    def page(c: str):
        return F.regexp_extract(c, name, 1).try_cast("long")

    rows = reassembled.select(
        page("origin").alias("page_id"),
        F.col("kind").alias("record_type"),
        page("refers_to").alias("refers_to"),
        F.length("payload").cast("long").alias("own_bytes"),
        "digest",
        "whole",
        F.regexp_extract("refers_to", name, 2).alias("of_digest"),
    )
    rows = common.materialise(rows)
    responses = rows.where("record_type = 'response'").groupBy(F.col("page_id").alias("of_page"), F.col("digest").alias("of_digest")).agg(F.max("own_bytes").alias("of_bytes"))
    revisits = rows.where("record_type = 'revisit'").join(
        responses.withColumnRenamed("of_digest", "_digest"), F.col("refers_to").eqNullSafe(F.col("of_page")) & (F.col("of_digest") == F.col("_digest")), "left")
    done = revisits.select(
        "page_id",
        F.col("of_bytes").alias("payload_bytes"),
        F.when(F.col("of_bytes").isNotNull(), F.col("of_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
        (F.col("whole") & F.col("of_bytes").isNotNull() & (F.col("digest") == F.col("of_digest"))).alias("whole"),
    )
    others = rows.where("record_type is null or record_type <> 'revisit'")
    return others.select("page_id", F.col("own_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to", "whole").unionAll(done)


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write every page to archives, read them back, and sum each page up from what was read."""
    path = path or common.scratch_folder(pages.sparkSession)
    write(pages, path)
    return page_summary(reassemble(records(pages.sparkSession, path)))
