"""WARC archives: written from a table of pages, read back, and assembled into captures.

Every page becomes three records that name each other: a response (or a revisit, if an earlier page holds the same payload), its request
and its metadata. Spark's text writer makes the files, by the byte: each record is a gzip member whose last byte, always zero, is
the writer's line separator. The reader takes records by their stated length. Assembly joins records through their concurrent-to identifiers,
whichever record names the other and over however many records.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.llm.components import connected_components
from hirelake.llm.shared import give_back, small_batches, staged

EOL = "\r\n"
VERSION = "WARC/1.1"
#: Fixed value: the profile of revisits by equal payload.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A file ends with the record that reaches this size.
FILE_BYTES = 32 << 20
EMPTY_MEMBER = b"\x1f\x8b\x08" + bytes(6) + b"\xff\x03" + bytes(9)
RECORD_SCHEMA = (
    "record_id string, type string, concurrent_to array<string>, refers_to string, target_uri string, date string, "
    "payload_digest string, payload_bytes long, computed_digest string, block string"
)


def base32_sha1(data):
    """SHA-1 of a binary or text column in upper-case base32: five hex digits make four letters."""
    digits = F.sha1(data)
    quads = [F.lpad(F.conv(F.substring(digits, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*quads), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(kind: str, *cols):
    h = F.md5(F.to_json(F.struct(F.lit(kind).alias("kind"), *cols)).cast("binary"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(kind, record_id, uri, date: str, content_type: str, block, *headers):
    """Header lines, an empty line, the block. Null headers are left out."""
    lines = [F.lit(VERSION), F.concat(F.lit("WARC-Type: "), kind if not isinstance(kind, str) else F.lit(kind)), F.concat(F.lit("WARC-Record-ID: "), record_id), F.lit(f"WARC-Date: {date}"), F.concat(F.lit("WARC-Target-URI: "), uri), *headers]
    lines += [F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(EOL, *lines), F.lit(EOL * 2), block)


def _members(compressed: bool):
    """Records as gzip members without their last byte (or as they are), with the number of the file within the task."""

    def run(batches):
        part = size = 0
        for batch in batches:
            parts, values, weight = [], [], 0
            for value in batch.column(0):
                raw = value.as_py()
                if compressed:
                    pack = zlib.compressobj(wbits=31)
                    raw = pack.compress(raw + EOL.encode() * 2) + pack.flush()
                    if raw[-1]:  # 16 MiB or more: the length's first byte is not zero
                        raw += EMPTY_MEMBER
                    raw = raw[:-1]
                parts.append(part)
                values.append(raw)
                size += len(raw)
                weight += len(raw)
                if size >= FILE_BYTES:
                    part, size = part + 1, 0
                if weight > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(values, pa.binary())], names=["part", "value"])
                    parts, values, weight = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(values, pa.binary())], names=["part", "value"])
        give_back()

    return run


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", compressed: bool = True) -> None:
    """Write the pages as WARC files of about ``FILE_BYTES`` under ``path``, each record a gzip member if ``compressed``.

    The payload is the html in UTF-8 (null: empty). Of pages with equal payloads of at least ``least_bytes`` bytes the one with the
    smallest id (then url) is the response and the others revisit it; smaller ones are all responses. A page with a null id is a revisit where
    its payload has a page with an id. A null url leaves the target out; line ends in a url are percent-encoded. Rows that repeat id, url and html
    repeat their records, identifiers included.
    """
    small_batches(pages.sparkSession)
    uri = F.replace(F.replace(F.col(url_col), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    rows = pages.select(F.col(id_col).alias("id"), uri.alias("uri"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", base32_sha1(F.col("html"))).withColumn("n", F.octet_length("html"))
    firsts = (
        rows.filter(F.col("n") >= least_bytes).groupBy("digest", "n")
        .agg(F.min(F.when(F.col("id").isNotNull(), F.struct("id", "uri"))).alias("first"), F.count("*").alias("many"))
        .filter("many > 1 and first is not null").select(F.col("digest").alias("_digest"), F.col("n").alias("_n"), "first")
    )
    firsts = staged(firsts, "firsts")
    told = rows.join(firsts, (rows["digest"] == firsts["_digest"]) & (rows["n"] == firsts["_n"]), "left")
    same = F.col("first.id").eqNullSafe(F.col("id")) & F.col("first.uri").eqNullSafe(F.col("uri"))
    revisit = F.col("first").isNotNull() & ~same
    own = [F.col("id"), F.col("uri"), F.col("digest")]
    response_id = _urn("response", *own)
    concurrent = F.concat(F.lit("WARC-Concurrent-To: "), response_id)
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("n").cast("string"), F.lit(EOL * 2))
    refers = F.concat(F.lit("WARC-Refers-To: "), _urn("response", F.col("first.id").alias("id"), F.col("first.uri").alias("uri"), F.col("digest")))
    response = _record(
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")), response_id, F.col("uri"), date, "application/http;msgtype=response",
        F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")), F.when(revisit, refers), F.when(revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
    )
    get = F.concat(F.lit("GET "), F.coalesce("uri", F.lit("")), F.lit(f" HTTP/1.1{EOL}{EOL}"))
    request = _record("request", _urn("request", *own), F.col("uri"), date, "application/http;msgtype=request", get, concurrent)
    fields = F.concat_ws(EOL, F.concat(F.lit("page-id: "), F.col("id").cast("string")), F.concat(F.lit("payload-bytes: "), F.col("n").cast("string")))
    metadata = _record("metadata", _urn("metadata", *own), F.col("uri"), date, "application/warc-fields", fields, concurrent)
    records = told.select(F.explode(F.array(*[r.cast("binary") for r in (request, response, metadata)])).alias("value")).mapInArrow(_members(compressed), "part int, value binary")
    end = "\x00" if compressed else EOL * 2
    records.withColumn("value", F.col("value").cast("string")).write.partitionBy("part").option("lineSep", end).option("compression", "none").text(path)


def _chunks(raw: bytes) -> Iterator[bytes]:
    """The file's bytes in pieces, unpacked if gzip (one member or many)."""
    if raw[:2] != b"\x1f\x8b":
        yield raw
        return
    unpack, rest, full = None, b"", False
    for k in range(0, len(raw), 1 << 16):
        rest += raw[k : k + (1 << 16)]
        while rest or full:
            unpack = unpack or zlib.decompressobj(31)
            piece = unpack.decompress(rest, 1 << 20)
            full = len(piece) == 1 << 20 and not unpack.eof  # more may wait inside
            rest = unpack.unused_data if unpack.eof else unpack.unconsumed_tail
            unpack = None if unpack.eof else unpack
            if piece:
                yield piece


CONCURRENT = "warc-concurrent-to"


def records_in(raw: bytes):
    """(headers in lower case, block) of each whole record; of what it is concurrent to a list, as that may be told again and again. Bytes that start no record are passed over up to the next
    ``WARC/`` after an empty line; a record cut short at the end of the file is left out."""
    source, buffer, ended, at = _chunks(raw), bytearray(), False, 0

    def more() -> bool:
        nonlocal ended, at
        del buffer[:at]
        at = 0
        piece = next(source, None)
        ended = piece is None
        buffer.extend(piece or b"")
        return not ended

    while True:
        head = buffer.find(b"\r\n\r\n", at)
        if head < 0:
            if not more():
                return
            continue
        lines = bytes(buffer[at:head]).lstrip(b"\r\n").decode("utf-8", "replace").split("\r\n")
        headers = {CONCURRENT: []}
        for k, _, v in (line.partition(":") for line in lines[1:]):
            k, v = k.strip().lower(), v.strip()
            headers[k] = headers[k] + [v] if k == CONCURRENT else v
        size = headers.get("content-length", "")
        if not lines[0].startswith("WARC/") or not size.isdigit():
            at = head + 4
            continue
        end = head + 4 + int(size)
        while len(buffer) < end:
            shift = at
            if not more():
                return
            head, end = head - shift, end - shift
        yield headers, bytes(buffer[head + 4 : end])
        at = end


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records of the WARC files under ``path`` (columns of ``RECORD_SCHEMA``).

    For responses and revisits ``payload_digest`` is what the header states, ``computed_digest`` and ``payload_bytes`` are those of
    the payload in the file, and ``block`` is the payload as text; for others ``block`` is the record's block. A file must
    fit a Spark binary value (2 GB).
    """

    def run(batches):
        names = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]
        kinds = [{"payload_bytes": pa.int64(), "concurrent_to": pa.list_(pa.string())}.get(n, pa.string()) for n in names]
        for batch in batches:
            for value in batch.column(0):
                rows, weight = [], 0
                for h, block in records_in(value.as_py()):
                    kind = h.get("warc-type")
                    n = digest = None
                    if kind in ("response", "revisit"):
                        block = block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block
                        n, digest = len(block), base64.b32encode(hashlib.sha1(block).digest()).decode()
                    stated = h.get("warc-payload-digest")
                    rows.append((h.get("warc-record-id"), kind, h[CONCURRENT], h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-date"), stated and stated.rpartition(":")[2], n, digest, block.decode("utf-8", "replace")))
                    weight += len(block)
                    if weight > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                        rows, weight = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
        give_back()

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, RECORD_SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, request, response, metadata, copies.

    Records belong together that name each other as concurrent, in either direction and over any number of records in between.
    Of several records of one kind the largest by identifier stands in the row (nothing is gathered, so a capture with very many is no
    burden); a kind that is absent is null. ``capture_id`` is the response's identifier, or else the least in the capture. ``copies`` is
    how often responses were found (1 where there is none). Records without an identifier are left out.
    """
    records = staged(records.filter("record_id is not null").withColumn("number", F.monotonically_increasing_id()), "records")
    fields = [c for c in records.columns if c not in ("type", "number")]
    of = lambda kinds: F.max(F.when(F.col("type").isin(*kinds), F.struct(*fields[:1], "type", *fields[1:])))
    answers = F.col("type").isin("response", "revisit")
    # All records that bear or name an identifier are tied to the first of them, whether or not there is a record of that identifier.
    names = records.select("number", F.explode(F.array_union(F.array("record_id"), F.coalesce("concurrent_to", F.array().cast("array<string>")))).alias("name"))
    ties = names.join(names.groupBy("name").agg(F.min("number").alias("first")), "name").filter("number <> first")
    labels = connected_components(ties.select(F.col("number").alias("a"), F.col("first").alias("b")))
    return (
        records.join(labels, records["number"] == labels["node"], "left").groupBy(F.coalesce("label", "number").alias("label"))
        .agg(of(["request"]).alias("request"), of(["response", "revisit"]).alias("response"), of(["metadata"]).alias("metadata"), F.min("record_id").alias("least"), F.greatest(F.sum(answers.cast("long")), F.lit(1)).alias("copies"))
        .select(F.coalesce("response.record_id", "least").alias("capture_id"), "request", "response", "metadata", "copies")
    )


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """Captures with the size and page of the full payload: page_id (text), payload_bytes, payload_digest, record_type, refers_to_page."""
    page = lambda c: F.nullif(F.regexp_extract(c, r"page-id: ([^\r\n]*)", 1), F.lit(""))
    flat = staged(
        captures.filter("response is not null").select(
            "capture_id", page(F.col("metadata.block")).alias("page_id"), F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("refers_to"),
            F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.computed_digest").alias("digest"), "copies",
        ),
        "captures",
    )
    first = flat.filter("record_type = 'response'")
    again = flat.filter("record_type = 'revisit'").alias("v").join(first.alias("r"), F.col("v.refers_to") == F.col("r.capture_id"), "left")
    revisits = again.select(F.col("v.page_id").alias("page_id"), F.col("r.payload_bytes").alias("payload_bytes"), F.col("r.digest").alias("payload_digest"), F.col("v.record_type").alias("record_type"), F.col("r.page_id").alias("refers_to_page"), F.col("v.copies").alias("copies"))
    plain = first.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast("string").alias("refers_to_page"), "copies")
    return plain.unionByName(revisits)
