"""WARC archives: writing, reading, and revisit records for equal payloads.

Only headers (digest, id, address) are shuffled, by payload digest, to find the
response of each group of equal payloads. The archives are then written anew:
one response with the payload, revisit records that refer to it without one,
all with fresh record ids, dates and lengths. Records go through Spark's own
text writer, whose line end is the last byte of a record, so the files appear
by its commit protocol and a task that runs again leaves no half file. Reading goes
by Content-Length, so a payload may hold anything.

Cases: a null payload is empty. A null page id is written without an id and
never becomes a response if another page of the group has an id; without any id
all of the group are responses. Rows that repeat the smallest page id are all
responses. A null address is empty; line ends in it are percent-encoded.
An empty table gives archives without records.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from editlift.llm.common import staged, text_or_empty
from editlift.session import broadcast_if_small

#: Payloads below this many bytes are always written.
LEAST_BYTES = 100

#: Bounds an archive file: so many records of a task go to one file.
RECORDS_PER_FILE = 1000

EOL = "\r\n"
HTTP = f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "

RECORD = "page_id long, record_id string, record_type string, url string, refers_to_record string, payload_digest string, payload binary"


def record_id(page_id: Column, digest: Column) -> Column:
    """A name that a revisit can state without having seen the response."""
    h = F.md5(F.concat_ws("/", F.coalesce(page_id.cast("string"), F.lit("-")), digest))
    dashed = F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    return F.concat(F.lit("<urn:uuid:"), dashed, F.lit(">"))


def digested(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, size), payloads as text."""
    rows = pages.select(
        pages[id_col].cast("long").alias("page_id"), text_or_empty(url_col).alias("url"), text_or_empty(payload_col).alias("payload")
    )
    return rows.select("*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("size"))


def resolve_revisits(records: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Records with ``original_id`` and ``original_url``, null for responses."""
    headers = records.where(F.col("size") >= least_bytes).select("digest", "page_id", "url")
    originals = (
        headers.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct(F.col("page_id").isNull(), "page_id", "url")).alias("first"))
        .where((F.col("n") > 1) & F.col("first.page_id").isNotNull())
        .select("digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))
    )
    # The records stay where they are while the repeated digests are few; beyond
    # that the join is dealt out by digest, and a hot digest is split on the left.
    joined = records.join(broadcast_if_small(originals), "digest", "left")
    revisit = F.col("first_id").isNotNull() & (F.col("size") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select(
        *records.columns, F.when(revisit, F.col("first_id")).alias("original_id"), F.when(revisit, F.col("first_url")).alias("original_url")
    )


def write_archives(records: DataFrame, path: str, date: str | None = None, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Gzipped WARC files below ``path``."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    revisit = F.col("original_id").isNotNull()
    clean = lambda c: F.regexp_replace(F.regexp_replace(c, "\r", "%0D"), "\n", "%0A")
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(EOL))
    block = F.concat(F.lit(HTTP), F.col("size").cast("string"), F.lit(EOL * 2), F.when(revisit, "").otherwise(F.col("payload")))
    header = F.concat(
        F.lit(f"WARC/1.1{EOL}"),
        field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        field("WARC-Record-ID", record_id(F.col("page_id"), F.col("digest"))),
        field("WARC-Date", F.lit(date)),
        field("WARC-Target-URI", clean(F.col("url"))),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(F.col("page_id").isNull(), "").otherwise(field("X-Page-Id", F.col("page_id").cast("string"))),
        F.when(revisit, F.concat(
            field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            field("WARC-Refers-To", record_id(F.col("original_id"), F.col("digest"))),
            field("WARC-Refers-To-Target-URI", clean(F.col("original_url"))),
            field("WARC-Refers-To-Date", F.lit(date)),
        )).otherwise(""),
        field("Content-Type", F.lit("application/http;msgtype=response")),
        field("Content-Length", F.octet_length("block").cast("string")),
        F.lit(EOL),
    )
    whole = records.withColumn("block", block).select(F.concat(header, F.col("block"), F.lit("\r\n\r")).alias("value"))
    whole.write.option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def stream(content: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """Unpacked parts of a file that may be gzipped, also in several members."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    view = memoryview(content)
    unzip, at = zlib.decompressobj(31), 0
    while at < len(view) or unzip.unconsumed_tail:
        chunk = unzip.unconsumed_tail or view[at : at + step]
        at += 0 if unzip.unconsumed_tail else len(chunk)
        yield unzip.decompress(chunk, step)
        if unzip.eof:
            at -= len(unzip.unused_data)
            unzip = zlib.decompressobj(31)


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record of a file."""
    parts, buffer, at = stream(content), bytearray(), 0

    def have(n: int) -> bool:
        nonlocal buffer, at
        if at > 1 << 22:
            del buffer[:at]
            at = 0
        while len(buffer) - at < n:
            part = next(parts, None)
            if part is None:
                return False
            buffer += part
        return True

    while have(1):
        end, seen = -1, 0
        while end < 0:
            end = buffer.find(b"\r\n\r\n", at)
            if end < 0 and not have(len(buffer) - at + 1):
                raise ValueError("an archive ends inside a header")
        lines = bytes(buffer[at:end]).decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record header: {lines[0][:40]!r}")
        fields = {k.strip().lower(): v.strip(" ") for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(fields["content-length"])
        at = end + 4
        if not have(n + 4) or bytes(buffer[at + n : at + n + 4]) != b"\r\n\r\n":
            raise ValueError("an archive ends inside a block")
        yield fields, bytes(buffer[at : at + n])
        at += n + 4


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of all archives below ``path``; a response whose payload does not fit its digest raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in (c.strip().split() for c in RECORD.split(","))])
        for batch in batches:
            for k in range(batch.num_rows):
                rows, size = [], 0
                for fields, block in parse(batch.column(0)[k].as_py()):
                    payload = block.partition(b"\r\n\r\n")[2] if fields["warc-type"] == "response" else None
                    digest = fields["warc-payload-digest"].partition(":")[2]
                    if payload is not None and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"payload and digest differ in {fields['warc-record-id']}")
                    page = fields.get("x-page-id")
                    rows.append((
                        int(page) if page else None, fields["warc-record-id"], fields["warc-type"],
                        fields.get("warc-target-uri", ""), fields.get("warc-refers-to"), digest, payload,
                    ))
                    size += len(block)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, RECORD)


def resolve_payloads(records: DataFrame) -> DataFrame:
    """Records with ``payload_bytes`` and ``refers_to`` (a page id), revisits by joining their responses.

    Takes the narrow columns only. Ids of responses that repeat name the same payload, so they count once.
    """
    narrow = staged(records.select(
        "page_id", "record_id", "record_type", "refers_to_record", "payload_digest", F.octet_length("payload").cast("long").alias("own_bytes")
    ), "warc-headers")
    responses = narrow.where(F.col("record_type") == "response").groupBy("record_id").agg(
        F.min("page_id").alias("refers_to"), F.max("own_bytes").alias("their_bytes")
    )
    revisits = narrow.where(F.col("record_type") == "revisit").join(
        responses.withColumnRenamed("record_id", "refers_to_record"), "refers_to_record", "left"
    )
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    whole = narrow.where(F.col("record_type") == "response").select(
        "page_id", F.col("own_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")
    )
    return whole.unionByName(revisits.withColumn("payload_bytes", F.col("their_bytes")).select(*columns))
