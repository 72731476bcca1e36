"""WARC archives: writing, reading, and resolving records of equal payload to revisits.

Records are written by Spark's text sink, one row per record with the record separator of the format as line separator,
into gzip files, so any file system Spark knows will do. Reading takes the files' lines in order and parses them as a
stream, by each record's own Content-Length.

Revisit resolution shuffles headers by payload digest, without payloads: of the records of a digest the one with the
largest page_id is the original. Its identity goes back to the headers by digest, and the archive is written with fresh
headers, responses with and revisits without their payload; a revisit also names the address and date of its original.
After reading, revisits are joined to the responses they refer to.

Scale: headers are numbered where they are read and stored without payloads, so that even repeated rows and rows without
a page_id are told apart with no window. Payloads cross the network once, copies as one row for each task, and take part
in no join. Joins of headers are plain and split by adaptive execution where a payload is frequent; a gzip file, which
can't be split, holds at most ``FILE_RECORDS`` records.

Nulls and ties: a null payload counts as empty. A null page_id is smaller than any other and is written without the
page's field. Of several records with the largest page_id of a payload, the one of the smallest url is the original.
Payloads under ``min_bytes`` are never deduplicated. Revisits read without their response in sight keep their reference.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.frames import arrow_map, batch
from tidemark.sources.staging import new_path, stage

FILE_RECORDS = 20_000
# Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RESPONSE_TYPE = "application/http;msgtype=response"
BREAK = "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: The record's page, an extension field.
PAGE_FIELD = "Page-Id"
RECORDS = "page_id long, url string, record_id string, record_type string, digest string, payload_bytes long, refers_to string, intact boolean"


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 in base 32, upper case: 160 bits are 32 letters, four for every five hex digits."""
    digits = F.sha1(payload)
    letters = []
    for at in range(0, 40, 5):
        number = F.conv(F.substring(digits, at + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            letters.append(F.substring(F.lit(BASE32), F.shiftright(number, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*letters)


def _record_id(page: Column, nth: Column, digest: Column) -> Column:
    seed = F.md5(F.concat(page.cast("string"), F.lit(":"), nth.cast("string"), F.lit(":"), digest))
    return F.regexp_replace(seed, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")


#: Stands for a missing page_id where records are matched.
NO_PAGE = -(1 << 63)


def resolved(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds record_id, record_type, refers_to and target_uri to (page_id, url, payload, digest, payload_bytes, has_payload,
    told), where ``told`` is what a revisit already referred to. Of a revisit the payload is empty."""
    records = records.withColumn("page", F.coalesce("page_id", F.lit(NO_PAGE)))
    shared = F.col("has_payload") & (F.col("payload_bytes") >= min_bytes)
    # the order in which records of a payload come up for its original: largest page first, whose complement is smallest
    rank = [F.bitwise_not("page").alias("from_last"), F.col("url").alias("uri")]
    small = F.when(F.col("has_payload") & ~shared, F.col("payload")).alias("small")
    headers = stage(
        records.select("page", *("page_id url digest payload_bytes has_payload told".split()), small, F.monotonically_increasing_id().alias("row")), "warc-headers"
    )
    first = headers.filter(shared).groupBy("digest").agg(F.min(F.struct(*rank, "row")).alias("original"))
    others = headers.join(first, "digest", "left").filter(F.col("original").isNull() | (F.col("row") != F.col("original.row")))
    kept = F.col("small").isNotNull()
    target = _record_id(F.bitwise_not("original.from_last"), F.lit(0), F.col("digest"))
    others = others.select(
        "page_id", "url", F.coalesce("small", F.lit("")).alias("payload"), "digest", "payload_bytes",
        _record_id(F.col("page"), F.col("row") + 1, F.coalesce("digest", F.lit(""))).alias("record_id"),
        F.when(kept, "response").otherwise("revisit").alias("record_type"), F.when(~kept, F.coalesce(target, "told")).alias("refers_to"),
        F.when(~kept, F.col("original.uri")).alias("target_uri"),
    )
    # copies are one row before anything crosses the network; no payload takes part in a join
    whole = F.min_by(F.struct("page_id", "page", "url", "payload", "payload_bytes"), F.struct(*rank)).alias("record")
    originals = records.filter(shared).groupBy("digest").agg(whole).select("record.*", "digest")
    originals = originals.select(
        "page_id", "url", "payload", "digest", "payload_bytes", _record_id(F.col("page"), F.lit(0), F.col("digest")).alias("record_id"),
        F.lit("response").alias("record_type"), F.lit(None).cast("string").alias("refers_to"), F.lit(None).cast("string").alias("target_uri"),
    )
    return originals.unionAll(others)


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null; line breaks in values would end the field."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value, "[\\r\\n]+", " "), F.lit(BREAK)), F.lit(""))


def record_text(date: str | None = None) -> Column:
    """The record as one string, from the columns of :func:`resolved`; the separator behind it is the sink's."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(BREAK * 2)
    )
    size = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    now = F.lit(date) if date else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    header = F.concat(
        F.lit(VERSION + BREAK), _field("WARC-Type", F.col("record_type")), _field("WARC-Record-ID", F.col("record_id")),
        _field("WARC-Date", now), _field("WARC-Target-URI", F.col("url")), _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _field("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))), _field("WARC-Refers-To", F.col("refers_to")),
        _field("WARC-Refers-To-Target-URI", F.col("target_uri")), _field("WARC-Refers-To-Date", F.when(F.col("target_uri").isNotNull(), now)),
        _field(PAGE_FIELD, F.col("page_id").cast("string")), _field("Content-Type", F.lit(RESPONSE_TYPE)),
        _field("Content-Length", size.cast("string")), F.lit(BREAK),
    )
    return F.concat(header, http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))


def from_pages(pages: DataFrame) -> DataFrame:
    """Records of (page_id, url, html): each with its payload, digest and size."""
    payload = F.coalesce(pages["html"], F.lit(""))
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].alias("url"), payload.alias("payload"))
    return rows.select(
        "*", base32_sha1(F.col("payload")).alias("digest"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.lit(True).alias("has_payload"), F.lit(None).cast("string").alias("told"),
    )


def write_archives(records: DataFrame, path: str, min_bytes: int = 0, date: str | None = None, file_records: int = FILE_RECORDS) -> None:
    """Writes deduplicated gzip archives below ``path``."""
    text = resolved(records, min_bytes).select(record_text(date).alias("value"))
    text.write.option("lineSep", BREAK * 2).option("compression", "gzip").option("maxRecordsPerFile", file_records).text(path)


def _header_fields(lines: list[bytes]) -> dict[str, str]:
    pairs = (line.decode("utf-8", "replace").partition(":") for line in lines[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def parse(lines: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of each record in a stream of lines, which were split at line feeds."""
    for line in lines:
        if not line.startswith(b"WARC/"):
            continue  # the empty lines between records
        header = [line]
        for line in lines:
            if line in (b"\r", b""):
                break
            header.append(line)
        fields = _header_fields(header)
        size, got, block = int(fields.get("content-length", 0)), 0, []
        for line in lines:
            block.append(line)
            got += len(line) + 1
            if got >= size + len(BREAK):
                break
        yield fields, b"\n".join([*block, b""])[:size]


def _record_batches(with_payload: bool):
    def out(rows: list[tuple]) -> pa.RecordBatch:
        names = ["page_id", "url", "record_id", "record_type", "digest", "payload_bytes", "refers_to", "intact"]
        types = [pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.bool_()]
        if with_payload:
            names, types = [*names, "payload"], [*types, pa.binary()]
        return batch(names, types, list(zip(*(row[: len(names)] for row in rows))) or [[]] * len(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for fields, block in parse(line for part in batches for line in part.column(0).to_pylist()):
            kind = fields.get("warc-type")
            if kind not in ("response", "revisit"):
                continue
            _, _, payload = block.partition(b"\r\n\r\n")
            digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
            page = fields.get(PAGE_FIELD.lower())
            if kind == "revisit":
                payload, size, intact = None, None, None
            else:
                size, own = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                digest, intact = digest or own, digest in (None, own)
            rows.append(
                (int(page) if page else None, fields.get("warc-target-uri"), fields.get("warc-record-id"), kind, digest, size, fields.get("warc-refers-to"), intact, payload)
            )
            held += len(payload or b"") if with_payload else 0
            if len(rows) >= 5000 or held > 8 << 20:
                yield out(rows)
                rows, held = [], 0
        yield out(rows)

    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """The response and revisit records of the gzip archives below ``path``; ``intact`` tells whether a payload has its digest."""
    lines = spark.read.option("lineSep", "\n").option("pathGlobFilter", "*.gz").text(path).select(F.col("value").cast("binary"))
    return arrow_map(lines, _record_batches(with_payload), RECORDS + (", payload binary" if with_payload else ""))


def with_targets(records: DataFrame) -> DataFrame:
    """Records of :func:`read_archives` with refers_to as the page of the response, and that response's payload size."""
    columns = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")
    records = records.withColumn("payload_digest", F.col("digest"))
    is_revisit = F.col("record_type") == "revisit"
    responses = records.filter(~is_revisit)
    # responses refer to nothing and stay out of the join, where all of them would have one key
    targets = responses.select(
        F.col("record_id").alias("target"), F.col("page_id").alias("target_page"), F.col("payload_bytes").alias("target_bytes")
    )
    revisits = records.filter(is_revisit).drop("payload_bytes")
    met = revisits.join(targets, revisits["refers_to"] == targets["target"], "left").drop("refers_to")
    met = met.withColumnsRenamed({"target_bytes": "payload_bytes", "target_page": "refers_to"})
    own = responses.withColumn("refers_to", F.lit(None).cast("long"))
    return own.select(*columns).unionAll(met.select(*columns))


def deduplicate_archives(spark: SparkSession, source: str, target: str, min_bytes: int = 0) -> None:
    """Rewrites archives: one response for each payload, revisits for the others, fresh headers for all."""
    read = read_archives(spark, source, with_payload=True)
    records = read.select(
        "page_id", "url", F.coalesce(F.col("payload"), F.lit(b"")).cast("string").alias("payload"), "digest",
        F.coalesce("payload_bytes", F.lit(0).cast("long")).alias("payload_bytes"), F.col("payload").isNotNull().alias("has_payload"), F.col("refers_to").alias("told"),
    )
    write_archives(records, target, min_bytes)


def archived(pages: DataFrame, path: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` to archives below ``path`` (by default in the shared folder) and gives what is read back."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_archives(from_pages(pages), path, min_bytes)
    # headers only, so that the archives are read and parsed once
    return with_targets(stage(read_archives(spark, path), "warc-read"))
