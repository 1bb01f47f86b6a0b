"""WARC archives and revisit resolution (operator 1).

Archives are gzip-compressed WARC 1.1 files in a folder, written and read by Spark's text source with the record end
(two line ends) as the separator; a parser in the tasks joins the pieces again by Content-Length, so payloads may
hold anything, separators and record starts included.

De-duplication shuffles headers only: they are grouped by payload digest with partial sums, so a digest that a third of
all records share costs each task one row, and records whose digest occurs twice or more are joined to the first of
their digest. Both sides of that join are written tables, so Spark splits a hot digest's partition. Payloads move once,
to meet the decisions, and fresh archives are written: responses with their payload, revisits with headers that refer to
the response. Reading those back resolves each revisit by a join to the record it refers to.

Defined results: null payloads are empty ones; payloads below ``min_bytes`` are never revisits; the response of a
digest is the record with the smallest page_id (records without page_id come after all others), and repeated rows of
that page_id are responses too; line ends and control characters in a URL are percent-encoded, a null URL has no
header; empty tables give no rows; extra columns are ignored. Archives are compressed at the fastest level, which costs
a tenth more bytes and a third of the time of the usual one.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.llm.common import new_path, table, written

MIN_BYTES = 0
END = b"\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
COLUMNS = "page_id long, record_id string, record_type string, url string, date string, digest string, bytes long, refers_to_id string, payload binary"
RECORD = pa.schema(
    [("page_id", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("date", pa.string()), ("digest", pa.string()), ("bytes", pa.int64()), ("refers_to_id", pa.string()), ("payload", pa.binary())]
)
#: What ``write_archives`` reads. A record without digest gets digest and id from its payload when it is written.
WRITTEN = ("page_id", "record_id", "record_type", "url", "date", "digest", "payload", "refers_to_id", "refers_to_url", "refers_to_date")
SLICE = 64


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def _clean(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f\x85  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8")), url)


def record(page_id: int | None, record_id: str | None, record_type: str, url: str | None, date: str, known: str | None, payload: bytes | None, refers_to_id: str | None, refers_to_url: str | None, refers_to_date: str | None) -> bytes:
    """One record without the two line ends that follow it."""
    body = payload or b""
    if known is None:
        known = digest(body)
        record_id = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, repr((page_id, url)) + known)}"
    lines = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    lines.append(f"WARC-Payload-Digest: sha1:{known}")
    if record_type == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to_id}>"]
        if refers_to_url is not None:
            lines.append(f"WARC-Refers-To-Target-URI: {_clean(refers_to_url)}")
        lines.append(f"WARC-Refers-To-Date: {refers_to_date}")
        body = b""
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode("utf-8") + END + body


def write_archives(records: DataFrame, path: str) -> None:
    """Write rows with the columns ``WRITTEN`` as records, one archive file for each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                columns = [c.to_pylist() for c in batch.slice(start, SLICE).columns]
                yield pa.record_batch([pa.array([record(*r) for r in zip(*columns)], pa.binary())], names=["value"])

    lines = records.select(*WRITTEN).mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    lines.write.options(**{"compression": "gzip", "zlib.compress.level": "BEST_SPEED", "lineSep": END.decode("ascii")}).text(path)


def parse(header: bytes) -> dict[str, str]:
    out = {}
    for line in header.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        out[name.strip().lower().decode("ascii", "replace")] = value.strip().decode("utf-8", "replace")
    return out


def read_archives(spark: SparkSession, path: str, payload: bool) -> DataFrame:
    """The records of all archives in a folder. Without ``payload`` that column is null and bytes and digest are worked out from it; with it, they are the header's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, held, size, need = None, [], 0, 0
        rows: list[tuple] = []

        def take(data: bytes) -> tuple[bytes, int]:
            """Keep the records that ``data`` holds; what is left, and how long it must grow before it is worth a look."""
            at = 0
            while True:
                split = data.find(END, at)
                if split < 0:
                    return data[at:], 0
                head = parse(data[at:split])
                length = int(head["content-length"])
                end = split + len(END) + length
                if end + len(END) > len(data):
                    return data[at:], end + len(END) - at
                revisit = head["warc-type"] == "revisit"
                page = head.get("x-page-id")
                body = data[split + len(END) : end] if payload or not revisit else None
                known = head["warc-payload-digest"].removeprefix("sha1:") if revisit or payload else digest(body)
                rows.append((
                    None if page is None else int(page), head["warc-record-id"].strip("<>"), head["warc-type"], head.get("warc-target-uri"), head["warc-date"],
                    known, None if revisit else length, head["warc-refers-to"].strip("<>") if revisit else None, body if payload else None,
                ))
                at = end + len(END)

        def batch_of() -> pa.RecordBatch:
            columns = zip(*rows) if rows else [()] * len(RECORD)
            return pa.record_batch([pa.array(list(c), f.type) for c, f in zip(columns, RECORD)], schema=RECORD)

        for batch in batches:
            for name, piece in zip(batch.column(1).to_pylist(), batch.column(0)):
                if name != file:
                    file, held, size, need = name, [], 0, 0
                held += [piece.as_py(), END]
                size += len(held[-2]) + len(END)
                if size >= need:
                    left, need = take(b"".join(held))
                    held, size = [left], len(left)
                if len(rows) >= 4 * SLICE:
                    yield batch_of()
                    rows.clear()
        yield batch_of()

    pieces = spark.read.option("lineSep", END.decode("ascii")).text(path)
    return pieces.select(F.col("value").cast("binary").alias("value"), F.xxhash64("_metadata.file_path").alias("file")).mapInArrow(run, COLUMNS)


def page_records(pages: DataFrame) -> DataFrame:
    """A response record for each page; its payload is the html in UTF-8."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    none = [F.lit(None).cast("string").alias(c) for c in ("record_id", "digest", "refers_to_id", "refers_to_url", "refers_to_date")]
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.lit("response").alias("record_type"), F.lit(DATE).alias("date"), html.alias("payload"), *none)


def dedup_archives(spark: SparkSession, source: str, target: str, min_bytes: int = MIN_BYTES) -> None:
    """Read archives and write fresh ones in which all but the first record of each payload are revisits."""
    heads = written(read_archives(spark, source, payload=False).drop("payload"), "headers")
    able = heads.where(F.col("bytes") >= min_bytes)
    order = F.struct(F.coalesce(F.col("page_id"), F.lit(2**63 - 1)).alias("page"), F.col("record_id").alias("id"), F.col("url").alias("url"), F.col("date").alias("date"))
    firsts = able.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = written(firsts.select("digest", F.col("first.page").alias("first_page"), F.col("first.id").alias("first_id"), F.col("first.url").alias("first_url"), F.col("first.date").alias("first_date")), "firsts")
    found = able.join(firsts, "digest").where((F.col("record_id") != F.col("first_id")) & ~F.col("page_id").eqNullSafe(F.col("first_page")))
    revisits = written(found.select("record_id", "first_id", "first_url", "first_date").dropDuplicates(["record_id"]), "revisits")
    both = read_archives(spark, source, payload=True).drop("refers_to_id").join(revisits, "record_id", "left")
    again = F.col("first_id").isNotNull()
    fresh = both.select(
        "page_id", "record_id", F.when(again, "revisit").otherwise(F.col("record_type")).alias("record_type"), "url", "date", "digest", "bytes",
        F.col("first_id").alias("refers_to_id"), F.when(~again, F.col("payload")).alias("payload"), F.col("first_url").alias("refers_to_url"), F.col("first_date").alias("refers_to_date"),
    )
    write_archives(fresh, target)


def resolve_revisits(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives with the bytes and digest of its full payload; refers_to is the page_id of a revisit's response."""
    heads = written(read_archives(spark, path, payload=False).drop("payload"), "resolved")
    # copies of one response record are equal, so any of them will do
    originals = heads.where("record_type = 'response'").groupBy("record_id").agg(F.first("page_id").alias("to_page"), F.first("bytes").alias("to_bytes"), F.first("digest").alias("to_digest"))
    originals = written(originals.withColumnRenamed("record_id", "refers_to_id"), "originals")
    revisits = heads.where("record_type = 'revisit'").join(originals, "refers_to_id", "left")
    out = ["page_id", F.coalesce("to_bytes", "bytes").alias("payload_bytes"), F.coalesce("to_digest", "digest").alias("payload_digest"), "record_type", F.col("to_page").alias("refers_to"), "record_id", "url"]
    responses = heads.where("record_type = 'response'").select("*", F.lit(None).cast("long").alias("to_page"), F.lit(None).cast("long").alias("to_bytes"), F.lit(None).cast("string").alias("to_digest"))
    return responses.select(*out).unionByName(revisits.select(*out))


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain, fresh = new_path(spark, "warc"), new_path(spark, "warc-fresh")
    write_archives(page_records(table(spark, sf_dir, "pages")), plain)
    dedup_archives(spark, plain, fresh)
    return resolve_revisits(spark, fresh).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
