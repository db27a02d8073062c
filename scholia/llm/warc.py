"""WARC archives with revisit records for payloads that repeat.

Every row gives one record. Headers (page, url and payload digest, with the number of equal rows) are grouped by digest; of
equal payloads the row with the smallest page_id keeps its response record, and the others become revisit records that refer to it.
Only responses meet their payload again. A digest, or a row, that a large part of all rows repeats is dealt out in parts.

Archives are written by Spark's text writer, so they go to any store that Spark writes to: each line is a gzip member that holds
one record, and the line separator is an empty gzip member. They are read by the text reader, line by line, so files of any
size are split and streamed; a task holds one record of them at a time. Revisit records are joined to the responses they refer to.

Null payloads and urls are empty; line breaks in urls go. Rows without a page_id are written too, after those with one in order. Equal rows are
one response, or a revisit each. Payloads smaller than `least` are always responses. Payloads of any length count whole. Empty tables
give an archive without records and no rows. Columns other than page_id, url and html aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PARTS, shared_dir, spread_join, table, written

#: The date in the fresh headers, and the profile of revisits to an identical payload (fixed values).
DATE = "2025-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: An empty gzip member. No payload holds it, as it isn't UTF-8.
SEPARATOR = bytes.fromhex("1f8b08000000000000ff03000000000000000000").decode("latin-1")
KEY = ["page", "url", "sha1"]
#: Revisits of equal rows that one task writes.
SPAN = 10_000


def digest(payload: bytes) -> str:
    """Base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def payloads(pages: DataFrame) -> DataFrame:
    """page_id, page (as a text), url, html and the payload's sha1 in hex of every row."""
    html, url = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("html", "url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(url, r"[\r\n]", "").alias("url"), html.alias("html"))
    return rows.withColumn("page", F.coalesce(F.col("page_id").cast("string"), F.lit(""))).withColumn("sha1", F.sha1(F.col("html").cast("binary")))


def headers(pages: DataFrame) -> DataFrame:
    """page_id, page, url, sha1, payload_bytes and rows: how many equal rows there are."""
    rows = payloads(pages).withColumn("payload_bytes", F.octet_length("html").cast("long")).drop("html")
    return rows.groupBy("page_id", *KEY, "payload_bytes").agg(F.count("*").alias("rows"))


def resolved(heads: DataFrame, least: int = 0) -> DataFrame:
    """`heads` (a written table) with the page and url of the response, `to_page` and `to_url`, and how many responses and revisits there are."""
    lead = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url", "page")).alias("lead")
    found = spread_join(heads, heads.groupBy("sha1").agg(lead), ["sha1"], heads, ["page", "url"])
    own = (F.col("page") == F.col("lead.page")) & (F.col("url") == F.col("lead.url"))
    responses = F.when(F.col("payload_bytes") < least, F.col("rows")).otherwise(own.cast("long"))
    return found.select(*heads.columns, F.col("lead.page").alias("to_page"), F.col("lead.url").alias("to_url"), responses.alias("responses"), (F.col("rows") - responses).alias("revisits"))


def with_payload(pages: DataFrame, heads: DataFrame) -> DataFrame:
    """The rows of `heads` with responses, each once, with their html."""
    rows = payloads(pages).select(*KEY, "html")
    wanted = heads.where("responses > 0")
    found = rows.join(wanted.where("rows = 1"), KEY)
    if wanted.where("rows > 1").isEmpty():
        return found
    parts = F.pmod(F.spark_partition_id(), F.lit(PARTS)).alias("_part")
    again = wanted.where("rows > 1").withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return found.unionByName(rows.select("*", parts).join(again, [*KEY, "_part"]).dropDuplicates(KEY).drop("_part"))


def record_id(page: str, url: str, sha1: str, number: int) -> str:
    """A record's id: the page, and what tells its records apart."""
    return f"<urn:page:{page}:{hashlib.sha1(url.encode()).hexdigest()}:{sha1}:{number}>"


def member(page: str, url: str, sha1: str, number: int, again: bool, html: str, to_page: str, to_url: str, date: str) -> bytes:
    """The gzip member of one record."""
    block = HTTP + (b"" if again else html.encode())
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if again else 'response'}", f"WARC-Record-ID: {record_id(page, url, sha1, number)}", f"WARC-Date: {date}"]
    lines += [f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}"]
    if again:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(to_page, to_url, sha1, 1)}", f"WARC-Refers-To-Target-URI: {to_url}", f"WARC-Refers-To-Date: {date}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress((("\r\n".join(lines)) + END).encode() + block + END.encode()) + pack.flush()


def write(pages: DataFrame, heads: DataFrame, path: str, date: str = DATE, per_file: int = 100_000) -> None:
    """Writes the archives of the pages, whose headers are resolved, to the folder."""
    lean = [*KEY, "to_page", "to_url"]
    responses = with_payload(pages, heads).select(*lean, "html", F.lit(False).alias("again"), F.explode(F.sequence(F.lit(1), F.col("responses"))).alias("number"))
    # a row that repeats very often is dealt out in spans of SPAN records
    spans = heads.where("revisits > 0").select(*lean, "rows", F.explode(F.sequence(F.col("responses") + 1, F.col("rows"), F.lit(SPAN))).alias("from"))
    if not heads.where(F.col("revisits") > SPAN).isEmpty():
        spans = spans.repartition(PARTS, *KEY, "from")
    number = F.explode(F.sequence("from", F.least(F.col("from") + SPAN - 1, "rows"))).alias("number")
    revisits = spans.select(*lean, F.lit("").alias("html"), F.lit(True).alias("again"), number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                rows = batch.slice(at, 100).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([member(date=date, **r) for r in rows], pa.binary())], ["value"])

    found = responses.unionByName(revisits).mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    found.write.option("lineSep", SEPARATOR).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", per_file).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """kind, record, page_id, url, payload_digest (as its header says), target (the record a revisit refers to) and payload of each record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "record", "page_id", "url", "payload_digest", "target", "payload"]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                rows = [parsed(zlib.decompress(x.as_py(), 31)) for x in batch.column("value").slice(at, 100)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(7)], names)

    lines = spark.read.option("lineSep", SEPARATOR).option("encoding", "ISO-8859-1").text(path).select(F.col("value").cast("binary").alias("value"))
    return lines.mapInArrow(run, "kind string, record string, page_id long, url string, payload_digest string, target string, payload binary")


def parsed(data: bytes) -> tuple:
    """The fields of one record."""
    end = data.index(END.encode())
    head = dict(line.split(": ", 1) for line in data[:end].decode().split("\r\n")[1:])
    block = data[end + 4 : end + 4 + int(head["Content-Length"])]
    page = head["WARC-Record-ID"].split(":")[2]
    return head["WARC-Type"], head["WARC-Record-ID"], int(page) if page else None, head["WARC-Target-URI"], head["WARC-Payload-Digest"].removeprefix("sha1:"), head.get("WARC-Refers-To"), block[block.index(END.encode()) + 4 :]


def archived(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes the pages' archives, reads them back and tells each page's payload and record.

    Returns page_id, payload_bytes, payload_digest, record_type and refers_to. A response's digest and size are those
    of the payload in the archive; a revisit has the digest of its header and the size of the response it refers to.
    """
    spark = pages.sparkSession
    heads = written(resolved(written(headers(pages), "warc-headers"), least), "warc-resolved")
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, heads, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [(digest(p), len(p)) if k == "response" else (d, None) for k, p, d in zip(batch.column("kind").to_pylist(), batch.column("payload").to_pylist(), batch.column("payload_digest").to_pylist())]
            columns = [batch.column(c) for c in ("record", "page_id", "kind", "target")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([x[0] for x in new], pa.string()), pa.array([x[1] for x in new], pa.int64())], ["record", "page_id", "record_type", "target", "payload_digest", "payload_bytes"])

    back = written(read(spark, path).mapInArrow(run, "record string, page_id long, record_type string, target string, payload_digest string, payload_bytes long"), "warc-records")
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    responses = back.where("record_type = 'response'")
    revisits = back.where("record_type = 'revisit'").drop("payload_bytes")
    first = responses.select(F.col("record").alias("target"), F.col("page_id").alias("refers_to"), "payload_bytes")
    return responses.withColumn("refers_to", F.lit(None).cast("long")).select(*out).unionByName(spread_join(revisits, first, ["target"], revisits, ["record"]).select(*out))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages"))
