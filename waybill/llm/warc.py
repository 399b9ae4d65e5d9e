"""WARC archives: writing pages as records, and reading records back with segments reassembled.

Writing uses Spark's text sink, which writes the bytes of a record as they are: records are split into segments of at most ``SEGMENT``
bytes, so no row and no file has to hold a large document whole. Bodies are in chunked transfer framing. Payloads that occurred
before become revisit records.

Reading takes whole files of bounded size, plain or gzip, and goes from record to record by Content-Length. Segments may lie in
any files: they are grouped by the identifier of the record in which they began, ordered by segment number, checked against the
total length, joined, and the chunked framing is decoded.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from waybill.llm.base import stored

#: Bytes of a segment, and of a chunk in the transfer framing; records of a file.
SEGMENT, CHUNK, RECORDS = 16_384, 4_096, 4_096
#: The alphabet of base32 (RFC 4648).
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def base32(hexadecimal: F.Column) -> F.Column:
    """Base32 of a SHA-1 in hexadecimal: five hexadecimal digits are four of base32."""
    out = []
    for k in range(0, 40, 5):
        bits = F.conv(F.substring(hexadecimal, k + 1, 5), 16, 10).cast("int")
        out += [
            F.substring(F.lit(BASE32), F.shiftright(bits, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)
        ]
    return F.concat(*out)


def _identifier(*parts: F.Column) -> F.Column:
    """A record identifier that depends on the parts alone."""
    sum_of = F.md5(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("\0")) for p in parts]))
    groups = [F.substring(sum_of, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *groups), F.lit(">"))


def _framed(payload: F.Column, chunk: int) -> F.Column:
    """The HTTP response with its body in chunks."""
    size = F.octet_length(payload)

    def one(k):
        length = F.least(F.lit(chunk), size - k * chunk)
        part = F.substr(payload, k * chunk + 1, F.lit(chunk)).cast("string")
        return F.concat(F.lower(F.hex(length)), F.lit("\r\n"), part, F.lit("\r\n"))

    chunks = F.when(size > 0, F.transform(F.sequence(F.lit(0), F.floor((size - 1) / chunk).cast("int")), one))
    body = F.coalesce(F.array_join(chunks, ""), F.lit(""))
    return F.concat(F.lit(_HEAD), body, F.lit("0\r\n\r\n")).cast("binary")


def _counted(pages: DataFrame) -> DataFrame:
    """page_id, url and payload of each different page, and how many copies of it there are.

    Payloads are only grouped where a page_id and url stand more than once.
    """
    key = ["page_id", "url"]
    many = stored(pages.groupBy(*key).count().where("count > 1").select(*[F.col(c).alias(f"of_{c}") for c in key]), "warc-repeated")
    if not many.take(1):
        return pages.withColumn("copies", F.lit(1).cast("long"))
    same = pages["page_id"].eqNullSafe(many["of_page_id"]) & pages["url"].eqNullSafe(many["of_url"])
    alone = pages.join(many, same, "left_anti").withColumn("copies", F.lit(1).cast("long"))
    grouped = pages.join(many, same, "left_semi").groupBy(*key, "payload").agg(F.count(F.lit(1)).alias("copies"))
    return alone.unionByName(grouped)


def records(
    pages: DataFrame, date: str, least: int = 0, segment: int = SEGMENT, chunk: int = CHUNK, copies: bool = False
) -> DataFrame:
    """The text of WARC records for ``pages`` (page_id, url, html), a row for each segment.

    Of the pages with equal payloads of at least ``least`` bytes those with the smallest page_id (null last) are responses, and the others revisit
    the first of them by url. A null html is an empty payload. Rows alike in page_id, url and html have the same
    identifier, so readers see one page; with ``copies`` they are numbered in it, so readers see each.
    """
    plain = pages.select(
        "page_id",
        F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20").alias("url"),
        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"),
    )
    numbered = _counted(plain) if copies else plain.withColumn("copies", F.lit(1).cast("long"))
    known = numbered.select(
        "page_id", "url", "payload", "copies", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("bytes")
    )
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.col("url").isNull().alias("bare"), "url")
    first = known.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.min(order).alias("first"))
    joined = known.join(first, ["digest", "bytes"], "left").withColumns(
        {
            "id": _identifier(F.col("page_id"), F.col("url"), F.col("digest")),
            "first_id": _identifier(F.col("first.page_id"), F.col("first.url"), F.col("digest")),
        }
    )
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    block = F.when(F.col("revisit"), F.lit(_HEAD).cast("binary")).otherwise(_framed(F.col("payload"), chunk))
    if copies:  # the first copy keeps the identifier to which revisits refer
        joined = joined.withColumn("revisit", revisit).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
        own = _identifier(F.col("page_id"), F.col("url"), F.col("digest"), F.col("copy"))
        joined, revisit = joined.withColumn("id", F.when(F.col("copy") > 1, own).otherwise(F.col("id"))), F.col("revisit")
    blocks = joined.withColumn("revisit", revisit).withColumn("block", block).withColumn("total", F.octet_length("block"))
    parts = blocks.withColumn(
        "number", F.explode(F.sequence(F.lit(1), F.ceil(F.col("total") / segment).cast("int")))
    ).withColumn("content", F.substr("block", (F.col("number") - 1) * segment + 1, F.lit(segment)))

    def line(name: str, value: F.Column, when: F.Column | None = None) -> F.Column:
        text = F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))
        return F.coalesce(text if when is None else F.when(when, text), F.lit(""))

    number, total = F.col("number"), F.col("total")
    split, began = total > segment, number == 1
    kind = F.when(~began, "continuation").when(F.col("revisit"), "revisit").otherwise("response")
    own = F.when(began, F.col("id")).otherwise(_identifier(F.col("id"), number))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", own),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("digest"))), began),
        line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), F.col("revisit")),
        line("WARC-Refers-To", F.col("first_id"), F.col("revisit")),
        line("X-Page-ID", F.col("page_id")),
        line("WARC-Segment-Number", number, split),
        line("WARC-Segment-Origin-ID", F.col("id"), ~began),
        line("WARC-Segment-Total-Length", total, split & (number * segment >= total)),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length("content")),
    )
    # the sink ends each row with \r\n, the second of the two after a record
    return parts.select(F.concat(head, F.lit("\r\n"), F.col("content").cast("string"), F.lit("\r\n")).alias("value"))


def write_archive(
    pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", least: int = 0, segment: int = SEGMENT,
    chunk: int = CHUNK, copies: bool = False,
) -> None:
    """Write ``pages`` as gzip WARC files of bounded size to a new folder; see ``records``."""
    writer = records(pages, date, least, segment, chunk, copies).write.option("lineSep", "\r\n")
    writer.option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes, bool]]:
    """Headers (names in lower case), block and whether the block is complete, of each record of a file."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = data.find(b"WARC/")
    while at >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = int(headers["content-length"]) if headers.get("content-length", "").isdigit() else 0
        start = end + 4
        yield headers, data[start : start + length], start + length <= len(data)
        at = data.find(b"WARC/", start + length)


def decode(block: bytes) -> bytes | None:
    """The payload of an HTTP response: its body, with chunked framing taken off; None where the framing is broken."""
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"HTTP/"):
        return block
    coded = [x for x in head.lower().split(b"\r\n") if x.startswith(b"transfer-encoding:")]
    if not any(b"chunked" in x for x in coded):
        return body
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            return None
        if size < 0 or end + 2 + size > len(body):
            return None
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        if body[end + 2 + size : end + 4 + size] != b"\r\n":
            return None
        at = end + 4 + size


_READ = (
    "id string, type string, page_id string, url string, digest string, refers_id string, origin string, number int, total long, "
    "payload binary, bytes long, sha1 string, segment binary, whole boolean"
)


def _reader(payloads: bool):
    """Records of files; the payload of a record without segments comes with its size and SHA-1, and itself only if ``payloads`` are wanted."""
    names = [x.split()[0] for x in _READ.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows, held = [], 0
                for head, block, whole in parse(content):
                    number = head.get("warc-segment-number")
                    kind = head.get("warc-type")
                    alone = number is None
                    payload = decode(block) if alone and kind != "revisit" else None
                    row = (
                        head.get("warc-record-id"), kind, head.get("x-page-id"), head.get("warc-target-uri"),
                        head.get("warc-payload-digest"), head.get("warc-refers-to"),
                        head.get("warc-segment-origin-id") or head.get("warc-record-id"), None if alone else int(number),
                        int(head["warc-segment-total-length"]) if "warc-segment-total-length" in head else None,
                        payload if payloads else None, None if payload is None else len(payload),
                        None if payload is None else hashlib.sha1(payload).hexdigest(), None if alone else block, whole,
                    )
                    rows.append(row)
                    held += len(block) if payloads or not alone else 0
                    if held > 1 << 24 or len(rows) >= 1 << 14:
                        yield pd.DataFrame(rows, columns=names, dtype=object)
                        rows, held = [], 0
                yield pd.DataFrame(rows, columns=names, dtype=object)

    return read


@F.pandas_udf(BinaryType())
def _decoded(blocks: pd.Series) -> pd.Series:
    return blocks.map(lambda b: None if b is None else decode(bytes(b)))


def read_archive(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each record of the archive: id, type, page_id, url, digest (as stated), refers_id, payload, its bytes and SHA-1, and status.

    status is complete, or says why a record has no payload: truncated (its file ends too early), incomplete (segments are
    missing), wrong length (segments do not add up to the total) or broken framing. A revisit has no payload of its own.
    Records that repeat an identifier are one record. An empty folder gives no rows. Without ``payloads`` there is no such column, and of records
    that are not in segments no content leaves the task that reads them.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    read = files.mapInPandas(_reader(payloads), _READ)
    began = F.col("type") != "continuation"
    fields = ("id", "type", "page_id", "url", "digest", "refers_id")
    grouped = read.groupBy("origin").agg(
        *[F.max(F.when(began, F.col(f))).alias(f) for f in fields],
        *([F.first("payload", ignorenulls=True).alias("alone")] if payloads else []),
        F.max("bytes").alias("alone_bytes"),
        F.max("sha1").alias("alone_sha1"),
        F.collect_set(F.when(F.col("number").isNotNull(), F.struct("number", "segment"))).alias("found"),
        F.max("total").alias("total"),
        F.min("whole").alias("whole"),
    )
    parts = grouped.withColumn("found", F.sort_array("found"))
    joined = F.array_join(F.transform("found", lambda x: x["segment"].cast("string")), "").cast("binary")
    numbers = F.transform("found", lambda x: x["number"])
    wanted = F.when(F.size("found") > 0, F.sequence(F.lit(1), F.size("found")))
    size = F.aggregate("found", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x["segment"]))
    trouble = (
        F.when(~F.col("whole"), "truncated")
        .when(F.col("id").isNull(), "incomplete")
        .when((F.size("found") > 0) & (F.col("total").isNull() | (numbers != wanted)), "incomplete")
        .when((F.size("found") > 0) & (size != F.col("total")), "wrong length")
    )
    block = F.when(F.col("trouble").isNull() & (F.size("found") > 0), joined)
    decoded = parts.withColumn("trouble", trouble).withColumn("decoded", _decoded(block))
    sound = F.col("trouble").isNull()
    content = {
        "bytes": F.when(sound, F.coalesce("alone_bytes", F.octet_length("decoded").cast("long"))),
        "sha1": F.when(sound, F.coalesce("alone_sha1", F.sha1("decoded"))),
    }
    if payloads:
        content["payload"] = F.when(sound, F.coalesce("alone", "decoded"))
    broken = F.when((F.col("type") != "revisit") & F.col("bytes").isNull(), "broken framing")
    return (
        decoded.withColumns(content)
        .withColumn("status", F.coalesce("trouble", broken, F.lit("complete")))
        .select("id", "type", F.col("page_id").cast("long").alias("page_id"), "url", "digest", "refers_id", *sorted(content, reverse=True), "status")
    )


def read_pages(spark: SparkSession, path: str, store) -> DataFrame:
    """A row for each page of the archive with its full payload's size and digest; a revisit takes them from its response.

    page_id, url, payload_bytes, payload_digest, record_type, refers_to (page_id of the response) and status; a revisit whose
    response is not there or has another digest than the revisit states has the status "no response".
    ``store`` cuts the plan: it is given the narrow table of records.
    """
    facts = read_archive(spark, path, payloads=False).select(
        "id", "type", "page_id", "url", F.regexp_replace("digest", "^sha1:", "").alias("stated"), "refers_id", "status",
        "bytes", base32(F.col("sha1")).alias("computed"),
    )
    facts = store(facts)
    own = facts.select(
        F.col("id").alias("of_id"), F.col("page_id").alias("of_page"), F.col("bytes").alias("of_bytes"),
        F.col("computed").alias("of_digest"),
    )
    again = F.col("type") == "revisit"
    lost = again & ~F.coalesce(F.col("of_digest") == F.col("stated"), F.lit(False))
    first = facts.where(~again).withColumns(
        {"of_page": F.lit(None).cast("long"), "of_bytes": F.lit(None).cast("long"), "of_digest": F.lit(None).cast("string")}
    )
    second = facts.where(again).join(own, facts["refers_id"] == own["of_id"], "left").drop("of_id")
    return first.unionByName(second).select(
        "page_id",
        "url",
        F.coalesce("bytes", "of_bytes").alias("payload_bytes"),
        F.coalesce("computed", "of_digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.col("of_page").alias("refers_to"),
        F.when(lost, "no response").otherwise(F.col("status")).alias("status"),
    )
