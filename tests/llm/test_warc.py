"""Archives written and read back; reassembly of foreign, damaged and gzip files."""

import base64
import gzip
import hashlib

from pyspark.sql import functions as F

from waybill.llm.warc import decode, parse, read_archive, read_pages, write_archive
from waybill.session import fresh_dir

LONG = "<p>é漢🙂</p>\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 3000


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS id", "'x' AS payload", "2 AS number")


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def round_trip(spark, rows, **options):
    path = fresh_dir(spark, "test-archive")
    write_archive(pages(spark, rows), path, **options)
    return path, read_pages(spark, path, lambda facts: facts).collect()


def test_round_trip(spark):
    rows = [
        (5, "http://a.example/x", LONG), (9, "http://a.example/y", LONG), (1, "http://b.example", "<p>one</p>"),
        (2, None, None), (3, "http://c.example/\r\nX-Bad: 1", ""), (None, "http://d.example", "<p>one</p>"),
        (None, "http://e.example", "no id"), (7, "u", "x" * 16_384), (8, "v", "tiny"),
    ]
    path, got = round_trip(spark, rows, segment=1000, chunk=300)
    first = {}
    for i, _, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(t or "", i)
    want = {
        (i, len((t or "").encode()), digest(t), "response" if first[t or ""] == i else "revisit", None if first[t or ""] == i else first[t or ""])
        for i, _, t in rows
    }
    assert {(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got} == want
    assert len(got) == len(rows) and {r["status"] for r in got} == {"complete"}
    records = read_archive(spark, path).where("type = 'response'").collect()
    assert {bytes(r["payload"]).decode() for r in records} == {t or "" for _, _, t in rows}


def test_smaller_payloads_are_all_responses(spark):
    rows = [(1, "a", "tiny"), (2, "b", "tiny"), (3, "c", "a longer one"), (4, "d", "a longer one")]
    _, got = round_trip(spark, rows, least=8)
    assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in got} == {
        (1, "response", None), (2, "response", None), (3, "response", None), (4, "revisit", 3),
    }


def test_repeated_rows_are_one_page(spark):
    _, got = round_trip(spark, [(1, "a", LONG), (1, "a", LONG), (2, "b", LONG)], segment=1000)
    assert sorted((r["page_id"], r["record_type"]) for r in got) == [(1, "response"), (2, "revisit")]


def test_copies_are_pages_of_their_own(spark):
    rows = [(1, "a", LONG), (1, "a", LONG), (1, "a", LONG), (2, "b", LONG), (2, "b", LONG), (3, "c d", ""), (3, "c%20d", None), (4, "e", "x"), (4, "e", "y")]
    _, got = round_trip(spark, rows, segment=1000, copies=True)
    assert sorted((r["page_id"], r["record_type"], r["refers_to"] or 0) for r in got) == [
        *[(1, "response", 0)] * 3, *[(2, "revisit", 1)] * 2, *[(3, "response", 0)] * 2, (4, "response", 0), (4, "response", 0),
    ]
    assert {r["status"] for r in got} == {"complete"}
    assert {r["payload_bytes"] for r in got if r["page_id"] <= 2} == {len(LONG.encode())}


def test_empty(spark):
    path, got = round_trip(spark, [])
    assert got == []


def test_decode():
    body = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    assert decode(body + b"3;x=1\r\nabc\r\n2\r\nde\r\n0\r\nTrailer: 1\r\n\r\n") == b"abcde"
    assert decode(body + b"0\r\n\r\n") == b""
    for broken in (b"", b"3\r\nab", b"3\r\nabcX", b"z\r\n", b"3\r\nabc\r\n"):
        assert decode(body + broken) is None
    assert decode(b"HTTP/1.1 200 OK\r\n\r\nplain") == b"plain" and decode(b"no http") == b"no http"


def record(**headers):
    block = headers.pop("block")
    lines = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in headers.items())
    return f"WARC/1.0\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def segments(name, parts, total, numbers=None):
    out = []
    for k, part in enumerate(parts, 1):
        head = {"WARC_Type": "response" if k == 1 else "continuation", "WARC_Record_ID": f"<{name}-{k}>" if k > 1 else f"<{name}>"}
        head |= {"WARC_Segment_Number": (numbers or range(1, 99))[k - 1]}
        if k > 1:
            head["WARC_Segment_Origin_ID"] = f"<{name}>"
        if k == len(parts):
            head["WARC_Segment_Total_Length"] = total
        out.append(record(block=part, **head))
    return out


def test_reassembly_of_damaged_archives(spark):
    good = segments("good", [b"HTTP/1.1 200 OK\r\n\r\nab", b"cd", b"ef"], 25)
    hole = segments("hole", [b"abc", b"def", b"ghi"], 9)
    wrong = segments("wrong", [b"abc", b"def"], 7)
    orphan = segments("orphan", [b"abc", b"def"], 6)[1:]
    cut = record(block=b"x" * 50, WARC_Type="response", WARC_Record_ID="<cut>")[:-30]
    files = [
        good[2] + hole[0] + wrong[1],
        gzip.compress(good[0]) + gzip.compress(hole[2]) + gzip.compress(wrong[0]),
        good[1] + good[1] + b"".join(orphan) + cut,
        b"",
        b"not an archive",
    ]
    # as text without line ends the sink writes the bytes as they are
    path = fresh_dir(spark, "test-foreign")
    table = spark.createDataFrame([(bytearray(f),) for f in files if f], "content binary")
    assert [len(list(parse(f))) for f in files] == [3, 3, 4, 0, 0]
    plain = table.where(F.substring("content", 1, 2) != F.unhex(F.lit("1F8B")))
    plain.repartition(3).select(F.col("content").cast("string").alias("value")).write.option("lineSep", "\r\n").text(path)
    zipped = spark.createDataFrame([(bytearray(gzip.decompress(files[1])),)], "content binary")
    zipped.select(F.col("content").cast("string").alias("value")).write.option("compression", "gzip").mode("append").text(path)
    got = {r["id"]: (r["status"], None if r["payload"] is None else bytes(r["payload"])) for r in read_archive(spark, path).collect()}
    assert got == {
        "<good>": ("complete", b"abcdef"),
        "<hole>": ("incomplete", None),
        "<wrong>": ("wrong length", None),
        None: ("incomplete", None),
        "<cut>": ("truncated", None),
    }


def test_smallest_page_id_under_several_urls(spark):
    """As the query's SQL has it: all rows of the smallest page_id are responses, also under other urls."""
    for copies in (False, True):
        _, got = round_trip(spark, [(1, "b", "same"), (1, "a", "same"), (2, "c", "same")], copies=copies)
        assert sorted((r["page_id"], r["url"], r["record_type"], r["refers_to"]) for r in got) == [
            (1, "a", "response", None), (1, "b", "response", None), (2, "c", "revisit", 1),
        ]


def test_facts_without_payloads(spark):
    """What pages need is read without sending on payloads that stand in one record."""
    path, _ = round_trip(spark, [(1, "a", "short"), (2, "b", LONG), (3, "c", LONG)], segment=1000)
    facts = read_archive(spark, path, payloads=False)
    assert "payload" not in facts.columns
    key = ["id", "status", "bytes", "sha1"]
    assert sorted(map(str, facts.select(*key).collect())) == sorted(map(str, read_archive(spark, path).select(*key).collect()))
