"""Differencing, marks and decoding on small sites."""

import random

import pytest
from pyspark.sql import functions as F

from waybill.llm import extract
from waybill.llm.base import table
from waybill.llm.extract import common, main_text, main_texts


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS host", "2 AS hashes")


def texts(df):
    return sorted(((r["page_id"], r["text"]) for r in df.collect()), key=str)


def slow_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@pytest.mark.parametrize("bits", [1 << 31, 16])
def test_longest_common_subsequence(monkeypatch, bits):
    monkeypatch.setattr(extract, "TABLE_BITS", bits)
    rng = random.Random(bits)
    for _ in range(400):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 16))] for _ in range(2))
        places = common(a, b)
        rest = iter(b)
        assert places == sorted(set(places)) and len(places) == slow_length(a, b)
        assert all(a[k] in rest for k in places)


def plain(title, *body):
    """A page without any mark of what is its article."""
    lines = "".join(f"<div>{x}</div>" for x in body)
    return f"<html><body><div>Site name</div><div>Home | About</div><h2>{title}</h2>{lines}<div>All rights &copy; us</div></body></html>"


def test_shared_lines_of_the_nearest_page_go(spark):
    rows = [
        (1, "http://h.example/a/1", plain("One", "first text", "more")),
        (2, "http://h.example/a/2", plain("Two", "second text", "Today: sunny")),
        (3, "http://h.example/b/c/1", plain("Three", "third text", "Today: sunny")),
        (4, "http://h.example/b/c/2", plain("Four", "fourth text", "Today: sunny")),
        (5, "http://alone.example/x", "<p>only page</p>"),
    ]
    want = [(1, "One\nfirst text\nmore"), (2, "Two\nsecond text\nToday: sunny"), (3, "Three\nthird text"), (4, "Four\nfourth text"),
            (5, "only page")]
    assert texts(main_texts(pages(spark, rows))) == want


def test_ranges_and_hosts_join_up(spark, monkeypatch):
    """Small ranges: neighbours across the border of two ranges still find each other."""
    monkeypatch.setattr(extract, "RANGE", 3)
    rows = [(k, f"http://h.example/p{k:03}", plain(f"T{k}", f"text {k}")) for k in range(40)]
    assert texts(main_texts(pages(spark, rows))) == sorted(((k, f"T{k}\ntext {k}") for k in range(40)), key=str)


def test_marked_pages():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head>
    <body class="no-sidebar"><header><h1>Site</h1></header><nav><ul><li>Menu</li></ul></nav><!-- <p>no</p> -->
    <div class="ad">buy</div><div id="cookie-notice">accept</div><article><header><h1>Head &amp; line</h1><span>by x</span></header>
    <p>One\n two&nbsp;<b>three</b><br>four<p>5 &lt; 6 &#233; &am<aside>see also</aside></p><ul><li>x<li>y</ul>
    <form>mail <input></form><section class="comments"><p>first!</p></section></article>
    <div class="related">more</div><footer>&copy; z</footer>"""
    assert main_text(page, None) == "Head & line\nOne two three four\n5 < 6 é &am\nx\ny"


def framed(kind, title, text):
    """A page whose main part also holds lines of the site that no mark tells from its text."""
    body = f"<h2>{title}</h2><p>{text}</p><p>Said by all.</p>"
    return f"<body><div>Home | About {title}</div><main><div>Read in your language</div>{kind(body)}<div>More from us</div></main></body>"


def test_differencing_reaches_marked_pages(spark):
    """In a main part lines of the site go; the lines of a marked article come back where they recur, and what stands outside goes even if it does not."""
    whole, article = (lambda body: body), (lambda body: f"<article>{body}</article>")
    rows = [(k, f"http://h.example/{kind}/{k}", framed(article if kind == "a" else whole, f"T{k}", f"text {k}")) for kind, k in (("m", 1), ("m", 2), ("a", 3), ("a", 4))]
    want = [(1, "T1\ntext 1"), (2, "T2\ntext 2"), (3, "T3\ntext 3\nSaid by all."), (4, "T4\ntext 4\nSaid by all.")]
    assert texts(main_texts(pages(spark, rows))) == want


def test_awkward_rows(spark):
    long = "<article>" + "".join(f"<p>line {k % 9}</p>" for k in range(20_000)) + "</article>"
    rows = [
        (1, None, "<p>no url</p>"), (None, "http://h.example/1", "<p>no id</p><p>same</p>"), (2, "http://h.example/2", None),
        (3, "http://h.example/3", ""), (4, "http://h.example/4", "<p>unclosed <b>tags <div class='ad'>x"),
        (5, "not a url", "plain & simple"), (6, "http://h.example/6", long), (6, "http://h.example/6", long),
        (7, "http://c.example/1", "<p>copy</p>"), (8, "http://c.example/2", "<p>copy</p>"), (9, "http://h.example/9", "<"),
    ]
    got = texts(main_texts(pages(spark, rows)))
    whole = "\n".join(f"line {k % 9}" for k in range(20_000))
    want = [(1, "no url"), (None, "no id\nsame"), (2, ""), (3, ""), (4, "unclosed tags"), (5, "plain & simple"), (6, whole), (6, whole),
            (7, "copy"), (8, "copy"), (9, "<")]
    assert got == sorted(want, key=str)


def test_empty(spark):
    assert main_texts(pages(spark, [])).count() == 0


def test_tables_pages(spark):
    """On the given pages the text is what stands in the article element."""
    source = table(spark, "/root/testdata/sf0.01", "pages")
    inner = F.regexp_extract("html", r"(?s)<article>(.*)</article>", 1)
    flat = F.regexp_replace(F.regexp_replace(inner, r"</?(p|h1)>", "\n"), r"<[^>]*>", "")
    flat = F.replace(F.replace(flat, F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))
    lines = F.filter(F.transform(F.split(flat, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    want = source.where("html LIKE '%</article>%' AND NOT html RLIKE '&am?[^p;]'").select("page_id", F.array_join(lines, "\n").alias("want"))
    assert main_texts(source).join(want, "page_id").where("text <> want").count() == 0
