"""Main text of HTML pages by nearest-URL page differencing, led by the page's own marks.

Pages of a host are paired with the page whose URL path is nearest: the neighbour in path order that shares more leading path
parts. The text lines of the two are aligned by longest common subsequence, and lines that both have are the site's, not the page's:
they go. That is done to every page. A check of the page's marks follows: of the lines left, those in elements that are never an article's
text (navigation, forms, scripts, adverts and the like) go too, and where a page marks its main part, those outside it; lines of a marked
article come back where they recur on the neighbour. In a main part that is no article, and on pages without marks, differencing decides.

Only hashes of lines travel to the neighbour, never its text, and pages are shuffled once. Hosts are cut into ranges of the
path order with their borders joined up afterwards, so a large host is no larger task.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waybill.llm.base import partitions, stored
from waybill.llm.urlfilter import host_of

#: Paths of a range.
RANGE = 100_000

# Elements that break lines, that hold no text, and that are never an article's text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 "
    "h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot "
    "th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset(
    "nav footer aside form head title button select option datalist dialog menu template object iframe noscript svg math canvas "
    "audio video map".split()
)
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adslot adbox adsense sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notices alert popup modal overlay sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer "
    "masthead share sharing social related recommended recommendations comment comments commentlist respond disqus replies "
    "newsletter subscribe subscription signup login search widget widgets pagination pager toolbar skip copyright complementary "
    "contentinfo".split()
)
HEADS = frozenset("header pageheader topbar banner".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|xmp)\b[^>]*>.*?(?:</\1\s*>|\Z)|<![^>]*>|<\?[^>]*>"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""",
    re.DOTALL | re.IGNORECASE,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_HIDDEN = re.compile(r"\shidden\b|display\s*:\s*none", re.IGNORECASE)
_LETTERS = re.compile(r"[a-z]+")

#: Where a line stands: in an element that is never text, nowhere in particular, in the marked main part, or in the marked article.
NO, OPEN, MAIN, ARTICLE = 0, 1, 2, 3


def _marks(attributes: str) -> set[str]:
    return {w for m in _NAMES.finditer(attributes) for w in _LETTERS.findall((m[1] or m[2] or m[3] or "").lower())}


def _tokens(page: str) -> list[tuple]:
    """(text) pieces and (name, closing, attributes) tags in page order; raw elements and comments are gone."""
    out, at = [], 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            out.append((page[at : m.start()],))
        if name := m[3] or m[6]:
            out.append((name.lower(), bool(m[2] or m[5]), m[4] or m[7] or ""))
        elif not m[1] and m[0].startswith("<!--"):
            pass
        at = m.end()
    if at < len(page):
        out.append((page[at:],))
    return out


def _ends(tokens: list[tuple]) -> dict[int, int]:
    """The place of the closing tag of each element that has one."""
    ends, stack, count = {}, [], {}
    for k, token in enumerate(tokens):
        if len(token) == 1 or token[0] in VOID:
            continue
        name, closing, _ = token
        if not closing:
            stack.append((name, k))
            count[name] = count.get(name, 0) + 1
        elif count.get(name):
            while stack:
                top, begun = stack.pop()
                count[top] -= 1
                if top == name:
                    ends[begun] = k
                    break
    return ends


def lines_of(page: str | None) -> list[tuple[str, int]]:
    """The text lines of a page, a line for each block, and where they stand (NO, OPEN, MAIN or ARTICLE)."""
    if not page:
        return []
    tokens = _tokens(page)
    ends = _ends(tokens)
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    skip = article = main = head = -1  # the places of the closing tags of what we are in
    brief = False  # an element that is never text but is not closed: it goes up to the next block

    def flush(where: int) -> None:
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if text:
            out.append((text, where))

    def place(k: int) -> int:
        if k <= skip or brief or (k <= head and not heading):
            return NO
        return ARTICLE if k <= article else MAIN if k <= main else OPEN

    heading = False
    for k, token in enumerate(tokens):
        if len(token) == 1:
            parts.append(token[0])
            continue
        name, closing, attributes = token
        if name == "br":
            parts.append(" ")
        if name not in BLOCKS and name not in NEVER:
            if k <= skip or closing or not attributes or not (_marks(attributes) & MARKS):
                continue
        flush(place(k))
        if closing:
            if name[0] == "h" and name[1:].isdigit():
                heading = False
            continue
        if brief and name in BLOCKS:
            brief = False
        if name[0] == "h" and name[1:].isdigit():
            heading = True
        if k <= skip:
            continue
        marks = _marks(attributes) if attributes else set()
        bad = name in NEVER or (attributes and _HIDDEN.search(attributes))
        bad = bad or (name not in ("html", "body", "main") and marks & MARKS)
        if bad:
            if k in ends:
                skip = ends[k]
            elif name not in VOID:
                brief = True
        elif name == "header" or (name not in ("html", "body", "main", "article") and marks & HEADS and not heading):
            # the header of a page goes; of an article's own header the headings stay
            if k in ends:
                if k <= max(article, main):
                    head = max(head, ends[k])
                else:
                    skip = ends[k]
        elif name == "article" or "articlebody" in marks:
            article = max(article, ends.get(k, len(tokens)))
        elif name == "main" or ("main" in marks and name != "body"):
            main = max(main, ends.get(k, len(tokens)))
    flush(place(len(tokens)))
    return out


def common(a: list, b: list) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``, by bit vectors over ``b``.

    Equal ends are cut off first. Lists too long for a table of bits are halved (Hirschberg), so memory stays bounded.
    """
    first = 0
    while first < len(a) and first < len(b) and a[first] == b[first]:
        first += 1
    last = 0
    while last < min(len(a), len(b)) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    out = list(range(first)) + [len(a) - last + k for k in range(last)]
    x, y = a[first : len(a) - last], b[first : len(b) - last]
    if not x or not y:
        return out
    if len(x) * len(y) > TABLE_BITS and len(x) > 1:
        half = len(x) // 2
        ahead = _row_lengths(_rows(x[:half], y)[-1], len(y))
        behind = _row_lengths(_rows(x[half:][::-1], y[::-1])[-1], len(y))[::-1]
        cut = int(np.argmax(ahead + behind))
        inside = common(x[:half], y[:cut]) + [half + k for k in common(x[half:], y[cut:])]
        return sorted(out + [first + k for k in inside])
    rows = _rows(x, y, keep=True)
    i, j = len(x), len(y)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if not i or rows[i - 1] >> (j - 1) & 1:
            out.append(first + i)
            j -= 1
    return sorted(out)


#: Bits of a table that is kept at once.
TABLE_BITS = 1 << 31


def _rows(x: list, y: list, keep: bool = False) -> list[int]:
    """Row by row of x the bits of y where the length of the common subsequence does not grow; the last row only, or all."""
    places: dict = {}
    for k, line in enumerate(y):
        places[line] = places.get(line, 0) | (1 << k)
    full = (1 << len(y)) - 1
    row, out = full, []
    for line in x:
        hit = row & places.get(line, 0)
        row = ((row + hit) | (row - hit)) & full
        if keep:
            out.append(row)
    return out or [row]


def _row_lengths(row: int, size: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(row.to_bytes(size // 8 + 1, "little"), np.uint8), bitorder="little")[:size]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def line_hashes(lines: list[tuple[str, int]]) -> list[int]:
    return [xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63) for text, _ in lines]


def main_text(page: str | None, neighbour: list[int] | None) -> str:
    """The page's main text; neighbour: the hashes of the nearest page's lines, if there is one."""
    lines = lines_of(page)
    shared = set(common(line_hashes(lines), list(neighbour))) if neighbour is not None else set()
    # the check by marks: what cannot be main text goes, and what is marked as the article stays whole
    least = MAIN if any(where >= MAIN for _, where in lines) else OPEN
    own = [text for k, (text, where) in enumerate(lines) if where == ARTICLE or (where >= least and k not in shared)]
    return "\n".join(own or (text for text, where in lines if where >= least))  # all shared: the same page twice


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch[["host", "path", "page_id"]].assign(hashes=[line_hashes(lines_of(page)) for page in batch["html"]])


def _extracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = [main_text(page, hashes) for page, hashes in zip(batch["html"], batch["hashes"], strict=True)]
        yield batch[["page_id", "url"]].assign(text=texts)


def neighbours(lines: DataFrame) -> DataFrame:
    """host, path and the line hashes of the nearest other path of the host; lines: host, path, page_id, hashes.

    A path stands for all its pages, with the lines of the smallest page_id. Paths without a neighbour are not returned.
    """
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.xxhash64("hashes").alias("tie"))
    paths = lines.where(F.col("host").isNotNull()).groupBy("host", "path").agg(F.min_by("hashes", order).alias("hashes"))
    paths = stored(paths, "extract-paths")
    ranges = partitions(paths, paths.count(), RANGE)
    cut = stored(
        paths.repartitionByRange(ranges, "host", "path").withColumn("range", F.spark_partition_id()), "extract-ranges"
    )
    page = F.struct("host", "path", "hashes")
    key = F.struct("host", "path")
    borders = cut.groupBy("range").agg(F.min_by(page, key).alias("first"), F.max_by(page, key).alias("last"))
    across = Window.orderBy("range")
    borders = borders.select(
        "range", F.lag("last").over(across).alias("before"), F.lead("first").over(across).alias("after")
    )
    inside = Window.partitionBy("range").orderBy("host", "path")
    placed = (
        cut.withColumns({"up": F.lag(page).over(inside), "down": F.lead(page).over(inside)})
        .join(borders, "range")
        .withColumns({"up": F.coalesce("up", "before"), "down": F.coalesce("down", "after")})
    )

    def nearness(other: str) -> F.Column:
        """Leading path parts in common; -1 for another host."""
        same = F.zip_with(F.split("path", "/"), F.split(f"{other}.path", "/"), lambda a, b: a.eqNullSafe(b))
        differs = F.array_position(same, F.lit(False))
        leading = F.when(differs > 0, differs - 1).otherwise(F.size(same))
        return F.when(F.col(f"{other}.host") == F.col("host"), leading).otherwise(-1)

    near = placed.withColumns({"near_up": nearness("up"), "near_down": nearness("down")})
    hashes = F.when(F.col("near_up") >= F.col("near_down"), F.col("up.hashes")).otherwise(F.col("down.hashes"))
    return near.where(F.greatest("near_up", "near_down") >= 0).select("host", "path", hashes.alias("hashes"))


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every row of ``pages`` (page_id, url, html); text is empty where there is none.

    Character references are decoded, white space within a block is one space, blocks are joined by one line feed. A null html is
    empty; a page without a URL, or alone on its host, has no neighbour and keeps all lines that no mark rules out. A page all of
    whose lines its neighbour has too is a copy and keeps them. Repeated rows come back as often. An empty table gives no rows.
    Other columns of ``pages`` play no part.
    """
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    named = pages.select(F.col("page_id").cast("string"), "url", "html").withColumns({"host": host_of(F.col("url")), "path": path})
    lines = named.select("host", "path", "page_id", "html").mapInPandas(
        _hashed, "host string, path string, page_id string, hashes array<long>"
    )
    near = stored(neighbours(lines.withColumn("page_id", F.col("page_id").cast("long"))), "extract-neighbours")
    spread = F.concat(F.lit("\0"), F.xxhash64("page_id", "html").cast("string"))
    keyed = named.withColumn("host", F.coalesce("host", spread)).join(near, ["host", "path"], "left")
    texts = keyed.select("page_id", "url", "html", "hashes").mapInPandas(_extracted, "page_id string, url string, text string")
    return texts.withColumn("page_id", F.col("page_id").cast("long"))
