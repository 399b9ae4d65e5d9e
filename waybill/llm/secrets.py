"""Secret scans: named shapes, and Shannon entropy in a window that slides over candidate strings.

A candidate is a maximal run of one character class (hexadecimal digits, base-64 characters) at least as long as the class's
window. The window moves one character at a time; it keeps the count c of each character and the sum of c log2 c, of which a step
changes two terms. The entropy is log2(width) - sum / width; windows at or above the class's threshold are joined to spans.
Terms are whole numbers of 2^-32 bits, so a sum kept by steps is the sum counted anew, however long the run.
An allow list takes candidates back that only look random: numbers, plain words, identifiers, known examples, and strings that
the text before them calls a checksum.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 1 << 32

# The shapes of the contract, each with the group whose length counts and the least length.
BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I), 2, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"(?<![0-9a-f])[0-9a-f]+"), 0, 16),
}
#: A text without one of these, in any case, has no assignment: a quick test before the pattern.
NAMES = ("passw", "secret", "token", "key")


@dataclass(frozen=True)
class CharClass:
    """Characters of a class (inside brackets), the window's width and the bits per character that make it a secret."""

    chars: str
    width: int
    bits: float


CLASSES = {"entropy_hex": CharClass("0-9A-Fa-f", 20, 3.0), "entropy_base64": CharClass("A-Za-z0-9+/_-", 24, 4.0)}
KINDS = [*BASE, *CLASSES]


@dataclass(frozen=True)
class AllowList:
    """What is no secret whatever its entropy.

    ``shapes`` match a whole candidate; ``labels`` match the text right before it; ``known`` are candidates as such.
    """

    shapes: tuple[str, ...] = (
        r"[0-9]+",  # numbers
        r"[a-z]+|[A-Z]+",  # words
        r"[A-Z]?[a-z]+(?:[A-Z][a-z]+)+",  # camel case
        r"[A-Za-z]{2,}(?:[-_/+][A-Za-z]{2,})+",  # words joined
        r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}",  # UUIDs
    )
    labels: tuple[str, ...] = (r"(?:sha-?(?:1|224|256|384|512)|md5|crc32|checksum|digest|commit|etag)[\"']?\x20?[-:=]?\x20?[\"']?",)
    known: frozenset[str] = field(default_factory=frozenset)
    reach: int = 24

    def compiled(self):
        shapes = [re.compile(s) for s in self.shapes]
        labels = [re.compile(f"(?:{s})$", re.A | re.I) for s in self.labels]

        def allowed(text: str, start: int, end: int) -> bool:
            run = text[start:end]
            if run in self.known or any(s.fullmatch(run) for s in shapes):
                return True
            before = text[max(0, start - self.reach) : start]
            return any(s.search(before) for s in labels)

        return allowed


def _terms(width: int) -> list[int]:
    return [round(c * math.log2(c) * BITS) if c else 0 for c in range(width + 1)]


def dense_windows(run: str, width: int, bits: float) -> Iterator[tuple[int, int]]:
    """Joined spans of the windows of ``run`` whose entropy is at least ``bits`` per character."""
    terms = _terms(width)
    most = terms[width] - math.ceil(bits * width * BITS)  # the entropy is high enough if the sum is no more
    counts = dict.fromkeys(run, 0)
    total, begin, until = 0, None, 0
    for i, entering in enumerate(run):
        at = i + 1 - width
        if at > 0:
            leaving = run[at - 1]
            c = counts[leaving]
            total += terms[c - 1] - terms[c]
            counts[leaving] = c - 1
        c = counts[entering]
        total += terms[c + 1] - terms[c]
        counts[entering] = c + 1
        if at >= 0 and total <= most:
            if begin is not None and at > until:
                yield begin, until
                begin = None
            begin, until = at if begin is None else begin, i + 1
    if begin is not None:
        yield begin, until


def spans_of(text: str, classes: dict[str, CharClass], runs: dict[str, re.Pattern], allowed) -> list[tuple[str, int, int]]:
    """(kind, start, end) of one text, by start and then kind as listed."""
    low, out = text.lower(), []
    for kind, (shape, group, least) in BASE.items():
        if kind == "assign" and not any(n in low for n in NAMES):
            continue
        out += [(kind, *m.span()) for m in shape.finditer(text) if m.end(group) - m.start(group) >= least]
    for kind, of in classes.items():
        for m in runs[kind].finditer(text):
            found = list(dense_windows(m.group(), of.width, of.bits))
            if found and not allowed(text, *m.span()):
                out += [(kind, m.start() + a, m.start() + b) for a, b in found]
    order = {k: i for i, k in enumerate([*BASE, *classes])}
    return sorted(out, key=lambda s: (s[1], order[s[0]], s[2]))


def _scanner(classes: dict[str, CharClass], allow: AllowList):
    @F.pandas_udf("array<struct<kind:string,start:int,end:int>>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        runs = {k: re.compile(f"(?<![{c.chars}])[{c.chars}]{{{c.width},}}") for k, c in classes.items()}
        allowed = allow.compiled()
        for texts in batches:
            yield pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in spans_of(t or "", classes, runs, allowed)] for t in texts], dtype=object)

    return scan


def find_secrets(
    docs: DataFrame,
    text: str = "text",
    out: str = "secrets",
    classes: dict[str, CharClass] | None = None,
    allow: AllowList | None = None,
) -> DataFrame:
    """``docs`` with the spans of its secrets: kind, start and end in code points, end exclusive, by start and kind.

    Kinds are assign, access and hex (shapes, never suppressed) and one per character class (windows of high entropy outside the allow list);
    spans of different kinds may overlap. A null or empty text has none. A text is scanned whole however long; rows are
    independent, so repeated rows give the same spans each, an empty table gives none, and other columns stay; only one named ``out`` is replaced.
    """
    return docs.withColumn(out, _scanner(CLASSES if classes is None else classes, allow or AllowList())(F.col(f"`{text}`")))


def digest(found: DataFrame, spans: str = "secrets") -> DataFrame:
    """doc_id, number of spans of each shape, the hash of the shapes' spans and all spans as one string."""

    def joined(of):
        return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def shaped(*kinds):
        return F.filter(spans, lambda s: s["kind"].isin(*kinds))

    return found.select(
        "doc_id",
        *[F.size(shaped(k)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(joined(shaped(*BASE)), 256).alias("base_sha256"),
        joined(F.col(spans)).alias("spans"),
    )
