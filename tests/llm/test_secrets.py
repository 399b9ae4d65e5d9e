"""Secret scans against entropies counted anew in every window and shapes matched character by character."""

import hashlib
import math
import random
import re
import string
from collections import Counter

from tests.llm.common import awkward, docs_table
from waybill.llm.secrets import BASE, CLASSES, AllowList, dense_windows, digest, find_secrets

HEX = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
RANDOM64 = "q9Zx+7LmV2/tKdR4wYp1Hc8sNfUe3aJb"


def slow_windows(run, width, bits):
    marked = set()
    for i in range(len(run) - width + 1):
        shares = [c / width for c in Counter(run[i : i + width]).values()]
        if -sum(s * math.log2(s) for s in shares) >= bits - 1e-9:
            marked |= set(range(i, i + width))
    return marked


def slow_base(text):
    """The three shapes, walked by hand."""
    out, low = [], "".join(c.lower() if c.isascii() else c for c in text)
    i, value = 0, set(string.ascii_letters + string.digits + "+/_.=-")
    while i < len(text):
        name = next((n for n in ("password", "passwd", "secret", "token", "api_key", "apikey") if low.startswith(n, i)), None)
        j = i + len(name or "")
        ends = []
        for quote in (1, 0):
            k = j + (quote and text[j : j + 1] in ('"', "'") and j < len(text))
            while text[k : k + 1] == " ":
                k += 1
            if text[k : k + 1] in (":", "=") and k < len(text):
                ends.append(k + 1)
        if not name or not ends:
            i += 1
            continue
        k = ends[0]
        while text[k : k + 1] == " ":
            k += 1
        k += k < len(text) and text[k] in "\"'"
        end = k
        while end < len(text) and text[end] in value:
            end += 1
        if end == k:
            i += 1
            continue
        if end - k >= 12:
            out.append(("assign", i, end))
        i = end
    for m in re.finditer(r"[A-Z0-9]+", text):
        at = m.group().find("AKIA")
        if at >= 0 and len(m.group()) - at >= 18:
            out.append(("access", m.start() + at, m.end()))
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m.group()) >= 16:
            out.append(("hex", *m.span()))
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_windows_against_counting_anew():
    rng = random.Random(5)
    for n in range(300):
        letters = rng.choice(["01", "0123456789abcdef", string.ascii_letters + string.digits, "a"])
        run = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 120)))
        width, bits = rng.choice([(4, 2.0), (20, 3.0), (24, 4.0), (8, 0.0), (16, 4.0)])
        spans = list(dense_windows(run, width, bits))
        assert {i for a, b in spans for i in range(a, b)} == slow_windows(run, width, bits), (n, run)
        assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))  # joined, in order


def test_shapes_against_a_walk(spark):
    rng = random.Random(2)
    parts = [
        "token", "PassWord", "api_key", "apikey", "secret", " ", "=", ":", '"', "'", "  ", HEX[:15], HEX[:16], HEX, "AKIA", "AKIAABCDEFGH234567", "é",
        "x.y-z", "abcdefghijkl", "abcdefghijk", "\n", "🙂", "toſen", "toKen", "toKen=",
    ]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))), "a") for i in range(600)]
    rows.append((600, "token=secret: abcdefghijklmnop", "a"))  # a match that fails uses up its text
    found = digest(find_secrets(docs_table(spark, rows))).collect()
    for r in found:
        want = slow_base(rows[r["doc_id"]][1])
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == kind for k, *_ in want) for kind in ("assign", "access", "hex")], rows[r["doc_id"]]
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest(), rows[r["doc_id"]]
        assert [s for s in r["spans"].split(",") if s and not s.startswith("entropy")] == (text.split(",") if text else [])


def kinds(spark, text, **how):
    (row,) = find_secrets(docs_table(spark, [(1, text, "a")]), **how).collect()
    return [(s["kind"], text[s["start"] : s["end"]]) for s in row["secrets"]]


def test_entropy_and_allow_list(spark):
    assert kinds(spark, f"the key is {RANDOM64} so") == [("entropy_base64", RANDOM64)]
    assert ("entropy_hex", HEX.upper()) in kinds(spark, f"id {HEX.upper()}.")
    for harmless in (
        "31415926535897932384626433832795028841", "internationalisierungsvorschrift", "someVeryLongIdentifierOfAProgram", "a/path-of_many/words-and_more",
        "123e4567-e89b-12d3-a456-426614174000", "a" * 60, "sha256: " + RANDOM64, "commit " + HEX.upper(),
    ):
        assert [k for k, _ in kinds(spark, f"see {harmless} there") if k not in BASE] == [], harmless
    assert kinds(spark, f"see {RANDOM64}", allow=AllowList(known=frozenset([RANDOM64]))) == []
    assert [k for k, _ in kinds(spark, f"sha1: {HEX}")] == ["hex"]  # shapes are never suppressed
    assert kinds(spark, f"see {RANDOM64}", classes={}) == []


def test_secret_inside_a_long_run(spark):
    """Only the dense part of a long run is a span."""
    text = "xy" * 40_000 + RANDOM64 + "xy" * 40_000
    ((kind, part),) = kinds(spark, text)
    assert kind == "entropy_base64" and RANDOM64 in part and len(part) < len(RANDOM64) + 24


def test_awkward_rows(spark):
    rows = awkward()
    found = digest(find_secrets(docs_table(spark, rows))).collect()
    assert sorted(r["doc_id"] or -1 for r in found) == sorted(i or -1 for i, *_ in rows)
    assert all(r["spans"] == "" and r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in found)
    clashing = docs_table(spark, [(1, f"token={HEX}", "a")]).selectExpr("*", "1 AS secrets", "2 AS spans", "3 AS kind", "4 AS start")
    (row,) = find_secrets(clashing).collect()
    assert [s["kind"] for s in row["secrets"]] == ["assign", "hex", "entropy_hex"] and row["spans"] == 2
    assert digest(find_secrets(docs_table(spark, []))).count() == 0


def test_class_order_is_fixed():
    assert list(CLASSES) == ["entropy_hex", "entropy_base64"]
