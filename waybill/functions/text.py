"""Text functions: trimming, SQL text normalisation, truncation, checksums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"[\p{Z}\s\x0B\u0085]+"


def trim_all(c: Column) -> Column:
    """Trim every kind of Unicode space, not only blanks."""
    return F.regexp_replace(F.regexp_replace(c, f"^{_SPACE}", ""), f"{_SPACE}$", "")


def normalize_sql(c: Column, ignore_case: bool = True, ignore_space: bool = True, ignore_comments: bool = True) -> Column:
    """Comparable form of a definition: comments go first, then white space, then case."""
    if ignore_comments:
        c = F.regexp_replace(c, r"/\*[\s\S]*?\*/", "")
        c = F.regexp_replace(c, r"--[^\n]*", "")
    if ignore_space:
        c = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.upper(c) if ignore_case else c


def truncated(c: Column, limit: int = 100) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit("..."))).otherwise(c)


def content_checksum(c: Column) -> Column:
    return F.sha2(c, 256)


def glob_regex(glob: str) -> str:
    """Regular expression of a file-name style pattern with * and ?."""
    special = set("\\.+^$(){}[]|")
    return "^" + "".join(".*" if ch == "*" else "." if ch == "?" else "\\" + ch if ch in special else ch for ch in glob) + "$"
