"""Redaction, masking, hashing and encryption as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

REDACTED = "[REDACTED]"

# fixed values: what counts as personal or secret text, in the order of replacement; home_path also stops at white
# space and knows backslashes, so that it ends with the user's name
PATTERNS = {
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "ipv4": r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b",
    "home_path": r"(/Users/[^/\s]+|/home/[^/\s]+|C:\\Users\\[^\\\s]+)",
    "token": r"(?i)(token|key|secret|password|pwd|api[_-]?key)[\s:=]+[\S]+",
}
# fixed values: words that announce a sensitive value
KEYWORDS = [
    "credit card", "creditcard", "cc number", "social security", "ssn", "sin",
    "bank account", "routing number", "pin", "cvv", "cvc",
]
# fixed values: parts of a key name that make it sensitive; the audit log uses the shorter list
SENSITIVE_KEYS = ["password", "pwd", "secret", "token", "key", "api", "credential", "auth", "private", "ssn", "social"]
AUDIT_SENSITIVE_KEYS = ["password", "token", "key", "secret", "credential"]
# fixed values: column-name pattern -> (class, mask)
COLUMN_CLASSES = [
    ("SSN|SOCIAL_SECURITY", "RESTRICTED", "last4"),
    ("CREDIT_CARD|CC_", "RESTRICTED", "last4"),
    ("EMAIL|E_MAIL", "CONFIDENTIAL", "email"),
    ("PHONE|MOBILE", "CONFIDENTIAL", "last4"),
    ("ADDRESS|ADDR", "CONFIDENTIAL", "hide"),
]


def keyword_pattern(word: str, strict: bool = True) -> str:
    """A keyword and the value after it; ``strict`` wants whole words, so "shopping" holds no "pin"."""
    edge = r"\b" if strict else ""
    return rf"(?i){edge}{re.escape(word).replace(chr(92) + ' ', ' ')}{edge}[\s:]*[\S]+"


def _holds_any(low: Column, texts: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [low.contains(t) for t in texts])


# a cheap test on the lower-case text that holds wherever the pattern matches
_MAY_MATCH: dict[str, Callable[[Column], Column]] = {
    PATTERNS["email"]: lambda low: low.contains("@"),
    PATTERNS["ipv4"]: lambda low: low.rlike(r"[0-9]\.[0-9]"),
    PATTERNS["home_path"]: lambda low: _holds_any(low, ["/users/", "/home/", "c:\\users\\"]),
    PATTERNS["token"]: lambda low: _holds_any(low, ["token", "key", "secret", "password", "pwd"]),
}


def pattern_count(c: Column, pattern: str) -> Column:
    """Matches of a pattern; the pattern only runs on texts that may hold one."""
    may = _MAY_MATCH.get(pattern)
    found = F.regexp_count(c, F.lit(pattern))
    return F.when(may(F.lower(c)), found).when(c.isNotNull(), 0) if may else found


def redact(
    c: Column,
    extra: Sequence[str] = (),
    without: Sequence[str] = (),
    strict: bool = True,
) -> Column:
    """Replace every match by ``[REDACTED]``; ``extra`` and ``without`` add and drop patterns.

    Replacements run in sequence, each only on texts that may hold a match. The text and its
    lower-case form travel in a one-element array, so every step reads the step before by
    reference and the expression grows by one step per pattern.
    """
    for pattern in extra:
        re.compile(pattern)
    steps = [(p, _MAY_MATCH.get(p)) for p in [*[p for p in PATTERNS.values() if p not in without], *extra]]
    steps += [(keyword_pattern(w, strict), lambda low, w=w: low.contains(w)) for w in KEYWORDS]
    state = F.array(F.struct(c.alias("t"), F.lower(c).alias("low")))
    for pattern, may in steps:
        state = F.transform(state, _replacing(pattern, may))
    return state[0]["t"]


def _replacing(pattern: str, may: Callable[[Column], Column] | None) -> Callable[[Column], Column]:
    def step(s: Column) -> Column:
        replaced = F.regexp_replace(s["t"], pattern, REDACTED)
        text = F.when(may(s["low"]), replaced).otherwise(s["t"]) if may else replaced
        return F.struct(text.alias("t"), s["low"].alias("low"))

    return step


def is_sensitive(key: Column, words: Sequence[str] = tuple(SENSITIVE_KEYS)) -> Column:
    return F.lower(key).rlike("|".join(words))


def masked_keys(pairs: Column) -> Column:
    """Entries (key, value) with sensitive keys renamed to ``[SENSITIVE_KEY]``; later ones get ``_2``, ``_3`` …, all after the others."""
    hidden = F.filter(pairs, lambda e: is_sensitive(e["key"]))
    label = F.lit("[SENSITIVE_KEY]")
    renamed = F.transform(
        hidden,
        lambda e, i: F.struct(
            F.when(i == 0, label).otherwise(F.concat(label, F.lit("_"), (i + 1).cast("string"))).alias("key"),
            e["value"].alias("value"),
        ),
    )
    return F.concat(F.filter(pairs, lambda e: ~is_sensitive(e["key"])), renamed)


def mask_sensitive_keys(entries: Column) -> Column:
    """Map with sensitive keys renamed to ``[SENSITIVE_KEY]``; later ones get ``_2``, ``_3`` …

    Keys that collide after masking all stay, in the order of their names. One level; ``operators.documents`` walks nested documents.
    """
    return F.map_from_entries(masked_keys(F.array_sort(F.map_entries(entries))))


def redact_sensitive_values(entries: Column) -> Column:
    """Map with the values of sensitive keys replaced; the keys stay (audit form)."""
    return F.transform_values(
        entries, lambda k, v: F.when(is_sensitive(k, AUDIT_SENSITIVE_KEYS), REDACTED).otherwise(v)
    )


def hash_identifier(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 32)


def pseudonymize_email(email: Column) -> Column:
    return F.concat(F.left(F.md5(email), F.lit(8)), F.lit("@"), F.split_part(email, F.lit("@"), F.lit(2)))


def mask_email_by_role(email: Column, role: Column) -> Column:
    return F.when(role == "ADMIN", email).otherwise("***@***.***")


def _mask(c: Column, how: str) -> Column:
    if how == "email":
        return F.when(c.isNotNull(), "***@***.***")
    if how == "hide":
        return F.when(c.isNotNull(), "[MASKED]")
    return F.concat(F.lit("***"), F.right(F.regexp_replace(c.cast("string"), "[^0-9]", ""), F.lit(4)))


def classify_column(name: str) -> tuple[str, str | None]:
    """Class and mask of a column by its name; the first matching pattern decides."""
    for pattern, level, mask in COLUMN_CLASSES:
        if re.search(pattern, name, re.IGNORECASE):
            return level, mask
    return "PUBLIC", None


def masked_columns(names: Sequence[str]) -> list[Column]:
    """The columns with the masks of their classes applied."""
    out = []
    for name in names:
        mask = classify_column(name)[1]
        out.append(_mask(F.col(name), mask).alias(name) if mask else F.col(name))
    return out


def encrypt(c: Column, key: Column) -> Column:
    """AES-GCM with a random nonce in front, base64; the caller owns the key (16, 24 or 32 bytes)."""
    return F.base64(F.aes_encrypt(c.cast("binary"), key, F.lit("GCM")))


def decrypt(c: Column, key: Column) -> Column:
    return F.aes_decrypt(F.unbase64(c), key, F.lit("GCM")).cast("string")
