"""Advice and classes for logged SQL text and error messages, as plain text tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: leading keywords and the classes of errors
STATEMENTS = ["INSERT", "UPDATE", "DELETE", "CREATE", "ALTER", "DROP", "MERGE", "COPY"]
RETRYABLE = ["connection reset", "connection refused", "timeout", "deadlock", "too many connections", "resource busy"]
_TARGETS = {"INSERT": r"INTO\s+(\S+)", "UPDATE": r"UPDATE\s+(\S+)", "DELETE": r"FROM\s+(\S+)"}


def statement_type(sql: Column) -> Column:
    text = F.upper(F.regexp_replace(sql, r"^\s+", ""))
    out = F.when(F.lit(False), "")
    for word in STATEMENTS:
        out = out.when(text.startswith(word), word)
    return out.otherwise("UNKNOWN")


def target_table(sql: Column) -> Column:
    """Upper-case target of INSERT, UPDATE and DELETE; NULL for other statements."""
    kind, text = statement_type(sql), F.upper(sql)
    out = F.when(F.lit(False), "")
    for word, pattern in _TARGETS.items():
        out = out.when(kind == word, F.regexp_extract(text, pattern, 1))
    return F.nullif(out, F.lit(""))


def error_class(message: Column) -> Column:
    low = F.lower(message)
    return (
        F.when(low.rlike("|".join(RETRYABLE)), "retryable")
        .when(message.contains("does not exist") | message.contains("not found"), "not_found")
        .when(message.contains("syntax error"), "syntax")
        .otherwise("other")
    )


def lint(sql: Column, est_rows: Column) -> Column:
    """Array of (rule, severity) for each piece of advice that applies to the statement."""
    low = F.lower(sql)
    rules = [
        ("missing_filter", "high", (est_rows > 1_000_000) & ~low.contains("where")),
        ("select_star", "medium", low.contains("select *") | low.contains("select\n*")),
        ("cartesian_join", "high", low.contains("join") & ~low.contains(" on ")),
        ("order_without_limit", "low", low.contains("order by") & ~low.contains("limit")),
        ("subquery_to_cte", "medium", (F.regexp_count(low, F.lit("select")) > 1) & low.contains("from (")),
        ("expensive_distinct", "medium", low.contains("distinct") & (est_rows > 100_000)),
        # the length test stands outside the pattern: other engines cap repeat counts at 1000
        ("large_in_clause", "warning", F.length(F.regexp_extract(sql, r"\sIN\s*\(([^)]*)\)", 1)) >= 1000),
        ("case_sensitive_like", "warning", sql.rlike(r"\sLIKE\s+'[^']+'") & ~low.contains("ilike")),
    ]
    hits = [F.when(cond, F.struct(F.lit(name).alias("rule"), F.lit(level).alias("severity"))) for name, level, cond in rules]
    return F.array_compact(F.array(*hits))
