"""Scan of text files by line for credentials, injection risks and unsafe settings."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.functions.text import glob_regex


@dataclass(frozen=True)
class ScanRule:
    rule_id: str
    severity: str
    pattern: str
    file_types: tuple[str, ...] = ()
    unless: tuple[str, ...] = ()  # a line holding one of these texts is not a finding
    whole_file: bool = False  # one finding per file instead of one per line


CODE = (".go", ".py", ".js")
CONFIG = (".go", ".py", ".js", ".yaml", ".yml", ".json")
# fixed values: rules, severities, patterns and file types
RULES = [
    ScanRule("CRED001", "CRITICAL", r"""(?i)(password|passwd|pwd)\s*[:=]\s*["'][\w\S]{4,}["']""", CONFIG, ("example", "test")),
    ScanRule("CRED002", "CRITICAL", r"""(?i)(api[_-]?key|apikey|api[_-]?secret)\s*[:=]\s*["'][\w\-]{16,}["']""", (*CONFIG, ".env")),
    ScanRule("CRED003", "CRITICAL", r"-----BEGIN (RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----", whole_file=True),
    ScanRule("SQL001", "HIGH", r"""(?i)(exec|execute|query)\s*\(\s*["']?\s*\+|fmt\.sprintf.*select|string\s*\+.*where""", CODE),
    ScanRule("CONFIG001", "HIGH", r"(?i)insecureskipverify\s*[:=]\s*true|tls\.config.*insecure|sslverify\s*[:=]\s*false", (".go", ".yaml", ".yml")),
    ScanRule("CONFIG002", "MEDIUM", r"(?i)(md5|sha1|des|rc4)\.new|crypto\/(md5|sha1|des|rc4)", CODE),
    ScanRule("PERM001", "MEDIUM", r"(?i)os\.(chmod|mkdir|mkdirall|writefile|create).*0[67]77|perm:\s*0[67]77", (".go",)),
    ScanRule("ERROR001", "LOW", r"_\s*:=\s*\w+\(", (".go",)),
]
# fixed values: paths that are left out
EXCLUDED = (".git", "node_modules", "vendor", "*.test", "*_test.go")


def _extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^.]*)$", 1))


def _hit(rule: ScanRule, text: Column, line: Column, evidence: Column) -> Column:
    test = text.rlike(rule.pattern)
    for word in rule.unless:
        test = test & ~text.contains(word)
    if rule.file_types:  # the cheap test comes first
        test = F.col("__ext").isin(*rule.file_types) & test
    return F.when(
        test, F.struct(F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.severity).alias("severity"), line.alias("line"), evidence.alias("evidence"))
    )


def security_scan(files: DataFrame, path: str, text: str, rules: Sequence[ScanRule] = RULES, excluded: Sequence[str] = EXCLUDED) -> DataFrame:
    """Findings (path, rule, severity, line, evidence); line 0 stands for the file as a whole.

    The files are read once: each becomes its lines, after a line 0 with the whole text for rules on files. Only files that a line rule applies to are
    split.
    """
    name = F.regexp_extract(F.col(path), r"([^/]*)$", 1)
    skip = reduce(lambda a, b: a | b, [name.rlike(glob_regex(g)) | F.col(path).contains(g) for g in excluded], F.lit(False))
    kept = files.where(~skip).withColumn("__ext", _extension(F.col(path)))
    by_line = [r for r in rules if not r.whole_file]
    by_file = [r for r in rules if r.whole_file]
    line, none = F.col("__line"), F.array().cast("array<string>")
    split = F.split(text, "\n", -1) if by_line else none
    if by_line and all(r.file_types for r in by_line):
        split = F.when(F.col("__ext").isin(*sorted({t for r in by_line for t in r.file_types})), split).otherwise(none)
    whole = F.array(F.col(text) if by_file else F.lit(None).cast("string"))
    lines = kept.select(path, "__ext", F.posexplode(F.concat(whole, split)).alias("pos", "__line"))
    evidence = F.regexp_replace(line, r"^\s+|\s+$", "")
    in_line = F.array(*[_hit(r, line, F.col("pos").cast("long"), evidence) for r in by_line])
    in_file = F.array(*[_hit(r, line, F.lit(0).cast("long"), F.lit("")) for r in by_file])
    hits = in_line if not by_file else in_file if not by_line else F.when(F.col("pos") == 0, in_file).otherwise(in_line)
    found = lines.select(path, F.explode(F.array_compact(hits)).alias("h"))
    return found.select(path, "h.*")
