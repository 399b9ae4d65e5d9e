"""Event gates and enrichment."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.functions.text import glob_regex

# fixed values: consent levels from least to most
LEVELS = ["none", "minimal", "basic", "full"]


def property_gate(
    events: DataFrame,
    props: str,
    event_type: str,
    exclude: Sequence[str],
    required_level: Mapping[str, str],
    consent: str,
) -> DataFrame:
    """Drop events whose type needs more consent than given, and properties whose key matches a glob."""
    allowed = [kind for kind, level in required_level.items() if LEVELS.index(level) <= LEVELS.index(consent)]
    blocked = "|".join(f"({glob_regex(g)})" for g in exclude)
    kept = events.where(F.col(event_type).isin(allowed))
    return kept.withColumn(props, F.map_filter(props, lambda k, v: ~k.rlike(blocked))) if exclude else kept


def enrich(
    events: DataFrame,
    event_type: str,
    allowed: Sequence[str] = (),
    conditions: Mapping[str, str] | None = None,
    static: Mapping[str, str] | None = None,
    computed: Mapping[str, str] | None = None,
) -> DataFrame:
    """Keep allowed types (none listed: all) that meet every condition; add fixed and computed fields."""
    tests: list[Column] = [F.expr(e) for e in (conditions or {}).values()]
    if allowed:
        tests.append(F.col(event_type).isin(list(allowed)))
    for test in tests:
        events = events.where(test)
    added = {name: F.lit(v) for name, v in (static or {}).items()}
    added.update({name: F.expr(e) for name, e in (computed or {}).items()})
    return events.withColumns(added) if added else events
