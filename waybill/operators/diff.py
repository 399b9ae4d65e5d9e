"""Differences between two catalogs or two versions of a table, and the plan to reconcile them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.functions.text import normalize_sql

KEY = ["database_name", "schema_name", "object_type", "object_name"]
# property label -> column of a catalog
PROPERTIES = {
    "Owner": "owner",
    "Comment": "comment",
    "Definition": "definition",
    "ColumnCount": "column_count",
    "IsSecure": "is_secure",
    "IsMaterialized": "is_materialized",
    "Language": "language",
    "ReturnType": "return_type",
}
# fixed values: order in which object types are changed
TYPE_ORDER = ["SEQUENCE", "FILE_FORMAT", "STAGE", "TABLE", "VIEW", "FUNCTION", "PROCEDURE", "STREAM", "PIPE", "TASK"]


def _differs(label: str, a: Column, b: Column) -> Column:
    if label != "Definition":
        return ~a.eqNullSafe(b)
    given = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
    return given & (normalize_sql(a) != normalize_sql(b))


def details_of(properties: Mapping[str, str], old: str, new: str) -> Column:
    """Array of (property, source_value, target_value) for the properties that differ."""
    found = []
    for label, column in properties.items():
        a, b = F.col(f"{old}.{column}"), F.col(f"{new}.{column}")
        item = F.struct(F.lit(label).alias("property"), a.alias("source_value"), b.alias("target_value"))
        found.append(F.when(_differs(label, a, b), item))
    return F.array_compact(F.array(*found))


def catalog_diff(source: DataFrame, target: DataFrame, properties: Mapping[str, str] = PROPERTIES) -> DataFrame:
    """Full outer difference by object: only in source REMOVED, only in target ADDED, else MODIFIED.

    Object keys are unique on each side. ``source`` and ``target`` keep the whole objects. Properties whose column
    is not in both catalogs are not compared.
    """
    properties = {p: c for p, c in properties.items() if c in source.columns and c in target.columns}
    a = source.select(*KEY, F.struct(*properties.values()).alias("source"))
    b = target.select(*KEY, F.struct(*properties.values()).alias("target"))
    both = a.join(b, KEY, "full_outer").withColumn("__details", details_of(properties, "source", "target"))
    kind = (
        F.when(F.col("target").isNull(), "REMOVED")
        .when(F.col("source").isNull(), "ADDED")
        .when(F.size("__details") > 0, "MODIFIED")
    )
    return (
        both.withColumn("diff_type", kind)
        .where(F.col("diff_type").isNotNull())
        .withColumn("details", F.when(F.col("diff_type") == "MODIFIED", F.col("__details")).otherwise(F.filter("__details", lambda d: F.lit(False))))
        .drop("__details")
    )


def detail_text(details: Column) -> Column:
    show = lambda v: F.coalesce(v, F.lit(""))
    return F.array_join(
        F.transform(details, lambda d: F.concat(d["property"], F.lit(":"), show(d["source_value"]), F.lit("->"), show(d["target_value"]))),
        "|",
    )


def object_filter(
    diffs: DataFrame,
    include_names: Sequence[str] = (),
    exclude_names: Sequence[str] = (),
    include_types: Sequence[str] = (),
    exclude_types: Sequence[str] = (),
) -> DataFrame:
    """Differences that no exclude pattern or type hides and, where given, some include admits."""
    name, kind = F.col("object_name"), F.col("object_type")
    tests = [~name.rlike(p) for p in exclude_names]
    if include_names:
        tests.append(reduce(lambda x, y: x | y, [name.rlike(p) for p in include_names]))
    if exclude_types:
        tests.append(~kind.isin(list(exclude_types)))
    if include_types:
        tests.append(kind.isin(list(include_types)))
    return reduce(lambda df, t: df.where(t), tests, diffs)


@dataclass(frozen=True)
class IgnoreRule:
    object_type: str = ""
    pattern: str = ""
    property: str = ""


def apply_ignore_rules(diffs: DataFrame, rules: Sequence[IgnoreRule]) -> DataFrame:
    """Drop differences that a rule hides.

    A rule with a property touches MODIFIED rows only and hides a row when every detail is
    covered by some rule; a rule without one hides whatever it matches.
    """

    def matches(rule: IgnoreRule) -> Column:
        test = F.lit(True)
        if rule.object_type:
            test = test & (F.col("object_type") == rule.object_type)
        if rule.pattern:
            test = test & F.col("object_name").rlike(rule.pattern)
        return test

    whole = [matches(r) for r in rules if not r.property]
    partial = [r for r in rules if r.property]
    hidden = reduce(lambda x, y: x | y, whole, F.lit(False))
    if partial:
        covered = F.forall(
            "details",
            lambda d: reduce(lambda x, y: x | y, [matches(r) & (d["property"] == r.property) for r in partial]),
        )
        hidden = hidden | ((F.col("diff_type") == "MODIFIED") & covered)
    return diffs.where(~hidden)


def diff_summary(diffs: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """Counts per object type and a row ``ALL``.

    ``matching`` = greater side minus differences, as reports show it (it can go negative);
    ``matched_keys`` counts the objects that are equal on both sides.
    """
    kinds = diffs.groupBy("object_type").agg(
        F.count_if(F.col("diff_type") == "ADDED").alias("added"),
        F.count_if(F.col("diff_type") == "REMOVED").alias("removed"),
        F.count_if(F.col("diff_type") == "MODIFIED").alias("modified"),
    )
    sides = (
        source.select("object_type", F.lit(1).alias("s"), F.lit(0).alias("t"))
        .unionAll(target.select("object_type", F.lit(0), F.lit(1)))
        .groupBy("object_type")
        .agg(F.sum("s").alias("source_objects"), F.sum("t").alias("target_objects"))
    )
    zero = F.lit(0).cast("long")
    joined = sides.join(kinds, "object_type", "left").select(
        "object_type", "source_objects", "target_objects", *[F.coalesce(c, zero).alias(c) for c in ("added", "removed", "modified")]
    )
    added_up = joined.withColumn("total", F.greatest("source_objects", "target_objects"))
    numbers = ["source_objects", "target_objects", "added", "removed", "modified", "total"]
    overall = added_up.agg(*[F.sum(c).alias(c) for c in numbers]).select(F.lit("ALL").alias("object_type"), *numbers)
    different = F.col("added") + F.col("removed") + F.col("modified")
    return (
        added_up.select("object_type", *numbers)
        .unionByName(overall)
        .withColumn("different", different)
        .withColumn("matching", F.col("total") - F.col("different"))
        .withColumn("matched_keys", F.col("source_objects") - F.col("removed") - F.col("modified"))
    )


def diff_sorted(diffs: DataFrame) -> DataFrame:
    return diffs.orderBy("object_type", "database_name", "schema_name", "object_name")


def drift_matrix(objects: DataFrame, baseline: str, environments: Sequence[str], ignore_names: Sequence[str] = ("^TEMP_.*", ".*_BACKUP$"), properties: Mapping[str, str] = PROPERTIES) -> DataFrame:
    """Differences of each environment from the baseline, counted in one pass over all environments."""
    kept = reduce(lambda df, p: df.where(~F.col("object_name").rlike(p)), ignore_names, objects)
    body = F.struct(*properties.values())
    names = [baseline, *environments]
    wide = kept.groupBy(*KEY).agg(
        *[F.max(F.when(F.col("environment") == e, body)).alias(f"e{i}") for i, e in enumerate(names)]
    )
    counts = []
    for i, _ in enumerate(environments, 1):
        base, env = F.col("e0"), F.col(f"e{i}")
        changed = reduce(
            lambda x, y: x | y, [_differs(label, base[c], env[c]) for label, c in properties.items()]
        )
        counts += [
            F.count_if(base.isNull() & env.isNotNull()).alias(f"a{i}"),
            F.count_if(base.isNotNull() & env.isNull()).alias(f"r{i}"),
            F.count_if(base.isNotNull() & env.isNotNull() & changed).alias(f"m{i}"),
        ]
    rows = [
        F.struct(
            F.lit(e).alias("environment"),
            F.col(f"a{i}").alias("added"),
            F.col(f"r{i}").alias("removed"),
            F.col(f"m{i}").alias("modified"),
            (F.col(f"a{i}") + F.col(f"r{i}") + F.col(f"m{i}") > 0).alias("drift"),
        )
        for i, e in enumerate(environments, 1)
    ]
    return wide.agg(*counts).select(F.explode(F.array(*rows)).alias("e")).select("e.*")


def sync_plan(
    diffs: DataFrame,
    include_creates: bool = True,
    include_alters: bool = True,
    include_drops: bool = False,
    safe_mode: bool = True,
    alter_value: str = "source",
) -> DataFrame:
    """Statements that bring the target to the source: by object type, drops, then alters, then creates.

    ``alter_value`` picks which side's comment and owner an ALTER writes.
    """
    full = F.concat_ws(".", "database_name", "schema_name", "object_name")
    kind = F.col("object_type")
    drop = F.concat(
        F.lit("DROP "), F.replace(kind, F.lit("_"), F.lit(" ")), F.lit(" IF EXISTS "), full,
        F.when(kind == "TABLE", " CASCADE;").otherwise(";"),
    )
    definition = F.coalesce(F.col("source.definition"), F.lit(""))
    create = F.when(definition != "", definition).otherwise(
        F.concat(F.lit("-- definition not available: "), kind, F.lit(" "), full)
    )
    rebuilt = kind.isin("VIEW", "PROCEDURE", "FUNCTION")

    def alter(d: Column) -> Column:
        value = F.coalesce(d[f"{alter_value}_value"], F.lit(""))
        return (
            F.when(d["property"] == "Comment", F.concat(F.lit("COMMENT ON "), kind, F.lit(" "), full, F.lit(" IS '"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("';")))
            .when(d["property"] == "Owner", F.when(value != "", F.concat(F.lit("GRANT OWNERSHIP ON "), kind, F.lit(" "), full, F.lit(" TO ROLE "), value, F.lit(";"))))
            .when(d["property"] == "Definition", F.when(rebuilt, F.concat(drop, F.lit("\n\n"), create)))
            .otherwise(F.concat(F.lit("-- "), d["property"], F.lit(" of "), kind, F.lit(" "), full, F.lit(" differs")))
        )

    changes = F.array_join(F.array_compact(F.transform("details", alter)), "\n\n")
    what = F.col("diff_type")
    op = (
        F.when((what == "ADDED") & F.lit(include_drops and not safe_mode), F.struct(F.lit(1).alias("step"), F.lit("DROP").alias("op"), drop.alias("statement")))
        .when((what == "MODIFIED") & F.lit(include_alters), F.struct(F.lit(2).alias("step"), F.lit("ALTER").alias("op"), changes.alias("statement")))
        .when((what == "REMOVED") & F.lit(include_creates), F.struct(F.lit(3).alias("step"), F.lit("CREATE").alias("op"), create.alias("statement")))
    )
    order = F.array_position(F.array(*[F.lit(t) for t in TYPE_ORDER]), kind).cast("int")
    return (
        diffs.select(*KEY, op.alias("o"), order.alias("type_order"))
        .where(F.col("o").isNotNull() & (F.col("o.statement") != "") & (F.col("type_order") > 0))
        .select("type_order", "o.step", *KEY, "o.op", "o.statement")
        .orderBy("type_order", "step", "database_name", "schema_name", "object_name")
    )


def row_checksum(columns: Sequence[str]) -> Column:
    """Checksum of a row in which NULL and empty text differ and neighbours cannot run together."""
    parts = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("N")) for c in columns]
    return F.sha2(F.concat_ws("\u0001", *parts), 256)


def row_snapshot_diff(old: DataFrame, new: DataFrame, key: str, keep_equal: bool = False) -> DataFrame:
    """added, removed and modified rows by key with both checksums; keys are unique on each side."""
    columns = [c for c in old.columns if c != key]
    a = old.select(key, row_checksum(columns).alias("old_checksum"))
    b = new.select(key, row_checksum(columns).alias("new_checksum"))
    return row_verdicts(a, b, key, keep_equal)


def row_verdicts(old: DataFrame, new: DataFrame, key: str, keep_equal: bool = False) -> DataFrame:
    """What became of each key, from (key, old_checksum) and (key, new_checksum)."""
    verdict = (
        F.when(F.col("old_checksum").isNull(), "added")
        .when(F.col("new_checksum").isNull(), "removed")
        .when(F.col("old_checksum") != F.col("new_checksum"), "modified")
        .otherwise("equal")
    )
    out = old.join(new, key, "full_outer").withColumn("verdict", verdict)
    return out if keep_equal else out.where(F.col("verdict") != "equal")


def undoing(verdicts: DataFrame, key: str) -> DataFrame:
    """Operation per key that takes the new version back to the old."""
    op = F.when(F.col("verdict") == "added", "DROP").when(F.col("verdict") == "modified", "REPLACE").otherwise("CREATE")
    return verdicts.select(key, op.alias("op"))


def restore_operations(snapshot: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Operation per key that takes ``current`` back to ``snapshot``."""
    return undoing(row_snapshot_diff(snapshot, current, key), key)


def only_in_left(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_anti")


def row_multiset_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """Rows, with multiplicity, that one table holds and the other does not, in one aggregate.

    Both tables are counted per distinct row before the shuffle, so many equal rows cost one.
    """
    columns = source.columns
    both = source.select("*", F.lit(1).alias("__n")).unionByName(target.select(*columns, F.lit(-1).alias("__n")))
    net = both.groupBy(*columns).agg(F.sum("__n").alias("__net")).where(F.col("__net") != 0)
    return net.select(
        *columns,
        F.when(F.col("__net") > 0, "source").otherwise("target").alias("only_in"),
        F.abs("__net").alias("copies"),
    )


def cdc_changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Change feed between two versions: insert and update rows as they are now, deletes as they were."""
    columns = [c for c in new.columns if c != key]
    a = old.select(key, F.struct(*columns).alias("__old"))
    b = new.select(key, F.struct(*columns).alias("__new"))
    kind = (
        F.when(F.col("__old").isNull(), "insert")
        .when(F.col("__new").isNull(), "delete")
        .when(~F.col("__old").eqNullSafe(F.col("__new")), "update")
    )
    changed = a.join(b, key, "full_outer").withColumn("change", kind).where(F.col("change").isNotNull())
    return changed.select("change", key, F.coalesce("__new", "__old").alias("r")).select("change", key, "r.*")


def version_compare(versions: DataFrame, older: int, newer: int) -> DataFrame:
    """Differences from one stored catalog version to another."""
    return catalog_diff(versions.where(F.col("version") == older), versions.where(F.col("version") == newer))


def latest_version(versions: DataFrame) -> DataFrame:
    return versions.agg(F.max_by("version", F.struct("captured_at", "version")).alias("version"))

