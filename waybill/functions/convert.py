"""Type conversion, date parsing and value maps over columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: type names accepted by a column mapping
TYPES = {
    "STRING": "string", "VARCHAR": "string", "TEXT": "string",
    "INT": "bigint", "INTEGER": "bigint", "BIGINT": "bigint",
    "FLOAT": "double", "DOUBLE": "double",
    "DECIMAL": "decimal(18,2)", "NUMERIC": "decimal(18,2)",
    "BOOLEAN": "boolean", "BOOL": "boolean",
    "DATE": "date",
    "TIMESTAMP": "timestamp_ntz", "DATETIME": "timestamp_ntz",
}

# fixed values: accepted date layouts, first match wins
_DAY = r"\d{4}-\d{2}-\d{2}"
_CLOCK = r"\d{2}:\d{2}:\d{2}"


def parse_date_multi(c: Column) -> Column:
    """Timestamp from yyyy-MM-dd, MM/dd/yyyy, yyyy-MM-ddTHH:mm:ssZ or yyyy-MM-dd HH:mm:ss; else NULL.

    Works on text only, so no session time zone is involved.
    """
    text = (
        F.when(c.rlike(f"^{_DAY}( {_CLOCK})?$"), c)
        .when(c.rlike(r"^\d{2}/\d{2}/\d{4}$"), F.regexp_replace(c, r"^(\d{2})/(\d{2})/(\d{4})$", "$3-$1-$2"))
        .when(c.rlike(f"^{_DAY}T{_CLOCK}Z$"), F.translate(c, "TZ", " "))
    )
    return text.try_cast("timestamp_ntz")


def convert(c: Column, type_name: str, on_error: str = "abort") -> Column:
    """Cast to a named type. ``abort`` fails the job on a bad value, ``null`` gives NULL.

    Unknown type names leave the value as it is.
    """
    target = TYPES.get(type_name.upper().split("(")[0])
    if target is None:
        return c
    if "(" in type_name and target.startswith("decimal"):
        target = type_name.lower().replace("numeric", "decimal")
    if target in ("date", "timestamp_ntz"):
        parsed = parse_date_multi(c.cast("string"))
        if on_error == "abort":
            problem = F.concat(F.lit("not a date: "), c.cast("string"))
            parsed = F.when(c.isNull() | parsed.isNotNull(), parsed).otherwise(F.raise_error(problem).cast("timestamp_ntz"))
        return parsed.cast(target)
    return c.try_cast(target) if on_error == "null" else c.cast(target)


def value_map(c: Column, mapping: Mapping[str, str | None], default: str | None = None) -> Column:
    """Dictionary on the text of the value; a miss gives ``default``, or the value itself."""
    text = c.cast("string")
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    miss = F.lit(default) if default is not None else text
    return F.when(F.map_contains_key(table, text), F.try_element_at(table, text)).otherwise(miss)
