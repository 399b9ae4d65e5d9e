"""Bulk loads from files, with rejects and an audit per file."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waybill.functions.convert import convert
from waybill.operators.ordered import row_number_by_key
from waybill.operators.writes import written
from waybill.session import checkpointed, fresh_dir
from waybill.sources.jsonarray import load_arrays

# fixed values: file formats a load accepts
FORMATS = ("CSV", "JSON", "PARQUET", "AVRO", "ORC")


@dataclass(frozen=True)
class LoadOptions:
    field_delimiter: str = ","
    record_delimiter: str | None = None
    skip_header: bool = False
    quote: str = '"'
    escape: str = "\\"
    strip_outer_array: bool = False


def bulk_load(spark: SparkSession, path: str, fmt: str, schema: T.StructType, options: LoadOptions = LoadOptions()) -> DataFrame:
    """Typed rows of the files under ``path``; compression follows the file names.

    JSON files hold one object per line or, with ``strip_outer_array``, are one array of objects each; both are split between tasks.
    """
    kind = fmt.upper()
    if kind not in FORMATS:
        raise ValueError(f"unknown file format {fmt}; known: {', '.join(FORMATS)}")
    if kind == "JSON" and options.strip_outer_array:
        return load_arrays(spark, path, schema)
    reader = spark.read.schema(schema)
    if kind == "CSV":
        reader = reader.options(sep=options.field_delimiter, header=options.skip_header, quote=options.quote, escape=options.escape, mode="FAILFAST")
        if options.record_delimiter:
            reader = reader.option("lineSep", options.record_delimiter)
    elif kind == "JSON":
        reader = reader.option("mode", "FAILFAST")
    try:
        return reader.format(kind.lower()).load(path)
    except AnalysisException as error:
        if kind == "AVRO":
            raise RuntimeError("AVRO needs the spark-avro package on the class path") from error
        raise


class LoadError(RuntimeError):
    """More rows were rejected than the load allows."""


def parsed_rows(spark: SparkSession, path: str, schema: T.StructType, options: LoadOptions = LoadOptions()) -> DataFrame:
    """CSV rows as text, their typed columns, the first error, and the file they came from.

    A row with too many or too few columns is an error, whatever its fields hold, and ``raw`` keeps its whole line.
    """
    raw = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    rows = (
        spark.read.schema(T.StructType([*raw, T.StructField("__line", T.StringType())]))
        .options(sep=options.field_delimiter, header=options.skip_header, quote=options.quote, escape=options.escape)
        # without pruning Spark counts the columns of every row, also where a query needs only some of them
        .options(columnNameOfCorruptRecord="__line", columnPruning=False)
        .csv(path)
    )
    quoted = f"{re.escape(options.quote)}(?:[^{re.escape(options.quote)}{re.escape(options.escape)}]|{re.escape(options.escape)}.)*{re.escape(options.quote)}"
    fields = F.regexp_count(F.regexp_replace("__line", quoted, ""), F.lit(re.escape(options.field_delimiter))) + 1
    typed = []
    problems = [
        F.when(
            F.col("__line").isNotNull(),
            F.concat(F.lit("too "), F.when(fields > len(raw), "many").otherwise("few"), F.lit(" columns: "), fields, F.lit(f" instead of {len(raw)}")),
        )
    ]
    for f in schema:
        kind = f.dataType.simpleString()
        c = F.col(f.name)
        made = convert(c, "DATETIME", "null") if kind == "timestamp_ntz" else c.try_cast(kind)
        typed.append(made.alias(f.name))
        problems.append(F.when(c.isNotNull() & made.isNull(), F.concat(F.lit(f"{f.name}: "), c)))
    return rows.select(
        *typed,
        F.coalesce(*problems).alias("error"),
        F.to_json(F.struct(*raw.names, F.col("__line").alias("line"))).alias("raw"),
        F.col("_metadata.file_path").alias("file"),
    )


def load_with_errors(spark: SparkSession, path: str, schema: T.StructType, on_error: str = "ABORT_STATEMENT", options: LoadOptions = LoadOptions()) -> tuple[DataFrame, DataFrame]:
    """Good rows and rejects of a CSV load.

    ``ABORT_STATEMENT`` allows no reject, ``CONTINUE`` any number, ``CONTINUE n`` up to n. The files
    are parsed once into a staged table; counting its rejects decides whether the load stands.
    """
    staged = written(parsed_rows(spark, path, schema, options), fresh_dir(spark, "load"))
    words = on_error.upper().split()
    allowed = None if words == ["CONTINUE"] else int(words[1]) if words[0] == "CONTINUE" else 0
    if allowed is not None:
        rejected = staged.where("error IS NOT NULL").count()
        if rejected > allowed:
            raise LoadError(f"{rejected} rows rejected, {allowed} allowed")
    good = staged.where("error IS NULL").select(*schema.names)
    return good, staged.where("error IS NOT NULL").select("file", "error", "raw")


def load_audit(parsed: DataFrame, file: str = "file") -> DataFrame:
    """Per file: rows parsed, loaded and in error, one of the errors (the least text), and status."""
    errors = F.count_if(F.col("error").isNotNull())
    return parsed.groupBy(file).agg(
        F.count("*").alias("rows_parsed"),
        F.count_if(F.col("error").isNull()).alias("rows_loaded"),
        errors.alias("errors_seen"),
        F.min("error").alias("first_error"),
        F.when(errors == 0, "LOADED").when(errors < F.count("*"), "PARTIALLY_LOADED").otherwise("LOAD_FAILED").alias("status"),
    )


def external_raw_scan(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines of JSON files as variants with file name, row number in the file and load time.

    Lines are numbered by their place in the file: block by block, and within a block as read. The
    scan is checkpointed first, so all steps of the numbering see the same places.
    """
    lines = spark.read.text(path).select(
        F.col("value"),
        F.col("_metadata.file_path").alias("filename"),
        (F.col("_metadata.file_block_start").cast("decimal(38,0)") * F.expr("8589934592BD") + F.monotonically_increasing_id() % 8589934592).alias("__at"),
    )
    numbered = row_number_by_key(checkpointed(lines), ["filename"], ["__at"], "file_row_number")
    return numbered.select(
        F.try_parse_json("value").alias("event_data"), "filename", "file_row_number", F.current_timestamp().alias("load_timestamp")
    )


def staging_load(rows: DataFrame, source_system: str) -> DataFrame:
    """Every column as text, with the source system and the load time."""
    return rows.select(
        *[F.col(c).cast("string").alias(c) for c in rows.columns],
        F.lit(source_system).alias("source_system"),
        F.current_timestamp().alias("load_timestamp"),
    )


def staging_to_typed(staged: DataFrame, types: dict[str, str]) -> DataFrame:
    """Typed rows from text; unparseable values become NULL and are counted per row."""
    made = {c: convert(F.col(c), kind, "null") for c, kind in types.items()}
    bad = sum((F.when(F.col(c).isNotNull() & v.isNull(), 1).otherwise(0) for c, v in made.items()), F.lit(0))
    return staged.select(*[v.alias(c) for c, v in made.items()], bad.alias("unparseable"))
