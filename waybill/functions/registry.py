"""Named transforms and validators that users add to the row steps."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from waybill.functions.convert import convert, value_map
from waybill.functions.text import trim_all

Transform = Callable[..., Column]
Validator = Callable[..., Column]


class Registry:
    """Names for Column -> Column functions; a pandas UDF is a Column function too."""

    def __init__(self, kind: str, initial: Mapping[str, Callable]):
        self._kind = kind
        self._known = dict(initial)

    def register(self, name: str, function: Callable) -> None:
        self._known[name.upper()] = function

    def register_vectorised(self, spark: SparkSession, name: str, function: Callable[..., pa.Array], returns: str) -> None:
        """Add a function from Arrow arrays to one Arrow array of type ``returns``, for what Spark's own functions cannot say.

        It runs on batches in Python workers, and is known in expression text and SQL of the session under the same name, too. Each call
        gets arrays of one length and gives an array of that length; nulls are part of them.
        """
        made = F.arrow_udf(_annotated(function), returns)
        spark.udf.register(name, made)
        self.register(name, lambda *columns: made(*columns))

    def __getitem__(self, name: str) -> Callable:
        try:
            return self._known[name.upper()]
        except KeyError:
            raise KeyError(f"no {self._kind} named {name}; known: {sorted(self._known)}") from None


def _annotated(function: Callable) -> Callable:
    """The function with Arrow types on all parameters, which tell Spark that it works on arrays."""

    def called(*arrays):
        return function(*arrays)

    names = list(inspect.signature(function).parameters)
    called.__annotations__ = {**dict.fromkeys(names, pa.Array), "return": pa.Array}
    called.__signature__ = inspect.Signature(
        [inspect.Parameter(n, inspect.Parameter.POSITIONAL_ONLY, annotation=pa.Array) for n in names], return_annotation=pa.Array
    )
    called.__name__ = getattr(function, "__name__", "function")
    return called


def _lookup(c: Column, mapping: Mapping[str, str], default: str | None = None) -> Column:
    return value_map(c, mapping, default)


def transforms() -> Registry:
    return Registry(
        "transform",
        {
            "UPPER": F.upper,
            "LOWER": F.lower,
            "TRIM": trim_all,
            "REGEXP_REPLACE": lambda c, pattern, replacement: F.regexp_replace(c, pattern, replacement),
            "MAP": _lookup,
            "CONVERT": lambda c, type, on_error="abort": convert(c, type, on_error),
            "COMPUTE": lambda c, expression: F.expr(expression),
        },
    )


def validators() -> Registry:
    """Each gives the number of rows that break the rule, as an aggregate column."""
    return Registry(
        "validator",
        {
            "NOT_NULL": lambda column: F.count_if(F.col(column).isNull()),
            "NOT_BLANK": lambda column: F.count_if(F.trim(F.col(column)) == ""),
            "RULE": lambda expression: F.count_if(~F.coalesce(F.expr(expression), F.lit(False))),
        },
    )
