"""Python functions of the caller as SQL functions, by their type hints."""

from __future__ import annotations

import typing
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import types as T

_PLAIN = {str: T.StringType(), int: T.LongType(), float: T.DoubleType(), bool: T.BooleanType(), bytes: T.BinaryType()}


def spark_type(hint: object) -> T.DataType:
    """Of str, int, float, bool, bytes, list[...], dict[..., ...] and optional ones of these."""
    if hint in _PLAIN:
        return _PLAIN[hint]
    args = [a for a in typing.get_args(hint) if a is not type(None)]
    kind = typing.get_origin(hint)
    if kind is list:
        return T.ArrayType(spark_type(args[0]))
    if kind is dict:
        return T.MapType(spark_type(args[0]), spark_type(args[1]))
    if len(args) == 1:
        return spark_type(args[0])
    raise TypeError(f"no column type for {hint!r}")


def register(spark: SparkSession, f: Callable, name: str | None = None) -> dict[str, str]:
    """Registers a function for SQL, Arrow-batched; its parameters and their types. Functions
    whose parameters or result have no hint are refused."""
    hints = typing.get_type_hints(f)
    if "return" not in hints:
        raise TypeError(f"{f.__name__} does not say what it returns")
    result = spark_type(hints.pop("return"))
    parameters = f.__code__.co_varnames[: f.__code__.co_argcount]
    if missing := [p for p in parameters if p not in hints]:
        raise TypeError(f"{f.__name__}: no type of {', '.join(missing)}")
    from pyspark.sql.functions import udf

    spark.udf.register(name or f.__name__, udf(f, result, useArrow=True))
    return {p: spark_type(hints[p]).simpleString() for p in parameters}
