"""Declared results: a DDL type ("double"), DDL columns ("a double, b long"), a type or a struct."""

from __future__ import annotations

import typing

from pyspark.sql import types as T

HINTS = {int: T.LongType(), float: T.DoubleType(), str: T.StringType(), bool: T.BooleanType()}


def parse(returns, function=None) -> T.DataType:
    """The Spark type of `returns`; None takes the function's return annotation."""
    if returns is None and function is not None:
        returns = typing.get_type_hints(function).get("return") if hasattr(function, "__annotations__") else None
        if returns is None:
            raise ValueError("returns is needed: a DDL string, a type, or a return annotation of int, float, str or bool")
    if isinstance(returns, T.DataType):
        return returns
    if returns in HINTS:
        return HINTS[returns]
    if isinstance(returns, str):
        return T._parse_datatype_string(returns)
    raise ValueError(f"not a type: {returns!r}")


def fields(returns, function=None, name: str = "result") -> list[T.StructField]:
    """The result's columns: those of a struct, or one by the given name."""
    kind = parse(returns, function)
    return list(kind.fields) if isinstance(kind, T.StructType) else [T.StructField(name, kind, True)]
