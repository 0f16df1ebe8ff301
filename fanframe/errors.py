"""Exceptions of user functions keep their type at the actions of this module."""

from __future__ import annotations

import builtins
import contextlib
import re

from pyspark.errors import PythonException
from pyspark.sql import DataFrame

LAST_LINE = re.compile(r"^(?:\w+\.)*(\w+)(?::\s?(.*))?$")


@contextlib.contextmanager
def reraise():
    """Raise the builtin exception that a user function raised on a worker, from Spark's own."""
    try:
        yield
    except PythonException as e:
        for line in reversed(str(e).splitlines()):
            m = LAST_LINE.match(line.strip())
            kind = getattr(builtins, m[1], None) if m else None
            if isinstance(kind, type) and issubclass(kind, Exception):
                try:
                    error = kind(m[2] or "")
                except TypeError:
                    break
                raise error from e
        raise


def collect(df: DataFrame) -> list:
    with reraise():
        return df.collect()


def to_pandas(df: DataFrame, order_by=None):
    """A pandas frame; in the given order, which is the only way to have one."""
    with reraise():
        out = df.toPandas()
    return out.sort_values(order_by, kind="stable", ignore_index=True) if order_by else out
