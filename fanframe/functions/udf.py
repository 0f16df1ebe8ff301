"""Batch functions: how rows, cells and frames reach a user function and what comes back."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fanframe.session import config


def bound(f, args=(), kwargs=None):
    """f with trailing arguments, as pandas passes them."""
    kwargs = kwargs or {}
    if not args and not kwargs:
        return f

    @functools.wraps(f, updated=())
    def call(x):
        return f(x, *args, **kwargs)

    return call


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Enough partitions for a Python stage: files read as fewer tasks than there are cores are dealt anew.

    Python over a row costs far more than moving it once. An input that is read in more partitions
    than that isn't touched: a stated number of workers never turns a large scan into fewer tasks.
    """
    if df.isStreaming:
        return df
    spark = df.sparkSession
    asked = partitions or config().nb_workers
    n = asked or spark.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().optimizedPlan()
    size = int(str(plan.stats().sizeInBytes()))
    per_task = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    unknown = size >= 1 << 60  # what Spark takes where it has no statistics
    if size > n * per_task and not (asked and unknown):
        return df
    return df.repartition(n)


def as_output(values, field: T.StructField) -> pd.Series:
    """A result column; NaN becomes null at this edge."""
    out = pd.Series(values)
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return pd.to_numeric(out).astype("float64")
    if isinstance(field.dataType, T.ArrayType):
        return out.map(lambda v: None if v is None else list(v))
    if out.dtype.kind == "f":
        return out.astype(object).where(out.notna(), None)
    return out


def as_outputs(values: list, field: T.StructField) -> pd.Series:
    """As as_output, for the results of many groups: integers stay exact beside another group's null."""
    if isinstance(field.dataType, (T.IntegralType, T.BooleanType)):
        return pd.Series([None if pd.isna(v) else v.item() if isinstance(v, np.generic) else v for v in values], dtype=object)
    return as_output(values, field)


def frame_columns(result, names: list[str], n: int) -> list[list]:
    """The named columns of what a row function returned for n rows."""
    if isinstance(result, pd.DataFrame):
        if all(c in result.columns for c in names):
            return [result[c].tolist() for c in names]
        return [result.iloc[:, k].tolist() for k in range(len(names))]
    if len(names) == 1:
        return [result.tolist()]
    rows = [[r.get(c) for c in names] if isinstance(r, dict) else list(r) for r in result]
    return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in names]


def common_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows as pandas gives them to a row function: integers beside floats are floats."""
    kinds = {d.kind for d in pdf.dtypes}
    return pdf.astype(np.float64) if kinds <= set("if") and "f" in kinds else pdf
