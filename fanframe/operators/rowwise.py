"""Functions over rows, columns and cells of a table.

A Python function runs in Arrow batches. With native=True the function gets Columns and gives
Columns, and the plan stays within code generation.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fanframe.functions.batches import Groups, by_groups
from fanframe.functions.schema import fields, parse
from fanframe.functions.udf import as_output, as_outputs, bound, common_rows, frame_columns, spread
from fanframe.progress import Progress, counted, counter

AXES = {0: 0, "index": 0, 1: 1, "columns": 1}


def axis_number(axis) -> int:
    """0 for columns as wholes, 1 for rows; anything else is an error before any work starts."""
    if isinstance(axis, bool) or axis not in AXES:
        raise ValueError(f"No axis named {axis}")
    return AXES[axis]


class Fields:
    """A row of Columns: by name, or as an attribute."""

    def __init__(self, names: Sequence[str]):
        self._names = list(names)

    def __getitem__(self, name: str) -> Column:
        if name not in self._names:
            raise KeyError(name)
        return F.col(f"`{name}`")

    __getattr__ = __getitem__


def apply(df: DataFrame, f: Callable, axis=0, **how) -> DataFrame:
    """apply_columns for axis 0 or "index", apply_rows for axis 1 or "columns"."""
    return (apply_rows if axis_number(axis) else apply_columns)(df, f, **how)


def apply_rows(df: DataFrame, f: Callable, returns=None, keys: Sequence[str] = (), columns: Sequence[str] | None = None, args: tuple = (), raw: bool = False, result_type: str | None = None, name: str = "result", native: bool = False, spelled: bool = False, partitions: int | None = None, progress: Progress | None = None, **kwargs) -> DataFrame:
    """f(row) for every row; keys and the result's columns.

    returns: a type for scalars and lists, columns for rows that give a Series, dict, list or frame row.
    result_type: as in pandas ("expand", "reduce", "broadcast"). spelled: f takes the columns'
    values as arguments in place of a row, which is several times faster.
    """
    columns = list(columns if columns is not None else [c for c in df.columns if c not in keys])
    keys = list(keys)
    if native:
        out = f(Fields(columns), *args, **kwargs)
        made = out if isinstance(out, dict) else {name: out}
        return df.select(*keys, *[c.alias(n) for n, c in made.items()])
    if result_type == "broadcast" and returns is None:
        returns = T.StructType([df.schema[c] for c in columns])
    cols = fields(returns, f, name)
    names, call, count = [c.name for c in cols], bound(f, args, kwargs), counter(progress)

    def run(batches):
        for pdf in batches:
            body = pdf[columns]
            if spelled:
                if all(d.kind in "if" for d in body.dtypes):
                    body = common_rows(body)
                got = pd.Series([f(*v, *args, **kwargs) for v in zip(*(body[c].tolist() for c in columns), strict=True)], dtype=object)
            elif len(body):
                got = body.apply(call, axis=1, raw=raw, result_type=result_type)
            else:
                got = pd.Series([], dtype=object)
            made = frame_columns(got, names, len(pdf))
            counted(count, len(pdf))
            yield pd.DataFrame({**{k: pdf[k].to_numpy() for k in keys}, **{c.name: as_output(v, c) for c, v in zip(cols, made, strict=True)}})

    schema = T.StructType([df.schema[k] for k in keys] + cols)
    return spread(df.select(*keys, *[c for c in columns if c not in keys]), partitions).mapInPandas(run, schema)


def apply_columns(df: DataFrame, f: Callable, returns=None, columns: Sequence[str] | None = None, order_by: Sequence[str] = (), mode: str = "reduce", args: tuple = (), native: bool = False, name: str = "result", progress: Progress | None = None, condense: Callable | None = None, **kwargs) -> DataFrame:
    """f(column) for every column as a whole.

    mode "reduce": one row (column, result) per column. mode "same": f gives a value for each row;
    the order columns and the changed columns. A whole column meets in one task, as f needs it;
    native functions (a Column aggregate, or one over the column) aggregate before the shuffle.
    A column without rows reduces to f of an empty column, null if that fails.
    condense (mode "reduce"): where f needs little of a column, condense(piece) gives the values that
    stand for a piece of it. Pieces shrink where they are read, and f sees what stands for them all.
    """
    columns = list(columns if columns is not None else [c for c in df.columns if c not in order_by])
    order_by = list(order_by)
    if mode not in ("reduce", "same"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "same" and not order_by:
        raise ValueError("a result for each row needs order_by: unique key columns")
    if condense is not None and (native or mode != "reduce" or order_by):
        raise ValueError("condense is for Python functions in mode 'reduce', in any order of rows")
    call = bound(f, args, kwargs)
    if native and mode == "reduce":
        wide = df.agg(*[f(F.col(f"`{c}`"), *args, **kwargs).alias(c) for c in columns])
        return wide.unpivot([], columns, "column", name) if len(columns) else wide
    if native:  # f(column, over) applies `over` to its aggregates, which are taken once and come back as one row
        aggregates: list[Column] = []

        def over(agg: Column) -> Column:
            aggregates.append(agg.alias(f"__aggregate_{len(aggregates)}"))
            return F.col(f"__aggregate_{len(aggregates) - 1}")

        made = [f(F.col(f"`{c}`"), over, *args, **kwargs).alias(c) for c in columns]
        rows = df.join(F.broadcast(df.agg(*aggregates)), F.lit(True)) if aggregates else df
        return rows.select(*order_by, *made)
    kind = parse(returns, f)
    keyed = df.select(*[F.col(o).alias(f"key_{k}") for k, o in enumerate(order_by)], *[F.col(f"`{c}`").cast("double").alias(f"v_{k}") for k, c in enumerate(columns)])
    ids = [f"key_{k}" for k in range(len(order_by))]
    if condense is not None and columns:

        def condensed(batches):
            for pdf in batches:
                for k, c in enumerate(columns if len(pdf) else []):
                    v = [float(x) for x in condense(pdf[f"v_{k}"].rename(c))]
                    yield pd.DataFrame({"c": np.full(len(v), k, dtype="int32"), "v": v})

        tall = spread(keyed).mapInPandas(condensed, "c int, v double")
    else:
        tall = keyed.select(*ids, F.explode(F.array(*[F.struct(F.lit(k).alias("c"), F.col(f"v_{k}").alias("v")) for k in range(len(columns))])).alias("x")).select(*ids, "x.c", "x.v") if columns else None
    if tall is None:
        return df.sparkSession.createDataFrame([], T.StructType([T.StructField("column", T.StringType()), T.StructField(name, kind)]))
    count = counter(progress, "columns")
    if mode == "reduce":
        result = T.StructType([T.StructField("column", T.StringType()), T.StructField(name, kind)])

        def reduce(groups: Groups) -> pd.DataFrame:
            got = []
            for key, pdf in groups:
                values = pdf["v"].iloc[:-1]  # the last is the column's mark
                values.name = columns[key[0]]
                try:
                    got.append(call(values))
                except Exception:
                    if len(values):
                        raise
                    got.append(None)
            counted(count, len(groups))
            return pd.DataFrame({"column": [columns[c] for c in groups.ids[0]], name: as_outputs(got, result[name])})

        # A row for each column that isn't one of its own, so that columns without rows are met too.
        marks = df.sparkSession.range(len(columns)).select(F.col("id").cast("int").alias("c"), F.lit(None).cast("double").alias("v"), F.lit(True).alias("mark"))
        tall = tall.withColumn("mark", F.lit(False)).unionByName(marks, allowMissingColumns=True)
        return by_groups(tall, ["c"], ["c", "v"], reduce, result, [F.col("mark"), *[F.col(i).asc_nulls_last() for i in ids]], sorting=["mark", *ids])

    def same(key, pdf):
        pdf = pdf.sort_values(ids, kind="stable", ignore_index=True)
        counted(count, 1)
        return pdf[ids].assign(c=columns[key[0]], r=as_output(list(call(pdf["v"].rename(columns[key[0]]))), T.StructField("r", kind)))

    schema = T.StructType([keyed.schema[i] for i in ids] + [T.StructField("c", T.StringType()), T.StructField("r", kind)])
    wide = tall.groupBy("c").applyInPandas(same, schema).groupBy(*ids).pivot("c", columns).agg(F.first("r"))
    return wide.select(*[F.col(i).alias(o) for i, o in zip(ids, order_by, strict=True)], *columns)


def apply_cells(df: DataFrame, f: Callable, returns=None, columns: Sequence[str] | None = None, keys: Sequence[str] = (), na_action: str | None = None, native: bool = False, partitions: int | None = None, progress: Progress | None = None, **kwargs) -> DataFrame:
    """f(cell) for every cell of the columns; keys and the columns under their names. na_action="ignore" leaves nulls alone."""
    if na_action not in (None, "ignore"):
        raise ValueError(f"na_action must be None or 'ignore', not {na_action!r}")
    columns, keys = list(columns if columns is not None else [c for c in df.columns if c not in keys]), list(keys)
    call = bound(f, (), kwargs)
    if native:
        one = lambda c: F.when(c.isNotNull(), call(c)) if na_action else call(c)
        return df.select(*keys, *[one(F.col(f"`{c}`")).alias(c) for c in columns])
    kind, count = parse(returns, f), counter(progress)

    def run(batches):
        for pdf in batches:
            counted(count, len(pdf))
            made = {c: as_output(pdf[c].map(call, na_action=na_action).tolist(), T.StructField(c, kind)) for c in columns}
            yield pd.DataFrame({**{k: pdf[k].to_numpy() for k in keys}, **made})

    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField(c, kind) for c in columns])
    return spread(df.select(*keys, *columns), partitions).mapInPandas(run, schema)


#: pandas' newer name for the same.
map_cells = apply_cells
