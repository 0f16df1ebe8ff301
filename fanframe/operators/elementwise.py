"""Functions over the values of one column: map (function or dictionary) and apply."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fanframe.functions.schema import fields, parse
from fanframe.functions.udf import as_output, bound, frame_columns, spread
from fanframe.progress import Progress, counted, counter

#: Larger dictionaries are joined, smaller ones are part of the plan.
INLINE = 200


def map_values(df: DataFrame, column: str, f: Callable | Mapping, returns=None, keys: Sequence[str] = (), na_action: str | None = None, name: str = "result", native: bool = False, partitions: int | None = None, progress: Progress | None = None) -> DataFrame:
    """f(value), or the dictionary's entry (null where there is none); keys and the result.

    A mapping with a default of its own (__missing__) is asked for every value, as a function.
    Null and NaN values reach a function unless na_action is "ignore", which leaves them null.
    """
    if na_action not in (None, "ignore"):
        raise ValueError(f"na_action must be None or 'ignore', not {na_action!r}")
    keys, value = list(keys), F.col(f"`{column}`")
    if isinstance(f, Mapping) and hasattr(f, "__missing__"):
        f = f.__getitem__  # the mapping knows what to give for other values
    elif isinstance(f, Mapping):
        return _map_dictionary(df, column, f, keys, name, returns)
    if native:
        out = f(value)
        return df.select(*keys, (F.when(value.isNotNull(), out) if na_action else out).alias(name))
    kind, count = parse(returns, f), counter(progress)

    def run(batches):
        for pdf in batches:
            counted(count, len(pdf))
            made = as_output(pdf["v"].map(f, na_action=na_action).tolist(), T.StructField(name, kind))
            yield pd.DataFrame({**{k: pdf[k].to_numpy() for k in keys}, name: made})

    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField(name, kind)])
    return spread(df.select(*keys, value.alias("v")), partitions).mapInPandas(run, schema)


def _map_dictionary(df: DataFrame, column: str, entries: Mapping, keys: list[str], name: str, returns) -> DataFrame:
    value = F.col(f"`{column}`")
    kind = None if returns is None else parse(returns)
    if not entries:
        return df.select(*keys, F.lit(None).cast(kind or T.StringType()).alias(name))
    if len(entries) <= INLINE:
        table = F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])
        out = F.when(value.isNotNull(), F.element_at(table, value))
        return df.select(*keys, (out.cast(kind) if kind else out).alias(name))
    rows = df.sparkSession.createDataFrame(list(entries.items()), ["map_key", "map_value"])
    # The optimizer broadcasts the entries if their size allows.
    out = df.join(rows, value == F.col("map_key"), "left")
    return out.select(*keys, (F.col("map_value").cast(kind) if kind else F.col("map_value")).alias(name))


def apply_values(df: DataFrame, column: str, f: Callable, returns=None, keys: Sequence[str] = (), args: tuple = (), name: str = "result", native: bool = False, partitions: int | None = None, progress: Progress | None = None, **kwargs) -> DataFrame:
    """f(value, *args, **kwargs) for each value; a declared struct widens to its columns."""
    keys, value = list(keys), F.col(f"`{column}`")
    if native:
        out = f(value, *args, **kwargs)
        made = out if isinstance(out, dict) else {name: out}
        return df.select(*keys, *[c.alias(n) for n, c in made.items()])
    cols, call, count = fields(returns, f, name), bound(f, args, kwargs), counter(progress)
    names = [c.name for c in cols]

    def run(batches):
        for pdf in batches:
            counted(count, len(pdf))
            made = frame_columns(pd.Series([call(v) for v in pdf["v"].tolist()], dtype=object), names, len(pdf))
            yield pd.DataFrame({**{k: pdf[k].to_numpy() for k in keys}, **{c.name: as_output(v, c) for c, v in zip(cols, made, strict=True)}})

    schema = T.StructType([df.schema[k] for k in keys] + cols)
    return spread(df.select(*keys, value.alias("v")), partitions).mapInPandas(run, schema)
