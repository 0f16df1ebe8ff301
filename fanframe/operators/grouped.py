"""Functions over whole groups.

A group must fit into one Python worker, since the function sees all of it; where the result is
an aggregate, native=True keeps it in the JVM with partial aggregation, which hot keys don't hurt.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fanframe.functions.batches import Groups, by_groups
from fanframe.functions.schema import fields
from fanframe.functions.udf import as_outputs, bound
from fanframe.progress import Progress, counted, counter


class Attributes(dict):
    """A group's own attrs. pandas copies attrs deeply to whatever is derived, which takes longer than most functions; not if they seem empty."""

    def __bool__(self) -> bool:
        return False


MODES = ("scalar", "series", "frame", "transform")


def group_apply(df: DataFrame, keys: str | Sequence[str], f: Callable, returns=None, mode: str = "scalar", columns: Sequence[str] | None = None, order_by: Sequence[str] = (), args: tuple = (), name: str = "result", dropna: bool = True, with_key: bool = False, native: bool = False, progress: Progress | None = None, condense: Callable | None = None, condensed=None, **kwargs) -> DataFrame:
    """f(group, *args, **kwargs) for each group; key columns and the result's columns.

    mode: "scalar" (one value a group), "series" (one row, columns by label), "frame" (any rows),
    "transform" (a row for each row; `order_by` columns are carried as the row's key).
    Rows with a null key are dropped unless dropna is False. with_key: f(key, group).
    columns: those that f needs; only they are read. order_by: the order of a group's rows.
    A frame may be a dict of columns, which is much faster to make.
    condense: where f needs little of a group, condense(piece) gives rows (a frame, its columns
    declared as `condensed`) that stand for a piece of a group. Pieces shrink where they are read,
    and f sees the rows that stand for them all, so that no worker holds a large group.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    keys, order_by = [keys] if isinstance(keys, str) else list(keys), list(order_by)
    if dropna:
        df = df.dropna(subset=keys)
    if native:
        out = f(*args, **kwargs) if args or kwargs else f()
        made = out if isinstance(out, dict) else {name: out}
        return df.groupBy(*keys).agg(*[c.alias(n) for n, c in made.items()])
    if condense is not None:
        if mode == "transform" or order_by:
            raise ValueError("condense is for results of whole groups, in any order of rows")
        df = _run(df, keys, condense, fields(condensed), "frame", columns, [], False, None, pieces=True)
        columns = None
    return _run(df, keys, bound(f, args, kwargs) if not with_key else lambda key, g: f(key, g, *args, **kwargs), fields(returns, f, name), mode, columns, order_by, with_key, counter(progress, "groups"))


def _run(df: DataFrame, keys: list[str], f: Callable, cols: list[T.StructField], mode: str, columns: Sequence[str] | None, order_by: list[str], with_key: bool, count, pieces: bool = False) -> DataFrame:
    used = list(dict.fromkeys([*keys, *order_by, *(columns if columns is not None else df.columns)]))
    carried = [c for c in order_by if c not in keys] if mode == "transform" else []
    cols = [c for c in cols if c.name not in carried and c.name not in keys]
    names = [c.name for c in cols]

    def values(key, pdf) -> list[list]:
        """Of one group, a list for each result column."""
        name, n = key if len(key) > 1 else key[0], len(pdf)
        object.__setattr__(pdf, "_attrs", Attributes(name=name))
        object.__setattr__(pdf, "name", name)  # as pandas has it, whatever the columns are
        got = f(name, pdf) if with_key else f(pdf)
        if mode == "scalar":
            made = [[got]]
        elif mode == "series":
            # Labels are looked up only where they differ from the columns: a look-up in a fresh index builds a table first.
            same = isinstance(got, pd.Series) and got.index.tolist() == names
            made = [[v] for v in (got.tolist() if same else [got[c] for c in names])]
        elif isinstance(got, pd.Series):
            made = [got.tolist()]
        else:
            made = [x.tolist() if hasattr(x, "tolist") else list(x) for x in (got[c.name] for c in cols)]
        if mode == "transform" and len(made[0]) != n:
            raise ValueError(f"a transform of {n} rows gave {len(made[0])}")
        return made

    def work(groups: Groups) -> pd.DataFrame:
        made: list[list] = [[] for _ in cols]
        sizes = []
        for key, pdf in groups:
            got = values(key, pdf)
            for into, x in zip(made, got, strict=True):
                into += x
            sizes.append(len(got[0]))
        counted(count, len(groups))
        spots = np.repeat(groups.starts[:-1], sizes)
        return pd.DataFrame({**{k: groups.column(k, spots) for k in keys}, **{c: groups.column(c) for c in carried}, **{c.name: as_outputs(x, c) for c, x in zip(cols, made, strict=True)}})

    schema = T.StructType([df.schema[k] for k in keys] + [df.schema[c] for c in carried] + cols)
    return by_groups(df, keys, used, work, schema, [F.col(f"`{c}`").asc_nulls_last() for c in order_by], pieces=pieces)
