"""Many groups in one Python call: sorted rows come in batches, and groups are slices of them.

A call for each group costs milliseconds before the function has started. Here rows are dealt by
their keys, sorted in the JVM (which can spill) and streamed; the last group of a batch waits for
the next one, so that a worker holds a batch and one group at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fanframe.functions.udf import spread
from fanframe.session import config

NULL = "__null_of_{}"
#: Keys that are equal exactly if they are equal as Python values.
PLAIN = (T.IntegralType, T.FractionalType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)


def plain_keys(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether neighbours can be compared in Python: no nested keys, no strings with a collation."""
    return all(isinstance(t, PLAIN) or t.simpleString() == "string" for t in (df.schema[k].dataType for k in keys))


def _masked(field: T.StructField) -> bool:
    return field.nullable and isinstance(field.dataType, (T.IntegralType, T.BooleanType))


def packed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns, with nulls of integers and booleans apart: a null in one group must not make another group's integers floats."""
    out: list[Column] = []
    for c in columns:
        col = F.col(f"`{c}`")
        if _masked(df.schema[c]):
            zero = F.lit(False) if isinstance(df.schema[c].dataType, T.BooleanType) else F.lit(0)
            out += [F.coalesce(col, zero.cast(df.schema[c].dataType)).alias(c), col.isNull().alias(NULL.format(c))]
        else:
            out.append(col.alias(c))
    return df.select(*out)


def nulls_first(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """The order of a packed table by columns of `df`: as Spark's own, though nulls of integers and booleans are filled."""
    return [x for c in columns for x in ([F.col(f"`{NULL.format(c)}`").desc()] if _masked(df.schema[c]) else []) + [F.col(f"`{c}`")]]


def _sorting(rows: DataFrame, keys: Sequence[str]) -> list[Column]:
    return [F.col(f"`{c}`") for k in keys for c in (k, NULL.format(k)) if c in rows.columns]


def dealt(rows: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """Rows by their keys over enough partitions for Python, sorted within each.

    The number is stated, as Spark would otherwise merge partitions by their bytes, of which a group
    has few for the time that it takes.
    """
    spark = rows.sparkSession
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = max(spark.sparkContext.defaultParallelism, config().nb_workers or 0, min(int(spark.conf.get("spark.sql.shuffle.partitions")), size >> 20))
    by = _sorting(rows, keys)
    return rows.repartition(n, *by).sortWithinPartitions(*by, *order)


class Groups:
    """A batch of whole groups: `rows` in order, group k from starts[k] to starts[k + 1]."""

    def __init__(self, pdf: pd.DataFrame, keys: Sequence[str], columns: Sequence[str], starts: np.ndarray):
        self.keys, self.starts = list(keys), np.append(starts, len(pdf))
        self.rows = pd.DataFrame({c: pdf[c] for c in columns}, copy=False)
        self.nulls = {c: m for c in columns if NULL.format(c) in pdf.columns and (m := pdf[NULL.format(c)].to_numpy(dtype=bool)).any()}
        self.ids = [self._values(k) for k in keys]

    def __len__(self) -> int:
        return len(self.starts) - 1

    def _values(self, c: str) -> list:
        first = self.rows[c].iloc[self.starts[:-1]]
        values = list(first.to_numpy()) if first.dtype.kind in "iufb" else list(first)
        return [float("nan") if m else v for v, m in zip(values, self.nulls[c][self.starts[:-1]], strict=True)] if c in self.nulls else values

    def __iter__(self) -> Iterator[tuple[tuple, pd.DataFrame]]:
        ends, whole = self.starts.tolist(), self.rows._mgr
        for k, key in enumerate(zip(*self.ids, strict=True)):
            a, b = ends[k], ends[k + 1]
            part = whole.get_slice(slice(a, b), axis=1)  # as pandas' groupby cuts its groups: iloc takes several times longer
            part.axes[1] = pd.RangeIndex(b - a)
            g = pd.DataFrame._from_mgr(part, part.axes)
            for c, m in self.nulls.items():
                if m[a:b].any():
                    kind = object if g[c].dtype.kind == "b" else "float64"
                    g = g.assign(**{c: g[c].astype(kind).mask(m[a:b], None if kind is object else np.nan)})
            yield key, g

    def column(self, c: str, spots: np.ndarray | None = None) -> pd.Series:
        """A column at the given rows (default: all), with its nulls."""
        s = self.rows[c] if spots is None else self.rows[c].iloc[spots]
        if c in self.nulls:
            s = s.astype(object).mask(self.nulls[c] if spots is None else self.nulls[c][spots], None)
        return s.reset_index(drop=True)


def _changes(pdf: pd.DataFrame, names: Sequence[str]) -> np.ndarray:
    """Rows that differ from the one before in one of the columns."""
    new = np.zeros(max(len(pdf) - 1, 0), dtype=bool)
    for c in names:
        x = pdf[c].to_numpy()
        differ = x[1:] != x[:-1]
        if x.dtype.kind in "fOmM":  # nulls are one group, and so is NaN
            gone = pd.isna(pdf[c]).to_numpy()
            differ = differ & ~(gone[1:] & gone[:-1])
        new |= differ.astype(bool)
    return np.flatnonzero(new) + 1


def _joined(pieces: list[pd.DataFrame]) -> pd.DataFrame:
    """Pieces of one group as one frame. Only the first has the keys, which are the same in all rows and take no room."""
    n, made = sum(len(p) for p in pieces), {}
    for c in list(pieces[0].columns):
        if len(pieces) == 1 or c in pieces[1].columns:
            made[c] = pd.concat([p.pop(c) for p in pieces], ignore_index=True)
        else:
            one = pieces[0][c].iloc[:1]
            made[c] = pd.Series(np.broadcast_to(one.to_numpy(), n), copy=False) if isinstance(one.dtype, np.dtype) else one.repeat(n).reset_index(drop=True)
    return pd.DataFrame(made, copy=False)


def whole_groups(batches: Iterator[pd.DataFrame], keys: Sequence[str], columns: Sequence[str], pieces: bool = False) -> Iterator[Groups]:
    """Batches of sorted rows as batches of whole groups (of what a batch has of a group, if pieces)."""
    held: list[pd.DataFrame] = []  # of the last group
    for pdf in batches:
        same = [c for k in keys for c in (k, NULL.format(k)) if c in pdf.columns]
        if not len(pdf):
            continue
        starts = np.append(0, _changes(pdf, same))
        if pieces:
            yield Groups(pdf, keys, columns, starts)
            continue
        if held and not len(_changes(pd.concat([held[0].iloc[:1][same], pdf.iloc[:1][same]]), same)):
            end = int(starts[1]) if len(starts) > 1 else len(pdf)
            held.append(pdf.iloc[:end].drop(columns=same).copy())
            if end == len(pdf):
                continue
            pdf, starts = pdf.iloc[end:], starts[1:] - end
        if held:
            yield Groups(_joined(held), keys, columns, np.array([0]))
        last = int(starts[-1])
        if last:
            yield Groups(pdf.iloc[:last], keys, columns, starts[:-1])
        held = [pdf.iloc[last:].copy()]
    if held:
        yield Groups(_joined(held), keys, columns, np.array([0]))


def by_groups(df: DataFrame, keys: Sequence[str], columns: Sequence[str], work: Callable[[Groups], pd.DataFrame], schema: T.StructType, order: Sequence[Column] = (), sorting: Sequence[str] = (), pieces: bool = False) -> DataFrame:
    """work(Groups) over all groups of the table; pieces: over what each input partition's batches have of them, without a shuffle by keys.

    sorting: columns that only the order needs and that aren't sent to Python.
    """
    keys, columns = list(keys), list(columns)

    def run(batches):
        for groups in whole_groups(batches, keys, columns, pieces):
            yield work(groups)

    sent = packed(df, columns).columns
    rows = packed(df, [*columns, *[c for c in sorting if c not in columns]])
    if plain_keys(df, keys):
        rows = spread(rows).sortWithinPartitions(*_sorting(rows, keys)) if pieces else dealt(rows, keys, order)
        return rows.select(*[F.col(f"`{c}`") for c in sent]).mapInPandas(run, schema)

    def one(pdf):  # Spark tells the groups, in a call for each
        pdf = pdf.sort_values("__place", ignore_index=True) if order else pdf
        return work(Groups(pdf, keys, columns, np.array([0])))

    by = _sorting(rows, keys)
    rows = rows.withColumn("__place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))) if order else rows
    return rows.groupBy(*by).applyInPandas(one, schema)
