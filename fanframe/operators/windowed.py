"""Rolling and expanding functions, over groups or whole tables.

A rolling function runs pandas' own rolling in chunks of consecutive rows. Each chunk also gets
the rows around it that its windows reach (its halo), so hot groups and ungrouped tables are
dealt over many tasks. Positions come from a row number within groups; without groups, from row
numbers within ranges of the first order column plus the counts of the ranges before. Time windows
need no positions: chunks are spans of time, and their rows are sorted only once they are dealt.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pandas.api.indexers import BaseIndexer
from pandas.core.indexers.objects import VariableWindowIndexer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fanframe.functions.batches import Groups, by_groups, nulls_first
from fanframe.functions.frames import Frame
from fanframe.functions.udf import as_output
from fanframe.progress import Progress, counted, counter
from fanframe.session import config

CHUNK_ROWS = 20_000
RANGES = 64


def rolling(df: DataFrame, columns: str | Sequence[str], window: int | str, order_by: Sequence[str], by: Sequence[str] = (), min_periods: int | None = None, center: bool = False, closed: str | None = None, step: int | None = None, on: str | None = None, method: str = "single", axis: int = 0, win_type: str | None = None) -> Windows:
    """A rolling window over ordered rows; by: group columns. Time offsets are over `on` (default: the first order column)."""
    if method != "single" or axis != 0 or win_type is not None:
        raise NotImplementedError("only method='single', axis=0 and unweighted windows")
    return Windows(df, columns, Frame(window, min_periods, center, closed, step), order_by, by, on)


def expanding(df: DataFrame, columns: str | Sequence[str], order_by: Sequence[str], by: Sequence[str] = (), min_periods: int = 1, method: str = "single", axis: int = 0) -> Windows:
    """A window of all rows up to each one, within groups or the whole table."""
    if method != "single" or axis != 0:
        raise NotImplementedError("only method='single' and axis=0")
    return Windows(df, columns, Frame(None, min_periods), order_by, by, None)


def _micros(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType
    return F.unix_micros(F.col(column).cast("timestamp")) if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else F.col(column).cast("long")


class Windows:
    def __init__(self, df: DataFrame, columns, frame: Frame, order_by, by, on):
        self.df, self.frame = df, frame
        self.columns = [columns] if isinstance(columns, str) else list(columns)
        self.order_by, self.by = [order_by] if isinstance(order_by, str) else list(order_by), [by] if isinstance(by, str) else list(by)
        if not self.order_by:
            raise ValueError("order_by is needed: rows have no other order")
        self.on = on or self.order_by[0]

    def apply(self, f: Callable, raw: bool = False, args: tuple = (), kwargs: dict | None = None, index: str | None = None, name: str = "result", native: bool = False, chunk_rows: int = CHUNK_ROWS, engine: str | None = None, progress: Progress | None = None) -> DataFrame:
        """f(window) at every row, as doubles: by, order_by and a result column per input column.

        raw: f gets an array, else a Series labelled by `index` (default: the row's position).
        native: f(column, spec) gives a Column over the frame; min_periods of 1 and more holds for both.
        Native time windows that end at the current row are refused, since Spark's frames would
        take in later rows of the same time.
        """
        if engine not in (None, "cython"):
            raise NotImplementedError(f"engine {engine!r}")
        names = [name] if len(self.columns) == 1 else self.columns
        df = self.df.dropna(subset=self.by) if self.by else self.df
        if native:
            return self._native(df, f, names, chunk_rows)
        carried = list(dict.fromkeys([*self.by, *self.order_by]))
        rows = df.select(*carried, *[F.col(f"`{c}`").cast("double").alias(f"v_{k}") for k, c in enumerate(self.columns)], *([F.col(index).alias("label")] if index else []), *([_micros(df, self.on).alias("us")] if self.frame.timed else []))
        if self.frame.window is None:
            placed = rows.withColumns({"chunk": F.lit(0).cast("long"), "own": F.lit(True), "pos": F.lit(0).cast("long")})
        else:
            placed = self._chunks(rows if self.frame.timed else self._positions(rows, chunk_rows), chunk_rows)
        return self._run(placed, carried, names, f, raw, args, kwargs or {}, index, counter(progress))

    def _native(self, df: DataFrame, f: Callable, names: list[str], chunk_rows: int) -> DataFrame:
        if self.frame.least == 0:
            raise NotImplementedError("native windows need min_periods of 1 and more")
        if self.frame.timed and self.frame.closed not in ("left", "neither"):
            raise NotImplementedError("native time windows differ from pandas at tied times; use the Python form")
        if not self.by and not self.frame.timed and self.frame.window is not None:
            return self._native_chunks(df, f, names, chunk_rows)
        order = [_micros(df, self.on)] if self.frame.timed else [F.col(c) for c in self.order_by]
        spec = self.frame.over(self.by, order)
        out = []
        for c, n in zip(self.columns, names, strict=True):
            x = F.col(f"`{c}`").cast("double")
            clean = F.when(~F.isnan(x), x)
            out.append(F.when(F.count(clean).over(spec) >= self.frame.least, f(clean, spec)).cast("double").alias(n))
        carried = list(dict.fromkeys([*self.by, *self.order_by]))
        if self.frame.step:
            place = F.row_number().over((Window.partitionBy(*self.by) if self.by else Window).orderBy(*self.order_by)) - 1
            return df.select(*carried, *out, place.alias("pos")).filter(F.col("pos") % self.frame.step == 0).drop("pos")
        return df.select(*carried, *out)

    def _native_chunks(self, df: DataFrame, f: Callable, names: list[str], chunk_rows: int) -> DataFrame:
        """Ungrouped frames by chunks with the rows around them, so that no task holds the table."""
        carried = list(dict.fromkeys(self.order_by))
        rows = df.select(*carried, *[F.col(f"`{c}`").cast("double").alias(f"v_{k}") for k, c in enumerate(self.columns)])
        placed, spec = self._chunks(self._positions(rows, chunk_rows), chunk_rows), self.frame.over(["chunk"], [F.col("pos")])
        out = []
        for k, n in enumerate(names):
            clean = F.when(~F.isnan(f"v_{k}"), F.col(f"v_{k}"))
            out.append(F.when(F.count(clean).over(spec) >= self.frame.least, f(clean, spec)).cast("double").alias(n))
        wanted = F.col("own") & (F.col("pos") % self.frame.step == 0) if self.frame.step else F.col("own")
        return placed.select(*carried, *out, wanted.alias("__wanted")).filter("__wanted").drop("__wanted")

    def _positions(self, rows: DataFrame, chunk_rows: int) -> DataFrame:
        """Adds pos: the row's place from 0 within its group, or within the table."""
        if self.by:
            return rows.withColumn("pos", F.row_number().over(Window.partitionBy(*self.by).orderBy(*self.order_by)).cast("long") - 1)
        first = F.col(self.order_by[0])
        kind = rows.schema[self.order_by[0]].dataType
        number = first.cast("double") if isinstance(kind, T.NumericType) else F.unix_micros(first.cast("timestamp")).cast("double") if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else None
        if number is None:
            return rows.withColumn("pos", F.row_number().over(Window.orderBy(*self.order_by)).cast("long") - 1)
        n = max(RANGES, config().nb_workers or 0)
        cuts = rows.select(F.percentile_approx(number, [k / n for k in range(1, n)], 10 * n)).first()[0] or []
        cuts = sorted(set(cuts))
        # Nulls sort first, as in the order below.
        spot = F.when(number.isNull(), 0).otherwise(F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]).cast("array<double>"), lambda c: c < number)) if cuts else F.lit(0))
        ranged = rows.withColumn("range", spot.cast("int"))
        counts = {r[0]: r[1] for r in ranged.groupBy("range").count().collect()}
        before = np.concatenate([[0], np.cumsum([counts.get(k, 0) for k in range(len(cuts) + 1)])])
        offset = F.get(F.array(*[F.lit(int(b)) for b in before]).cast("array<long>"), F.col("range"))
        local = F.row_number().over(Window.partitionBy("range").orderBy(*self.order_by)).cast("long") - 1
        return ranged.withColumn("pos", local + offset).drop("range")

    def _chunks(self, rows: DataFrame, chunk_rows: int) -> DataFrame:
        """Each row in its own chunk, and in others whose windows reach it."""
        first, last = self.frame.bounds()
        back, ahead = max(0, -first), max(0, last)
        if self.frame.timed:
            sizes = rows.groupBy(*self.by).agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("first"), F.max("us").alias("last"))
            most, span = sizes.agg(F.max("n"), F.max("last") - F.min("first")).first()
            most, span = most or 0, (span or 0) + 1
            total = max(1, -(-most // max(chunk_rows, 1)))  # chunks of a group
            size = max(-(-span // total), 2 * (back + ahead), 1)
            at = F.col("us")
        else:
            size, at = max(chunk_rows, 1), F.col("pos")
        here = F.floor(at / size)
        reach = F.sequence(F.greatest(F.floor((at - ahead) / size), F.lit(0 if not self.frame.timed else -(1 << 62))), F.floor((at + back) / size))
        return rows.withColumn("home", here).withColumn("chunk", F.explode(reach)).withColumn("own", F.col("home") == F.col("chunk")).drop("home")

    def _run(self, placed: DataFrame, carried, names, f, raw, args, kwargs, index, count) -> DataFrame:
        frame, values = self.frame, [f"v_{k}" for k in range(len(names))]
        by = self.by

        def work(groups: Groups) -> pd.DataFrame:
            rows, n = groups.rows, len(groups.rows)
            sizes = np.diff(groups.starts)
            low, high = np.repeat(groups.starts[:-1], sizes), np.repeat(groups.starts[1:], sizes)
            own = rows["own"].to_numpy()
            if frame.timed:
                us = rows["us"].to_numpy()
                begin, end = _timed_bounds(frame, us, groups.starts)
                labels = pd.to_datetime(us, unit="us")  # as pandas needs them
            else:
                pos = rows["pos"].to_numpy()
                labels = groups.column("label").to_numpy() if index else (pos if frame.window is not None else np.arange(n) - low)
                begin, end = _bounds(frame, np.arange(n), low, high)
            if frame.least > 0:  # f is not asked for rows that other chunks own
                begin, end = _own(begin, end, own, groups.starts)
            made = {}
            for v, name in zip(values, names, strict=True):
                s = pd.Series(rows[v].to_numpy(), index=labels)
                got = s.rolling(_Given(begin=begin, end=end), min_periods=frame.least).apply(f, raw=raw, args=args, kwargs=kwargs)
                made[name] = as_output(got.to_numpy(), T.StructField(name, T.DoubleType())).to_numpy()
            counted(count, int(own.sum()))
            out = pd.DataFrame({**{c: groups.column(c) for c in carried}, **made})
            return out[own & (pos % frame.step == 0) if frame.step else own]

        schema = T.StructType([placed.schema[c] for c in carried] + [T.StructField(n, T.DoubleType()) for n in names])
        keys = [*by, "chunk"] if frame.window is not None else by or ["chunk"]
        if frame.timed:
            order = nulls_first(placed, [*self.order_by, "us"])
        else:
            order = [F.col(f"`{c}`") for c in self.order_by] if frame.window is None else [F.col("pos")]
        return by_groups(placed, keys, placed.columns, work, schema, order)


class _Given(BaseIndexer):
    """Windows as given: pandas' own windows for many groups in one call."""

    def get_window_bounds(self, num_values=0, min_periods=None, center=None, closed=None, step=None):
        return self.begin, self.end


def _bounds(frame: Frame, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row and end of each row's window; its group lies from low to high."""
    if frame.window is None:
        return low, at + 1
    first, last = frame.bounds()
    begin, end = np.clip(at + first, low, high), np.clip(at + last + 1, low, high)
    return begin, np.maximum(begin, end)


def _timed_bounds(frame: Frame, us: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begin, end = np.empty(len(us), dtype=np.int64), np.empty(len(us), dtype=np.int64)
    size = pd.Timedelta(frame.window).value
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        ns = us[a:b] * 1000
        steps = np.diff(ns)
        if (steps < 0).any() and (steps > 0).any():
            raise ValueError("index must be monotonic")
        s, e = VariableWindowIndexer(index_array=ns, window_size=size).get_window_bounds(b - a, frame.least, frame.center, frame.closed)
        begin[a:b], end[a:b] = s + a, e + a
    return begin, end


def _own(begin: np.ndarray, end: np.ndarray, own: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Empty windows at rows that a chunk doesn't own: at its start before its own rows, at its end behind them, so that bounds keep rising."""
    if own.all():
        return begin, end
    sizes = np.diff(starts)
    seen = np.cumsum(own)
    before = seen == np.repeat(seen[starts[:-1]] - own[starts[:-1]], sizes)
    edge = np.where(before, np.repeat(starts[:-1], sizes), np.repeat(starts[1:], sizes))
    return np.where(own, begin, edge), np.where(own, end, edge)
