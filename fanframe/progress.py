"""Progress of Python stages: workers add what they have done to an accumulator, the driver shows it."""

from __future__ import annotations

import sys
import threading

from pyspark.sql import SparkSession

from fanframe.session import config

MARKS = 25
EVERY_S = 0.25


def _notebook_widget(total: int | None):
    """A widget where a notebook runs and has widgets, else None."""
    try:
        from IPython import get_ipython
        from ipywidgets import IntProgress
    except ImportError:
        return None
    shell = get_ipython()
    if shell is None or not hasattr(shell, "kernel"):
        return None
    from IPython.display import display

    widget = IntProgress(min=0, max=total or 1, bar_style="info")
    display(widget)
    return widget


class Progress:
    """Rows (or groups, or columns) done out of a total, which may be unknown while a plan is lazy.

    As a context it shows a line until it is left; watch() shows one whenever something has been
    done since, as long as the driver lives. In notebooks with widgets there is a bar as well.
    """

    def __init__(self, spark: SparkSession, total: int | None = None, out=None, unit: str = "rows"):
        self.done, self.total, self.out, self.unit = spark.sparkContext.accumulator(0), total, out or sys.stderr, unit
        self._stop, self._shown = threading.Event(), -1
        self._widget = _notebook_widget(total)
        self.failed = False

    def line(self) -> str:
        n, end = self.done.value, ", failed" if self.failed else ""
        if not self.total:
            return f"{n:,} {self.unit} done{end}"
        share = min(1.0, n / self.total)
        return f"[{'#' * int(share * MARKS):-<{MARKS}}] {n:,} of {self.total:,} {self.unit} ({share:.1%}){end}"

    def _show(self, anyway: bool = False) -> None:
        n = self.done.value
        if n == self._shown and not anyway:
            return
        self._shown = n
        self.out.write("\r" + self.line())
        self.out.flush()
        if self._widget is not None:
            self._widget.max = max(self._widget.max, n)
            self._widget.value = n
            self._widget.bar_style = "danger" if self.failed else "success" if self.total and n >= self.total else "info"

    def _keep_showing(self) -> None:
        while not self._stop.wait(EVERY_S):
            self._show()

    def watch(self) -> Progress:
        self._shown = self.done.value
        self._thread = threading.Thread(target=self._keep_showing, daemon=True)
        self._thread.start()
        return self

    __enter__ = watch

    def __exit__(self, kind, *_) -> None:
        self.failed = kind is not None
        self._stop.set()
        self._thread.join()
        self._show(anyway=True)
        self.out.write("\n")


def counted(count, n: int) -> None:
    """Called on workers once a batch, chunk or group."""
    if count is not None:
        count.add(n)


def counter(progress: Progress | None, unit: str = "rows"):
    """What a closure ships to workers: the given progress' counter, or that of a bar of its own if initialize() asked for bars."""
    if progress is None and config().progress_bar and (spark := SparkSession.getActiveSession()) is not None:
        progress = Progress(spark, unit=unit).watch()
    return None if progress is None else progress.done
