"""Window parameters in pandas' terms, and the Spark frames they stand for."""

from __future__ import annotations

import dataclasses

import pandas as pd
from pyspark.sql import Window, WindowSpec

CLOSED = ("right", "left", "both", "neither")


@dataclasses.dataclass(frozen=True)
class Frame:
    """window: a number of rows or a time offset; None is expanding."""

    window: int | str | None
    min_periods: int | None = None
    center: bool = False
    closed: str | None = None
    step: int | None = None

    def __post_init__(self):
        if self.closed not in (None, *CLOSED):
            raise ValueError(f"closed must be 'right', 'left', 'both' or 'neither', not {self.closed!r}")
        if isinstance(self.window, int) and self.window < 0:
            raise ValueError("window must be an integer 0 or greater")
        if self.min_periods is not None and self.min_periods < 0:
            raise ValueError("min_periods must be >= 0")
        if isinstance(self.window, int) and (self.min_periods or 0) > self.window:
            raise ValueError(f"min_periods {self.min_periods} must be <= window {self.window}")
        if self.step is not None and self.step < 1:
            raise ValueError("step must be positive")
        if self.timed and self.step is not None:
            raise NotImplementedError("step is not supported with time offsets")
        if self.timed:
            self.micros()

    @property
    def timed(self) -> bool:
        return isinstance(self.window, str)

    def micros(self) -> int:
        return int(pd.Timedelta(self.window).total_seconds() * 1_000_000)

    @property
    def least(self) -> int:
        if self.min_periods is not None:
            return self.min_periods
        return self.window if isinstance(self.window, int) else 1

    def bounds(self) -> tuple[int, int]:
        """First and last row of the frame, relative to the current one (microseconds if timed)."""
        size = self.micros() if self.timed else self.window
        first, last = -(size - 1), 0
        if self.center:
            shift = size // 2 if self.timed else (size - 1) // 2
            first, last = first + shift, last + shift
        if self.closed in ("both", "left"):
            first -= 1
        if self.closed in ("left", "neither"):
            last -= 1
        return first, last

    def over(self, keys: list[str], order: list) -> WindowSpec:
        spec = (Window.partitionBy(*keys) if keys else Window).orderBy(*order)
        if self.window is None:
            return spec.rowsBetween(Window.unboundedPreceding, 0)
        first, last = self.bounds()
        return spec.rangeBetween(first, last) if self.timed else spec.rowsBetween(first, last)
