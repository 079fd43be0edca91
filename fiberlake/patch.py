"""Patch: a labelled array as a lazy DataFrame of cells and a little metadata.

Cells have, for each dimension, its value and its index (`<dim>_idx`), and `value`.  Null stands for a missing sample;
NaN becomes null when data come in.  Evenly sampled coordinates are known by start, step and length, so ranges of
labels become ranges of indices on the driver, and reach the scan.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from fiberlake.errors import CoordError, ParameterError, PatchDimError


@dataclass(frozen=True)
class Coord:
    """An evenly sampled coordinate, or (step None) one whose values only the cells know."""

    n: int | None = None
    start: float = 0
    step: float | None = 1
    units: str = ""

    @property
    def even(self) -> bool:
        return self.step is not None and self.n is not None

    def value(self, i: int) -> float:
        return self.start + i * self.step

    @property
    def stop(self) -> float:
        return self.value(self.n - 1)

    def place(self, v: float) -> float:
        """The index of a label, whole if it is as near as the labels' own precision can tell."""
        exact = (v - self.start) / self.step
        slack = max(1e-10, 4 * 2.220446049250313e-16 * max(abs(v), abs(self.start)) / abs(self.step))
        return round(exact) if abs(exact - round(exact)) <= slack else exact

    def index_range(self, low, high, relative: bool = False, samples: bool = False) -> tuple[int, int]:
        """Indices of a closed range of values; half-open if samples."""
        if not self.even:
            raise CoordError("an evenly sampled coordinate is needed")
        if samples:
            lo, hi, _ = slice(low, high).indices(self.n)
            return lo, hi - 1
        if relative:
            low, high = (None if v is None else (self.start + v if v >= 0 else self.stop + v) for v in (low, high))
        if low is not None and high is not None and low > high:
            low, high = high, low
        to = self.place
        ends = sorted((0 if low is None else to(low), self.n - 1 if high is None else to(high)))
        return max(0, math.ceil(ends[0])), min(self.n - 1, math.floor(ends[1]))

    def coord_range(self, extend: bool = True) -> float:
        """From the least to the greatest label, and a step more."""
        return abs(self.stop - self.start) + (abs(self.step) if extend else 0)

    def update_limits(self, min=None, max=None, step=None) -> Coord:
        """Two of least label, greatest label and step at most: one end moves the labels, both stretch them.

        Stretched labels fill min up to, but without, max.
        """
        if None not in (min, max, step):
            raise ParameterError("two limits at most")
        if not self.even:
            raise CoordError("an evenly sampled coordinate is needed")
        if min is not None and max is not None:
            return replace(self, start=min, step=(max - min) / self.n)
        new = replace(self, step=step) if step is not None else self
        if min is not None:
            return replace(new, start=min if new.step > 0 else min - (new.n - 1) * new.step)
        if max is not None:
            return replace(new, start=max - (new.n - 1) * new.step if new.step > 0 else max)
        return new

    def change_length(self, n: int) -> Coord:
        return replace(self, n=n)

    def sort(self, reverse: bool = False) -> Coord:
        """The same labels, ascending or descending."""
        return self if (self.step < 0) == reverse else replace(self, start=self.stop, step=-self.step)

    def next_index(self, value: float, allow_out: bool = False) -> int:
        """The first index whose label is at or after a value."""
        place = math.ceil(self.place(value))
        if not 0 <= place < self.n and not allow_out:
            raise CoordError(f"{value} is outside")
        return min(max(place, 0), self.n)

    def approx_equal(self, other: Coord) -> bool:
        if not self.even or not other.even:
            return self == other
        near = lambda a, b: math.isclose(a, b, rel_tol=1e-5, abs_tol=1e-8)
        return self.n == other.n and self.units == other.units and near(self.start, other.start) and near(self.stop, other.stop)

    def summary(self) -> dict:
        ends = (min(self.start, self.stop), max(self.start, self.stop)) if self.even and self.n else (None, None)
        return {"min": ends[0], "max": ends[1], "step": self.step, "units": self.units, "n": self.n}

    def samples_in(self, width: float, samples: bool = False) -> int:
        n = int(width) if samples else math.ceil(round(width / abs(self.step), 10))
        if n <= 0 or self.n is not None and n > self.n:
            raise ParameterError(f"a window of {width} has {n} samples; the coordinate has {self.n}")
        return n


@dataclass(frozen=True)
class Aux:
    """A coordinate that is no dimension: a table of its dimensions' labels and, under its own name, its values."""

    dims: tuple[str, ...]
    df: DataFrame


@dataclass(frozen=True)
class Patch:
    df: DataFrame
    dims: tuple[str, ...]
    coords: dict[str, Coord]
    attrs: dict[str, str] = field(default_factory=dict)
    history: tuple[str, ...] = ()
    aux: dict[str, Aux] = field(default_factory=dict)

    @classmethod
    def from_cells(cls, df: DataFrame, dims: tuple[str, ...], coords: dict[str, Coord], **attrs: str) -> Patch:
        value = F.col("value").cast("double")
        columns = [c for d in dims for c in (F.col(d), F.col(f"{d}_idx").cast("long").alias(f"{d}_idx"))]
        return cls(df.select(*columns, F.nanvl(value, F.lit(None).cast("double")).alias("value")), dims, dict(coords), attrs)

    def check(self, *dims: str) -> None:
        for d in dims:
            if d not in self.dims:
                raise PatchDimError(f"{d} is none of {self.dims}")

    def others(self, *dims: str) -> list[str]:
        return [d for d in self.dims if d not in dims]

    @property
    def keys(self) -> list[str]:
        return [c for d in self.dims for c in (d, f"{d}_idx")]

    def trace(self, dim: str) -> WindowSpec:
        """A window over all samples along dim, one trace at a time; never over the whole patch unless that is one trace."""
        return Window.partitionBy(*(f"{d}_idx" for d in self.others(dim)))

    def ordered(self, dim: str) -> WindowSpec:
        return self.trace(dim).orderBy(f"{dim}_idx")

    def new(self, df: DataFrame | None = None, step: str | None = None, **changes) -> Patch:
        history = (*self.history, step) if step else self.history
        return replace(self, df=self.df if df is None else df, history=history, **changes)

    def with_value(self, value: Column, step: str) -> Patch:
        return self.new(self.df.select(*self.keys, value.alias("value")), step)

    def map_value(self, f: Callable[[Column], Column], step: str) -> Patch:
        return self.with_value(f(F.col("value")), step)

    def pipe(self, f: Callable, *args, **kwargs) -> Patch:
        return f(self, *args, **kwargs)

    def transpose(self, *dims: str) -> Patch:
        if sorted(dims) != sorted(self.dims):
            raise PatchDimError(f"{dims} isn't an order of {self.dims}")
        return self.new(dims=tuple(dims))
