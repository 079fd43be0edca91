"""Mutes, range tapers, alignment of traces, concatenation, correlation and the Wiener filter; all of it Catalyst."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiberlake.errors import ParameterError, PatchDimError
from fiberlake.operators.selecting import label
from fiberlake.patch import Coord, Patch


def line_mute(patch: Patch, dim: str, low: float | None, high: float | None, invert: bool = False) -> Patch:
    """Zero in a closed band of labels; outside it if invert."""
    patch.check(dim)
    inside = (F.lit(True) if low is None else F.col(dim) >= low) & (F.lit(True) if high is None else F.col(dim) <= high)
    return patch.with_value(F.when(~inside if invert else inside, F.lit(0.0)).otherwise(F.col("value")), "line mute")


def taper_range(patch: Patch, dim: str, ends: tuple[float, float, float, float], invert: bool = False) -> Patch:
    """Rises from the first to the second label as half a cosine, falls from the third to the fourth, is zero beyond."""
    a, b, c, d = map(float, ends)
    if not a <= b <= c <= d:
        raise ParameterError("the four labels ascend")
    x = F.col(dim).cast("double")
    rise = F.lit(0.5) - F.lit(0.5) * F.cos((x - a) * (math.pi / (b - a))) if b > a else F.lit(1.0)
    fall = F.lit(0.5) - F.lit(0.5) * F.cos((F.lit(d) - x) * (math.pi / (d - c))) if d > c else F.lit(1.0)
    weight = F.when((x < a) | (x > d), 0.0).when(x < b, rise).when(x <= c, 1.0).otherwise(fall)
    return patch.with_value(F.col("value") * (F.lit(1.0) - weight if invert else weight), "taper range")


def align_to_shift(patch: Patch, dim: str, other: str, shifts: DataFrame, mode: str = "same", fill: float | None = None) -> Patch:
    """Moves each trace along dim by its number of samples in shifts (other, shift), one row for each label of other.

    full: wide enough for all; valid: where every trace has samples; same: the labels as they were.
    """
    patch.check(dim, other)
    if mode not in ("full", "same", "valid"):
        raise ParameterError("mode is full, same or valid")
    coord = patch.coords[dim]
    ends = shifts.agg(F.min("shift").alias("low"), F.max("shift").alias("high")).first()
    low, high = {"full": (ends.low, coord.n - 1 + ends.high), "same": (0, coord.n - 1), "valid": (ends.high, coord.n - 1 + ends.low)}[mode]
    if high < low:
        raise ParameterError("no label is left")
    new = replace(coord, n=high - low + 1, start=coord.value(low))
    moved = patch.df.join(shifts.select(other, "shift"), other)
    moved = moved.withColumn(f"{dim}_idx", F.col(f"{dim}_idx") + F.col("shift") - low).where(F.col(f"{dim}_idx").between(0, new.n - 1))
    keys = [c for c in patch.keys if c not in (dim, f"{dim}_idx")]
    grid = patch.df.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(new.n - 1).cast("long"))).alias(f"{dim}_idx"))
    idx = [f"{d}_idx" for d in patch.dims]
    df = grid.join(moved.select(*idx, "value", F.lit(True).alias("there")), idx, "left")
    df = df.withColumn("value", F.when(F.col("there"), F.col("value")).otherwise(F.lit(fill).cast("double"))).withColumn(dim, label(new, dim))
    return patch.new(df.select(*patch.keys, "value"), "align", coords=patch.coords | {dim: new})


def concatenate(patches: list[Patch], dim: str) -> Patch:
    """One after the other in the given order, without regard to labels and gaps; indices go on."""
    first, offset, parts = patches[0], 0, []
    for p in patches:
        if p.dims != first.dims:
            raise PatchDimError(f"{p.dims} isn't {first.dims}")
        parts.append(p.df.select(*first.keys, "value").withColumn(f"{dim}_idx", F.col(f"{dim}_idx") + F.lit(offset).cast("long")))
        offset += p.coords[dim].n
    df = parts[0]
    for part in parts[1:]:
        df = df.unionByName(part)
    return first.new(df, "concatenate", coords=first.coords | {dim: Coord(offset, 0, None, first.coords[dim].units)})


def correlate(patch: Patch, dim: str, other: str, source, max_lag: int) -> Patch:
    """For each trace and lag, the sum of its samples times those of the source's trace, `lag` samples before."""
    patch.check(dim, other)
    if set(patch.dims) != {dim, other}:
        raise PatchDimError("two dimensions are needed")
    lags = F.explode(F.sequence(F.lit(-max_lag).cast("long"), F.lit(max_lag).cast("long")))
    one = patch.df.where(F.col(other) == source).select(F.col(f"{dim}_idx").alias("at"), F.col("value").alias("own"), lags.alias("lag"))
    one = one.select((F.col("at") + F.col("lag")).alias(f"{dim}_idx"), "lag", "own")
    sums = patch.df.join(one, f"{dim}_idx").groupBy(other, f"{other}_idx", "lag").agg(F.sum(F.col("value") * F.col("own")).alias("value"))
    name, step = f"lag_{dim}", patch.coords[dim].step
    df = sums.withColumn(f"{name}_idx", F.col("lag") + max_lag).withColumn(name, F.col("lag") * F.lit(step))
    out = patch.new(dims=(other, name), coords={other: patch.coords[other], name: Coord(2 * max_lag + 1, -max_lag * step, step)})
    return out.new(df.select(*out.keys, "value"), "correlate")


def wiener(patch: Patch, dim: str, size: int, noise: float | None = None) -> Patch:
    """Local mean and variance over an odd number of samples, zero beyond the ends; noise: the mean variance if not given."""
    if size % 2 == 0:
        raise ParameterError("size is odd")
    w, x = patch.ordered(dim).rowsBetween(-(size // 2), size // 2), F.coalesce("value", F.lit(0.0))
    df = patch.df.withColumn("m", F.sum(x).over(w) / size).withColumn("v", F.sum(x * x).over(w) / size - F.col("m") * F.col("m"))
    level = F.lit(noise if noise is not None else df.agg(F.avg("v")).first()[0])
    value = F.when(F.col("v") < level, F.col("m")).otherwise(F.col("m") + (F.col("value") - F.col("m")) * (F.lit(1.0) - F.try_divide(level, F.col("v"))))
    return patch.new(df.select(*patch.keys, value.alias("value")), "wiener filter")


def slope_mute(patch: Patch, slopes: tuple[float, float], dims: tuple[str, str] = ("distance", "time"), invert: bool = False) -> Patch:
    """Zero in the wedge between two slopes from the first labels of both dimensions, lines included; outside it if invert."""
    low, high = map(float, slopes)
    patch.check(*dims)
    if not 0 <= low <= high:
        raise ParameterError("slopes are positive and ascend")
    rise, run = (F.col(f"{d}_idx") * F.lit(abs(float(patch.coords[d].step))) for d in dims)
    inside = (rise >= run * low) & (F.lit(True) if math.isinf(high) else rise <= run * high)
    return patch.with_value(F.when(~inside if invert else inside, F.lit(0.0)).otherwise(F.col("value")), "slope mute")
