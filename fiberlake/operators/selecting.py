"""Selection, order and shape.  All of it is filters, joins on small index tables and index arithmetic."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from fiberlake.errors import ParameterError
from fiberlake.patch import Coord, Patch


def select(patch: Patch, dim: str, low=None, high=None, relative: bool = False, samples: bool = False) -> Patch:
    """A closed range of labels (half-open if samples); None is open."""
    patch.check(dim)
    coord = patch.coords[dim]
    if not coord.even:
        column = F.col(dim)
        keep = (F.lit(True) if low is None else column >= low) & (F.lit(True) if high is None else column <= high)
        return reindex(patch.new(patch.df.where(keep)), dim, F.col(f"{dim}_idx"))
    lo, hi = coord.index_range(low, high, relative, samples)
    df = patch.df.where(F.col(f"{dim}_idx").between(lo, hi)).withColumn(f"{dim}_idx", F.col(f"{dim}_idx") - lo)
    return patch.new(df, coords=patch.coords | {dim: replace(coord, n=max(0, hi - lo + 1), start=coord.value(lo))})


def reindex(patch: Patch, dim: str, order: Column) -> Patch:
    """Indices from 0 along dim in the given order; the window runs over labels, one row each, not over cells."""
    labels = patch.df.select(f"{dim}_idx", dim).distinct()
    ranked = labels.withColumn("to", (F.row_number().over(Window.orderBy(order)) - 1).cast("long"))
    df = patch.df.join(ranked.select(f"{dim}_idx", "to"), f"{dim}_idx").withColumn(f"{dim}_idx", F.col("to")).drop("to")
    return patch.new(df.select(*patch.keys, "value"), coords=patch.coords | {dim: replace(patch.coords[dim], step=None, n=None)})


def isin(patch: Patch, dim: str, values: list) -> Patch:
    return reindex(patch.new(patch.df.where(F.col(dim).isin(values))), dim, F.col(f"{dim}_idx"))


def order(patch: Patch, dim: str, values: list) -> Patch:
    """Labels in the order, and as often, as given."""
    patch.check(dim)
    rows = [(v, i) for i, v in enumerate(values)]
    index = F.broadcast(patch.df.sparkSession.createDataFrame(rows, f"`{dim}` {patch.df.schema[dim].dataType.simpleString()}, `to` long"))
    df = patch.df.join(index, dim).withColumn(f"{dim}_idx", F.col("to")).select(*patch.keys, "value")
    return patch.new(df, coords=patch.coords | {dim: Coord(len(values), 0, None)})


def where(patch: Patch, condition: Column, other: float | None = None) -> Patch:
    return patch.with_value(F.when(condition, F.col("value")).otherwise(F.lit(other).cast("double")), "where")


def is_missing(include_inf: bool = True) -> Column:
    v = F.col("value")
    return v.isNull() | (F.abs(v) == float("inf")) if include_inf else v.isNull()


def dropna(patch: Patch, dim: str, how: str = "any", include_inf: bool = True) -> Patch:
    """Drops labels along dim where any, or all, other cells are missing."""
    if how not in ("any", "all"):
        raise ParameterError("how is 'any' or 'all'")
    missing = is_missing(include_inf)
    bad = F.bool_or(missing) if how == "any" else F.bool_and(missing)
    good = patch.df.groupBy(f"{dim}_idx").agg(bad.alias("bad")).where(~F.col("bad")).select(f"{dim}_idx")
    return reindex(patch.new(patch.df.join(good, f"{dim}_idx", "left_semi"), "dropna"), dim, F.col(f"{dim}_idx"))


def fillna(patch: Patch, value: float, include_inf: bool = True) -> Patch:
    return patch.with_value(F.when(is_missing(include_inf), F.lit(float(value))).otherwise(F.col("value")), "fillna")


def full(patch: Patch, value: float) -> Patch:
    return patch.with_value(F.lit(float(value)), "full")


def flip(patch: Patch, dim: str, flip_coords: bool = True) -> Patch:
    n, coord = patch.coords[dim].n, patch.coords[dim]
    df = patch.df.withColumn(f"{dim}_idx", F.lit(n - 1) - F.col(f"{dim}_idx"))
    if flip_coords:
        return patch.new(df, "flip", coords=patch.coords | {dim: replace(coord, start=coord.stop, step=-coord.step)})
    return patch.new(df.withColumn(dim, label(coord, dim)), "flip")


def label(coord: Coord, dim: str) -> Column:
    value = F.lit(coord.start) + F.col(f"{dim}_idx") * F.lit(coord.step)
    return value.cast("long") if isinstance(coord.start, int) and isinstance(coord.step, int) else value


def roll(patch: Patch, dim: str, shift: int) -> Patch:
    n = patch.coords[dim].n
    df = patch.df.withColumn(f"{dim}_idx", F.pmod(F.col(f"{dim}_idx") + shift, F.lit(n)))
    return patch.new(df.withColumn(dim, label(patch.coords[dim], dim)), "roll")


def pad(patch: Patch, dim: str, before: int = 0, after: int = 0, value: float = 0.0) -> Patch:
    """Adds samples at both ends; the new ones carry the constant and extended labels."""
    coord = patch.coords[dim]
    wide = replace(coord, n=coord.n + before + after, start=coord.value(-before))
    moved = patch.df.withColumn(f"{dim}_idx", F.col(f"{dim}_idx") + before)
    added = [*range(before), *range(before + coord.n, wide.n)]
    ends = F.broadcast(patch.df.sparkSession.createDataFrame([(i,) for i in added], f"`{dim}_idx` long")).withColumn(dim, label(wide, dim).cast(patch.df.schema[dim].dataType))
    rest = patch.df.where(F.col(f"{dim}_idx") == 0).select(*(c for c in patch.keys if c not in (dim, f"{dim}_idx")))
    new = rest.crossJoin(ends).withColumn("value", F.lit(float(value)))
    return patch.new(moved.unionByName(new.select(*patch.keys, "value")), "pad", coords=patch.coords | {dim: wide})


def append_dim(patch: Patch, dim: str, values: list) -> Patch:
    """The same cells for each label of a new dimension."""
    table = F.array(*(F.lit(v) for v in values))
    df = patch.df.select("*", F.posexplode(table).alias(f"{dim}_idx", dim)).withColumn(f"{dim}_idx", F.col(f"{dim}_idx").cast("long"))
    out = patch.new(dims=(*patch.dims, dim), coords=patch.coords | {dim: Coord(len(values), 0, None)})
    return out.new(df.select(*out.keys, "value"))


def squeeze(patch: Patch, dim: str) -> Patch:
    if patch.coords[dim].n != 1:
        raise ParameterError(f"{dim} has {patch.coords[dim].n} samples")
    out = patch.new(dims=tuple(patch.others(dim)), coords={k: v for k, v in patch.coords.items() if k != dim})
    return out.new(patch.df.select(*out.keys, "value"))


def sort_coord(patch: Patch, dim: str, reverse: bool = False) -> Patch:
    return reindex(patch, dim, F.desc(dim) if reverse else F.asc(dim))


def snap(patch: Patch, dim: str) -> Patch:
    """Sorted, then labels evenly spaced between the least and the greatest."""
    out = sort_coord(patch, dim)
    ends = out.df.agg(F.min(dim).alias("low"), F.max(dim).alias("high"), (F.max(f"{dim}_idx") + 1).alias("n")).first()
    step = (ends.high - ends.low) / (ends.n - 1) if ends.n > 1 else 0.0
    coord = Coord(ends.n, float(ends.low), float(step))
    return out.new(out.df.withColumn(dim, label(coord, dim)), "snap", coords=out.coords | {dim: coord})


def rename(patch: Patch, **names: str) -> Patch:
    df = patch.df
    for old, new in names.items():
        df = df.withColumnRenamed(old, new).withColumnRenamed(f"{old}_idx", f"{new}_idx")
    return patch.new(df, dims=tuple(names.get(d, d) for d in patch.dims), coords={names.get(k, k): v for k, v in patch.coords.items()})


def to_dataframe(patch: Patch, labels: list) -> object:
    """Rows by the first dimension, a column for each label of the second."""
    row, column = patch.dims
    return patch.df.groupBy(row).pivot(column, labels).agg(F.first("value"))
