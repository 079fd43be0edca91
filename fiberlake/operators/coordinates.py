"""Coordinates beside dimensions: values that belong to the labels of one or several dimensions, or to none.

They are small tables keyed by labels, so selecting, sorting or flipping a patch needs nothing done to them: whoever
reads one joins it to the labels that are left.  Operations that make new labels leave their old values behind.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiberlake.errors import CoordError, ParameterError, PatchDimError
from fiberlake.operators.selecting import reindex
from fiberlake.patch import Aux, Coord, Patch


def aux_of(patch: Patch, name: str) -> Aux:
    """A coordinate whose dimensions the patch still has."""
    found = patch.aux.get(name)
    if found is None or not set(found.dims) <= set(patch.dims):
        raise CoordError(f"{name} is no coordinate of the patch")
    return found


def labels(patch: Patch, dim: str) -> DataFrame:
    """(dim, dim_idx), one row for each label."""
    patch.check(dim)
    return patch.df.select(dim, f"{dim}_idx").distinct()


def update_coords(patch: Patch, **coords: tuple[str | tuple[str, ...] | None, DataFrame | Column | list] | None) -> Patch:
    """name=(dims, values) sets a coordinate, name=None takes it away.

    values: a frame of the dimensions and the name; a column expression of the labels; for one dimension a list in the
    order of its indices; for no dimension a list.
    """
    aux = dict(patch.aux)
    for name, given in coords.items():
        if name in patch.dims:
            raise PatchDimError(f"{name} is a dimension")
        if given is None:
            aux.pop(name, None)
            continue
        dims, values = given
        dims = () if dims is None else (dims,) if isinstance(dims, str) else tuple(dims)
        patch.check(*dims)
        spark = patch.df.sparkSession
        if isinstance(values, Column):
            table = patch.df.select(*dims).distinct().withColumn(name, values)
        elif isinstance(values, DataFrame):
            table = values.select(*dims, name)
        elif not dims:
            table = spark.createDataFrame([(v,) for v in values], [name])
        elif len(dims) == 1:
            n = patch.coords[dims[0]].n
            if n is not None and n != len(values):
                raise CoordError(f"{dims[0]} has {n} labels, {name} {len(values)} values")
            rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], [f"{dims[0]}_idx", name])
            table = labels(patch, dims[0]).join(rows, f"{dims[0]}_idx").select(*dims, name)
        else:
            raise ParameterError("values of several dimensions are a frame or an expression")
        aux[name] = Aux(dims, table)
    return replace(patch, aux=aux)


def drop_coords(patch: Patch, *names: str) -> Patch:
    if set(names) & set(patch.dims):
        raise PatchDimError("dimensions can't be dropped")
    return replace(patch, aux={k: v for k, v in patch.aux.items() if k not in names})


def drop_private_coords(patch: Patch) -> Patch:
    return drop_coords(patch, *(n for n in patch.aux if n.startswith("_")))


def get_coord(patch: Patch, name: str, sorted_needed: bool = False, even_needed: bool = False) -> Coord | Aux:
    if name not in patch.dims:
        if even_needed:
            raise CoordError(f"{name} isn't evenly sampled")
        return aux_of(patch, name)
    coord = patch.coords[name]
    if (even_needed or sorted_needed) and not coord.even:
        raise CoordError(f"{name} isn't evenly sampled")
    return coord


def get_axis(patch: Patch, dim: str) -> int:
    patch.check(dim)
    return patch.dims.index(dim)


def get_array(patch: Patch, name: str | None = None) -> DataFrame:
    """The cells, or a coordinate's values beside the labels they belong to; sorted by index."""
    if name is None:
        return patch.df.orderBy(*(f"{d}_idx" for d in patch.dims))
    if name in patch.dims:
        return labels(patch, name).orderBy(f"{name}_idx")
    aux = aux_of(patch, name)
    keys = patch.df.select(*(c for d in aux.dims for c in (d, f"{d}_idx"))).distinct() if aux.dims else None
    return aux.df if keys is None else keys.join(aux.df, list(aux.dims)).orderBy(*(f"{d}_idx" for d in aux.dims))


def _one_dim(patch: Patch, name: str) -> tuple[str, DataFrame]:
    aux = aux_of(patch, name)
    if len(aux.dims) != 1:
        raise CoordError(f"{name} belongs to {len(aux.dims)} dimensions")
    return aux.dims[0], aux.df


def select_by(patch: Patch, name: str, low=None, high=None, values: list | None = None) -> Patch:
    """Keeps the labels of the coordinate's dimension whose value is in a closed range, or one of the values."""
    dim, table = _one_dim(patch, name)
    c = F.col(name)
    if low is not None and high is not None and low > high:
        low, high = high, low
    keep = c.isin(list(values)) if values is not None else (F.lit(True) if low is None else c >= low) & (F.lit(True) if high is None else c <= high)
    left = patch.df.join(table.where(keep).select(dim), dim, "left_semi")
    return reindex(patch.new(left), dim, F.col(f"{dim}_idx"))


def sort_by(patch: Patch, name: str, reverse: bool = False) -> Patch:
    """The coordinate's dimension in the order of its values; labels go along."""
    dim, table = _one_dim(patch, name)
    order = labels(patch, dim).join(table, dim)
    with_value = patch.df.join(order.select(dim, name), dim)
    ranked = reindex(patch.new(with_value.withColumn(f"{dim}_idx", F.struct(F.col(name).alias("v"), F.col(f"{dim}_idx").alias("i"))).drop(name)), dim, F.desc(f"{dim}_idx") if reverse else F.asc(f"{dim}_idx"))
    return ranked


def set_dims(patch: Patch, **names: str) -> Patch:
    """old=new: the values of a one-dimensional coordinate become the labels of its dimension, the old ones a coordinate."""
    for old, new in names.items():
        dim, table = _one_dim(patch, new)
        if dim != old:
            raise PatchDimError(f"{new} belongs to {dim}")
        df = patch.df.join(table, old).withColumnRenamed(f"{old}_idx", f"{new}_idx")
        dims = tuple(new if d == old else d for d in patch.dims)
        coords = {new if k == old else k: Coord(c.n, 0, None) if k == old else c for k, c in patch.coords.items()}
        aux = {k: Aux((new,), v.df.join(table, old).select(new, k)) if v.dims == (old,) else v for k, v in patch.aux.items() if k != new}
        aux[old] = Aux((new,), table.select(new, old))
        patch = replace(patch, dims=dims, coords=coords, aux=aux)
        patch = patch.new(df.select(*patch.keys, "value"))
    return patch


def coords_from_points(patch: Patch, dim: str, points: pd.DataFrame, extrapolate: bool = False) -> Patch:
    """Coordinates by linear interpolation of a table of points, a pandas frame of the dimension and further columns.

    Beyond the first and last point there is no value, or the line through the two points there goes on.
    """
    patch.check(dim)
    points = points.sort_values(dim)
    xs = points[dim].to_numpy(float)
    if len(xs) < 2:
        raise ParameterError("two points are needed")
    for name in (c for c in points.columns if c != dim):
        ys = points[name].to_numpy(float)
        x, value = F.col(dim).cast("double"), F.lit(None).cast("double")
        # a tree of halves would be shorter for long tables; each is a comparison of constants in generated code
        lines = [(xs[i], xs[i + 1], ys[i], (ys[i + 1] - ys[i]) / (xs[i + 1] - xs[i])) for i in range(len(xs) - 1) if xs[i + 1] > xs[i]]

        def tree(part: list) -> Column:
            if len(part) == 1:
                x0, _, y0, slope = part[0]
                return F.lit(y0) + (x - F.lit(x0)) * F.lit(slope)
            half = len(part) // 2
            return F.when(x < F.lit(part[half][0]), tree(part[:half])).otherwise(tree(part[half:]))

        value = tree(lines)
        if not extrapolate:
            value = F.when(x.between(float(xs[0]), float(xs[-1])), value)
        patch = update_coords(patch, **{name: (dim, value)})
    return patch


def add_distance_to(patch: Patch, origin: dict[str, float], order: float = 2, prefix: str = "origin") -> Patch:
    """<prefix>_distance: the norm of the coordinates' distance from a point; the point's coordinates go with no dimension."""
    found = {n: aux_of(patch, n) for n in origin}
    dims = {a.dims for a in found.values()}
    if len(dims) != 1:
        raise CoordError("all coordinates belong to the same dimension")
    (keys,) = dims
    names = list(origin)
    table = found[names[0]].df
    for n in names[1:]:
        table = table.join(found[n].df, list(keys))
    gaps = [F.abs(F.lit(float(origin[n])) - F.col(n)) for n in names]
    if math.isinf(order):
        value = F.greatest(*gaps) if len(gaps) > 1 else gaps[0]
    else:
        total = sum((F.pow(g, F.lit(float(order))) for g in gaps[1:]), F.pow(gaps[0], F.lit(float(order))))
        value = F.pow(total, F.lit(1.0 / order))
    out = update_coords(patch, **{f"{prefix}_distance": (keys, table.select(*keys, value.alias(f"{prefix}_distance")))})
    return update_coords(out, **{f"{prefix}_{n}": (None, [float(v)]) for n, v in origin.items()})


def broadcast_to(patch: Patch, **dims: list) -> Patch:
    """Dimensions of length 1 get the given labels, new ones are appended; others have to fit as they are."""
    from fiberlake.operators.selecting import append_dim, squeeze

    for d, values in dims.items():
        if d in patch.dims:
            n = patch.coords[d].n
            if n == len(values):
                continue
            if n != 1:
                raise PatchDimError(f"{d} has {n} labels, not 1 or {len(values)}")
            order = patch.dims
            patch = append_dim(squeeze(patch, d), d, values).transpose(*order)
        else:
            patch = append_dim(patch, d, values)
    return patch


def update_attrs(patch: Patch, **attrs) -> Patch:
    """Sets attributes; <dim>_min, <dim>_max or <dim>_step move or stretch an evenly sampled coordinate too."""
    from fiberlake.operators.selecting import label

    for name in list(attrs):
        dim, _, end = name.rpartition("_")
        if dim in patch.dims and end in ("min", "max", "step"):
            coord = patch.coords[dim].update_limits(**{end: attrs.pop(name)})
            df = patch.df.withColumn(dim, label(coord, dim))
            patch = patch.new(df.select(*patch.keys, "value"), coords=patch.coords | {dim: coord})
    return patch.new(attrs=patch.attrs | {k: str(v) for k, v in attrs.items()})


def equals(a: Patch, b: Patch, close: bool = False, only_required: bool = True) -> bool:
    """The same dimensions, labels and samples (missing equals missing); close: samples within 1e-8 and 1e-5 of their size."""
    if a.dims != b.dims or not only_required and a.attrs != b.attrs:
        return False
    right = b.df.select(*a.keys, F.col("value").alias("other"), F.lit(True).alias("there"))
    both = a.df.withColumn("here", F.lit(True)).join(right, a.keys, "full")
    x, y = F.col("value"), F.col("other")
    same = F.abs(x - y) <= 1e-8 + 1e-5 * F.abs(y) if close else x.eqNullSafe(y)
    fine = F.col("here").isNotNull() & F.col("there").isNotNull() & (F.coalesce(same, F.lit(False)) | x.isNull() & y.isNull())
    return both.where(~fine).isEmpty()


def truth(patch: Patch) -> bool:
    """Of a patch of one sample."""
    rows = patch.df.select("value").limit(2).collect()
    if len(rows) != 1:
        raise ParameterError("only one sample has a truth value")
    return rows[0].value is None or rows[0].value != 0


def required(dims: tuple[str, ...] = (), coords: tuple[str, ...] = (), attrs: tuple[str, ...] = (), history: bool = True) -> Callable:
    """A decorator for functions of a patch: checks what they need on the driver, and notes the call in the history."""

    def wrap(function: Callable) -> Callable:
        def run(patch: Patch, *args, **kwargs):
            patch.check(*dims)
            for c in coords:
                get_coord(patch, c)
            for a in attrs:
                if not patch.attrs.get(a):
                    raise ParameterError(f"the patch has no {a}")
            out = function(patch, *args, **kwargs)
            return out.new(step=function.__name__) if history and isinstance(out, Patch) else out

        run.func, run.__name__, run.__doc__ = function, function.__name__, function.__doc__
        return run

    return wrap


def infer(values: np.ndarray) -> Coord:
    """Even if all steps are within a thousandth of their median, else known by its cells only."""
    values = np.asarray(values, float)
    if len(values) > 1 and np.isfinite(values).all():
        steps = np.diff(values)
        usual = float(np.median(steps))
        if usual and np.allclose(steps, usual, rtol=1e-3, atol=0):
            return Coord(len(values), float(values[0]), usual)
    return Coord(len(values), 0, None)
