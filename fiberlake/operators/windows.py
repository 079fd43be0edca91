"""Moving windows, whole-trace normalisation, integration and differentiation."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from fiberlake.errors import ParameterError
from fiberlake.patch import Patch

V = "value"


def _over(method: str, w) -> Column:
    known = {
        "mean": lambda: F.avg(V),
        "median": lambda: F.percentile(V, F.lit(0.5)),
        "min": lambda: F.min(V),
        "max": lambda: F.max(V),
        "std": lambda: F.stddev_pop(V),
        "std1": lambda: F.stddev_samp(V),
        "sum": lambda: F.sum(V),
    }
    if method not in known:
        raise ParameterError(f"{method} is none of {sorted(known)}")
    return known[method]().over(w)


def rolling(patch: Patch, dim: str, width: float, method: str, step: int = 1, center: bool = False, samples: bool = False) -> Patch:
    """Trailing windows; null unless a window is complete and has no null.  step keeps every step-th sample."""
    n = patch.coords[dim].samples_in(width, samples)
    ahead = (n - 1) // 2 if center else 0
    w = patch.ordered(dim).rowsBetween(ahead - n + 1, ahead)
    out = patch.with_value(F.when(F.count(V).over(w) == n, _over(method, w)), f"rolling {method}")
    return decimate(out, dim, step) if step > 1 else out


def decimate(patch: Patch, dim: str, factor: int) -> Patch:
    """Every factor-th sample, without a filter."""
    coord = patch.coords[dim]
    df = patch.df.where(F.col(f"{dim}_idx") % factor == 0).withColumn(f"{dim}_idx", F.floor(F.col(f"{dim}_idx") / factor))
    return patch.new(df, "decimate", coords=patch.coords | {dim: replace(coord, n=-(-coord.n // factor), step=coord.step * factor)})


def demean(patch: Patch, dim: str) -> Patch:
    return patch.with_value(F.col(V) - F.avg(V).over(patch.trace(dim)), "demean")


def demedian(patch: Patch, dim: str) -> Patch:
    return patch.with_value(F.col(V) - F.median(V).over(patch.trace(dim)), "demedian")


def standardize(patch: Patch, dim: str) -> Patch:
    w = patch.trace(dim)
    return patch.with_value(F.try_divide(F.col(V) - F.avg(V).over(w), F.stddev_pop(V).over(w)), "standardize")


def normalize(patch: Patch, dim: str, norm: str = "l2") -> Patch:
    """By the l1, l2 or max norm of each trace, or to signs (bit); a norm of zero counts as 1."""
    w = patch.trace(dim)
    if norm == "bit":
        return patch.map_value(F.signum, "normalize bit")
    known = {"l1": lambda: F.sum(F.abs(F.col(V))).over(w), "l2": lambda: F.sqrt(F.sum(F.col(V) * F.col(V)).over(w)), "max": lambda: F.max(F.abs(F.col(V))).over(w)}
    if norm not in known:
        raise ParameterError(f"{norm} is none of l1, l2, max, bit")
    size = known[norm]()
    return patch.with_value(F.col(V) / F.when(size == 0, F.lit(1.0)).otherwise(size), f"normalize {norm}")


def detrend(patch: Patch, dim: str, kind: str = "linear") -> Patch:
    if kind == "constant":
        return demean(patch, dim)
    w, x = patch.trace(dim), F.col(f"{dim}_idx")
    line = F.regr_slope(V, x).over(w) * x + F.regr_intercept(V, x).over(w)
    return patch.with_value(F.col(V) - line, "detrend")


def stalta(patch: Patch, dim: str, short: float, long: float, samples: bool = False) -> Patch:
    """Ratio of a short to a long trailing mean."""
    a, b = (patch.coords[dim].samples_in(x, samples) for x in (short, long))
    if a >= b:
        raise ParameterError("the long window is longer than the short one")

    def mean(n: int) -> Column:
        w = patch.ordered(dim).rowsBetween(1 - n, 0)
        return F.when(F.count(V).over(w) == n, F.avg(V).over(w))

    return patch.with_value(F.try_divide(mean(a), mean(b)), "stalta")


def integrate(patch: Patch, dim: str, definite: bool = False) -> Patch:
    """Trapezoids over the labels of dim; running from 0, or the whole."""
    w = patch.ordered(dim)
    width = (F.col(dim) - F.lag(dim).over(w)).cast("double")
    part = F.coalesce((F.col(V) + F.lag(V).over(w)) / 2 * width, F.lit(0.0))
    if not definite:
        stepped = patch.df.withColumn("part", part)
        return patch.new(stepped, "integrate").with_value(F.sum("part").over(w.rowsBetween(Window.unboundedPreceding, 0)), "integrate")
    out = patch.new(dims=tuple(patch.others(dim)), coords={k: v for k, v in patch.coords.items() if k != dim})
    return out.new(patch.df.withColumn("part", part).groupBy(*out.keys).agg(F.sum("part").alias(V)), "integrate")


def differentiate(patch: Patch, dim: str, step: int = 1) -> Patch:
    """Second order everywhere: central differences inside, one-sided with three points at the ends."""
    coord = patch.coords[dim]
    h = coord.step * step
    w = patch.ordered(dim)
    v = lambda k: F.col(V) if k == 0 else F.lead(V, k * step).over(w) if k > 0 else F.lag(V, -k * step).over(w)
    at = F.col(f"{dim}_idx")
    first = (-3 * v(0) + 4 * v(1) - v(2)) / (2 * h)
    last = (3 * v(0) - 4 * v(-1) + v(-2)) / (2 * h)
    inner = (v(1) - v(-1)) / (2 * h)
    return patch.with_value(F.when(at < step, first).when(at >= coord.n - step, last).otherwise(inner), "differentiate")


def strain_rate(patch: Patch, dim: str, step_multiple: int = 2) -> Patch:
    """Velocity to strain rate over a gauge of step_multiple samples."""
    if step_multiple % 2:
        raise ParameterError("step_multiple is even")
    return differentiate(patch, dim, step_multiple // 2)


def strain_rate_edgeless(patch: Patch, dim: str, step_multiple: int = 1) -> Patch:
    """Differences of samples step_multiple apart, at the labels between them."""
    coord, k = patch.coords[dim], step_multiple
    w = patch.ordered(dim)
    middle = (F.col(dim) + F.lead(dim, k).over(w)) / 2
    df = patch.df.select(*(c if c != dim else middle.alias(dim) for c in patch.keys), ((F.lead(V, k).over(w) - F.col(V)) / (k * coord.step)).alias(V), F.lead(f"{dim}_idx", k).over(w).alias("to"))
    return patch.new(df.where("to is not null").drop("to"), "strain rate", coords=patch.coords | {dim: replace(coord, n=coord.n - k, start=coord.start + k * coord.step / 2)})


def kurtosis(patch: Patch, dim: str, width: float, samples: bool = False) -> Patch:
    """Fourth over squared second central moment of windows around each sample, cut at the ends; null where nothing varies."""
    n = patch.coords[dim].samples_in(width, samples)
    w = patch.ordered(dim).rowsBetween(-(n // 2), n - n // 2 - 1)
    v = F.col(V)
    m1, m2, m3, m4 = (F.avg(x).over(w) for x in (v, v * v, v * v * v, v * v * v * v))
    var = m2 - m1 * m1
    fourth = m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * m1 * m1 * m1 * m1
    return patch.with_value(F.when(var > 0, F.try_divide(fourth, var * var)), "kurtosis")


def radians_to_strain(patch: Patch, gauge_length: float | None = None, wave_length: float = 1550e-9, stress_constant: float = 0.79, refractive_index: float = 1.445) -> Patch:
    """Phase in radians to strain, for a gauge length in metres (that of the attributes if not given).

    A patch whose data units have no radians comes back as it is.
    """
    gauge = gauge_length if gauge_length is not None else float(patch.attrs.get("gauge_length") or 0)
    if gauge <= 0:
        raise ParameterError("a positive gauge length is needed")
    units = patch.attrs.get("data_units", "")
    if "radian" not in units:
        return patch
    factor = wave_length / (4 * math.pi * refractive_index * gauge * stress_constant)
    out = patch.map_value(lambda v: v * F.lit(factor), "radians to strain")
    return out.new(attrs=out.attrs | {"data_units": units.replace("radians", "strain").replace("radian", "strain")})


def differentiate_high(patch: Patch, dim: str, order: int = 4) -> Patch:
    """First derivative of an even order of accuracy: centred stencils inside, one-sided ones of the same order at the ends."""
    import numpy as np

    coord, half = patch.coords[dim], order // 2
    if order < 2 or order % 2 or coord.n <= order:
        raise ParameterError("the order is even, positive and below the number of samples")
    w, at = patch.ordered(dim), F.col(f"{dim}_idx")

    def stencil(offsets: range) -> Column:
        # weights that are exact for all powers up to the order
        powers = np.vander(np.array(offsets, float), order + 1, increasing=True).T
        weights = np.linalg.solve(powers, np.eye(order + 1)[1]) / float(coord.step)
        v = lambda k: F.col(V) if k == 0 else F.lead(V, k).over(w) if k > 0 else F.lag(V, -k).over(w)
        parts = [v(k) * float(x) for k, x in zip(offsets, weights) if abs(x) > 1e-14]
        return sum(parts[1:], parts[0])

    inner = stencil(range(-half, half + 1))
    out = None
    for i in range(half):
        first, last = stencil(range(-i, order + 1 - i)), stencil(range(i - order, i + 1))
        out = F.when(at == i, first) if out is None else out.when(at == i, first)
        out = out.when(at == coord.n - 1 - i, last)
    return patch.with_value(out.otherwise(inner), f"differentiate, order {order}")


def rolling_apply(patch: Patch, dim: str, width: float, function, samples: bool = False) -> Patch:
    """function(windows) -> values, over complete trailing windows of each trace (rows of a numpy array); null before."""
    from fiberlake.operators.spectral import per_trace

    import numpy as np

    coord = patch.coords[dim]
    n = coord.samples_in(width, samples)

    def run(x):
        view = np.lib.stride_tricks.sliding_window_view(x, n, axis=-1)
        values = np.asarray(function(view.reshape(-1, n)), float).reshape(view.shape[:-1])
        return np.concatenate([np.full((*x.shape[:-1], n - 1), np.nan), values], axis=-1)

    return per_trace(patch, dim, run, coord.n, coord, "rolling apply", missing=float("nan"))
