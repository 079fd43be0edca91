"""Reductions along dimensions, one dimension after the other."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from fiberlake.errors import ParameterError
from fiberlake.patch import Coord, Patch


def _truth() -> Column:
    """A missing sample counts as true, as a NaN does."""
    return F.coalesce(F.col("value") != 0, F.lit(True))


def aggregator(method: str, dim: str) -> Column:
    v, at = F.col("value"), F.col(f"{dim}_idx")
    known: dict[str, Callable[[], Column]] = {
        "min": lambda: F.min(v),
        "max": lambda: F.max(v),
        "mean": lambda: F.avg(v),
        "median": lambda: F.median(v),
        "std": lambda: F.stddev_pop(v),
        "sum": lambda: F.coalesce(F.sum(v), F.lit(0.0)),
        "first": lambda: F.min_by(v, at),
        "last": lambda: F.max_by(v, at),
        "any": lambda: F.bool_or(_truth()).cast("double"),
        "all": lambda: F.bool_and(_truth()).cast("double"),
    }
    if method not in known:
        raise ParameterError(f"{method} is none of {sorted(known)}")
    return known[method]()


def aggregate(patch: Patch, dim: str | tuple[str, ...], method, keep: str = "drop") -> Patch:
    """Several dimensions are reduced in turn: a median of medians, a deviation of deviations.

    method: a name, or a function of a matrix that turns each row (a trace, NaN where missing) into one value.
    keep: "drop" takes the dimension away; "empty" keeps it with one label without value; a name of an aggregation keeps
    it with that of its labels.
    """
    if keep != "drop":
        for d in (dim,) if isinstance(dim, str) else dim:
            known = {"empty": lambda c: F.lit(None).cast("double"), "min": F.min, "max": F.max, "mean": F.avg, "median": F.median, "first": F.min, "last": F.max}
            if keep not in known:
                raise ParameterError(f"{keep} is none of drop, " + ", ".join(known))
            order, small = patch.dims, aggregate(patch, d, method)
            one = patch.df.agg(known[keep](F.col(d).cast("double")).alias(d))
            wide = small.df.join(F.broadcast(one)).withColumn(f"{d}_idx", F.lit(0).cast("long"))  # one row
            patch = small.new(dims=order, coords=patch.coords | {d: Coord(1, 0, None)})
            patch = patch.new(wide.select(*patch.keys, "value"))
        return patch
    for d in (dim,) if isinstance(dim, str) else dim:
        patch.check(d)
        if len(patch.dims) == 1:
            raise ParameterError("a patch keeps one dimension")
        out = patch.new(dims=tuple(patch.others(d)), coords={k: v for k, v in patch.coords.items() if k != d})
        if callable(method):
            from fiberlake.operators.spectral import per_trace

            one = per_trace(patch, d, lambda x: np.asarray(method(x), float)[:, None], 1, Coord(1), "aggregate", missing=float("nan"))
            patch = out.new(one.df.select(*out.keys, "value"), f"aggregate {getattr(method, '__name__', 'function')} {d}")
            continue
        patch = out.new(patch.df.groupBy(*out.keys).agg(aggregator(method, d).alias("value")), f"aggregate {method} {d}")
    return patch


def accumulate(patch: Patch, dim: str, method: str = "sum") -> Patch:
    """A running sum, minimum, maximum or product along dim."""
    from pyspark.sql import Window

    w = patch.ordered(dim).rowsBetween(Window.unboundedPreceding, 0)
    known = {"sum": F.sum, "min": F.min, "max": F.max, "product": F.product}
    if method not in known:
        raise ParameterError(f"{method} is none of {sorted(known)}")
    f = known[method]
    return patch.with_value(f("value").over(w), f"accumulate {method}")


def reduce(patch: Patch, dim: str, method: str = "sum") -> Patch:
    """A binary operation over all samples along dim: add, multiply, maximum or minimum; missing samples make it missing."""
    v = F.col("value")
    known = {"add": F.sum, "multiply": F.product, "maximum": F.max, "minimum": F.min}
    if method not in known:
        raise ParameterError(f"{method} is none of {sorted(known)}")
    patch.check(dim)
    out = patch.new(dims=tuple(patch.others(dim)), coords={k: c for k, c in patch.coords.items() if k != dim})
    value = F.when(F.count(v) == F.count("*"), known[method](v))
    return out.new(patch.df.groupBy(*out.keys).agg(value.alias("value")), f"{method} reduce {dim}")


def percentile(patch: Patch, dim: str, q: float) -> Patch:
    """The q-th percentile of the samples that are there, linear between them."""
    if not 0 <= q <= 100:
        raise ParameterError("q is between 0 and 100")
    patch.check(dim)
    out = patch.new(dims=tuple(patch.others(dim)), coords={k: c for k, c in patch.coords.items() if k != dim})
    return out.new(patch.df.groupBy(*out.keys).agg(F.percentile("value", q / 100).alias("value")), f"percentile {q} {dim}")
