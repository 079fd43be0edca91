"""Arithmetic and comparisons between patches and with numbers.  Patches meet where their shared labels are equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from fiberlake.errors import PatchDimError
from fiberlake.patch import Patch

BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda a, b: a + b,
    "subtract": lambda a, b: a - b,
    "multiply": lambda a, b: a * b,
    "divide": lambda a, b: F.try_divide(a, b),
    "floor_divide": lambda a, b: F.floor(F.try_divide(a, b)).cast("double"),
    "mod": lambda a, b: a - b * F.floor(F.try_divide(a, b)),
    "power": lambda a, b: F.pow(a, b),
    "maximum": lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b)),
    "minimum": lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.least(a, b)),
    "greater": lambda a, b: F.coalesce(a > b, F.lit(False)).cast("double"),
    "less": lambda a, b: F.coalesce(a < b, F.lit(False)).cast("double"),
    "greater_equal": lambda a, b: F.coalesce(a >= b, F.lit(False)).cast("double"),
    "less_equal": lambda a, b: F.coalesce(a <= b, F.lit(False)).cast("double"),
}
UNARY: dict[str, Callable[[Column], Column]] = {
    "abs": F.abs,
    "negative": lambda v: -v,
    "exp": F.exp,
    "log": F.ln,
    "log10": F.log10,
    "log2": F.log2,
    "sqrt": lambda v: F.when(v >= 0, F.sqrt(v)),
    "isnan": lambda v: v.isNull().cast("double"),
    "isfinite": lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)).cast("double"),
    "isinf": lambda v: F.coalesce(F.abs(v) == float("inf"), F.lit(False)).cast("double"),
}


def unary(patch: Patch, name: str) -> Patch:
    return patch.map_value(UNARY[name], name)


def binary(a: Patch, b: Patch | float, name: str) -> Patch:
    """Dimensions of one patch only are broadcast; shared ones are joined on equal labels, in ascending order."""
    f = BINARY[name]
    if not isinstance(b, Patch):
        return a.map_value(lambda v: f(v, F.lit(float(b))), name)
    shared = [d for d in a.dims if d in b.dims]
    if not shared:
        raise PatchDimError("the patches share no dimension")
    dims = (*a.dims, *(d for d in b.dims if d not in a.dims))
    right = b.df.select(*shared, *(c for d in b.dims if d not in a.dims for c in (d, f"{d}_idx")), F.col("value").alias("other"))
    df = a.df.join(right, shared).withColumn("value", f(F.col("value"), F.col("other")))
    out = a.new(df, name, dims=dims, coords=b.coords | a.coords)
    return out.new(df.select(*out.keys, "value"))
