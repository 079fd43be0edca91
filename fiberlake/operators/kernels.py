"""Filters by small kernels along one dimension.

Each cell at a border is copied to the places beyond the end that stand for it; then all windows are ordered frames over
a trace.  That is one pass over the cells and one shuffle, by trace, which filters along the same dimension share.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fiberlake.errors import ParameterError
from fiberlake.patch import Patch


def padded(patch: Patch, dim: str, before: int, after: int, mode: str = "reflect", cval: float = 0.0) -> DataFrame:
    """The cells with `before` and `after` more at the ends of each trace.

    reflect: d c b a | a b c d | d c b a; mirror: d c b | a b c d | c b a; nearest: a a | a b c d | d d; wrap: c d | a b c d | a b;
    constant: cval.
    """
    n, at = patch.coords[dim].n, F.col(f"{dim}_idx")
    if max(before, after) >= n:
        raise ParameterError(f"the kernel reaches {max(before, after)} samples; {dim} has {n}")
    v, one = F.col("value"), F.lit(1).cast("long")

    def copy(inside: Column, to: Column) -> Column:
        """One more place for cells inside."""
        return F.when(inside, F.array(F.struct(to.cast("long").alias("i"), v.alias("v"))))

    def edge(cell: int, first: int, last: int, value: Column) -> Column:
        """The places first..last for one cell."""
        if first > last:
            return F.lit(None)
        places = F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"), one)
        return F.when(at == cell, F.transform(places, lambda i: F.struct(i.alias("i"), value.alias("v"))))

    known = {
        "reflect": lambda: (copy(at < before, -1 - at), copy(at >= n - after, 2 * n - 1 - at)),
        "mirror": lambda: (copy(at.between(1, before), -at), copy(at.between(n - 1 - after, n - 2), 2 * (n - 1) - at)),
        "wrap": lambda: (copy(at >= n - before, at - n), copy(at < after, at + n)),
        "nearest": lambda: (edge(0, -before, -1, v), edge(n - 1, n, n - 1 + after, v)),
        "constant": lambda: (edge(0, -before, -1, F.lit(float(cval))), edge(n - 1, n, n - 1 + after, F.lit(float(cval)))),
    }
    if mode not in known:
        raise ParameterError(f"{mode} is none of " + ", ".join(known))
    own = F.array(F.struct(at.alias("i"), v.alias("v")))
    none = F.array().cast("array<struct<i:bigint,v:double>>")
    places = F.concat(own, *(F.coalesce(c.cast("array<struct<i:bigint,v:double>>"), none) for c in known[mode]()))
    keep = [c for c in patch.keys if c != f"{dim}_idx"]
    return patch.df.select(*keep, F.inline(places).alias(f"{dim}_idx", "value"))


def windowed(patch: Patch, dim: str, before: int, after: int, value, step: str, mode: str = "reflect", cval: float = 0.0) -> Patch:
    """value(window) over before..after samples around each; missing samples don't count."""
    at = F.col(f"{dim}_idx")
    order = Window.partitionBy(*(f"{d}_idx" for d in patch.others(dim))).orderBy(at)
    df = padded(patch, dim, before, after, mode, cval).withColumn("value", value(order))
    return patch.new(df.where(at.between(0, patch.coords[dim].n - 1)).select(*patch.keys, "value"), step)


def weighted(patch: Patch, dim: str, weights: list[float], mode: str = "reflect", step: str = "kernel", cval: float = 0.0) -> Patch:
    """sum(weights[k + radius] * sample at o + k)."""
    radius = len(weights) // 2

    def value(order) -> Column:
        near = [(w, F.col("value") if k == 0 else F.lead("value", k).over(order) if k > 0 else F.lag("value", -k).over(order)) for k, w in zip(range(-radius, radius + 1), map(float, weights)) if w]
        total = F.coalesce(near[0][1], F.lit(0.0)) * near[0][0]
        for w, v in near[1:]:
            total = total + F.coalesce(v, F.lit(0.0)) * w
        return F.when(F.coalesce(*(v for _, v in near)).isNotNull(), total)

    return windowed(patch, dim, radius, radius, value, step, mode, cval)


def gaussian(patch: Patch, dim: str, sigma: float, truncate: float = 4.0, mode: str = "reflect") -> Patch:
    radius = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return weighted(patch, dim, [x / sum(w) for x in w], mode, "gaussian")


def sobel(patch: Patch, dim: str, mode: str = "reflect") -> Patch:
    """A difference along dim, smoothed along the others."""
    out = weighted(patch, dim, [-1, 0, 1], mode, "sobel")
    for d in patch.others(dim):
        out = weighted(out, d, [1, 2, 1], mode, "sobel")
    return out


def savgol(patch: Patch, dim: str, width: int, order: int, mode: str = "reflect") -> Patch:
    """Weights of a least-squares polynomial at the middle of the window."""
    import numpy as np

    if width % 2 == 0 or order >= width:
        raise ParameterError("the width is odd and above the order")
    x = np.arange(width) - width // 2
    weights = np.linalg.pinv(np.vander(x, order + 1, increasing=True))[0]
    return weighted(patch, dim, weights.tolist(), mode, "savgol")


def _span(width: int) -> tuple[int, int]:
    """Samples before and after the middle; an even window has one more before."""
    return width // 2, width - 1 - width // 2


def median(patch: Patch, dim: str, width: int, mode: str = "reflect", cval: float = 0.0) -> Patch:
    return moving(patch, dim, width, "median", mode, cval)


def moving(patch: Patch, dim: str, width: int, method: str, mode: str = "reflect", cval: float = 0.0) -> Patch:
    """Centred windows: mean, sum, min, max, std or median."""
    known = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_pop, "median": lambda c: F.percentile(c, F.lit(0.5))}
    if width < 1 or method not in known:
        raise ParameterError("the width is positive and the method one of " + ", ".join(known))
    before, after = _span(width)
    return windowed(patch, dim, before, after, lambda w: known[method]("value").over(w.rowsBetween(-before, after)), f"moving {method}", mode, cval)


def hampel(patch: Patch, widths: dict[str, int], threshold: float = 10.0, approximate: bool = True) -> Patch:
    """Samples further from the local median than threshold median deviations become the median.

    A deviation is a sample's distance from the median around that sample; a median deviation of 0 counts as the smallest
    difference of a double.  approximate: medians along one dimension after the other, else of the whole box.
    """
    if threshold <= 0 or not math.isfinite(threshold):
        raise ParameterError("the threshold is positive")
    widths = {d: w + 1 - w % 2 for d, w in widths.items()}

    def medians(p: Patch) -> Patch:
        if not approximate and len(widths) > 1:
            return median_nd(p, widths)
        for d, w in widths.items():
            p = median(p, d, w)
        return p

    key = [f"{d}_idx" for d in patch.dims]
    if len(widths) == 1 or approximate:  # frames over traces: the sample itself goes along
        (first, width), *rest = widths.items()
        if not rest:
            before, after = _span(width)
            order = Window.partitionBy(*(f"{d}_idx" for d in patch.others(first))).orderBy(f"{first}_idx")
            frame, inside = order.rowsBetween(-before, after), F.col(f"{first}_idx").between(0, patch.coords[first].n - 1)
            half = F.percentile("value", F.lit(0.5)).over(frame)
            cells = padded(patch, first, before, after).withColumn("m", half).where(inside)
            # one array holds what has to be mirrored along
            gaps = patch.new(cells.select(*patch.keys, F.abs(F.col("value") - F.col("m")).alias("value"), F.col("value").alias("own"), "m"))
            wide = _padded_with(gaps, first, before, after, ["own", "m"]).withColumn("mad", half).where(inside)
            return _replaced(patch, wide, threshold)
    middle = medians(patch).df.select(*key, F.col("value").alias("m"))
    cells = patch.df.join(middle, key).select(*patch.keys, F.abs(F.col("value") - F.col("m")).alias("value"), F.col("value").alias("own"), "m")
    mad = medians(patch.new(cells.select(*patch.keys, "value"))).df.select(*key, F.col("value").alias("mad"))
    return _replaced(patch, cells.join(mad, key), threshold)


def _padded_with(patch: Patch, dim: str, before: int, after: int, more: list[str]) -> DataFrame:
    """As padded(), by reflection, with further columns."""
    n, at = patch.coords[dim].n, F.col(f"{dim}_idx")
    places = F.array_compact(F.array(at, F.when(at < before, -1 - at), F.when(at >= n - after, 2 * n - 1 - at)))
    keep = [c for c in patch.keys if c != f"{dim}_idx"]
    return patch.df.select(*keep, "value", *more, F.explode(places).alias(f"{dim}_idx"))


def _replaced(patch: Patch, cells: DataFrame, threshold: float) -> Patch:
    scale = F.when(F.col("mad") == 0, F.lit(2.220446049250313e-16)).otherwise(F.col("mad"))
    value = F.when(F.abs(F.col("own") - F.col("m")) / scale > threshold, F.col("m")).otherwise(F.col("own"))
    return patch.new(cells.select(*patch.keys, value.alias("value")), "hampel")


#: Cosine series of windows over x = i / (m - 1), by their published coefficients.
_SERIES = {"hann": (0.5, 0.5), "cos": (0.5, 0.5), "hamming": (0.54, 0.46), "blackman": (0.42, 0.5, 0.08), "blackmanharris": (0.35875, 0.48829, 0.14128, 0.01168), "nuttall": (0.3635819, 0.4891775, 0.1365995, 0.0106411)}


def window_value(kind: str, i: Column, m: int) -> Column:
    """The i-th of m values of a symmetric window."""
    x = i / F.lit(float(max(m - 1, 1)))
    if kind in _SERIES:
        out = F.lit(0.0)
        for k, a in enumerate(_SERIES[kind]):
            out = out + F.cos(x * (2 * math.pi * k)) * ((-1) ** k * a)
        return out
    y = F.abs(x - 0.5)  # 0 in the middle, 0.5 at the ends
    known = {
        "boxcar": lambda: F.lit(1.0) + 0 * x,
        "bartlett": lambda: 1 - 2 * y,
        "triang": lambda: 1 - F.abs(2 * i - (m - 1)) / F.lit(float(m if m % 2 == 0 else m + 1)),
        "barthann": lambda: 0.62 - 0.48 * y + 0.38 * F.cos(2 * math.pi * y),
        "bohman": lambda: F.when(y >= 0.5, 0.0).otherwise((1 - 2 * y) * F.cos(2 * math.pi * y) + F.sin(2 * math.pi * y) / math.pi),
        "parzen": lambda: (lambda z: F.when(z <= 0.5, 1 - 6 * z * z * (1 - z)).otherwise(2 * F.pow(1 - z, F.lit(3.0))))(F.abs(2 * i - (m - 1)) / F.lit(float(m))),
    }
    known["ramp"] = known["triang"]
    if kind not in known:
        raise ParameterError(f"{kind} is none of " + ", ".join(sorted({*_SERIES, *known})))
    return known[kind]()


def taper(patch: Patch, dim: str, fraction: float | tuple[float | None, float | None] = 0.1, kind: str = "hann") -> Patch:
    """Half a window at each end; fractions are of the distance from the first to the last label, None leaves an end."""
    coord = patch.coords[dim]
    ends = fraction if isinstance(fraction, tuple) else (fraction, fraction)
    reach = [None if f is None else math.floor(round(f * (coord.n - 1), 10)) + 1 for f in ends]
    if any(m is not None and not 0 < m <= coord.n for m in reach) or sum(m or 0 for m in reach) > coord.n:
        raise ParameterError("the tapered ends exceed the trace or overlap")
    at, weight = F.col(f"{dim}_idx"), F.lit(1.0)
    first, last = reach
    if first is not None:
        weight = F.when(at < first, window_value(kind, at, 2 * first)).otherwise(weight)
    if last is not None:
        weight = F.when(at >= coord.n - last, window_value(kind, at - (coord.n - 2 * last), 2 * last)).otherwise(weight)
    return patch.with_value(F.col("value") * weight, "taper")


def interpolate(patch: Patch, dim: str, values: list[float], kind: str = "linear") -> Patch:
    """Linear at new labels, beyond the ends by the end's two samples; or the nearest sample, the one before of two.

    Each label looks up its neighbours.
    """
    from fiberlake.patch import Coord

    if kind not in ("linear", "nearest"):
        raise ParameterError(f"{kind} is neither linear nor nearest")

    coord, at = patch.coords[dim], f"{dim}_idx"
    rows = []
    for i, v in enumerate(values):
        place = (v - coord.start) / coord.step
        low = min(max(math.floor(place), 0), coord.n - 2)
        if kind == "nearest":
            rows.append((min(max(math.ceil(place - 0.5), 0), coord.n - 1), i, float(v), 1.0))
        else:
            rows += [(low, i, float(v), 1 - (place - low)), (low + 1, i, float(v), place - low)]
    table = F.broadcast(patch.df.sparkSession.createDataFrame(rows, f"`{at}` long, `to` long, `label` double, w double"))
    keep = [c for c in patch.keys if c not in (dim, at)]
    found = patch.df.join(table, at).groupBy(*keep, "to", "label").agg(F.sum(F.col("value") * F.col("w")).alias("value"), F.count("value").alias("n"))
    df = found.select(*keep, F.col("label").alias(dim), F.col("to").alias(at), F.when(F.col("n") == (2 if kind == "linear" else 1), F.col("value")).alias("value"))
    return patch.new(df.select(*patch.keys, "value"), "interpolate", coords=patch.coords | {dim: Coord(len(values), 0, None)})


def median_nd(patch: Patch, widths: dict[str, int], mode: str = "reflect") -> Patch:
    """The median of a box of odd widths over several dimensions.

    Along all dimensions but the first a cell's neighbours become one array, by frames over traces; along the first the
    arrays of a frame are put together and sorted.  So each cell crosses a shuffle once for every dimension.
    """
    if any(w % 2 == 0 for w in widths.values()):
        raise ParameterError("widths are odd")
    boxes, names = patch, list(widths)
    df = patch.df.withColumn("box", F.array("value"))
    for d in names:
        r, n, at = widths[d] // 2, patch.coords[d].n, F.col(f"{d}_idx")
        if r >= n:
            raise ParameterError(f"the kernel reaches {r} samples; {d} has {n}")
        order = Window.partitionBy(*(f"{o}_idx" for o in patch.others(d))).orderBy(at)
        if mode == "reflect":
            wide = _padded_with(boxes.new(df), d, r, r, ["box"])
        else:
            raise ParameterError("boxes are reflected at borders")
        df = wide.withColumn("box", F.flatten(F.collect_list("box").over(order.rowsBetween(-r, r)))).where(at.between(0, n - 1))
    known = F.array_sort(F.filter("box", lambda v: v.isNotNull()))
    size = F.size(known)
    middle = (F.get(known, F.floor((size - 1) / 2).cast("int")) + F.get(known, F.floor(size / 2).cast("int"))) / 2
    return patch.new(df.select(*patch.keys, middle.alias("value")), "median")
