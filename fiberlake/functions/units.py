"""Units of data and coordinates: a conversion is one multiplication and one addition, settled on the driver."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from fiberlake.errors import ParameterError
from fiberlake.operators.selecting import label
from fiberlake.patch import Patch

_PREFIX = {"n": 1e-9, "u": 1e-6, "m": 1e-3, "c": 1e-2, "k": 1e3, "M": 1e6}
#: unit: (what it measures, factor and offset to that quantity's base unit)
_UNITS = {"m": ("length", 1.0, 0.0), "s": ("time", 1.0, 0.0), "Hz": ("rate", 1.0, 0.0), "K": ("temperature", 1.0, 0.0), "strain": ("strain", 1.0, 0.0)}
_UNITS |= {p + u: (_UNITS[u][0], f, 0.0) for u in ("m", "s", "Hz", "strain") for p, f in _PREFIX.items()}
_UNITS |= {"ft": ("length", 0.3048, 0.0), "inch": ("length", 0.0254, 0.0), "mile": ("length", 1609.344, 0.0), "min": ("time", 60.0, 0.0), "hour": ("time", 3600.0, 0.0), "day": ("time", 86400.0, 0.0), "degC": ("temperature", 1.0, 273.15), "degF": ("temperature", 5 / 9, 273.15 - 32 * 5 / 9), "percent": ("ratio", 0.01, 0.0), "": ("ratio", 1.0, 0.0)}


def conversion(old: str, new: str) -> tuple[float, float]:
    """(factor, offset): new = old * factor + offset."""
    for u in (old, new):
        if u not in _UNITS:
            raise ParameterError(f"unknown unit {u!r}")
    (kind, a, b), (other, c, d) = _UNITS[old], _UNITS[new]
    if kind != other:
        raise ParameterError(f"{old!r} is a {kind}, {new!r} a {other}")
    return a / c, (b - d) / c


def set_units(patch: Patch, data_units: str | None = None, **coord_units: str) -> Patch:
    """Names units, without conversion."""
    patch.check(*coord_units)
    coords = {d: replace(c, units=coord_units.get(d, c.units)) for d, c in patch.coords.items()}
    return patch.new(coords=coords, attrs=patch.attrs | ({} if data_units is None else {"data_units": data_units}))


def convert_units(patch: Patch, data_units: str | None = None, **coord_units: str) -> Patch:
    """Data by one expression; evenly sampled coordinates by their start and step, their labels by index."""
    patch.check(*coord_units)
    df, out = patch.df, set_units(patch, data_units, **coord_units)
    if data_units is not None:
        m, b = conversion(patch.attrs.get("data_units", ""), data_units)
        df = df.withColumn("value", F.col("value") * F.lit(m) + F.lit(b))
    coords = dict(out.coords)
    for d, units in coord_units.items():
        m, b = conversion(patch.coords[d].units, units)
        if coords[d].even:
            coords[d] = replace(coords[d], start=float(patch.coords[d].start * m + b), step=float(patch.coords[d].step * m))
            df = df.withColumn(d, label(coords[d], d))
        else:
            df = df.withColumn(d, F.col(d) * F.lit(m) + F.lit(b))
    return out.new(df.select(*out.keys, "value"), "convert units", coords=coords)
