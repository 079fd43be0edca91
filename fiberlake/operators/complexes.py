"""Complex spectra: Fourier transforms and their inverses over any dimensions, short-time transforms, slope filters,
slant stacks and dispersion images.

A spectrum's cells hold the real part in `value` and the imaginary part in `imag`.  Only the transforms themselves leave
Catalyst, one trace a row; everything done to the coefficients is a column expression or an aggregation.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from fiberlake.errors import CoordError, ParameterError
from fiberlake.operators.selecting import label
from fiberlake.patch import Coord, Patch

_EPS = 2.220446049250313e-16


@dataclass(frozen=True)
class Frames:
    """How a trace was cut for a short-time transform."""

    width: int
    hop: int
    first: int
    count: int
    window: tuple[float, ...]
    detrended: bool


@dataclass(frozen=True)
class Axis:
    """What a transformed dimension was before: its coordinate, its padded length, whether only half is kept."""

    coord: Coord
    n: int
    real: bool
    frames: Frames | None = None


@dataclass(frozen=True)
class Spectrum(Patch):
    origin: dict[str, Axis] = field(default_factory=dict)

    def plain(self, value: Column, step: str) -> Patch:
        return Patch(self.df.select(*self.keys, value.alias("value")), self.dims, self.coords, self.attrs, (*self.history, step))

    def with_parts(self, re: Column, im: Column, step: str) -> Spectrum:
        return self.new(self.df.select(*self.keys, re.alias("value"), im.alias("imag")), step)


def check_even(patch: Patch, *dims: str) -> None:
    patch.check(*dims)
    for d in dims:
        if not patch.coords[d].even:
            raise CoordError(f"{d} isn't evenly sampled")


def as_complex(patch: Patch) -> Spectrum:
    if isinstance(patch, Spectrum):
        return patch
    return Spectrum(patch.df.withColumn("imag", F.lit(0.0)), patch.dims, patch.coords, patch.attrs, patch.history)


def real(s: Spectrum) -> Patch:
    return s.plain(F.col("value"), "real")


def imag(s: Spectrum) -> Patch:
    return s.plain(F.col("imag"), "imag")


def modulus(s: Spectrum) -> Patch:
    return s.plain(F.hypot("value", "imag"), "abs")


def angle(s: Spectrum) -> Patch:
    return s.plain(F.atan2("imag", "value"), "angle")


def conj(s: Spectrum) -> Spectrum:
    return s.with_parts(F.col("value"), -F.col("imag"), "conj")


def fast_length(n: int) -> int:
    """The smallest length from n on without a prime factor over 11."""
    while True:
        left = n
        for p in (2, 3, 5, 7, 11):
            while left % p == 0:
                left //= p
        if left == 1:
            return n
        n += 1


def along(s: Spectrum, dim: str, f: Callable[[np.ndarray], np.ndarray], to: str, coord: Coord) -> Spectrum:
    """f turns a complex trace into a complex trace of coord's length; missing samples count as 0."""
    at = f"{dim}_idx"
    keep = [c for c in s.keys if c not in (dim, at)]
    zero = F.lit(0.0)
    cells = F.collect_list(F.struct(at, F.coalesce("value", zero).alias("re"), F.coalesce("imag", zero).alias("im")))
    rows = s.df.groupBy(*keep).agg(F.array_sort(cells).alias("t")).select(*keep, F.concat("t.re", "t.im").alias("t"))

    @F.pandas_udf("array<double>")
    def run(traces: pd.Series) -> pd.Series:
        out = []
        for x in traces:
            x, h = np.asarray(x, float), len(x) // 2
            y = np.asarray(f(x[:h] + 1j * x[h:]), complex)
            out.append(np.concatenate([y.real, y.imag]))
        return pd.Series(out)

    halves = rows.select(*keep, run("t").alias("t")).select(*keep, F.slice("t", 1, coord.n).alias("re"), F.slice("t", coord.n + 1, coord.n).alias("im"))
    cells = halves.select(*keep, F.posexplode(F.arrays_zip("re", "im")).alias(f"{to}_idx", "z"))
    cells = cells.select(*keep, F.col(f"{to}_idx").cast("long").alias(f"{to}_idx"), F.col("z.re").alias("value"), F.col("z.im").alias("imag"))
    out = s.new(dims=tuple(to if d == dim else d for d in s.dims), coords={to if k == dim else k: coord if k == dim else c for k, c in s.coords.items()})
    return out.new(cells.withColumn(to, label(coord, to)).select(*out.keys, "value", "imag"))


def dft(patch: Patch, *dims: str, half: bool = False, pad: bool = True) -> Spectrum:
    """Transforms scaled by the step, zero frequency in the middle; half: of the last dimension only frequencies from 0 on.

    Dimensions that are transformed already stay.  pad: zeros up to a fast length, which idft takes off again.
    """
    s = as_complex(patch)
    todo = [d for d in dims if f"ft_{d}" not in s.dims]
    check_even(s, *todo)
    for d in reversed(todo):
        one_sided = half and d == dims[-1]
        coord = s.coords[d]
        n, h = fast_length(coord.n) if pad else coord.n, abs(float(coord.step))
        if one_sided:
            new, f = Coord(n // 2 + 1, 0.0, 1 / (n * h)), (lambda x, n=n, h=h: np.fft.rfft(x.real, n) * h)
        else:
            new, f = Coord(n, -(n // 2) / (n * h), 1 / (n * h)), (lambda x, n=n, h=h: np.fft.fftshift(np.fft.fft(x, n)) * h)
        s = along(s, d, f, f"ft_{d}", new)
        s = s.new(step=f"dft of {d}", origin=s.origin | {d: Axis(coord, n, one_sided)})
    return s


def idft(s: Spectrum, *dims: str) -> Spectrum:
    """Back along the given, or all, transformed dimensions; padding goes."""
    todo = [d for d in (dims or s.origin) if s.origin[d].frames is None]
    for d in sorted(todo, key=lambda d: s.origin[d].real):
        axis = s.origin[d]
        n, m, h = axis.n, axis.coord.n, abs(float(axis.coord.step))
        f = (lambda x, n=n, m=m, h=h: np.fft.irfft(x, n)[:m] / h) if axis.real else (lambda x, m=m, h=h: np.fft.ifft(np.fft.ifftshift(x))[:m] / h)
        s = along(s, f"ft_{d}", f, d, axis.coord)
        s = s.new(step=f"idft of {d}", origin={k: v for k, v in s.origin.items() if k != d})
    return s


def power(s: Spectrum, output: str = "PSD", db: bool = False) -> Patch:
    """AS: amplitudes of harmonics; PS: bins that sum to the mean square; PSD: bins whose integral is the mean square.

    Unpadded extents count; one-sided spectra aren't doubled.  db: decibels, with a tiny floor.
    """
    extent = math.prod(a.coord.n * abs(float(a.coord.step)) for a in s.origin.values())
    square = F.col("value") * F.col("value") + F.col("imag") * F.col("imag")
    known = {"AS": F.sqrt(square) / extent, "PS": square / (extent * extent), "PSD": square / extent}
    if output not in known:
        raise ParameterError(f"{output} is none of " + ", ".join(known))
    out = known[output]
    return s.plain((20 if output == "AS" else 10) * F.log10(out + _EPS) if db else out, output)


def hann(n: int) -> tuple[float, ...]:
    return tuple(0.5 - 0.5 * math.cos(2 * math.pi * i / n) for i in range(n))


def stft(patch: Patch, dim: str, width: int, overlap: int | None = None, window: tuple[float, ...] | None = None, detrend: bool = False) -> Spectrum:
    """Half spectra, scaled by the step, of windows centred on every `width - overlap` samples; zeros lie beyond the ends.

    Every window that reaches a sample counts, those centred outside included; half the width overlaps if not given.
    """
    check_even(patch, dim)
    coord, hop = patch.coords[dim], width - (width // 2 if overlap is None else overlap)
    w = tuple(map(float, window or hann(width)))
    if not 0 < width <= coord.n or hop <= 0 or len(w) != width:
        raise ParameterError("the window fits into the trace, is as long as given, and moves on")
    middle, n, h = width // 2, coord.n, abs(float(coord.step))
    first, last = -((width - 1 - middle) // hop), (n - 1 + middle) // hop
    cut = Frames(width, hop, first, last - first + 1, w, detrend)
    bins = width // 2 + 1
    starts = np.arange(first, last + 1) * hop - middle
    weights = np.array(w)

    def f(x: np.ndarray) -> np.ndarray:
        before, after = -starts[0], max(0, starts[-1] + width - n)
        frames = np.pad(x.real, (before, after))[starts[:, None] + before + np.arange(width)]
        if detrend:
            t = np.arange(width) - (width - 1) / 2
            frames = frames - frames.mean(axis=1, keepdims=True)
            if width > 1:
                frames = frames - np.outer(frames @ t / (t @ t), t)
        return (np.fft.rfft(frames * weights, axis=1) * h).ravel()

    flat = along(as_complex(patch), dim, f, "flat", Coord(cut.count * bins, 0, 1))
    centre, freq = Coord(cut.count, coord.value(first * hop), coord.step * hop), Coord(bins, 0.0, 1 / (width * h))
    df = flat.df.withColumn(f"{dim}_idx", F.floor(F.col("flat_idx") / bins)).withColumn(f"ft_{dim}_idx", F.pmod("flat_idx", F.lit(bins).cast("long")))
    df = df.withColumn(dim, label(centre, dim)).withColumn(f"ft_{dim}", label(freq, f"ft_{dim}"))
    out = flat.new(dims=(*(d for x in patch.dims for d in ((f"ft_{dim}", dim) if x == dim else (x,))),), coords={k: c for k, c in flat.coords.items() if k != "flat"} | {dim: centre, f"ft_{dim}": freq})
    return out.new(df.select(*out.keys, "value", "imag"), f"stft of {dim}", origin=out.origin | {dim: Axis(coord, width, True, cut)})


def istft(s: Spectrum, dim: str) -> Patch:
    """Weighted overlap-add; not after detrending, nor where a sample has no weight."""
    axis = s.origin.get(dim)
    if axis is None or axis.frames is None or axis.frames.detrended:
        raise ParameterError(f"{dim} has no short-time transform that can be undone")
    cut, n, h = axis.frames, axis.coord.n, abs(float(axis.coord.step))
    w, bins = np.array(cut.window), cut.width // 2 + 1
    before = cut.width // 2 - cut.first * cut.hop
    total = np.zeros(before + n + 2 * cut.width)
    for k in range(cut.count):
        total[k * cut.hop : k * cut.hop + cut.width] += w * w
    total = total[before : before + n]
    if total.min() <= 1e-12:
        raise ParameterError("some sample has no weight in any window")

    def f(x: np.ndarray) -> np.ndarray:
        frames = np.fft.irfft(x.reshape(cut.count, bins), cut.width, axis=1) * w / h
        y = np.zeros(before + n + 2 * cut.width)
        for k, frame in enumerate(frames):
            y[k * cut.hop : k * cut.hop + cut.width] += frame
        return y[before : before + n] / total

    df = s.df.withColumn("flat_idx", F.col(f"{dim}_idx") * bins + F.col(f"ft_{dim}_idx")).withColumn("flat", F.col("flat_idx"))
    dims = tuple("flat" if d == dim else d for d in s.dims if d != f"ft_{dim}")
    coords = {k: c for k, c in s.coords.items() if k not in (dim, f"ft_{dim}")} | {"flat": Coord(cut.count * bins, 0, 1)}
    flat = s.new(df, dims=dims, coords=coords)
    return real(along(flat, "flat", f, dim, axis.coord))


def spectrogram(patch: Patch, dim: str, width: int, overlap: int | None = None) -> Patch:
    return modulus(stft(patch, dim, width, overlap))


def slope_filter(patch: Patch, slopes: tuple[float, float, float, float], dims: tuple[str, str] = ("distance", "time"), directional: bool = False, invert: bool = False) -> Patch:
    """Keeps slopes (frequency over wavenumber) between the middle two, with sine tapers to the outer two."""
    a, b, c, d = map(float, slopes)
    if not a <= b <= c <= d:
        raise ParameterError("the four slopes ascend")
    s = dft(patch, *dims)
    slope = F.col(f"ft_{dims[1]}") / (F.col(f"ft_{dims[0]}") + F.lit(_EPS))
    slope = slope if directional else F.abs(slope)
    loss = F.when(slope.between(c, d) & (slope > c), F.sin((slope - c) * (math.pi / 2 / (d - c))) if d > c else F.lit(1.0))
    loss = loss.when(slope.between(b, c), 0.0).when(slope.between(a, b), F.lit(1.0) - F.sin((slope - a) * (math.pi / 2 / (b - a))) if b > a else F.lit(0.0)).otherwise(1.0)
    mask = loss if invert else F.lit(1.0) - loss
    return real(idft(s.with_parts(F.col("value") * mask, F.col("imag") * mask, "slope filter"), *dims))


def _ascending(values: list[float], what: str) -> list[float]:
    values = [float(v) for v in values]
    if not values or values[0] <= 0 or any(a >= b for a, b in zip(values, values[1:])):
        raise ParameterError(f"{what} are positive and ascend")
    return values


def tau_p(patch: Patch, velocities: list[float], dims: tuple[str, str] = ("distance", "time")) -> Patch:
    """Slant stacks: for each slowness the sum over traces, moved by slowness times distance, linear between samples.

    Negative slownesses count distance from the other end and come first.  A cell adds to at most two places for each
    slowness, so this is one explode and one aggregation with map-side combine.
    """
    check_even(patch, *dims)
    x, t = dims
    speeds = _ascending(velocities, "velocities")
    cx, ct = patch.coords[x], patch.coords[t]
    slow = sorted(sign / v for v in speeds for sign in (-1, 1))
    shift = F.col("p.s") * F.when(F.col("p.s") < 0, F.col(f"{x}_idx") - F.lit(cx.n - 1)).otherwise(F.col(f"{x}_idx")) * F.lit(abs(float(cx.step)) / abs(float(ct.step)))
    table = F.array(*(F.struct(F.lit(i).cast("long").alias("i"), F.lit(s).alias("s")) for i, s in enumerate(slow)))
    rest = [c for d in patch.others(x, t) for c in (d, f"{d}_idx")]
    cells = patch.df.select(*rest, f"{x}_idx", F.col(f"{t}_idx").alias("at"), F.coalesce("value", F.lit(0.0)).alias("value"), F.explode(table).alias("p"))
    cells = cells.withColumn("shift", shift).withColumn("low", F.floor("shift")).withColumn("w", F.col("shift") - F.col("low"))
    ends = F.array(F.struct(F.lit(0).cast("long").alias("k"), (F.lit(1.0) - F.col("w")).alias("w")), F.struct(F.lit(1).cast("long").alias("k"), F.col("w").alias("w")))
    parts = cells.select(*rest, "p", "at", "value", "low", F.explode(ends).alias("e")).withColumn("to", F.col("at") - F.col("low") - F.col("e.k"))
    # beyond the last pair of samples nothing is added, and those places stay 0
    value = F.when(F.col("at") - F.col("e.k") <= ct.n - 2, F.col("value") * F.col("e.w")).otherwise(0.0)
    inside = parts.where(F.col("to").between(0, ct.n - 1)).groupBy(*rest, F.col("p.i").alias("slowness_idx"), F.col("to").alias(f"{t}_idx")).agg(F.sum(value).alias("value"))
    df = inside.withColumn("slowness", F.element_at(F.array(*(F.lit(s) for s in slow)), (F.col("slowness_idx") + 1).cast("int"))).withColumn(t, label(ct, t))
    out = patch.new(dims=(*patch.others(x, t), "slowness", t), coords={k: c for k, c in patch.coords.items() if k != x} | {"slowness": Coord(len(slow), 0, None)})
    return out.new(df.select(*out.keys, "value"), "tau-p")


def dispersion(patch: Patch, velocities: list[float], resolution: float | None = None, band: tuple[float, float] | None = None, dims: tuple[str, str] = ("distance", "time")) -> Patch:
    """Phase-shift stacks: for each velocity and frequency the modulus of the mean over traces of unit phasors, moved back.

    Frequencies run evenly from 0 to the sampling rate, as many as the trace has samples, or rate over resolution.
    """
    check_even(patch, *dims)
    x, t = dims
    speeds = _ascending(velocities, "velocities")
    cx, ct = patch.coords[x], patch.coords[t]
    rate = 1 / abs(float(ct.step))
    if resolution is not None and resolution <= 0:
        raise ParameterError("the resolution is positive")
    low, high = band or (0.0, rate / 2)
    if band and not 0 < low < high < rate / 2:
        raise ParameterError("the band lies between 0 and half the sampling rate")
    n = ct.n if resolution is None else int(rate / resolution)
    f = np.arange(n) * rate / max(n - 1, 1)
    live = np.flatnonzero((f >= low) & (f < high))
    if not len(live):
        raise ParameterError("no frequency lies in the band")
    first, count = int(live[0]), len(live)

    def phasors(v: np.ndarray) -> np.ndarray:
        z = np.fft.fft(v.real, n)[first : first + count]
        size = np.abs(z)
        return np.divide(z, size, out=np.zeros_like(z), where=size != 0)

    coord = Coord(count, float(f[first]), rate / max(n - 1, 1))
    s = along(as_complex(patch), t, phasors, "frequency", coord)
    rest = [c for d in patch.others(x, t) for c in (d, f"{d}_idx")]
    table = F.array(*(F.struct(F.lit(i).cast("long").alias("velocity_idx"), F.lit(v).alias("velocity")) for i, v in enumerate(speeds)))
    cells = s.df.select(*rest, x, "frequency", "frequency_idx", "value", "imag", F.explode(table).alias("v"))
    turn = F.col(x) * F.col("frequency") * F.lit(2 * math.pi) / F.col("v.velocity")
    re, im = F.col("value") * F.cos(turn) - F.col("imag") * F.sin(turn), F.col("value") * F.sin(turn) + F.col("imag") * F.cos(turn)
    df = cells.groupBy(*rest, "frequency", "frequency_idx", "v.velocity_idx", "v.velocity").agg((F.hypot(F.sum(re), F.sum(im)) / cx.n).alias("value"))
    coords = {k: c for k, c in patch.coords.items() if k not in (x, t)} | {"velocity": Coord(len(speeds), 0, None), "frequency": coord}
    out = patch.new(dims=(*patch.others(x, t), "velocity", "frequency"), coords=coords)
    return out.new(df.select(*out.keys, "value"), "dispersion")
