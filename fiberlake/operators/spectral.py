"""Fourier transforms and recursive filters on whole traces, in numpy on Arrow batches.

A trace (all samples along a dimension) is gathered as one row; its length is bounded by how recordings are cut.  The
traces of an Arrow batch are worked on together.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from fiberlake.errors import ParameterError
from fiberlake.patch import Coord, Patch


def per_trace(patch: Patch, dim: str, f: Callable[[np.ndarray], np.ndarray], n: int, coord: Coord, step: str, new_dim: str | None = None, missing: float = 0.0) -> Patch:
    """f turns the rows of a matrix, traces of one length, into rows of n values; missing samples count as `missing`.

    NaN in a result becomes null.
    """
    to = new_dim or dim
    out = patch.new(dims=tuple(to if d == dim else d for d in patch.dims), coords={to if k == dim else k: coord if k == dim else c for k, c in patch.coords.items()})
    keep = [c for c in patch.keys if c not in (dim, f"{dim}_idx")]
    traces = patch.df.groupBy(*keep).agg(F.array_sort(F.collect_list(F.struct(f"{dim}_idx", F.coalesce("value", F.lit(float(missing))).alias("value")))).alias("t"))
    traces = traces.select(*keep, F.col("t.value").alias("t"))

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        sizes, done = s.map(len).to_numpy(), np.empty(len(s), object)
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            for i, y in zip(rows, np.asarray(f(np.stack(s.iloc[rows].to_list()).astype(float)), float)):
                done[i] = y
        return pd.Series(done, index=s.index)

    cells = traces.select(*keep, F.posexplode(run("t")).alias(f"{to}_idx", "value")).withColumn(f"{to}_idx", F.col(f"{to}_idx").cast("long"))
    label = F.lit(float(coord.start)) + F.col(f"{to}_idx") * F.lit(float(coord.step))
    return out.new(cells.withColumn(to, label).withColumn("value", F.nanvl("value", F.lit(None).cast("double"))).select(*out.keys, "value"), step)


def amplitude_spectrum(patch: Patch, dim: str) -> Patch:
    """Modulus of the one-sided transform, scaled by the step."""
    coord = patch.coords[dim]
    n, h = coord.n, float(coord.step)
    return per_trace(patch, dim, lambda x: np.abs(np.fft.rfft(x)) * h, n // 2 + 1, Coord(n // 2 + 1, 0.0, 1 / (n * h)), "dft", f"ft_{dim}")


def butterworth(corners: int, low: float | None, high: float | None) -> list[np.ndarray]:
    """Second-order sections (b0 b1 b2 1 a1 a2) of a digital Butterworth filter; bounds as shares of Nyquist.

    Poles of the analog prototype are moved to the band and mapped by the bilinear transform.
    """
    poles = np.exp(1j * np.pi * (2 * np.arange(1, corners + 1) + corners - 1) / (2 * corners))
    warp = lambda w: 4 * math.tan(math.pi * w / 2)
    if low is None and high is None:
        raise ParameterError("one bound at least")
    if low is None:
        wc = warp(high)
        poles, zeros, gain = poles * wc, np.array([]), wc**corners
    elif high is None:
        wc = warp(low)
        poles, zeros, gain = wc / poles, np.zeros(corners), 1 / np.prod(-poles).real
    else:
        a, b = warp(low), warp(high)
        half, middle = poles * (b - a) / 2, a * b
        root = np.sqrt(half**2 - middle)
        poles, zeros, gain = np.concatenate([half + root, half - root]), np.zeros(corners), (b - a) ** corners
    gain = gain * np.real(np.prod(4 - zeros) / np.prod(4 - poles))
    zeros = np.concatenate([(4 + zeros) / (4 - zeros), -np.ones(len(poles) - len(zeros))])
    poles = (4 + poles) / (4 - poles)
    upper = sorted((p for p in poles if p.imag > 1e-12), key=abs)
    real = sorted((p.real for p in poles if abs(p.imag) <= 1e-12), key=abs)
    zeros = sorted(zeros.real, key=abs)
    ones, minus = [z for z in zeros if z > 0], [z for z in zeros if z <= 0]
    pairs = [np.array([1, -2 * p.real, abs(p) ** 2]) for p in upper]
    pairs += [np.poly(real[i : i + 2]) if len(real[i : i + 2]) == 2 else np.array([1, -real[i], 0.0]) for i in range(0, len(real), 2)]
    sections = []
    mixed = [z for two in zip(ones, minus) for z in two] + ones[len(minus) :] + minus[len(ones) :]
    for i, a in enumerate(pairs):
        own = mixed[2 * i : 2 * i + 2]
        b = np.poly(own) if own else np.array([1.0])
        b = np.concatenate([b, np.zeros(3 - len(b))])
        sections.append(np.concatenate([b * (gain if i == 0 else 1), a]))
    return sections


def run_sections(x: np.ndarray, sections: list[np.ndarray], settled: bool = True) -> np.ndarray:
    """One pass over time for all rows at once; settled: as if the first samples had always been there."""
    x = np.ascontiguousarray(x.T)  # a step in time is one row
    level = x[0].copy() if settled and len(x) else np.zeros(x.shape[1:])
    for s in sections:
        b0, b1, b2, _, a1, a2 = s
        out = level * ((b0 + b1 + b2) / (1 + a1 + a2))
        z2 = b2 * level - a2 * out
        z1 = b1 * level - a1 * out + z2
        y = np.empty_like(x)
        for i, v in enumerate(x):
            o = y[i] = b0 * v + z1
            z1 = b1 * v - a1 * o + z2
            z2 = b2 * v - a2 * o
        x, level = y, out
    return x.T


def zero_phase(x: np.ndarray, sections: list[np.ndarray]) -> np.ndarray:
    """Forward and backward, with ends continued oddly."""
    n = x.shape[1]
    k = min(n - 1, 3 * (2 * len(sections) + 1))
    long = np.concatenate([2 * x[:, :1] - x[:, k:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -k - 2 : -1]], axis=1)
    y = run_sections(run_sections(long, sections)[:, ::-1], sections)[:, ::-1]
    return y[:, k : k + n]


def pass_filter(patch: Patch, dim: str, low: float | None = None, high: float | None = None, corners: int = 4, zerophase: bool = True) -> Patch:
    """Butterworth band, high or low pass; bounds in cycles per unit of dim."""
    coord = patch.coords[dim]
    nyquist = 0.5 / abs(coord.step)
    for f in (low, high):
        if f is not None and not 0 < f < nyquist:
            raise ParameterError(f"{f} isn't between 0 and {nyquist}")
    sections = butterworth(corners, low and low / nyquist, high and high / nyquist)
    f = (lambda x: zero_phase(x, sections)) if zerophase else (lambda x: run_sections(x, sections, False))
    return per_trace(patch, dim, f, coord.n, coord, "pass filter")


def analytic(x: np.ndarray) -> np.ndarray:
    n = x.shape[-1]
    weights = np.zeros(n)
    weights[0] = 1
    weights[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        weights[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x) * weights)


def envelope(patch: Patch, dim: str) -> Patch:
    coord = patch.coords[dim]
    return per_trace(patch, dim, lambda x: np.abs(analytic(x)), coord.n, coord, "envelope")


def hilbert(patch: Patch, dim: str) -> Patch:
    """The imaginary part of the analytic signal; its real part is the patch."""
    coord = patch.coords[dim]
    return per_trace(patch, dim, lambda x: analytic(x).imag, coord.n, coord, "hilbert")


def resample(patch: Patch, dim: str, n: int) -> Patch:
    """n samples over the same extent, by cutting or filling up the transform."""
    coord = patch.coords[dim]

    def f(x: np.ndarray) -> np.ndarray:
        spectrum, old = np.fft.rfft(x), x.shape[1]
        m = min(old, n)
        out = np.zeros((len(x), n // 2 + 1), complex)
        out[:, : m // 2 + 1] = spectrum[:, : m // 2 + 1]
        if m % 2 == 0 and n != old:
            out[:, m // 2] *= 2 if n < old else 0.5
        return np.fft.irfft(out, n) * (n / old)

    return per_trace(patch, dim, f, n, Coord(n, coord.start, coord.step * coord.n / n), "resample")


def whiten(patch: Patch, dim: str, smooth: float | None = None, water_level: float | None = None, band: tuple[float, ...] | None = None) -> Patch:
    """Phases kept, amplitudes 1, or over their mean in `smooth` (a width in frequency, around the circle of the half spectrum).

    water_level: means below this share of the trace's largest count as that.  band: two frequencies, or four with cosine
    ramps between the outer pairs; the rest goes.  Transforms are padded to a fast length.
    """
    from fiberlake.operators.complexes import fast_length

    coord = patch.coords[dim]
    n = fast_length(coord.n)
    step = 1 / (n * abs(float(coord.step)))
    freq = np.arange(n // 2 + 1) * step
    if water_level is not None and not 0 <= water_level <= 1:
        raise ParameterError("the water level is between 0 and 1")
    if smooth is not None and not 0 < smooth < freq[-1]:
        raise ParameterError("the smoothing width is positive and below half the sampling rate")
    mask = np.ones(len(freq))
    if band is not None:
        if len(band) not in (2, 4) or any(b - a < 2 * step for a, b in zip(band, band[1:])):
            raise ParameterError("the band is two or four frequencies, two steps apart at least")
        low, high = band[0], band[-1]
        mask[(freq < low) | (freq > high)] = 0
        if len(band) == 4:
            up, down = (freq >= low) & (freq < band[1]), (freq > band[2]) & (freq <= high)
            mask[up] = 0.5 - 0.5 * np.cos(np.pi * (freq[up] - low) / (band[1] - low))
            mask[down] = 0.5 - 0.5 * np.cos(np.pi * (high - freq[down]) / (high - band[2]))
    width = 0 if smooth is None else math.ceil(round(smooth / step, 10))

    def f(x: np.ndarray) -> np.ndarray:
        s = np.fft.rfft(x, n)
        amp = np.ones(s.shape)
        if width:
            size = np.abs(s)
            before = width // 2
            ring = np.pad(size, ((0, 0), (before, width - 1 - before)), mode="wrap")
            mean = np.lib.stride_tricks.sliding_window_view(ring, width, axis=1).mean(axis=2)
            if water_level is not None:
                mean = np.maximum(mean, water_level * mean.max(axis=1, keepdims=True))
            amp = np.divide(size, mean, out=np.zeros_like(size), where=mean > 0)
        return np.fft.irfft(amp * mask * np.exp(1j * np.angle(s)), n)[:, : coord.n]

    return per_trace(patch, dim, f, coord.n, coord, "whiten")


def chebyshev(corners: int, ripple: float, high: float) -> list[np.ndarray]:
    """Second-order sections of a low pass of Chebyshev's first kind; ripple in decibels, the bound as a share of Nyquist."""
    mu = math.asinh(1 / math.sqrt(10 ** (0.1 * ripple) - 1)) / corners
    theta = np.pi * np.arange(1 - corners, corners, 2) / (2 * corners)
    poles = -np.sinh(mu + 1j * theta)
    gain = np.prod(-poles).real / (1 if corners % 2 else math.sqrt(10 ** (0.1 * ripple)))
    wc = 4 * math.tan(math.pi * high / 2)
    poles, gain = poles * wc, gain * wc**corners
    gain *= np.real(1 / np.prod(4 - poles))
    poles = (4 + poles) / (4 - poles)
    sections = []
    upper = sorted((p for p in poles if p.imag > 1e-12), key=abs)
    real = [p.real for p in poles if abs(p.imag) <= 1e-12]
    for i, a in enumerate([*(np.array([1, -2 * p.real, abs(p) ** 2]) for p in upper), *(np.array([1, -p, 0.0]) for p in real)]):
        b = np.array([1.0, 2.0, 1.0]) if a[2] else np.array([1.0, 1.0, 0.0])
        sections.append(np.concatenate([b * (gain if i == 0 else 1), a]))
    return sections


def decimate(patch: Patch, dim: str, factor: int, kind: str | None = "iir") -> Patch:
    """Every factor-th sample, after a low pass without phase shift.

    iir: Chebyshev's first kind, order 8, 0.05 dB, at 0.8 of the new half rate; fir: 20 * factor + 1 weights of a Hamming
    window; None: no filter.
    """
    from fiberlake.operators import windows

    coord = patch.coords[dim]
    if kind is None:
        return windows.decimate(patch, dim, factor)
    if kind == "iir":
        sections = chebyshev(8, 0.05, 0.8 / factor)
        f = lambda x: zero_phase(x, sections)[:, ::factor]
    elif kind == "fir":
        half = 10 * factor
        k = np.arange(-half, half + 1)
        weights = np.sinc(k / factor) * (0.54 + 0.46 * np.cos(np.pi * k / half))
        weights /= weights.sum()
        f = lambda x: np.stack([np.convolve(r, weights)[half : half + len(r)] for r in x])[:, ::factor]
    else:
        raise ParameterError(f"{kind} is neither iir, fir nor None")
    n = -(-coord.n // factor)
    return per_trace(patch, dim, f, n, Coord(n, coord.start, coord.step * factor, coord.units), f"decimate, {kind}")


def band_energy(patch: Patch, dim: str, low: float | None, high: float | None, window: float, step: int = 1, db: bool = True) -> Patch:
    """Root mean square of a band in trailing windows; db: 20 times its logarithm."""
    from fiberlake.operators import windows

    band = pass_filter(patch, dim, low, high)
    out = windows.rolling(band.map_value(lambda v: v * v, "square"), dim, window, "mean", step)
    size = F.sqrt("value")
    return out.with_value(F.when(size > 0, 20 * F.log10(size)) if db else size, "frequency band energy")


def recursive_kurtosis(patch: Patch, dim: str, width: float, samples: bool = False) -> Patch:
    """Kurtosis by exponential means of memory `width`; a variance below that of the whole trace counts as that."""
    coord = patch.coords[dim]
    keep = 1 - 1 / coord.samples_in(width, samples)

    def f(x: np.ndarray) -> np.ndarray:
        out, floor = np.empty(x.shape), x.var(axis=1)
        mean = var = kurt = np.zeros(len(x))
        for i, v in enumerate(x.T):
            mean = keep * mean + (1 - keep) * v
            gap = (v - mean) ** 2
            var = keep * var + (1 - keep) * gap
            scale = np.maximum(var, floor) ** 2
            with np.errstate(divide="ignore", invalid="ignore"):
                kurt = np.where(scale > 0, keep * kurt + (1 - keep) * gap**2 / scale, np.nan)
            out[:, i] = kurt
        return out

    return per_trace(patch, dim, f, coord.n, coord, "recursive kurtosis")


def notch(patch: Patch, dim: str, frequency: float, q: float = 30.0) -> Patch:
    """Takes one frequency out, without phase shift; q is frequency over bandwidth."""
    coord = patch.coords[dim]
    if not 0 < frequency < 0.5 / abs(coord.step):
        raise ParameterError(f"{frequency} isn't between 0 and half the sampling rate")
    w = 2 * math.pi * frequency * abs(coord.step)
    gain = 1 / (1 + math.tan(w / q / 2))
    section = np.array([gain, -2 * gain * math.cos(w), gain, 1, -2 * gain * math.cos(w), 2 * gain - 1])
    return per_trace(patch, dim, lambda x: zero_phase(x, [section]), coord.n, coord, "notch filter")


def phase_weighted_stack(patch: Patch, stack_dim: str, dim: str, power: float = 2.0) -> Patch:
    """Mean over stack_dim, times the modulus of the mean unit phasor to the given power."""
    coord, n = patch.coords[dim], patch.coords[dim].n
    both = per_trace(patch, dim, lambda x: np.concatenate([x, np.angle(analytic(x))], axis=1), 2 * n, Coord(2 * n, 0.0, 1.0), "phase")
    data, at = F.col(f"{dim}_idx") < n, F.pmod(F.col(f"{dim}_idx"), F.lit(n))
    rest = [c for d in patch.others(stack_dim, dim) for c in (d, f"{d}_idx")]
    mean = F.avg(F.when(data, F.col("value")))
    c, s = (F.avg(F.when(~data, f("value"))) for f in (F.cos, F.sin))
    df = both.df.groupBy(*rest, at.alias("at")).agg((mean * F.pow(F.sqrt(c * c + s * s), F.lit(power))).alias("value"))
    df = df.withColumnRenamed("at", f"{dim}_idx").withColumn(dim, F.lit(coord.start) + F.col(f"{dim}_idx") * F.lit(coord.step))
    out = patch.new(dims=tuple(patch.others(stack_dim)), coords={k: v for k, v in patch.coords.items() if k != stack_dim})
    return out.new(df.select(*out.keys, "value"), "phase-weighted stack")
