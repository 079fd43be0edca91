"""Operators on small patches against numpy and closed forms."""

import numpy as np
import pytest

from fiberlake.errors import ChunkError, CoordError, ParameterError
from fiberlake.functions import units
from fiberlake.operators import aggregating, complexes, kernels, selecting, shaping, spectral, spool, windows
from fiberlake.patch import Coord, Patch


def make(spark, data):
    rows = [(x, x, t, t, None if np.isnan(v) else float(v)) for x, r in enumerate(data) for t, v in enumerate(r)]
    df = spark.createDataFrame(rows, "distance long, distance_idx long, time long, time_idx long, value double")
    return Patch.from_cells(df, ("distance", "time"), {"distance": Coord(len(data)), "time": Coord(len(data[0]))})


def array(patch):
    rows = patch.df.orderBy(*(f"{d}_idx" for d in patch.dims)).collect()
    return np.array([np.nan if r.value is None else r.value for r in rows])


@pytest.fixture(scope="module")
def data():
    return np.random.default_rng(0).normal(size=(3, 40))


def test_index_ranges():
    c = Coord(10, 100.0, 0.5)
    assert c.index_range(101, 102) == (2, 4)
    assert c.index_range(102, 101) == (2, 4)
    assert c.index_range(-1, None, samples=True) == (9, 9)
    assert c.index_range(1, -1, relative=True) == (2, 7)
    with pytest.raises(CoordError):
        Coord(3, 0, None).index_range(0, 1)
    with pytest.raises(ParameterError):
        c.samples_in(100)


def test_nan_becomes_null(spark):
    p = make(spark, np.array([[1.0, np.nan, 3.0]]))
    assert array(aggregating.aggregate(p, "time", "sum")).tolist() == [4.0]
    assert array(aggregating.aggregate(p, "time", "last")).tolist() == [3.0]


def test_median_filter_and_hampel(spark, data):
    p = make(spark, data)
    padded = np.pad(data, ((0, 0), (2, 2)), mode="symmetric")
    view = np.lib.stride_tricks.sliding_window_view(padded, 5, axis=1)
    want = np.median(view, axis=2)
    assert np.allclose(array(kernels.median(p, "time", 5)), want.ravel())
    around = lambda x, shape: np.median(np.lib.stride_tricks.sliding_window_view(np.pad(x, [(k // 2, k // 2) for k in shape], mode="symmetric"), shape), axis=(2, 3))
    for widths, exact in (({"time": 5}, False), ({"time": 5, "distance": 3}, False), ({"time": 5, "distance": 3}, True)):
        box = (widths.get("distance", 1), widths["time"])
        medians = (lambda x: around(x, box)) if exact else (lambda x: around(around(x, (1, box[1])), (box[0], 1)))
        m = medians(data)
        mad = medians(np.abs(data - m))
        clean = np.where(np.abs(data - m) / np.where(mad == 0, np.finfo(float).eps, mad) > 1.5, m, data)
        assert np.allclose(array(kernels.hampel(p, widths, 1.5, approximate=not exact)), clean.ravel())


def test_nearest_border(spark, data):
    out = array(kernels.moving(make(spark, data), "time", 5, "mean", mode="nearest"))
    view = np.lib.stride_tricks.sliding_window_view(np.pad(data, ((0, 0), (2, 2)), mode="edge"), 5, axis=1)
    assert np.allclose(out, view.mean(axis=2).ravel())


def test_gradient(spark, data):
    assert np.allclose(array(windows.differentiate(make(spark, data), "time")), np.gradient(data, axis=1, edge_order=2).ravel())


def test_butterworth_halves_power_at_the_corners():
    for low, high in ((None, 0.3), (0.3, None), (0.2, 0.5)):
        sections = spectral.butterworth(4, low, high)
        for f in (low, high):
            if f:
                z = np.exp(1j * np.pi * f)
                h = np.prod([np.polyval(s[:3], z) / np.polyval(s[3:], z) for s in sections])
                assert abs(abs(h) - 0.5**0.5) < 1e-9


def test_pass_filter_keeps_its_band(spark):
    t = np.arange(400)
    slow, fast = np.sin(2 * np.pi * 0.02 * t), np.sin(2 * np.pi * 0.3 * t)
    out = array(spectral.pass_filter(make(spark, np.array([slow + fast])), "time", high=0.1))
    assert np.abs(out - slow)[50:-50].max() < 0.01


def test_recursive_filters_of_decimation():
    f = np.array([0.0, 0.1, 0.2, 0.4, 0.9])
    for sections in (spectral.chebyshev(8, 0.05, 0.2), spectral.chebyshev(5, 0.5, 0.2)):
        z = np.exp(1j * np.pi * f)
        h = np.abs(np.prod([np.polyval(s[:3], z) / np.polyval(s[3:], z) for s in sections], axis=0))
        ripple = 10 ** (-0.05 / 20) if len(sections) == 4 else 10 ** (-0.5 / 20)
        assert (h[:2] <= 1 + 1e-9).all() and (h[:2] >= ripple - 1e-9).all() and abs(h[2] - ripple) < 1e-9 and (h[3:] < 0.02).all()


def test_decimation_whitening_and_energy(spark):
    t = np.arange(400)
    slow, fast = np.sin(2 * np.pi * 0.01 * t), np.sin(2 * np.pi * 0.4 * t)
    p = make(spark, np.array([slow + fast]))
    for kind in ("iir", "fir"):
        out = array(spectral.decimate(p, "time", 4, kind))
        assert np.abs(out - slow[::4])[20:-20].max() < 0.02
    assert np.allclose(array(spectral.decimate(p, "time", 4, None)), (slow + fast)[::4])
    white = np.abs(np.fft.rfft(array(spectral.whiten(p, "time"))))
    assert np.allclose(white, 1)
    band = np.abs(np.fft.rfft(array(spectral.whiten(p, "time", band=(0.1, 0.3)))))
    f = np.arange(201) / 400
    assert np.allclose(band, (f >= 0.1) & (f <= 0.3), atol=1e-9)
    energy = array(spectral.band_energy(p, "time", None, 0.1, 100, db=False))
    assert np.isnan(energy[:99]).all() and abs(energy[250] - 0.5**0.5) < 0.01


def test_recursive_kurtosis(spark, data):
    got = array(spectral.recursive_kurtosis(make(spark, data), "time", 8)).reshape(data.shape)
    for row, out in zip(data, got):
        c, mean, var, kurt = 1 - 1 / 8, 0.0, 0.0, 0.0
        for x, y in zip(row, out):
            mean = c * mean + (1 - c) * x
            var = c * var + (1 - c) * (x - mean) ** 2
            kurt = c * kurt + (1 - c) * (x - mean) ** 4 / max(var, row.var()) ** 2
            assert abs(kurt - y) < 1e-9


def test_windows_of_tapers():
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    s = SparkSession.getActiveSession()
    for kind, want in (("hamming", np.hamming(9)), ("blackman", np.blackman(9)), ("hann", np.hanning(9)), ("bartlett", np.bartlett(9)), ("boxcar", np.ones(9))):
        assert np.allclose([r.w for r in s.range(9).select(kernels.window_value(kind, F.col("id"), 9).alias("w")).collect()], want)
    for kind in ("barthann", "bohman", "parzen", "nuttall", "blackmanharris", "triang", "ramp", "cos"):
        w = [r.w for r in s.range(9).select(kernels.window_value(kind, F.col("id"), 9).alias("w")).collect()]
        assert np.allclose(w, w[::-1]) and abs(w[4] - 1) < 1e-6 and w[0] < 0.25 and all(a <= b for a, b in zip(w, w[1:5]))


def test_envelope_and_resample(spark):
    t = np.arange(64)
    wave = np.cos(2 * np.pi * 4 * t / 64)
    assert np.allclose(array(spectral.envelope(make(spark, np.array([2 * wave])), "time")), 2)
    assert np.allclose(array(spectral.resample(make(spark, np.array([wave])), "time", 128))[::2], wave)


def test_snap(spark):
    df = spark.createDataFrame([(0, 0, 5, 0, 1.0), (0, 0, 1, 1, 2.0), (0, 0, 2, 2, 3.0)], "distance long, distance_idx long, time long, time_idx long, value double")
    out = selecting.snap(Patch(df, ("distance", "time"), {"distance": Coord(1), "time": Coord(3, 0, None)}), "time")
    assert [(r.time, r.value) for r in out.df.orderBy("time_idx").collect()] == [(1.0, 2.0), (3.0, 3.0), (5.0, 1.0)]


def test_chunk_errors(spark):
    df = spark.createDataFrame([("a", 0, 9, 1)], "station string, time_min long, time_max long, time_step long")
    with pytest.raises(ChunkError):
        spool.chunk(df, "time", ["station"], overlap=3)
    with pytest.raises(ChunkError):
        spool.chunk(df, "time", ["station"], length=3, overlap=3)
    assert spool.chunk(df, "time", ["station"], length=5).count() == 2


def test_glob():
    assert spool.glob_pattern("sta_[!a]?*.x") == r"(?s)^sta_[^a]..*\.x$"


def test_notch_takes_one_frequency(spark):
    t = np.arange(400)
    keep, gone = np.sin(2 * np.pi * 0.02 * t), np.sin(2 * np.pi * 0.2 * t)
    out = array(spectral.notch(make(spark, np.array([keep + gone])), "time", 0.2, q=5))
    assert np.abs(out - keep)[60:-60].max() < 0.03


def test_phase_weighted_stack(spark):
    wave = np.cos(2 * np.pi * 4 * np.arange(64) / 64)
    assert np.allclose(array(spectral.phase_weighted_stack(make(spark, np.array([wave, 3 * wave])), "distance", "time")), 2 * wave)
    assert np.allclose(array(spectral.phase_weighted_stack(make(spark, np.array([wave, -wave])), "distance", "time")), 0)


def test_wiener(spark, data):
    out = array(shaping.wiener(make(spark, data), "time", 5, noise=1.0)).reshape(data.shape)
    view = np.lib.stride_tricks.sliding_window_view(np.pad(data, ((0, 0), (2, 2))), 5, axis=1)
    m, v = view.mean(axis=2), view.var(axis=2)
    assert np.allclose(out, np.where(v < 1, m, m + (data - m) * (1 - 1 / v)))


def test_units():
    assert units.conversion("km", "m") == (1000.0, 0.0)
    assert units.conversion("degC", "K") == (1.0, 273.15)
    assert np.allclose(units.conversion("degF", "degC"), (5 / 9, -160 / 9))
    for wrong in (("m", "s"), ("m", "cubit")):
        with pytest.raises(ParameterError):
            units.conversion(*wrong)


def test_dft_and_back(spark, data):
    p = make(spark, data)
    s = complexes.dft(p, "distance", "time", pad=False)
    want = np.fft.fftshift(np.fft.fft2(data))
    assert np.allclose(array(complexes.real(s)), want.real.ravel()) and np.allclose(array(complexes.imag(s)), want.imag.ravel())
    assert np.allclose(array(complexes.angle(s)), np.angle(want).ravel(), atol=1e-6)
    for half in (False, True):
        assert np.allclose(array(complexes.real(complexes.idft(complexes.dft(p, "distance", "time", half=half)))), data.ravel())
    assert complexes.fast_length(13) == 14 and complexes.fast_length(64) == 64
    assert np.isclose(array(complexes.power(complexes.dft(p, "time", pad=False), "PS")).sum(), (data**2).mean(axis=1).sum())


def test_short_time_transform(spark, data):
    p = make(spark, data)
    for width, overlap in ((8, 4), (9, 6), (8, 0)):
        window = None if overlap else (1.0,) * width
        s = complexes.stft(p, "time", width, overlap, window)
        assert np.allclose(array(complexes.istft(s, "time")), data.ravel())
    s = complexes.stft(p, "time", 8, 4)
    got = {(r.distance_idx, r.time, r.ft_time_idx): r.value + 1j * r.imag for r in s.df.collect()}
    want = np.fft.rfft(data[1, 12:20] * complexes.hann(8))
    assert np.allclose([got[1, 16.0, k] for k in range(5)], want)
    with pytest.raises(ParameterError):
        complexes.istft(complexes.stft(p, "time", 8, detrend=True), "time")


def test_slope_filter(spark):
    d, t = np.mgrid[0:20, 0:20]
    slow, fast = np.cos(2 * np.pi * (5 * d - 1 * t) / 20), np.cos(2 * np.pi * (1 * d - 5 * t) / 20)
    p = make(spark, slow + fast)
    assert np.allclose(array(complexes.slope_filter(p, (1, 2, 8, 9))), fast.ravel())
    assert np.allclose(array(complexes.slope_filter(p, (1, 2, 8, 9), invert=True)), slow.ravel())
    assert np.allclose(array(complexes.slope_filter(p, (1, 2, 8, 9), directional=True)), 0)


def test_tau_p_finds_the_slowness(spark):
    data = np.zeros((5, 40))
    data[np.arange(5), 10 + 3 * np.arange(5)] = 1
    out = complexes.tau_p(make(spark, data), [1 / 3, 1.0])
    best = out.df.orderBy("value", ascending=False).first()
    assert (best.slowness, best.time, best.value) == (3.0, 10, 5.0)
    with pytest.raises(CoordError):
        complexes.tau_p(out, [1.0], dims=("slowness", "time"))
    with pytest.raises(ParameterError):
        complexes.tau_p(make(spark, data), [2.0, 1.0])


def test_dispersion(spark, data):
    out = array(complexes.dispersion(make(spark, data), [1.0, 4.0], band=(0.1, 0.3)))
    f = np.arange(40) / 39
    live = (f >= 0.1) & (f < 0.3)
    z = np.fft.fft(data)[:, live]
    turn = np.arange(3)[:, None] * 2 * np.pi * f[live]
    want = [np.abs((z / np.abs(z) * np.exp(1j * turn / c)).sum(axis=0)) / 3 for c in (1.0, 4.0)]
    assert np.allclose(out, np.ravel(want))
