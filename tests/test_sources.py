"""Formats: round trips, and bytes made by hand."""

import struct

import numpy as np
import pytest

from fiberlake.errors import ParameterError, UnknownFormatError
from fiberlake.operators import selecting
from fiberlake.patch import Coord, Patch
from fiberlake.sources import formats

START = 1_700_000_000


@pytest.fixture(scope="module")
def data():
    return np.random.default_rng(1).normal(size=(3, 20)).astype("f4").astype(float)


@pytest.fixture(scope="module")
def patch(spark, data):
    rows = [(x, x, START + t * 0.004, t, float(v)) for x, r in enumerate(data) for t, v in enumerate(r)]
    df = spark.createDataFrame(rows, "distance long, distance_idx long, time double, time_idx long, value double")
    return Patch(df, ("distance", "time"), {"distance": Coord(3), "time": Coord(20, START, 0.004, "s")}, {"tag": "x"})


def values(patch):
    return np.array([r.value for r in patch.df.orderBy(*(f"{d}_idx" for d in patch.dims)).collect()])


def test_parquet(spark, patch, data, tmp_path):
    formats.write_patch(patch, str(tmp_path / "p"))
    back = formats.read_patch(spark, str(tmp_path / "p"))
    assert (back.dims, back.coords, back.attrs) == (patch.dims, patch.coords, patch.attrs)
    assert np.array_equal(values(back), data.ravel())
    part = formats.read_patch(spark, str(tmp_path / "p"), time=(START + 0.008, START + 0.02))
    assert np.array_equal(values(part), data[:, 2:6].ravel())
    assert "PushedFilters: [IsNotNull(time_idx)" in part.df._jdf.queryExecution().toString()


def test_segy(spark, patch, data, tmp_path):
    folder = tmp_path / "segy"
    (out,) = formats.write(formats.to_traces(patch, "a/one"), str(folder), "segy").collect()
    assert out.bytes == 3600 + 3 * (240 + 80)
    (folder / "junk.sgy").write_bytes(b"x" * 4000)
    (folder / "short").write_bytes(b"")
    (row,) = formats.scan(spark, str(folder)).collect()
    assert (row.format, row.version, row.channels, row.time_min, row.time_max, row.time_step) == ("segy", "1.0", 3, START * 10**6, START * 10**6 + 76_000, 4000.0)
    assert formats.scan(spark, str(folder), modified_after="2100-01-01T00:00:00").count() == 0
    back = formats.to_patch(formats.read(spark, str(folder), "*.segy"), row.file)
    assert np.array_equal(values(back), data.ravel())
    assert np.array_equal(values(selecting.select(back, "time", START + 0.008, START + 0.02)), data[:, 2:6].ravel())
    with pytest.raises(Exception, match="UnknownFormatError"):
        formats.read(spark, str(folder), "*.sgy").collect()


def test_segy_limits(data):
    with pytest.raises(ParameterError):
        formats.segy_bytes(np.zeros((1, 2**15)), 0, 1000.0)
    with pytest.raises(ParameterError):
        formats.segy_bytes(data, 0, 0.5)


def test_hexadecimal_floats():
    # -118.625 is the textbook case; 1 is a sixteenth of 16
    assert formats.hexadecimal_floats(bytes.fromhex("c276a0004110000000000000")).tolist() == [-118.625, 1.0, 0.0]


def test_rsf(patch, data, tmp_path):
    formats.write(formats.to_traces(patch, "one"), str(tmp_path), "rsf").collect()
    head, _, body = (tmp_path / "one.rsf").read_bytes().partition(b"\n\n")
    assert {b"n1=20", b"n2=3", b"d1=0.004", b"esize=4"} <= set(head.split(b"\n"))
    assert np.array_equal(np.frombuffer(body, "f4").reshape(3, 20), data)


def test_wav(patch, tmp_path):
    formats.write_wav(patch, str(tmp_path), "one").collect()
    b = (tmp_path / "one.wav").read_bytes()
    assert struct.unpack_from("<4sI4s", b) == (b"RIFF", len(b) - 8, b"WAVE")
    assert struct.unpack_from("<HHI", b, 20) == (3, 3, 250)
    x = np.frombuffer(b[44:], "<f4").reshape(20, 3)
    assert np.allclose(np.abs(x).max(axis=0), 1) and np.allclose((x * (np.arange(20) - 9.5)[:, None]).sum(axis=0), 0, atol=1e-4)
    assert formats.write_wav(patch, str(tmp_path), "each", separate=True).count() == 3


def test_unknown(patch, tmp_path):
    with pytest.raises(UnknownFormatError):
        formats.write(formats.to_traces(patch, "one"), str(tmp_path), "xyz")
    assert formats.get_format(b"") is None
