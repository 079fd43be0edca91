"""Every registered query of the core against its SQL."""

import pytest

from fiberlake.plans.registry import ORACLES, QUERIES

from compare import differences, views

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return views(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, name):
    assert differences(spark, con, QUERIES[name], ORACLES[name], SF) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_points_without_the_corpus_operators():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_dispersion_of_all_traces(spark):
    import numpy as np

    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    z = np.fft.fft(np.array([r.embedding for r in rows], float))
    z /= np.abs(z)
    f = np.arange(64) / 63
    f, z = f[(f >= 0.1) & (f < 0.4)], z[:, (f >= 0.1) & (f < 0.4)]
    want = {(v, round(x, 6)): abs((z[:, i] * np.exp(2j * np.pi * x * np.arange(len(rows)) / v)).mean()) for v in (1.0, 2.0, 5.0) for i, x in enumerate(f)}
    got = {(r.velocity, round(r.frequency, 6)): r.value for r in QUERIES["dispersion"](spark, SF).collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 2e-6
