"""Coordinates beside dimensions, symbolic coordinates, and spools as objects, on small tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fiberlake.errors import ChunkError, CoordError, ParameterError, PatchDimError
from fiberlake.functions import times
from fiberlake.operators import aggregating, coordinates, selecting, spool, windows
from fiberlake.patch import Coord
from test_patch import array, make


@pytest.fixture(scope="module")
def patch(spark):
    return make(spark, np.arange(12.0).reshape(3, 4))


def test_symbolic_coordinates():
    c = Coord(10, 100.0, 0.5)
    assert (c.coord_range(), c.coord_range(extend=False), c.stop) == (5.0, 4.5, 104.5)
    assert c.update_limits(min=0) == Coord(10, 0, 0.5) and c.update_limits(max=10).start == 5.5
    assert c.update_limits(min=0, max=10) == Coord(10, 0, 1.0) and c.update_limits(step=2) == Coord(10, 100.0, 2)
    assert c.sort(reverse=True) == Coord(10, 104.5, -0.5) and c.sort() == c and c.change_length(3).stop == 101.0
    assert c.next_index(100.2) == 1 and c.next_index(99, allow_out=True) == 0 and c.approx_equal(Coord(10, 100.0 + 1e-10, 0.5))
    assert c.summary() == {"min": 100.0, "max": 104.5, "step": 0.5, "units": "", "n": 10}
    with pytest.raises(CoordError):
        c.next_index(200)
    with pytest.raises(ParameterError):
        c.update_limits(1, 2, 3)
    assert coordinates.infer(np.arange(5) * 2.0) == Coord(5, 0.0, 2.0) and not coordinates.infer(np.array([0, 1, 5])).even


def test_coordinates_follow_their_labels(patch):
    p = coordinates.update_coords(patch, depth=("time", [5.0, 3.0, 4.0, 1.0]), _own=("distance", [1, 2, 3]), shot=(None, [7]))
    assert [r.depth for r in coordinates.get_array(selecting.select(p, "time", 1, 2), "depth").collect()] == [3.0, 4.0]
    assert array(coordinates.select_by(p, "depth", 3.5, 10)).tolist() == [0, 2, 4, 6, 8, 10]
    assert array(coordinates.sort_by(p, "depth")).tolist() == [3, 1, 2, 0, 7, 5, 6, 4, 11, 9, 10, 8]
    assert array(coordinates.sort_by(p, "depth", reverse=True)).tolist()[:4] == [0, 2, 1, 3]
    assert coordinates.get_array(p, "shot").collect()[0].shot == 7 and coordinates.get_axis(p, "time") == 1
    assert "_own" not in coordinates.drop_private_coords(p).aux and "depth" not in coordinates.update_coords(p, depth=None).aux
    turned = coordinates.set_dims(p, time="depth")
    assert turned.dims == ("distance", "depth") and [r.time for r in coordinates.get_array(turned, "time").collect()] == [0, 1, 2, 3]
    reduced = aggregating.aggregate(p, "time", "sum")
    with pytest.raises(CoordError):
        coordinates.get_array(reduced, "depth")
    with pytest.raises(PatchDimError):
        coordinates.drop_coords(p, "time")
    with pytest.raises(CoordError):
        coordinates.update_coords(p, bad=("time", [1]))
    with pytest.raises(CoordError):
        coordinates.get_coord(p, "depth", even_needed=True)


def test_points_and_distances(patch):
    table = pd.DataFrame({"distance": [0.0, 2.0], "x": [0.0, 4.0], "y": [1.0, 1.0]})
    p = coordinates.coords_from_points(patch, "distance", table)
    assert [r.x for r in coordinates.get_array(p, "x").collect()] == [0.0, 2.0, 4.0]
    for order, want in ((2, [5**0.5, 1.0, 5**0.5]), (1, [3.0, 1.0, 3.0]), (float("inf"), [2.0, 1.0, 2.0])):
        q = coordinates.add_distance_to(p, {"x": 2.0, "y": 0.0}, order)
        assert np.allclose([r.origin_distance for r in coordinates.get_array(q, "origin_distance").collect()], want)


def test_attributes_equality_and_functions(spark, patch, data=None):
    assert coordinates.equals(patch, make(spark, np.arange(12.0).reshape(3, 4))) and not coordinates.equals(patch, make(spark, np.ones((3, 4))))
    near = patch.map_value(lambda v: v + 1e-10, "near")
    assert coordinates.equals(patch, near, close=True) and not coordinates.equals(patch, near)
    moved = coordinates.update_attrs(patch, time_min=10, tag="x")
    assert moved.coords["time"].start == 10 and moved.attrs["tag"] == "x" and moved.df.agg(F.max("time")).first()[0] == 13
    one = selecting.select(selecting.select(patch, "time", 1, 1), "distance", 0, 0)
    assert coordinates.truth(one)
    with pytest.raises(ParameterError):
        coordinates.truth(patch)

    @coordinates.required(dims=("time",), attrs=("tag",))
    def double(p):
        return p.map_value(lambda v: v * 2, "double")

    assert double(moved).history[-1] == "double"
    with pytest.raises(ParameterError):
        double(patch)


def test_functions_as_aggregations(patch):
    data = np.arange(12.0).reshape(3, 4)
    assert np.allclose(array(aggregating.aggregate(patch, "time", lambda x: np.median(x, axis=1))), np.median(data, axis=1))
    assert np.allclose(array(aggregating.reduce(patch, "distance", "multiply")), data.prod(axis=0))
    assert np.allclose(array(aggregating.percentile(patch, "time", 25)), np.percentile(data, 25, axis=1))
    got = array(windows.rolling_apply(patch, "time", 2, lambda w: w.sum(axis=1)))
    assert np.isnan(got[0]) and got[1] == 1.0
    kept = aggregating.aggregate(patch, "time", "max", keep="min")
    assert kept.dims == patch.dims and [r.time for r in kept.df.collect()] == [0.0] * 3


def test_spool(spark, tmp_path):
    rows = [(f"p{i}", "a" if i < 3 else "b", f"t{i % 2}", i * 10, i * 10 + 9, 1) for i in range(6)]
    catalog = spark.createDataFrame(rows, "patch_id string, station string, tag string, time_min long, time_max long, time_step long")
    cells = spark.createDataFrame([(f"p{i}", i * 10 + t, float(t)) for i in range(6) for t in range(10)], "patch_id string, time long, value double")
    s = spool.Spool(catalog, cells=cells)
    ids = lambda x: [r.patch_id for r in x.contents().orderBy("place").collect()]
    assert ids(s[1:4]) == ["p1", "p2", "p3"] and ids(s[-1]) == ["p5"] and ids(s[[0, 5]]) == ["p0", "p5"] and ids(s[::-2]) == ["p1", "p3", "p5"]
    assert len(s) == 6 and s[2].cells.count() == 10 and ids(s.sort("station")[0]) == ["p0"]
    cut = s.select(time=(5, 12))
    assert cut.cells.count() == 8 and ids(cut) == ["p0", "p1"]
    sums = s.map(lambda x: x.groupby("patch_id", as_index=False).agg(total=("value", "sum")), "patch_id string, total double")
    assert {r.total for r in sums.collect()} == {45.0}
    assert s.equals(spool.Spool(catalog.orderBy(F.desc("time_min")))) and not s.equals(s[:3])
    spool.write_spool(s[:3], str(tmp_path / "s"))
    spool.write_spool(s[3:], str(tmp_path / "s"))
    assert spool.spool(str(tmp_path / "s"), spark).equals(s) and spool.spool(s) is s
    big = spool.numbered(spark.range(1000).select(F.xxhash64("id").alias("k")), ["k"], "place", rows=90)
    assert [r.place for r in big.orderBy("k").collect()] == list(range(1000))
    with pytest.raises(ChunkError):
        spool.combine_attrs(catalog, ["station"], ["tag"], "time_min", "raise")


def test_whole_patches_are_cut_at_patches_only():
    rows = pd.DataFrame({"patch_id": list("aabbbbbbbcdd"), "value": np.arange(12.0)})
    for size in range(1, 14):
        frames = [f for i in range(0, 12, size) for f in (rows.iloc[i : i + size], rows.iloc[:0])]
        got = list(spool.whole_patches(iter(frames)))
        assert pd.concat(got, ignore_index=True).equals(rows) and all(g.index[0] == 0 for g in got)
        assert sum(g["patch_id"].nunique() for g in got) == 4
    assert list(spool.whole_patches(iter([]))) == [] and list(spool.whole_patches(iter([rows.iloc[:0]]))) == []


@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_many_patches_in_a_call(spark, threshold):
    catalog = spark.range(200).where("id != 7").selectExpr("concat('p', id) AS patch_id")
    cells = spark.range(3000).selectExpr("concat('p', id * id % 200) AS patch_id", "id AS time", "IF(id % 5 = 0, NULL, id / 7) AS value").repartition(5)
    cells = cells.unionAll(cells.where("patch_id = 'p1'").withColumn("time", F.explode(F.sequence(F.lit(0), F.lit(9)))))  # longer than a batch
    s = spool.Spool(catalog, cells=cells)

    def summed(x):
        patches = x["patch_id"].nunique()
        return x.groupby("patch_id", as_index=False).agg(most=("value", "max"), n=("time", "size"), low=("time", "min")).assign(patches=patches)

    schema = "patch_id string, n long, low long, most double, patches long"
    conf = {"spark.sql.autoBroadcastJoinThreshold": threshold, "spark.sql.execution.arrow.maxRecordsPerBatch": "70"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        one, many = (s.map(summed, schema, **options).toPandas().sort_values("patch_id", ignore_index=True) for options in ({}, {"many": True}))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert many.drop(columns="patches").equals(one.drop(columns="patches")) and many["n"].max() > 140
    assert set(one["patches"]) == {1} and many["patches"].max() > 1


def test_spool_map_makes_no_call_for_each_patch(spark):
    from fiberlake.plans.registry import QUERIES

    plan = QUERIES["spool_map"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "FlatMapGroupsInPandas" not in plan


def test_spans_and_ranges_of_time(spark):
    df = spark.createDataFrame([("10 seconds", 0), ("-2 minute", 0), ("3 months", 0), ("x", 0), (None, 0)], "s string, i int")
    assert [r.n for r in df.select(times.span_to_ns("s").alias("n")).collect()] == [10**10, -120 * 10**9, None, None, None]
    assert times.min_max_times((None, 5)) == (times.EARLIEST, 5) and times.is_time(df.selectExpr("current_timestamp() AS t"), "t") and not times.is_span(df, "s")
    with pytest.raises(ValueError):
        times.min_max_times((6, 5))
