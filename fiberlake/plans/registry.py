"""Registered queries over the driver's tables and the SQL that gives the same rows.

Embeddings are read as a patch: distance is vec_id, time the place in the vector.  Events are read as a catalog of
recordings (one for each user and day), and as a stream.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fiberlake.functions import robust, times, units
from fiberlake.operators import aggregating, arithmetic, complexes, coordinates, kernels, selecting, shaping, spectral, spool, windows
from fiberlake.patch import Coord, Patch
from fiberlake.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
TIMES = 64  # the length of every vector in embeddings

_P = "p AS (SELECT vec_id AS distance, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS time, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"
_N = _P + ", n AS (SELECT distance, time, CASE WHEN value > 0.1 THEN NULL ELSE value END AS value FROM p)"


def register(name: str, f: Query, sql: str | None = None) -> None:
    QUERIES[name] = f
    if sql:
        ORACLES[name] = sql


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of embeddings; the scan reads two columns."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    out = e.select(F.col("vec_id").alias("distance"), F.posexplode(F.col("embedding").cast("array<double>")).alias("time_idx", "value"))
    return out.select("distance", F.col("distance").alias("distance_idx"), F.col("time_idx").cast("long").alias("time"), F.col("time_idx").cast("long").alias("time_idx"), "value")


def patch(spark: SparkSession, sf_dir: str, nulls: bool = False) -> Patch:
    """vec_ids run from 0 without gaps, so the count of rows (metadata of the file) is the length of distance."""
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    df = cells(spark, sf_dir)
    if nulls:
        df = df.withColumn("value", F.when(F.col("value") <= 0.1, F.col("value")))
    return Patch(df, ("distance", "time"), {"distance": Coord(n, 0, 1, "m"), "time": Coord(TIMES, 0, 1, "s")})


def rounded(out: Patch, digits: int = 6) -> DataFrame:
    return out.df.select(*(F.col(d) for d in out.dims), (F.round("value", digits) + F.lit(0.0)).alias("value"))


def on_patch(name: str, f: Callable[[Patch], Patch], sql: str | None = None, nulls: bool = False, digits: int = 6) -> None:
    """sql: a select over p (or n, with nulls) of the dimensions and x, the value before it is rounded."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(f(patch(spark, sf_dir, nulls)), digits)

    oracle = sql and f"WITH {_N if nulls else _P}, r AS ({sql}) SELECT * EXCLUDE (x), round(CAST(x AS DOUBLE), {digits}) + 0.0 AS value FROM r"
    register(name, run, oracle)


# selection and shape
on_patch("select_range", lambda p: selecting.select(p, "time", 8, 55), "SELECT distance, time, value AS x FROM p WHERE time BETWEEN 8 AND 55")
on_patch("select_open", lambda p: selecting.select(p, "time", None, 20), "SELECT distance, time, value AS x FROM p WHERE time <= 20")
on_patch("select_relative", lambda p: selecting.select(p, "time", 10, -10, relative=True), "SELECT distance, time, value AS x FROM p WHERE time BETWEEN 10 AND 53")
on_patch("select_samples", lambda p: selecting.select(p, "time", -5, None, samples=True), "SELECT distance, time, value AS x FROM p WHERE time >= 59")
on_patch("select_isin", lambda p: selecting.isin(p, "distance", [1, 5, 9, 400]), "SELECT distance, time, value AS x FROM p WHERE distance IN (1, 5, 9, 400)")
register("order_values", lambda s, d: (q := selecting.order(patch(s, d), "time", [5, 2, 2, 60])).df.select("distance", F.col("time_idx").alias("place"), "time", F.round("value", 6).alias("value")), f"WITH {_P}, o AS (SELECT unnest([5, 2, 2, 60]) AS t, unnest([0, 1, 2, 3]) AS place) SELECT distance, CAST(place AS BIGINT) AS place, time, round(value, 6) AS value FROM p JOIN o ON time = t")
on_patch("where_cond", lambda p: selecting.where(p, F.col("value") > 0, 0.0), "SELECT distance, time, CASE WHEN value > 0 THEN value ELSE 0 END AS x FROM p")
on_patch("full", lambda p: selecting.full(p, 2.5), "SELECT distance, time, 2.5 AS x FROM p")
on_patch("fillna", lambda p: selecting.fillna(p, -1.0), "SELECT distance, time, coalesce(value, -1) AS x FROM n", nulls=True)
on_patch("dropna_any", lambda p: selecting.dropna(p, "distance", "any"), "SELECT distance, time, value AS x FROM n WHERE distance IN (SELECT distance FROM n GROUP BY 1 HAVING count(value) = count(*))", nulls=True)
on_patch("dropna_all", lambda p: selecting.dropna(p, "distance", "all"), "SELECT distance, time, value AS x FROM n WHERE distance IN (SELECT distance FROM n GROUP BY 1 HAVING count(value) > 0)", nulls=True)
register("flip", lambda s, d: selecting.flip(patch(s, d), "time").df.select("distance", "time_idx", "time", F.round("value", 6).alias("value")), f"WITH {_P} SELECT distance, 63 - time AS time_idx, time, round(value, 6) AS value FROM p")
on_patch("roll", lambda p: selecting.roll(p, "time", 5), "SELECT distance, (time + 5) % 64 AS time, value AS x FROM p")
on_patch("pad_const", lambda p: selecting.pad(p, "time", 2, 3, 1.0), "SELECT distance, time, value AS x FROM p UNION ALL SELECT DISTINCT distance, t, 1.0 FROM p, (SELECT CAST(unnest([-2, -1, 64, 65, 66]) AS BIGINT) AS t)")
on_patch("append_dim", lambda p: selecting.append_dim(p, "shot", [7, 8]), "SELECT distance, time, CAST(s AS INTEGER) AS shot, value AS x FROM p, (SELECT unnest([7, 8]) AS s)")
register("sort_coord", lambda s, d: selecting.sort_coord(patch(s, d), "time", reverse=True).df.select("distance", "time", "time_idx", F.round("value", 6).alias("value")), f"WITH {_P} SELECT distance, time, 63 - time AS time_idx, round(value, 6) AS value FROM p")
register("to_dataframe_pivot", lambda s, d: selecting.to_dataframe(patch(s, d), list(range(TIMES))).select("distance", *(F.round(F.col(str(i)), 6).alias(f"t{i}") for i in range(TIMES))), "SELECT vec_id AS distance, " + ", ".join(f"round(CAST(embedding[{i + 1}] AS DOUBLE), 6) AS t{i}" for i in range(TIMES)) + " FROM embeddings")

# aggregation
_SQL_AGG = {"min": "min(value)", "max": "max(value)", "mean": "avg(value)", "median": "median(value)", "std": "stddev_pop(value)", "sum": "coalesce(sum(value), 0)", "first": "arg_min_null(value, time)", "last": "arg_max_null(value, time)", "any": "CAST(bool_or(coalesce(value <> 0, true)) AS DOUBLE)", "all": "CAST(bool_and(coalesce(value <> 0, true)) AS DOUBLE)"}
for _m, _sql in _SQL_AGG.items():
    on_patch(f"agg_{_m}", partial(lambda p, m: aggregating.aggregate(p, "time", m), m=_m), f"SELECT distance, {_sql} AS x FROM n GROUP BY 1", nulls=True)
on_patch("ufunc_accumulate", lambda p: aggregating.accumulate(p, "time"), "SELECT distance, time, sum(value) OVER (PARTITION BY distance ORDER BY time) AS x FROM p")

on_patch("agg_function", lambda p: aggregating.aggregate(p, "time", lambda x: (x**2).sum(axis=1)), "SELECT distance, sum(value * value) AS x FROM p GROUP BY 1")
on_patch("agg_two_dims", lambda p: aggregating.aggregate(p, ("time", "distance"), "median", keep="empty"), "SELECT CAST(NULL AS DOUBLE) AS distance, CAST(NULL AS DOUBLE) AS time, median(m) AS x FROM (SELECT median(value) AS m FROM p GROUP BY distance)")
on_patch("agg_keep_mean", lambda p: aggregating.aggregate(p, "time", "max", keep="mean"), "SELECT distance, 31.5::DOUBLE AS time, max(value) AS x FROM p GROUP BY distance")
on_patch("ufunc_reduce", lambda p: aggregating.reduce(p, "time", "maximum"), "SELECT distance, max(value) AS x FROM p GROUP BY 1")
on_patch("percentile", lambda p: aggregating.percentile(p, "time", 30), "SELECT distance, quantile_cont(value, 0.3) AS x FROM p GROUP BY 1")

# coordinates beside dimensions
_lat = lambda p: coordinates.update_coords(p, latitude=("distance", (F.col("distance") * 7 % 100).cast("double")))
on_patch("select_by_coord", lambda p: coordinates.select_by(_lat(p), "latitude", 20, 40), "SELECT distance, time, value AS x FROM p WHERE distance * 7 % 100 BETWEEN 20 AND 40")
on_patch("set_dims", lambda p: coordinates.set_dims(coordinates.update_coords(p, depth=("time", F.col("time") * 2.5)), time="depth"), "SELECT distance, CAST(time * 2.5 AS DOUBLE) AS depth, value AS x FROM p")
register("get_array", lambda s, d: coordinates.get_array(_lat(patch(s, d)), "latitude"), f"WITH {_P} SELECT DISTINCT distance, distance AS distance_idx, CAST(distance * 7 % 100 AS DOUBLE) AS latitude FROM p")
register("sort_by_coord", lambda s, d: coordinates.sort_by(_lat(patch(s, d)), "latitude").df.select("distance", "distance_idx", "time", F.round("value", 6).alias("value")), f"WITH {_P}, r AS (SELECT distance, row_number() OVER (ORDER BY distance * 7 % 100, distance) - 1 AS distance_idx FROM (SELECT DISTINCT distance FROM p)) SELECT distance, distance_idx, time, round(value, 6) AS value FROM p JOIN r USING (distance)")
register("add_distance_to", lambda s, d: coordinates.get_array(coordinates.add_distance_to(coordinates.update_coords(patch(s, d), x=("distance", F.col("distance") * 2.0), y=("distance", F.col("distance") % 10 * 1.0)), {"x": 10, "y": 3}), "origin_distance").withColumn("origin_distance", F.round("origin_distance", 6)), f"WITH {_P} SELECT DISTINCT distance, distance AS distance_idx, round(sqrt(pow(10 - distance * 2.0, 2) + pow(3 - distance % 10, 2)), 6) AS origin_distance FROM p")


def _points(extrapolate: bool) -> Query:
    import pandas as pd

    table = pd.DataFrame({"distance": [10, 60, 200], "x": [0.0, 100.0, -40.0]})
    return lambda s, d: coordinates.get_array(coordinates.coords_from_points(patch(s, d), "distance", table, extrapolate), "x").withColumn("x", F.round("x", 6) + F.lit(0.0))


_LINES = "CASE WHEN distance < 60 THEN (distance - 10) * 2.0 ELSE 100 - (distance - 60) END"
register("coords_from_points", _points(False), f"WITH {_P} SELECT DISTINCT distance, distance AS distance_idx, CASE WHEN distance BETWEEN 10 AND 200 THEN round(CAST({_LINES} AS DOUBLE), 6) + 0.0 END AS x FROM p")
register("coords_extrapolated", _points(True), f"WITH {_P} SELECT DISTINCT distance, distance AS distance_idx, round(CAST({_LINES} AS DOUBLE), 6) + 0.0 AS x FROM p")
on_patch("update_attrs", lambda p: coordinates.update_attrs(p, time_min=100, tag="x"), "SELECT distance, time + 100 AS time, value AS x FROM p")
on_patch("broadcast_to", lambda p: coordinates.broadcast_to(aggregating.aggregate(p, "time", "mean"), shot=[1, 2, 3]), "SELECT distance, CAST(s AS INTEGER) AS shot, avg(value) AS x FROM p, (SELECT unnest([1, 2, 3]) AS s) GROUP BY 1, 2")

# windows
_ROLL = {"mean": "avg(value)", "min": "min(value)", "max": "max(value)", "sum": "sum(value)", "std": "stddev_pop(value)", "median": "quantile_cont(value, 0.5)"}
for _m, _sql in _ROLL.items():
    on_patch(f"roll_{_m}", partial(lambda p, m: windows.rolling(p, "time", 5, m), m=_m), f"SELECT distance, time, CASE WHEN count(value) OVER w = 5 THEN {_sql} OVER w END AS x FROM n WINDOW w AS (PARTITION BY distance ORDER BY time ROWS 4 PRECEDING)", nulls=True)
on_patch("roll_center", lambda p: windows.rolling(p, "time", 5, "mean", center=True), "SELECT distance, time, CASE WHEN count(value) OVER w = 5 THEN avg(value) OVER w END AS x FROM p WINDOW w AS (PARTITION BY distance ORDER BY time ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
on_patch("roll_step", lambda p: windows.rolling(p, "time", 4, "sum", step=3), "SELECT * FROM (SELECT distance, time, CASE WHEN count(value) OVER w = 4 THEN sum(value) OVER w END AS x FROM p WINDOW w AS (PARTITION BY distance ORDER BY time ROWS 3 PRECEDING)) WHERE time % 3 = 0")
on_patch("stalta", lambda p: windows.stalta(p.map_value(F.abs, "abs"), "time", 3, 10), "SELECT distance, time, CASE WHEN count(value) OVER l = 10 THEN avg(abs(value)) OVER s / avg(abs(value)) OVER l END AS x FROM p WINDOW s AS (PARTITION BY distance ORDER BY time ROWS 2 PRECEDING), l AS (PARTITION BY distance ORDER BY time ROWS 9 PRECEDING)")
_T = "OVER (PARTITION BY distance)"
on_patch("demean", lambda p: windows.demean(p, "time"), f"SELECT distance, time, value - avg(value) {_T} AS x FROM p")
on_patch("demedian", lambda p: windows.demedian(p, "time"), f"SELECT distance, time, value - median(value) {_T} AS x FROM p")
on_patch("standardize", lambda p: windows.standardize(p, "time"), f"SELECT distance, time, (value - avg(value) {_T}) / stddev_pop(value) {_T} AS x FROM p")
on_patch("normalize_l1", lambda p: windows.normalize(p, "time", "l1"), f"SELECT distance, time, value / sum(abs(value)) {_T} AS x FROM p")
on_patch("normalize_l2", lambda p: windows.normalize(p, "time", "l2"), f"SELECT distance, time, value / sqrt(sum(value * value) {_T}) AS x FROM p")
on_patch("normalize_max", lambda p: windows.normalize(p, "time", "max"), f"SELECT distance, time, value / max(abs(value)) {_T} AS x FROM p")
on_patch("normalize_bit", lambda p: windows.normalize(p, "time", "bit"), "SELECT distance, time, sign(value) AS x FROM p")
on_patch("detrend_linear", lambda p: windows.detrend(p, "time"), f"SELECT distance, time, value - (regr_slope(value, time) {_T} * time + regr_intercept(value, time) {_T}) AS x FROM p")
on_patch("integrate_cum", lambda p: windows.integrate(p, "time"), "SELECT distance, time, sum(part) OVER (PARTITION BY distance ORDER BY time) AS x FROM (SELECT distance, time, coalesce((value + lag(value) OVER w) / 2, 0) AS part FROM p WINDOW w AS (PARTITION BY distance ORDER BY time))")
on_patch("integrate_def", lambda p: windows.integrate(p, "time", definite=True), "SELECT distance, sum(part) AS x FROM (SELECT distance, coalesce((value + lag(value) OVER (PARTITION BY distance ORDER BY time)) / 2, 0) AS part FROM p) GROUP BY 1")
_DIFF = "CASE WHEN time < {k} THEN (-3 * value + 4 * lead(value, {k}) OVER w - lead(value, {k2}) OVER w) / (2.0 * {k}) WHEN time >= 64 - {k} THEN (3 * value - 4 * lag(value, {k}) OVER w + lag(value, {k2}) OVER w) / (2.0 * {k}) ELSE (lead(value, {k}) OVER w - lag(value, {k}) OVER w) / (2.0 * {k}) END"
for _k, _name in ((1, "differentiate"), (2, "differentiate_step")):
    on_patch(_name, partial(lambda p, k: windows.differentiate(p, "time", k), k=_k), "SELECT distance, time, " + _DIFF.format(k=_k, k2=2 * _k) + " AS x FROM p WINDOW w AS (PARTITION BY distance ORDER BY time)")
on_patch("strain_rate_edgeless", lambda p: windows.strain_rate_edgeless(p, "time", 2), "SELECT * FROM (SELECT distance, time + 1.0::DOUBLE AS time, (lead(value, 2) OVER w - value) / 2 AS x FROM p WINDOW w AS (PARTITION BY distance ORDER BY time)) WHERE x IS NOT NULL")
_CENTRED = "WINDOW w AS (PARTITION BY distance ORDER BY time ROWS BETWEEN 8 PRECEDING AND 7 FOLLOWING)"
on_patch("kurtosis_windowed", lambda p: windows.kurtosis(p, "time", 16), "SELECT distance, time, CASE WHEN m2 - m1 * m1 > 0 THEN (m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * m1 * m1 * m1 * m1) / ((m2 - m1 * m1) * (m2 - m1 * m1)) END AS x FROM (SELECT *, avg(value) OVER w AS m1, avg(value * value) OVER w AS m2, avg(value * value * value) OVER w AS m3, avg(value * value * value * value) OVER w AS m4 FROM p " + _CENTRED + ")", digits=4)
on_patch("kurtosis_recursive", lambda p: spectral.recursive_kurtosis(p, "time", 16))

# arithmetic
_half = lambda p: selecting.select(p, "time", 10, 40)
_ALIGN = "SELECT a.distance, a.time, {x} AS x FROM p a JOIN p b ON a.distance = b.distance AND a.time = b.time AND b.time BETWEEN 10 AND 40"
for _m, _sql in {"add": "a.value + b.value", "subtract": "a.value - 2 * b.value", "multiply": "a.value * b.value", "divide": "a.value / nullif(b.value, 0)", "maximum": "greatest(a.value, b.value)", "greater_equal": "CAST(a.value >= b.value AS DOUBLE)"}.items():
    on_patch(f"{_m}_align", partial(lambda p, m: arithmetic.binary(p, _half(p) if m != "subtract" else arithmetic.binary(_half(p), 2, "multiply"), m), m=_m), _ALIGN.format(x=_sql))
on_patch("broadcast_subtract", lambda p: arithmetic.binary(p, aggregating.aggregate(p, "time", "mean"), "subtract"), f"SELECT distance, time, value - avg(value) {_T} AS x FROM p")
_F = {"floor_divide": "floor(value / 0.07)", "mod": "value - 0.07 * floor(value / 0.07)", "power": "pow(value, 2)", "less": "CAST(value < 0.05 AS DOUBLE)"}
for (_m, _sql), _v in zip(_F.items(), (0.07, 0.07, 2, 0.05)):
    on_patch(_m, partial(lambda p, m, v: arithmetic.binary(p, v, m), m=_m, v=_v), f"SELECT distance, time, {_sql} AS x FROM p")
_U = {"exp": "exp(value)", "log": "CASE WHEN value > 0 THEN ln(value) END", "log10": "CASE WHEN value > 0 THEN log10(value) END", "log2": "CASE WHEN value > 0 THEN log2(value) END", "abs": "abs(value)", "negative": "-value", "isnan": "CAST(value IS NULL AS DOUBLE)", "isfinite": "CAST(value IS NOT NULL AS DOUBLE)"}
for _m, _sql in _U.items():
    on_patch(_m, partial(lambda p, m: arithmetic.unary(p, m), m=_m), f"SELECT distance, time, {_sql} AS x FROM n", nulls=True)

# kernels; a table of border indices gives the samples that an output needs
_K = "k AS (SELECT distance, o.time AS time, k, p.value FROM (SELECT time, k, time + k AS j FROM (SELECT DISTINCT time FROM p), (SELECT unnest(range(-{r}, {r} + 1)) AS k)) o JOIN p ON p.time = CASE WHEN j < 0 THEN -1 - j WHEN j > 63 THEN 127 - j ELSE j END)"


def on_kernel(name: str, f: Callable[[Patch], Patch], radius: int, sql: str) -> None:
    QUERIES[name] = lambda s, d: rounded(f(patch(s, d)))
    ORACLES[name] = f"WITH {_P}, {_K.format(r=radius)} SELECT distance, time, round({sql}, 6) + 0.0 AS value FROM k GROUP BY 1, 2"


on_kernel("moving_mean", lambda p: kernels.moving(p, "time", 5, "mean"), 2, "avg(value)")
on_kernel("moving_sum", lambda p: kernels.moving(p, "time", 5, "sum"), 2, "sum(value)")
on_kernel("moving_min", lambda p: kernels.moving(p, "time", 5, "min"), 2, "min(value)")
on_kernel("moving_max", lambda p: kernels.moving(p, "time", 5, "max"), 2, "max(value)")
on_kernel("moving_std", lambda p: kernels.moving(p, "time", 5, "std"), 2, "stddev_pop(value)")
on_patch("moving_even", lambda p: kernels.moving(p, "time", 4, "mean", mode="nearest"), "SELECT o.distance, o.time, avg(q.value) AS x FROM p o, (SELECT unnest([-2, -1, 0, 1]) AS k), p q WHERE q.distance = o.distance AND q.time = greatest(0, least(63, o.time + k)) GROUP BY 1, 2")
on_patch("moving_mirror", lambda p: kernels.moving(p, "time", 5, "max", mode="mirror"), "SELECT o.distance, o.time, max(q.value) AS x FROM p o, (SELECT unnest([-2, -1, 0, 1, 2]) AS k), p q WHERE q.distance = o.distance AND q.time = 63 - abs(63 - abs(o.time + k)) GROUP BY 1, 2")
on_patch("moving_wrap", lambda p: kernels.moving(p, "time", 5, "sum", mode="wrap"), "SELECT o.distance, o.time, sum(q.value) AS x FROM p o, (SELECT unnest([-2, -1, 0, 1, 2]) AS k), p q WHERE q.distance = o.distance AND q.time = (o.time + k + 64) % 64 GROUP BY 1, 2")
on_kernel("median_1d", lambda p: kernels.median(p, "time", 5), 2, "median(value)")
on_kernel("gaussian", lambda p: kernels.gaussian(p, "time", 1.5), 6, "sum(value * exp(-0.5 * (k / 1.5) ** 2)) / (SELECT sum(exp(-0.5 * (i / 1.5) ** 2)) FROM (SELECT unnest(range(-6, 7)) AS i))")
on_kernel("savgol", lambda p: kernels.savgol(p, "time", 5, 2), 2, "sum(value * CASE abs(k) WHEN 0 THEN 17 WHEN 1 THEN 12 ELSE -3 END) / 35")
_CLAMP = "CASE WHEN {v} < 0 THEN -1 - ({v}) WHEN {v} > {n} THEN 2 * {n} + 1 - ({v}) ELSE {v} END"
on_patch("sobel", lambda p: kernels.sobel(p, "time"), "SELECT o.distance, o.time, sum(q.value * a.w * b.w) AS x FROM p o, (SELECT max(distance) AS m FROM p), (SELECT unnest([-1, 1]) AS k, unnest([-1, 1]) AS w) a, (SELECT unnest([-1, 0, 1]) AS k, unnest([1, 2, 1]) AS w) b, p q WHERE q.time = " + _CLAMP.format(v="o.time + a.k", n=63) + " AND q.distance = " + _CLAMP.format(v="o.distance + b.k", n="m") + " GROUP BY 1, 2")
_MED = "quantile_cont({v}, 0.5) AS {o} FROM (SELECT o.distance, o.time, q.{v} FROM {t} o, (SELECT unnest([-2, -1, 0, 1, 2]) AS k) a, {t} q WHERE q.distance = o.distance AND q.time = " + _CLAMP.format(v="o.time + k", n=63) + ") GROUP BY 1, 2"
on_patch("hampel", lambda p: kernels.hampel(p, {"time": 5}, 3.0), "WITH m AS (SELECT distance, time, " + _MED.format(v="value", o="m", t="p") + "), g AS (SELECT p.distance, p.time, p.value, m, abs(p.value - m) AS gap FROM p JOIN m USING (distance, time)), d AS (SELECT distance, time, " + _MED.format(v="gap", o="mad", t="g") + ") SELECT distance, time, CASE WHEN gap / (CASE WHEN mad = 0 THEN 2.220446049250313e-16 ELSE mad END) > 3 THEN m ELSE value END AS x FROM g JOIN d USING (distance, time)")
on_patch("hampel_2d", lambda p: kernels.hampel(p, {"time": 3, "distance": 3}, 3.0))
on_patch("hampel_box", lambda p: kernels.hampel(p, {"time": 3, "distance": 3}, 3.0, approximate=False))
on_patch("taper", lambda p: kernels.taper(p, "time", 0.125), "SELECT distance, time, value * CASE WHEN least(time, 63 - time) < 8 THEN 0.5 - 0.5 * cos(2 * pi() * least(time, 63 - time) / 15) ELSE 1 END AS x FROM p")
on_patch("taper_blackman", lambda p: kernels.taper(p, "time", (0.25, None), "blackman"), "SELECT distance, time, value * CASE WHEN time < 16 THEN 0.42 - 0.5 * cos(2 * pi() * time / 31) + 0.08 * cos(4 * pi() * time / 31) ELSE 1 END AS x FROM p")
on_patch("taper_triangle", lambda p: kernels.taper(p, "time", (None, 0.25), "triang"), "SELECT distance, time, value * CASE WHEN time >= 48 THEN 1 - abs(2 * (time - 32) - 31) / 32.0 ELSE 1 END AS x FROM p")
on_patch("decimate_slice", lambda p: windows.decimate(p, "time", 4), "SELECT distance, time, value AS x FROM p WHERE time % 4 = 0")
on_patch("interp_linear", lambda p: kernels.interpolate(p, "time", [0.5, 10.25, 64.0]), "SELECT a.distance, t AS time, a.value * (1 - (t - a.time)) + b.value * (t - a.time) AS x FROM (SELECT CAST(unnest([0.5, 10.25, 64.0]) AS DOUBLE) AS t) JOIN p a ON a.time = least(CAST(floor(t) AS BIGINT), 62) JOIN p b ON b.distance = a.distance AND b.time = a.time + 1")
on_patch("interp_nearest", lambda p: kernels.interpolate(p, "time", [0.5, 10.25, 10.75, 70.0], "nearest"), "SELECT distance, t AS time, value AS x FROM (SELECT CAST(unnest([0.5, 10.25, 10.75, 70.0]) AS DOUBLE) AS t, unnest([0, 10, 11, 63]) AS i) JOIN p ON time = i")

# transforms
on_patch("dft_naive", lambda p: spectral.amplitude_spectrum(p, "time"), "SELECT distance, k / 64.0::DOUBLE AS ft_time, sqrt(pow(sum(value * cos(2 * pi() * k * time / 64)), 2) + pow(sum(value * sin(2 * pi() * k * time / 64)), 2)) AS x FROM p, (SELECT unnest(range(33)) AS k) GROUP BY 1, 2")
on_patch("pass_filter", lambda p: spectral.pass_filter(p, "time", 0.05, 0.2))
on_patch("envelope", lambda p: spectral.envelope(p, "time"))
on_patch("hilbert", lambda p: spectral.hilbert(p, "time"))
on_patch("resample", lambda p: spectral.resample(p, "time", 48))
on_patch("whiten", lambda p: spectral.whiten(p, "time"))
on_patch("whiten_band", lambda p: spectral.whiten(p, "time", smooth=0.1, water_level=0.05, band=(0.05, 0.1, 0.3, 0.4)))
on_patch("decimate_iir", lambda p: spectral.decimate(p, "time", 4))
on_patch("decimate_fir", lambda p: spectral.decimate(p, "time", 2, "fir"))
on_patch("band_energy", lambda p: spectral.band_energy(p, "time", 0.05, 0.2, 8))
on_patch("rolling_apply", lambda p: windows.rolling_apply(p, "time", 5, lambda w: w.max(axis=1) - w.min(axis=1)), "SELECT distance, time, CASE WHEN count(value) OVER w = 5 THEN max(value) OVER w - min(value) OVER w END AS x FROM n WINDOW w AS (PARTITION BY distance ORDER BY time ROWS 4 PRECEDING)", nulls=True)
on_patch("differentiate_4", lambda p: windows.differentiate_high(p, "time", 4), "SELECT distance, time, CASE time WHEN 0 THEN -25 / 12.0 * value + 4 * lead(value, 1) OVER w - 3 * lead(value, 2) OVER w + 4 / 3.0 * lead(value, 3) OVER w - 0.25 * lead(value, 4) OVER w WHEN 1 THEN -0.25 * lag(value, 1) OVER w - 5 / 6.0 * value + 1.5 * lead(value, 1) OVER w - 0.5 * lead(value, 2) OVER w + 1 / 12.0 * lead(value, 3) OVER w WHEN 62 THEN 0.25 * lead(value, 1) OVER w + 5 / 6.0 * value - 1.5 * lag(value, 1) OVER w + 0.5 * lag(value, 2) OVER w - 1 / 12.0 * lag(value, 3) OVER w WHEN 63 THEN 25 / 12.0 * value - 4 * lag(value, 1) OVER w + 3 * lag(value, 2) OVER w - 4 / 3.0 * lag(value, 3) OVER w + 0.25 * lag(value, 4) OVER w ELSE (lag(value, 2) OVER w - 8 * lag(value, 1) OVER w + 8 * lead(value, 1) OVER w - lead(value, 2) OVER w) / 12 END AS x FROM p WINDOW w AS (PARTITION BY distance ORDER BY time)")
on_patch("radians_to_strain", lambda p: windows.radians_to_strain(units.set_units(p, "radians"), gauge_length=1e-6), "SELECT distance, time, value * 1550e-9 / (4 * pi() * 1.445 * 1e-6 * 0.79) AS x FROM p")
on_patch("strain_rate", lambda p: windows.strain_rate(p, "time", 2), "SELECT distance, time, " + _DIFF.format(k=1, k2=2) + " AS x FROM p WINDOW w AS (PARTITION BY distance ORDER BY time)")

on_patch("notch", lambda p: spectral.notch(p, "time", 0.125))
on_patch("phase_weighted_stack", lambda p: spectral.phase_weighted_stack(p, "distance", "time"))

# mutes, alignment, correlation, units, times
on_patch("line_mute", lambda p: shaping.line_mute(p, "time", 10, 20), "SELECT distance, time, CASE WHEN time BETWEEN 10 AND 20 THEN 0 ELSE value END AS x FROM p")
on_patch("line_mute_invert", lambda p: shaping.line_mute(p, "time", None, 20, invert=True), "SELECT distance, time, CASE WHEN time > 20 THEN 0 ELSE value END AS x FROM p")
on_patch("taper_range", lambda p: shaping.taper_range(p, "time", (4, 12, 40, 60)), "SELECT distance, time, value * CASE WHEN time < 4 OR time > 60 THEN 0 WHEN time < 12 THEN 0.5 - 0.5 * cos((time - 4) * pi() / 8) WHEN time <= 40 THEN 1 ELSE 0.5 - 0.5 * cos((60 - time) * pi() / 20) END AS x FROM p")
_shifts = lambda p: p.df.select("distance", (F.col("distance") % 4).alias("shift")).distinct()
for _m, _low, _high in (("full", 0, 66), ("same", 0, 63), ("valid", 3, 63)):
    on_patch(f"align_{_m}", partial(lambda p, m: shaping.align_to_shift(p, "time", "distance", _shifts(p), m), m=_m), f"SELECT g.distance, g.time, p.value AS x FROM (SELECT distance, CAST(unnest(range({_low}, {_high} + 1)) AS BIGINT) AS time FROM (SELECT DISTINCT distance FROM p)) g LEFT JOIN p ON p.distance = g.distance AND p.time = g.time - g.distance % 4")
register("concatenate", lambda s, d: shaping.concatenate([selecting.select(patch(s, d), "time", 0, 9), selecting.select(patch(s, d), "time", 50, 63)], "time").df.select("distance", "time", "time_idx", F.round("value", 6).alias("value")), f"WITH {_P} SELECT distance, time, CASE WHEN time < 10 THEN time ELSE time - 40 END AS time_idx, round(value, 6) AS value FROM p WHERE time < 10 OR time >= 50")
on_patch("correlate", lambda p: shaping.correlate(p, "time", "distance", 7, 5), "SELECT a.distance, lag AS lag_time, sum(a.value * b.value) AS x FROM (SELECT CAST(unnest(range(-5, 6)) AS BIGINT) AS lag), p a JOIN p b ON b.distance = 7 AND a.time = b.time + lag GROUP BY 1, 2")
on_patch("wiener", lambda p: shaping.wiener(p, "time", 5), "SELECT distance, time, CASE WHEN v < nv THEN m ELSE m + (value - m) * (1 - nv / v) END AS x FROM (SELECT *, avg(v) OVER () AS nv FROM (SELECT *, s / 5 AS m, q / 5 - (s / 5) * (s / 5) AS v FROM (SELECT *, sum(value) OVER w AS s, sum(value * value) OVER w AS q FROM p WINDOW w AS (PARTITION BY distance ORDER BY time ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))))")
register("convert_units", lambda s, d: rounded(units.convert_units(units.set_units(patch(s, d), "degC"), "degF", distance="ft")).withColumn("distance", F.round("distance", 6)), f"WITH {_P} SELECT round(distance / 0.3048, 6) AS distance, time, round(value * 1.8 + 32, 6) AS value FROM p")
register("time_conversion", lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", times.timestamp_to_ns("ts").alias("ns"), times.seconds_to_ns("value").alias("from_seconds"), F.round(times.ns_to_seconds(times.timestamp_to_ns("ts")), 3).alias("seconds")), "SELECT event_id, epoch_us(ts) * 1000 AS ns, CAST(round(value * 1e9) AS BIGINT) AS from_seconds, round((epoch_us(ts) * 1000) / 1e9, 3) AS seconds FROM events")

# complex spectra, slopes, slant stacks
_S = "s AS (SELECT distance, k, sum(value * cos(2 * pi() * k * time / 64)) AS re, -sum(value * sin(2 * pi() * k * time / 64)) AS im FROM p, (SELECT unnest(range(33)) AS k) GROUP BY 1, 2)"
for _m, _f, _sql in (("real", complexes.real, "re"), ("imag", complexes.imag, "im"), ("abs", complexes.modulus, "sqrt(re * re + im * im)"), ("conj", lambda s: complexes.imag(complexes.conj(s)), "-im"), ("psd", complexes.power, "(re * re + im * im) / 64"), ("ps_db", lambda s: complexes.power(s, "PS", db=True), "10 * log10((re * re + im * im) / 4096 + 2.220446049250313e-16)")):
    register(f"dft_{_m}", partial(lambda s, d, f: rounded(f(complexes.dft(patch(s, d), "time", half=True)), 5), f=_f), f"WITH {_P}, {_S} SELECT distance, k / 64.0::DOUBLE AS ft_time, round({_sql}, 5) + 0.0 AS value FROM s")
on_patch("dft_angle", lambda p: complexes.angle(complexes.dft(p, "time", half=True)))
on_patch("idft", lambda p: complexes.real(complexes.idft(complexes.dft(p, "distance", "time"))), "SELECT distance, time, value AS x FROM p")
on_patch("stft", lambda p: complexes.modulus(complexes.stft(p, "time", 16)))
on_patch("istft", lambda p: complexes.istft(complexes.stft(p, "time", 16), "time"), "SELECT CAST(distance AS DOUBLE) AS distance, CAST(time AS DOUBLE) AS time, value AS x FROM p")
on_patch("slope_filter", lambda p: complexes.slope_filter(p, (0.1, 0.2, 2, 4)))
on_patch("slope_mute", lambda p: shaping.slope_mute(p, (1.0, 4.0)), "SELECT distance, time, CASE WHEN distance BETWEEN time AND 4 * time THEN 0 ELSE value END AS x FROM p")
on_patch("tau_p", lambda p: complexes.tau_p(p, [0.8, 3.0]), "SELECT slowness, time, x FROM (SELECT s AS slowness, tau AS time, sum(CASE WHEN pos + 1 < 64 THEN (1 - (shift - floor(shift))) * a.value + (shift - floor(shift)) * b.value ELSE 0 END) AS x FROM (SELECT *, tau + CAST(floor(shift) AS BIGINT) AS pos FROM (SELECT s, tau, x, abs(s) * CASE WHEN s < 0 THEN n - 1 - x ELSE x END AS shift FROM (SELECT unnest([-1 / 0.8::DOUBLE, -1 / 3::DOUBLE, 1 / 3::DOUBLE, 1 / 0.8::DOUBLE]) AS s), (SELECT unnest(range(64)) AS tau), (SELECT DISTINCT distance AS x FROM p), (SELECT count(DISTINCT distance) AS n FROM p))) g LEFT JOIN p a ON a.distance = g.x AND a.time = g.pos LEFT JOIN p b ON b.distance = g.x AND b.time = g.pos + 1 GROUP BY 1, 2)")
on_patch("dispersion", lambda p: complexes.dispersion(p, [1.0, 2.0, 5.0], band=(0.1, 0.4)))
on_patch("median_2d", lambda p: kernels.median_nd(p, {"distance": 3, "time": 3}), "SELECT distance, time, median(value) AS x FROM (SELECT o.distance, o.time, q.value FROM (SELECT distance, time, unnest(range(-1, 2)) AS dk FROM p) o, (SELECT unnest(range(-1, 2)) AS tk), (SELECT max(distance) AS m FROM p), p q WHERE q.distance = CASE WHEN o.distance + dk < 0 THEN 0 WHEN o.distance + dk > m THEN m ELSE o.distance + dk END AND q.time = CASE WHEN o.time + tk < 0 THEN 0 WHEN o.time + tk > 63 THEN 63 ELSE o.time + tk END) GROUP BY 1, 2")
register("gaps", lambda s, d: robust.gaps(s.read.parquet(f"{d}/events.parquet").select("user_id", micros("ts").alias("start")).distinct(), ["user_id"], "start", 5.0), "WITH e AS (SELECT DISTINCT user_id, epoch_us(ts) AS start FROM events), n AS (SELECT *, lead(start) OVER (PARTITION BY user_id ORDER BY start) AS following FROM e) SELECT user_id, start, following FROM (SELECT *, median(following - start) OVER (PARTITION BY user_id) AS m FROM n WHERE following IS NOT NULL) WHERE following - start > 5 * m")
register("fence", lambda s, d: cells(s, d).groupBy("distance").agg(*(F.round(c, 6).alias(n) for c, n in zip(robust.fence("value"), ("low", "high")))), f"WITH {_P}, q AS (SELECT distance, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b, min(value) AS l, max(value) AS h FROM p GROUP BY 1) SELECT distance, round(greatest(a - 1.5 * (b - a), l), 6) AS low, round(least(b + 1.5 * (b - a), h), 6) AS high FROM q")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Select, demean, rolling mean, standard deviation."""
    p = selecting.select(patch(spark, sf_dir), "time", 8, 55)
    return rounded(aggregating.aggregate(windows.rolling(windows.demean(p, "time"), "time", 5, "mean"), "time", "std"))


register("flagship", flagship, f"WITH {_P}, d AS (SELECT distance, time, value - avg(value) {_T} AS value FROM p WHERE time BETWEEN 8 AND 55), r AS (SELECT distance, CASE WHEN count(value) OVER w = 5 THEN avg(value) OVER w END AS value FROM d WINDOW w AS (PARTITION BY distance ORDER BY time ROWS 4 PRECEDING)) SELECT distance, round(stddev_pop(value), 6) + 0.0 AS value FROM r GROUP BY 1")


# catalogs
def micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recording for each user and day; times in microseconds."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_type")
    day = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min(micros("ts")).alias("time_min"), F.max(micros("ts")).alias("time_max"), F.max("event_type").alias("tag"))
    return day.select(F.concat_ws("_", F.lit("sta"), F.col("user_id").cast("string")).alias("station"), F.concat_ws("/", F.col("user_id").cast("string"), F.col("day").cast("string")).alias("patch_id"), "tag", "time_min", "time_max", F.lit(1_000_000).cast("long").alias("time_step"))


_C = "c AS (SELECT 'sta_' || user_id AS station, user_id || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS patch_id, max(event_type) AS tag, min(epoch_us(ts)) AS time_min, max(epoch_us(ts)) AS time_max, CAST(1000000 AS BIGINT) AS time_step FROM events GROUP BY user_id, CAST(ts AS DATE))"
_LOW, _HIGH = 1704412800_000_000, 1705000000_000_000
_DAY = 86_400_000_000
_ISLAND = "i AS (SELECT *, sum(CASE WHEN b IS NULL OR time_min > b + {tol} THEN 1 ELSE 0 END) OVER (PARTITION BY station ORDER BY time_min, time_max ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, max(time_max) OVER (PARTITION BY station ORDER BY time_min, time_max ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM c)), m AS (SELECT station, island, min(time_min) AS a, max(time_max) AS z FROM i GROUP BY 1, 2)"
_TOL = _DAY / 1_000_000
register("filter_glob", lambda s, d: spool.filter_catalog(catalog(s, d), station="sta_1?"), f"WITH {_C} SELECT * FROM c WHERE regexp_full_match(station, 'sta_1.')")
register("filter_isin", lambda s, d: spool.filter_catalog(catalog(s, d), station=["sta_1", "sta_7"]), f"WITH {_C} SELECT * FROM c WHERE station IN ('sta_1', 'sta_7')")
register("filter_minmax", lambda s, d: spool.filter_catalog(catalog(s, d), time_min=(_LOW, None)), f"WITH {_C} SELECT * FROM c WHERE time_min >= {_LOW}")
register("filter_overlap", lambda s, d: spool.filter_catalog(catalog(s, d), time=(_LOW, _HIGH)), f"WITH {_C} SELECT * FROM c WHERE time_max >= {_LOW} AND time_min <= {_HIGH}")
register("adjust_segments", lambda s, d: spool.adjust_segments(catalog(s, d), time=(_LOW, _HIGH)), f"WITH {_C} SELECT station, patch_id, tag, greatest(time_min, {_LOW}) AS time_min, least(time_max, {_HIGH}) AS time_max, time_step, time_min < {_LOW} OR time_max > {_HIGH} AS modified FROM c WHERE time_max >= {_LOW} AND time_min <= {_HIGH}")
register("spool_split", lambda s, d: spool.split(catalog(s, d), 100, ["time_min", "patch_id"]).select("patch_id", F.col("block").cast("long").alias("block")), f"WITH {_C} SELECT patch_id, CAST(floor((row_number() OVER (ORDER BY time_min, patch_id) - 1) / 100) AS BIGINT) AS block FROM c")
register("chunk_merge", lambda s, d: spool.chunk(catalog(s, d), "time", ["station"], tolerance=_TOL).select("station", "time_min", "time_max"), f"WITH {_C}, {_ISLAND.format(tol=_DAY)} SELECT station, a AS time_min, z AS time_max FROM m")
_CUT = "SELECT station, s AS time_min, least(s + {n} - 1000000, z) AS time_max FROM (SELECT station, z, a, unnest(range(a, z + 1, {stride})) AS s FROM m)"
register("chunk_fixed", lambda s, d: spool.chunk(catalog(s, d), "time", ["station"], length=_DAY, tolerance=_TOL).select("station", "time_min", "time_max"), f"WITH {_C}, {_ISLAND.format(tol=_DAY)} " + _CUT.format(n=_DAY, stride=_DAY) + f" WHERE s + {_DAY} - 1000000 <= z")
register("chunk_overlap", lambda s, d: spool.chunk(catalog(s, d), "time", ["station"], length=_DAY, overlap=_DAY // 2, tolerance=_TOL).select("station", "time_min", "time_max"), f"WITH {_C}, {_ISLAND.format(tol=_DAY)} " + _CUT.format(n=_DAY, stride=_DAY // 2) + f" WHERE s + {_DAY} - 1000000 <= z")
register("chunk_partial", lambda s, d: spool.chunk(catalog(s, d), "time", ["station"], length=_DAY, keep_partial=True, tolerance=_TOL).select("station", "time_min", "time_max"), f"WITH {_C}, {_ISLAND.format(tol=_DAY)} " + _CUT.format(n=_DAY, stride=_DAY) + " WHERE s + 1000000 <= z")
register("chunk_instructions", lambda s, d: spool.instructions(spool.chunk(catalog(s, d), "time", ["station"], length=_DAY, keep_partial=True, tolerance=_TOL), catalog(s, d), "time", ["station"], _DAY), f"WITH {_C}, {_ISLAND.format(tol=_DAY)}, k AS (" + _CUT.format(n=_DAY, stride=_DAY) + " WHERE s + 1000000 <= z) SELECT k.station, k.time_min AS chunk_min, k.time_max AS chunk_max, patch_id, greatest(k.time_min, c.time_min) AS time_min, least(k.time_max, c.time_max) AS time_max FROM k JOIN c ON k.station = c.station AND c.time_min <= k.time_max AND c.time_max >= k.time_min")
register("attrs_combine", lambda s, d: spool.combine_attrs(catalog(s, d), ["station"], ["tag", "time_step"], "time_min"), f"WITH {_C} SELECT station, CASE WHEN count(DISTINCT tag) = 1 THEN min(tag) END AS tag, min(time_step) AS time_step FROM c GROUP BY 1")
register("patch_names", lambda s, d: catalog(s, d).select("patch_id", F.concat_ws("__", F.lit("DAS"), "station", "tag", F.col("time_min").cast("string"), F.col("time_max").cast("string")).alias("name")), f"WITH {_C} SELECT patch_id, 'DAS__' || station || '__' || tag || '__' || time_min || '__' || time_max AS name FROM c")
register("stack", lambda s, d: spool.stack(cells(s, d).withColumn("shot", F.col("distance") % 10), ["shot", "time"]).select("shot", "time", F.round("value", 4).alias("value")), f"WITH {_P} SELECT distance % 10 AS shot, time, round(sum(value), 4) AS value FROM p GROUP BY 1, 2")

_spool = lambda s, d: spool.Spool(catalog(s, d))
register("spool_sort", lambda s, d: _spool(s, d).sort("time_max").contents().select("patch_id", "place"), f"WITH {_C} SELECT patch_id, row_number() OVER (ORDER BY time_max, time_min, patch_id) - 1 AS place FROM c")
register("spool_slice", lambda s, d: _spool(s, d)[5:50:3].catalog.select("patch_id"), f"WITH {_C}, o AS (SELECT patch_id, row_number() OVER (ORDER BY time_min, patch_id) - 1 AS place FROM c) SELECT patch_id FROM o WHERE place >= 5 AND place < 50 AND (place - 5) % 3 = 0")
register("spool_pick", lambda s, d: _spool(s, d)[[0, 7, -1]].catalog.select("patch_id"), f"WITH {_C}, o AS (SELECT patch_id, row_number() OVER (ORDER BY time_min, patch_id) - 1 AS place FROM c) SELECT patch_id FROM o WHERE place IN (0, 7, (SELECT count(*) - 1 FROM c))")
register("spool_names", lambda s, d: _spool(s, d).names(), f"WITH {_C} SELECT patch_id, 'DAS__' || station || '__' || tag || '__' || time_min || '__' || time_max AS name FROM c")
register("attrs_keep_first", lambda s, d: spool.combine_attrs(catalog(s, d), ["station"], ["tag", "time_step"], "time_min", "keep_first"), f"WITH {_C} SELECT station, arg_min(tag, time_min) AS tag, arg_min(time_step, time_min) AS time_step FROM c GROUP BY 1")


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the samples of the recordings in catalog()."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "value")
    return e.select(F.concat_ws("/", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("patch_id"), micros("ts").alias("time"), "value")


register("spool_select_cells", lambda s, d: spool.Spool(catalog(s, d), cells=_samples(s, d)).select(station="sta_1*", time=(_LOW, _HIGH)).cells.groupBy("patch_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")), "SELECT user_id || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS patch_id, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE starts_with(user_id::VARCHAR, '1') AND epoch_us(ts) BETWEEN " + f"{_LOW} AND {_HIGH} GROUP BY 1")
register("spool_map", lambda s, d: spool.Spool(catalog(s, d), cells=_samples(s, d)).map(lambda x: x.groupby("patch_id", as_index=False).agg(n=("value", "size"), most=("value", "max")).round(6), "patch_id string, n long, most double", many=True), "SELECT user_id || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS patch_id, count(*) AS n, round(max(value), 6) AS most FROM events GROUP BY 1")
register("merge_cells", lambda s, d: spool.merged_cells(spool.chunk(catalog(s, d), "time", ["station"], length=_DAY, keep_partial=True, tolerance=_TOL), catalog(s, d), _samples(s, d), "time", ["station"], _DAY).groupBy("station", "chunk_min").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")), f"WITH {_C}, {_ISLAND.format(tol=_DAY)}, k AS (" + _CUT.format(n=_DAY, stride=_DAY) + " WHERE s + 1000000 <= z), e AS (SELECT DISTINCT ON (user_id, ts) 'sta_' || user_id AS station, epoch_us(ts) AS t, value FROM events) SELECT k.station, k.time_min AS chunk_min, count(*) AS n, round(sum(value), 2) AS total FROM k JOIN e ON e.station = k.station AND t BETWEEN k.time_min AND k.time_max GROUP BY 1, 2")
register("sampling_groups", lambda s, d: spool.sampling_groups(catalog(s, d).withColumn("time_step", F.length("station") * 1000 + F.length("tag") * 10), "time").select("patch_id", "sampling"), f"WITH {_C}, t AS (SELECT patch_id, length(station) * 1000 + length(tag) * 10 AS step FROM c), g AS (SELECT step, sum(j) OVER (ORDER BY step) AS sampling FROM (SELECT step, CASE WHEN (step - lag(step) OVER (ORDER BY step)) / lag(step) OVER (ORDER BY step) > 0.05 THEN 1 ELSE 0 END AS j FROM (SELECT DISTINCT step FROM t))) SELECT patch_id, CAST(sampling AS BIGINT) AS sampling FROM t JOIN g USING (step)")
register("span_to_ns", lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", times.span_to_ns(F.concat_ws(" ", (F.col("event_id") % 90 - 5).cast("string"), F.element_at(F.array(*map(F.lit, ("seconds", "minute", "milliseconds", "parsecs"))), (F.col("event_id") % 4 + 1).cast("int")))).alias("ns")), "SELECT event_id, CAST((event_id % 90 - 5) * CASE event_id % 4 WHEN 0 THEN 1000000000 WHEN 1 THEN 60000000000 WHEN 2 THEN 1000000 END AS BIGINT) AS ns FROM events")

# streams, run until what is there has been read
register("stream_tumbling", lambda s, d: streams.tumbling(s, f"{d}/events.parquet"), "SELECT epoch_us(time_bucket(INTERVAL 1 day, ts)) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
register("stream_sliding", lambda s, d: streams.tumbling(s, f"{d}/events.parquet", slide="12 hours"), "SELECT epoch_us(start) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT *, unnest([time_bucket(INTERVAL 12 hours, ts), time_bucket(INTERVAL 12 hours, ts) - INTERVAL 12 hours]) AS start FROM events) GROUP BY ALL")
