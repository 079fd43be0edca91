"""Catalogs of recordings: one row per patch, with `<dim>_min`, `<dim>_max` and `<dim>_step` for each dimension."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fiberlake.errors import ChunkError, ParameterError


def condition(df: DataFrame, name: str, wanted) -> Column:
    """Text: a glob; list: membership; (low, high) on an interval: overlap; x_min= and x_max= without such columns: bounds."""
    if name in df.columns:
        c = F.col(name)
        if isinstance(wanted, str):
            return c.rlike(glob_pattern(wanted))
        if isinstance(wanted, (list, set, frozenset)):
            return c.isin(list(wanted))
        if isinstance(wanted, tuple):
            low, high = sorted(wanted) if None not in wanted else wanted
            return (F.lit(True) if low is None else c >= low) & (F.lit(True) if high is None else c <= high)
        return c == wanted
    if f"{name}_min" in df.columns and f"{name}_max" in df.columns:
        low, high = sorted(wanted) if None not in wanted else wanted
        inside = (F.lit(True) if low is None else F.col(f"{name}_max") >= low) & (F.lit(True) if high is None else F.col(f"{name}_min") <= high)
        return inside & F.col(f"{name}_min").isNotNull() & F.col(f"{name}_max").isNotNull()
    stem, _, end = name.rpartition("_")
    if stem in df.columns and end in ("min", "max"):
        return F.col(stem) >= wanted if end == "min" else F.col(stem) <= wanted
    raise ParameterError(f"{name} is no column and no interval")


def glob_pattern(glob: str) -> str:
    """Anchored, case-sensitive: * any characters, ? one, [..] one of, [!..] none of."""
    out, i = "", 0
    while i < len(glob):
        c, end = glob[i], glob.find("]", i + 2) if glob[i] == "[" else -1
        if end > 0:
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = end
        else:
            out += {"*": ".*", "?": "."}.get(c) or (c if c.isalnum() or c == "_" else "\\" + c)
        i += 1
    return f"(?s)^{out}$"


def filter_catalog(df: DataFrame, **wanted) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, (condition(df, k, v) for k, v in wanted.items())))


def adjust_segments(df: DataFrame, **wanted) -> DataFrame:
    """Filtered, and intervals cut to the range; `modified` tells which were."""
    out = filter_catalog(df, **wanted).withColumn("modified", F.lit(False))
    for name, value in wanted.items():
        if name not in df.columns and f"{name}_min" in df.columns:
            low, high = sorted(value) if None not in value else value
            first, last = F.col(f"{name}_min"), F.col(f"{name}_max")
            new_first = first if low is None else F.greatest(first, F.lit(low))
            new_last = last if high is None else F.least(last, F.lit(high))
            out = out.withColumn("modified", F.col("modified") | (new_first != first) | (new_last != last)).withColumns({f"{name}_min": new_first, f"{name}_max": new_last})
    return out


def islands(df: DataFrame, dim: str, group: list[str], tolerance: float = 1.5) -> DataFrame:
    """A number for each run of intervals without gaps of more than `tolerance` steps, within a group."""
    low, high, step = (F.col(f"{dim}_{x}") for x in ("min", "max", "step"))
    w = Window.partitionBy(*group).orderBy(f"{dim}_min", f"{dim}_max")
    before = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.coalesce(low > before + step * tolerance, F.lit(True)).cast("long")
    kept = df.where(low.isNotNull() & high.isNotNull()).withColumn("gap", gap)
    return kept.withColumn("island", F.sum("gap").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("gap")


def chunk(df: DataFrame, dim: str, group: list[str], length: int | None = None, overlap: int = 0, keep_partial: bool = False, tolerance: float = 1.5) -> DataFrame:
    """Merged intervals (length None), or intervals of a length cut from them."""
    if length is None and (overlap or keep_partial):
        raise ChunkError("merging takes neither overlap nor keep_partial")
    if length is not None and (length <= 0 or overlap >= length):
        raise ChunkError("the length is positive and above the overlap")
    keys = [*group, "island"]
    runs = islands(df, dim, group, tolerance).groupBy(*keys).agg(F.min(f"{dim}_min").alias("first"), F.max(f"{dim}_max").alias("last"), F.min_by(f"{dim}_step", f"{dim}_min").alias(f"{dim}_step"))
    if length is None:
        return runs.select(*group, F.col("first").alias(f"{dim}_min"), F.col("last").alias(f"{dim}_max"), f"{dim}_step")
    stride = length - overlap
    starts = F.explode(F.sequence("first", "last", F.lit(stride).cast("long")))
    cut = runs.withColumn("start", starts).withColumn("end", F.col("start") + length - F.col(f"{dim}_step"))
    cut = cut.where((F.col("end") <= F.col("last")) if not keep_partial else (F.col("start") + F.col(f"{dim}_step") <= F.col("last")))
    return cut.select(*group, F.col("start").alias(f"{dim}_min"), F.least("end", "last").alias(f"{dim}_max"), f"{dim}_step")


def instructions(chunks: DataFrame, sources: DataFrame, dim: str, group: list[str], bucket: int) -> DataFrame:
    """Which part of which source a chunk needs: an interval join on buckets of the dimension, not a nested loop."""
    def buckets(df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("low") / bucket), F.floor(F.col("high") / bucket))))

    a = buckets(chunks.select(*group, F.col(f"{dim}_min").alias("low"), F.col(f"{dim}_max").alias("high"))).withColumnsRenamed({"low": "chunk_min", "high": "chunk_max"})
    b = buckets(sources.select(*group, "patch_id", F.col(f"{dim}_min").alias("low"), F.col(f"{dim}_max").alias("high")))
    first = F.greatest("chunk_min", "low")
    met = a.join(b, [*group, "bucket"]).where((F.col("low") <= F.col("chunk_max")) & (F.col("high") >= F.col("chunk_min")) & (F.floor(first / bucket) == F.col("bucket")))
    return met.select(*group, "chunk_min", "chunk_max", "patch_id", first.alias(f"{dim}_min"), F.least("chunk_max", "high").alias(f"{dim}_max"))


def numbered(df: DataFrame, by: list[str], name: str, rows: int = 100_000) -> DataFrame:
    """Rows numbered from 0 in the order of `by`, whose first column is a number or a text and none of which is null.

    Ranges of about `rows` rows, with bounds from one pass, are numbered on their own; the rows before each range are
    added.  No task holds more than a range (or the rows of one value).
    """
    first = F.col(by[0])
    if df.schema[by[0]].dataType.typeName() == "string":  # its first six bytes, as a number
        first = F.conv(F.rpad(F.hex(F.substring(first.cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("long")
    points = [F.lit((i + 1) / 1000) for i in range(999)]
    seen = df.agg(F.count("*").alias("n"), F.percentile_approx(first, F.array(*points), F.lit(10_000)).alias("p")).first()
    parts = min(1000, max(1, -(-seen.n // rows)))
    bounds = sorted({seen.p[round(k * 1000 / parts) - 1] for k in range(1, parts)}) if parts > 1 else []
    place = F.lit(0)
    for b in bounds:
        place = place + F.when(first > F.lit(b), 1).otherwise(0)
    ranged = df.withColumn("_range", place)
    before, at = {}, 0
    for r in sorted(ranged.groupBy("_range").count().collect()) if bounds else []:  # 1000 rows at most
        before[r["_range"]], at = at, at + r["count"]
    offset = F.element_at(F.create_map(*(F.lit(x).cast("long") for kv in before.items() for x in kv)), F.col("_range").cast("long")) if before else F.lit(0)
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*by)) - 1 + offset
    return ranged.withColumn(name, place.cast("long")).drop("_range")


def split(df: DataFrame, size: int, by: list[str]) -> DataFrame:
    """Consecutive blocks of `size` catalog rows in the order of `by`."""
    return numbered(df, by, "_place").withColumn("block", F.floor(F.col("_place") / size)).drop("_place")


def combine_attrs(df: DataFrame, group: list[str], attrs: list[str], order: str, conflict: str = "drop") -> DataFrame:
    """Attributes that agree within a group; of others, null (drop), the first that is there (keep_first), or an error (raise)."""
    if conflict not in ("drop", "keep_first", "raise"):
        raise ParameterError(f"{conflict} is none of drop, keep_first, raise")
    if conflict == "keep_first":
        return df.groupBy(*group).agg(*(F.min_by(a, F.when(F.col(a).isNotNull(), F.col(order))).alias(a) for a in attrs))
    if conflict == "raise":
        bad = df.groupBy(*group).agg(*((F.count_distinct(a) > 1).alias(a) for a in attrs)).where(reduce(lambda x, y: x | y, (F.col(a) for a in attrs)))
        if not bad.isEmpty():
            raise ChunkError("attributes of a group differ")
    return df.groupBy(*group).agg(*(F.when(F.count_distinct(a) == 1, F.min_by(a, order)).alias(a) for a in attrs))


def stack(cells: DataFrame, keys: list[str]) -> DataFrame:
    """The sum of patches, cell by cell."""
    return cells.groupBy(*keys).agg(F.sum("value").alias("value"))


def sampling_groups(df: DataFrame, dim: str, name: str = "sampling", tolerance: float = 0.05) -> DataFrame:
    """A number for steps that lie close: sorted, a new group begins where a step is over 5 % above the one before."""
    steps = df.select(f"{dim}_step").distinct()  # as many rows as there are different steps
    w = Window.orderBy(f"{dim}_step")
    before = F.lag(f"{dim}_step").over(w)
    jump = F.coalesce((F.col(f"{dim}_step") - before) / before > tolerance, F.lit(False)).cast("long")
    groups = steps.withColumn("_jump", jump).withColumn(name, F.sum("_jump").over(w)).drop("_jump")
    return df.join(groups, f"{dim}_step")


def merged_cells(chunks: DataFrame, sources: DataFrame, cells: DataFrame, dim: str, group: list[str], bucket: int) -> DataFrame:
    """The samples of each chunk: (group, chunk_min, chunk_max, dim, value); of sources that overlap the later one counts.

    cells: (patch_id, dim, value).  The instructions say which samples of which source belong to a chunk.
    """
    wanted = instructions(chunks, sources, dim, group, bucket).withColumnsRenamed({f"{dim}_min": "low", f"{dim}_max": "high"})
    starts = sources.select("patch_id", F.col(f"{dim}_min").alias("starts"))
    met = cells.join(wanted, "patch_id").where(F.col(dim).between(F.col("low"), F.col("high"))).join(starts, "patch_id")
    return met.groupBy(*group, "chunk_min", "chunk_max", dim).agg(F.max_by("value", F.struct("starts", "patch_id")).alias("value"))


def whole_patches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames in which the rows of a patch follow each other, cut anew so that no patch lies in two of them."""
    held = []  # the last patch, which may go on in the next frame
    for x in frames:
        if x.empty:
            continue
        ids = x["patch_id"]
        begins = len(x) - int((ids == ids.iloc[-1]).sum())  # where the frame's last patch begins
        if begins or held and held[-1]["patch_id"].iloc[-1] != ids.iloc[0]:
            yield pd.concat([*held, x.iloc[:begins]] if begins else held, ignore_index=True)
            held = []
        held.append(x.iloc[begins:])
    if held:
        yield pd.concat(held, ignore_index=True)


@dataclass(frozen=True)
class Spool:
    """A catalog of patches in an order, and perhaps their cells (patch_id, ..., value).  Everything is lazy."""

    catalog: DataFrame
    order: tuple[str, ...] = ("time_min", "patch_id")
    cells: DataFrame | None = None

    def contents(self) -> DataFrame:
        """The catalog with `place`, from 0 in the spool's order."""
        return numbered(self.catalog, list(self.order), "place")

    def select(self, **wanted) -> Spool:
        """Catalog rows that match, their intervals cut; cells of what is left, within the intervals."""
        catalog = adjust_segments(self.catalog, **wanted)
        cells = self.cells
        if cells is not None:
            dims = [k for k in wanted if k not in self.catalog.columns and f"{k}_min" in self.catalog.columns and k in cells.columns]
            limits = catalog.select("patch_id", *(c for d in dims for c in (F.col(f"{d}_min").alias(f"_{d}_low"), F.col(f"{d}_max").alias(f"_{d}_high"))))
            cells = cells.join(limits, "patch_id")
            for d in dims:
                cells = cells.where(F.col(d).between(F.col(f"_{d}_low"), F.col(f"_{d}_high"))).drop(f"_{d}_low", f"_{d}_high")
        return replace(self, catalog=catalog.drop("modified"), cells=cells)

    def sort(self, name: str) -> Spool:
        """By an attribute, or the beginning of a dimension."""
        column = name if name in self.catalog.columns else f"{name}_min"
        if column not in self.catalog.columns:
            raise ParameterError(f"{name} is no column and no dimension")
        return replace(self, order=(column, *(c for c in ("time_min", "patch_id") if c != column and c in self.catalog.columns)))

    def __getitem__(self, wanted: int | slice | list[int]) -> Spool:
        place, n = F.col("place"), None
        if isinstance(wanted, int) and wanted >= 0:
            keep = place == wanted
        elif isinstance(wanted, list):
            n = self.catalog.count() if any(i < 0 for i in wanted) else 0
            keep = place.isin([i % n if i < 0 else i for i in wanted])
        else:
            n = self.catalog.count()
            r = range(*wanted.indices(n)) if isinstance(wanted, slice) else [wanted + n]
            keep = place.isin(list(r)) if not isinstance(r, range) else place.between(min(r, default=0), max(r, default=-1)) & ((place - (r[0] if len(r) else 0)) % abs(r.step) == 0)
        catalog = self.contents().where(keep).drop("place")
        cells = self.cells and self.cells.join(catalog.select("patch_id"), "patch_id", "left_semi")
        return replace(self, catalog=catalog, cells=cells)

    def __len__(self) -> int:
        return self.catalog.count()

    def names(self, prefix: str = "DAS", attrs: tuple[str, ...] = ("station", "tag")) -> DataFrame:
        parts = [F.coalesce(F.col(a).cast("string"), F.lit("")) for a in (*attrs, "time_min", "time_max")]
        return self.catalog.select("patch_id", F.concat_ws("__", F.lit(prefix), *parts).alias("name"))

    def split(self, size: int) -> DataFrame:
        return split(self.catalog, size, list(self.order))

    def chunk(self, dim: str, group: list[str], **options) -> DataFrame:
        return chunk(self.catalog, dim, group, **options)

    def map(self, function, schema: str, many: bool = False) -> DataFrame:
        """function(pandas frame of one patch's cells) -> pandas frame, for every patch.

        many: the function takes the cells of many patches at once, each patch whole and its rows together, and tells them
        apart by patch_id.  That spares small patches a call each, which takes longer than their work.  Integers come as
        floats where any of the frame is null.
        """
        if self.cells is None:
            raise ParameterError("the spool has no cells")
        own = self.cells.join(self.catalog.select("patch_id"), "patch_id", "left_semi")  # patches without cells are left out
        if not many:
            return own.groupBy("patch_id").applyInPandas(function, schema)
        # The count is dropped again: its window makes Spark bring a patch's rows to one task, together, whatever the join.
        counted = own.withColumn("_own_rows", F.count("*").over(Window.partitionBy("patch_id")))
        return counted.mapInPandas(lambda frames: (function(x) for x in whole_patches(f.drop(columns="_own_rows") for f in frames)), schema)

    def equals(self, other: Spool) -> bool:
        """The same catalog rows, as often, whatever the plans behind them."""
        if sorted(self.catalog.columns) != sorted(other.catalog.columns):
            return False
        right = other.catalog.select(*self.catalog.columns)
        return self.catalog.exceptAll(right).isEmpty() and right.exceptAll(self.catalog).isEmpty()


def spool(source, spark=None) -> Spool:
    """A spool as it is, of a catalog frame, or of the patches in a folder written by write_spool()."""
    if isinstance(source, Spool):
        return source
    if isinstance(source, DataFrame):
        return Spool(source)
    if isinstance(source, str) and spark is not None:
        return Spool(spark.read.parquet(f"{source}/catalog"), cells=spark.read.parquet(f"{source}/cells"))
    raise ParameterError("a spool is made of a spool, a catalog, or a folder and a session")


def write_spool(own: Spool, path: str, mode: str = "append") -> None:
    """Catalog and cells as Parquet; further spools are appended, and readers see them after the next read."""
    own.cells.sortWithinPartitions("patch_id").write.mode(mode).parquet(f"{path}/cells")
    own.catalog.write.mode(mode).parquet(f"{path}/catalog")
