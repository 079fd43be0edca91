"""Gaps in sorted coordinates and ranges without outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gaps(df: DataFrame, keys: list[str], column: str, factor: float) -> DataFrame:
    """Each key's labels followed by a distance over factor times the key's median distance: keys, column, following."""
    after = F.lead(column).over(Window.partitionBy(*keys).orderBy(column))
    steps = df.select(*keys, column).withColumn("following", after).where(F.col("following").isNotNull())
    usual = steps.groupBy(*keys).agg(F.median(F.col("following") - F.col(column)).alias("usual"))
    found = steps.join(usual, keys).where(F.col("following") - F.col(column) > F.col("usual") * factor)
    return found.select(*keys, column, "following")


def fence(column: str | Column, multiplier: float = 1.5) -> tuple[Column, Column]:
    """Aggregates: quartiles widened by multiplier times their distance, within the data's range."""
    c = F.col(column) if isinstance(column, str) else column
    low, high = F.percentile(c, 0.25), F.percentile(c, 0.75)
    wide = (high - low) * multiplier
    return F.greatest(low - wide, F.min(c)), F.least(high + wide, F.max(c))
