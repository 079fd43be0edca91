"""Structured Streaming over folders of recordings: windowed chunks of what has arrived, and work for each new batch."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fiberlake.errors import ParameterError


def read(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """A stream of the files of a folder (or one file); timestamps carry a zone, as watermarks need."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    status = spark._jvm.org.apache.hadoop.fs.Path(path)
    is_folder = status.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(status).isDirectory()
    stream = reader.parquet(path) if is_folder else reader.option("pathGlobFilter", name).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def folder_for(spark: SparkSession) -> str:
    """A new folder in the one that the cluster shares (spark.checkpoint.dir); a local session may have one of its own."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ParameterError("spark.checkpoint.dir names no folder that all executors share")
        shared = tempfile.mkdtemp(prefix="fiberlake-stream-")
    return f"{shared}/stream-{uuid.uuid4().hex}"


def drain(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs the stream over all that is there; its result is a table of files, which the driver never holds.

    Every batch writes a folder of its own, over what an attempt before may have left; of a complete result the last
    batch is the table, of an appended one all of them.
    """
    spark, folder, batches = stream.sparkSession, folder_for(stream.sparkSession), []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")
        batches.append(number)

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    paths = [f"{folder}/batch={n}" for n in (sorted(set(batches))[-1:] if mode == "complete" else sorted(set(batches)))]
    return spark.read.schema(stream.schema).parquet(*paths) if paths else spark.createDataFrame([], stream.schema)


def tumbling(spark: SparkSession, path: str, length: str = "1 day", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Counts and sums for each window and event type."""
    events = read(spark, path).withWatermark("ts", late)
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    out = events.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return drain(out).select(F.unix_micros("w.start").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


def sessions(spark: SparkSession, path: str, gap: str, key: str, late: str = "1 day") -> DataFrame:
    """Runs of a key's events without longer gaps; only closed ones."""
    events = read(spark, path).withWatermark("ts", late)
    out = events.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return drain(out, "append").select(key, F.unix_micros("w.start").alias("start"), F.unix_micros("w.end").alias("end"), "n")


def for_new(spark: SparkSession, path: str, work: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """work(batch, number) for what arrived since the last call; the checkpoint remembers, across failures too."""
    query = read(spark, path).writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
