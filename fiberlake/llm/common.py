"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a missing doc_id where rows are keyed; the result still shows null.
NO_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def keyed(docs: DataFrame, *extra: Column) -> DataFrame:
    """(doc_id, did, rid, text, extra...): did and rid together name a row by its id and its whole text.

    Rows that repeat both are the same document several times; whatever is worked out for the key holds for each.
    """
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), *extra)
    return out.withColumn("did", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("rid", F.xxhash64("did", "text"))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster names its shared folder in spark.checkpoint.dir.

    Only a local session (one machine, as in tests) gets a folder of its own where that is unset; on a cluster that is
    an error, since executors share no temporary folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="fiberlake-checkpoint-"))


class Tables:
    """Tables written as Parquet to the folder that the cluster shares, so that a job goes on from files.

    Unlike a checkpoint, what is read again has its real size: the size that Spark expects of a join is the product of
    its sides', and in rounds of joins over checkpoints that number gets longer than anything can be planned with.
    A name that is written again replaces its table; the last one of each name stays, for frames that still read it.
    """

    def __init__(self, spark: SparkSession):
        ensure_checkpoint_dir(spark)
        self.spark, self.folder = spark, f"{spark.sparkContext.getCheckpointDir()}/tables-{uuid.uuid4().hex}"
        self.turns: dict[str, int] = {}

    def put(self, name: str, frame: DataFrame) -> DataFrame:
        turn = self.turns[name] = self.turns.get(name, 0) + 1
        frame.write.parquet(f"{self.folder}/{name}-{turn}")
        if turn > 1:
            self.drop(name, turn - 1)
        return self.spark.read.schema(frame.schema).parquet(f"{self.folder}/{name}-{turn}")

    def drop(self, name: str, turn: int | None = None) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}-{turn or self.turns[name]}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(batch: pa.RecordBatch, column: str, limit: int):
    """Runs of rows of a batch whose texts have about `limit` bytes together; a longer text stands alone."""
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < len(lengths):
        yield batch.slice(start)


def bounded_batches(spark: SparkSession) -> None:
    """Texts go to Python in Arrow batches of about 4 MB, unless the session already says how large a batch may be.

    A batch stands in the JVM's memory outside its heap, twice while it grows, and in the worker's.  Frames are planned
    when they are used, so the setting stays with the session; it changes no result.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The same function, after which its process returns what it has freed to the system.

    Spark keeps its Python workers for later tasks, and an executor's memory is that of all its workers together.
    """

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
                trim(0)

    return out
