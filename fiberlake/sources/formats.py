"""File formats: Parquet for patches, SEG-Y (read, scan, write), RSF and WAV (write), and a registry that tells formats.

Foreign files are read as `traces`: file, channel, time_min (microseconds since 1970), time_step (microseconds) and
samples.  A file is read or written whole by one task, through a temporary name, so a task that is run again does no
harm; folders for writing have to be shared by all executors.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fiberlake.errors import ParameterError, PatchDimError, UnknownFormatError
from fiberlake.operators import selecting, windows
from fiberlake.patch import Coord, Patch

TRACES = "file string, channel long, time_min long, time_step double, samples array<double>"
CATALOG = "file string, format string, version string, channels long, time_min long, time_max long, time_step double"


@dataclass(frozen=True)
class Format:
    """sniff gives a version or None; header gives (channels, time_min, time_step, samples); traces gives rows."""

    name: str
    extensions: tuple[str, ...]
    sniff: Callable[[bytes], str | None]
    header: Callable[[bytes], tuple[int, int, float, int]]
    traces: Callable[[bytes], Iterator[tuple[int, int, float, np.ndarray]]]


# SEG-Y
_SEGY_TYPES = {2: ">i4", 3: ">i2", 5: ">f4", 6: ">f8", 8: ">i1"}  # 1 is the old hexadecimal float


def _segy_head(b: bytes) -> tuple[int, int, int]:
    """(interval, samples, code) of the binary header."""
    return (*struct.unpack_from(">h", b, 3216), *struct.unpack_from(">h", b, 3220), *struct.unpack_from(">h", b, 3224))


def segy_sniff(b: bytes) -> str | None:
    if len(b) < 3600:
        return None
    interval, samples, code = _segy_head(b)
    traces, extra = struct.unpack_from(">hh", b, 3212)
    major, minor = b[3500], b[3501]
    (fixed,) = struct.unpack_from(">h", b, 3502)
    fine = interval >= 0 and samples > 0 and 1 <= code <= 16 and traces >= 0 and extra >= 0
    return f"{major}.{minor}" if fine and major <= 3 and minor in (0, 1, 2, 3, 100) and fixed in (0, 1) else None


def hexadecimal_floats(raw: bytes) -> np.ndarray:
    """Sign, power of 16 (less 64) and a fraction of 24 bits."""
    u = np.frombuffer(raw, ">u4").astype(np.int64)
    return np.where(u >> 31, -1.0, 1.0) * ((u & 0xFFFFFF) / 2.0**24) * 16.0 ** (((u >> 24) & 0x7F) - 64)


def _segy_layout(b: bytes) -> tuple[int, int, int]:
    _, samples, code = _segy_head(b)
    if code != 1 and code not in _SEGY_TYPES:
        raise UnknownFormatError(f"samples of code {code}")
    width = 4 if code == 1 else np.dtype(_SEGY_TYPES[code]).itemsize
    return samples, code, 240 + samples * width


def _segy_start(b: bytes, at: int) -> tuple[int, float]:
    year, day, hour, minute, second = struct.unpack_from(">5h", b, at + 156)
    start = dt.datetime(max(year, 1), 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(days=max(day, 1) - 1, hours=hour, minutes=minute, seconds=second)
    (interval,) = struct.unpack_from(">h", b, at + 116)
    return (start - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1), float(interval or _segy_head(b)[0])


def segy_header(b: bytes) -> tuple[int, int, float, int]:
    samples, _, size = _segy_layout(b)
    channels = (len(b) - 3600) // size
    return (channels, *(_segy_start(b, 3600) if channels else (0, float(_segy_head(b)[0]))), samples)


def segy_traces(b: bytes) -> Iterator[tuple[int, int, float, np.ndarray]]:
    samples, code, size = _segy_layout(b)
    for i in range((len(b) - 3600) // size):
        at = 3600 + i * size
        raw = b[at + 240 : at + size]
        yield (i, *_segy_start(b, at), hexadecimal_floats(raw) if code == 1 else np.frombuffer(raw, _SEGY_TYPES[code]).astype(float))


def segy_bytes(data: np.ndarray, start: int, step: float) -> bytes:
    """Version 1.0 with big-endian floats; starts are cut to seconds."""
    channels, samples = data.shape
    if not 0 < samples < 2**15 or step != int(step) or not 0 < step < 2**15:
        raise ParameterError("SEG-Y holds up to 32,767 samples a trace, and steps of whole microseconds up to 32,767")
    head = bytearray(400)
    struct.pack_into(">h", head, 12, channels if channels < 2**15 else 0)
    struct.pack_into(">h", head, 16, int(step))
    struct.pack_into(">h", head, 20, samples)
    struct.pack_into(">h", head, 24, 5)
    struct.pack_into(">BBh", head, 300, 1, 0, 1)
    when = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(microseconds=start)
    parts = [" ".encode("cp037") * 3200, bytes(head)]
    for i, row in enumerate(data):
        own = bytearray(240)
        struct.pack_into(">i", own, 0, i + 1)
        struct.pack_into(">hh", own, 114, samples, int(step))
        struct.pack_into(">5h", own, 156, when.year, when.timetuple().tm_yday, when.hour, when.minute, when.second)
        parts += [bytes(own), row.astype(">f4").tobytes()]
    return b"".join(parts)


def rsf_bytes(data: np.ndarray, start: int, step: float) -> bytes:
    """Header and native floats in one file; time runs fastest and starts at 0, its real start has an entry of its own."""
    lines = ["fiberlake", 'data_format="native_float"', "esize=4", f"n1={data.shape[1]}", "o1=0.0", f"starttime={start / 1e6}", f"d1={step / 1e6}", 'label1="time"', 'unit1="s"', f"n2={data.shape[0]}", "o2=0", "d2=1", 'label2="channel"', 'unit2=""', 'in="stdin"']
    return ("\n".join(lines) + "\n\n").encode() + data.astype("=f4").tobytes()


def wav_bytes(data: np.ndarray, start: int, step: float) -> bytes:
    """Floats of 32 bits, channels interleaved, at a whole sampling rate."""
    rate, channels, body = round(1e6 / step), data.shape[0], data.T.astype("<f4").tobytes()
    form = struct.pack("<HHIIHH", 3, channels, rate, rate * channels * 4, channels * 4, 32)
    return b"RIFF" + struct.pack("<I", 4 + 8 + len(form) + 8 + len(body)) + b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(body)) + body


FORMATS: dict[str, Format] = {}
WRITERS: dict[str, Callable[[np.ndarray, int, float], bytes]] = {"segy": segy_bytes, "rsf": rsf_bytes, "wav": wav_bytes}


def register(f: Format) -> None:
    FORMATS[f.name] = f


register(Format("segy", ("segy", "sgy"), segy_sniff, segy_header, segy_traces))


def get_format(head: bytes, file: str = "", formats: tuple[Format, ...] | None = None) -> tuple[Format, str] | None:
    """The first format that knows the bytes; those with the file's extension are asked first."""
    ext = file.rsplit(".", 1)[-1].lower()
    for f in sorted(formats or FORMATS.values(), key=lambda f: ext not in f.extensions):
        version = f.sniff(head)
        if version is not None:
            return f, version
    return None


def _files(spark: SparkSession, path: str, pattern: str | None, modified_after: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    for name, v in (("pathGlobFilter", pattern), ("modifiedAfter", modified_after)):
        reader = reader.option(name, v) if v else reader
    return reader.load(path).select(F.col("path").alias("file"), "content")


def scan(spark: SparkSession, path: str, pattern: str | None = None, modified_after: str | None = None) -> DataFrame:
    """A catalog of the files that some format knows; others are left out."""
    known = tuple(FORMATS.values())

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for file, b in zip(batch["file"], batch["content"]):
                found = get_format(b, file, known)
                if found:
                    channels, start, step, n = found[0].header(b)
                    out.append((file, found[0].name, found[1], channels, start, start + round((n - 1) * step), step))
            yield pd.DataFrame(out, columns=["file", "format", "version", "channels", "time_min", "time_max", "time_step"])

    return _files(spark, path, pattern, modified_after).mapInPandas(rows, CATALOG)


def read(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Traces of all files that some format knows; a file that none knows is an error."""
    known = tuple(FORMATS.values())

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, b in zip(batch["file"], batch["content"]):
                found = get_format(b, file, known)
                if not found:
                    raise UnknownFormatError(file)
                traces = found[0].traces(b)
                while part := [t for _, t in zip(range(256), traces)]:
                    yield pd.DataFrame([(file, *t) for t in part], columns=["file", "channel", "time_min", "time_step", "samples"])

    return _files(spark, path, pattern, None).mapInPandas(rows, TRACES)


def to_patch(traces: DataFrame, file: str) -> Patch:
    """One file's traces as a patch of channel and time (seconds)."""
    own = traces.where(F.col("file") == file)
    first = own.agg(F.min("time_min").alias("start"), F.min("time_step").alias("step"), F.max(F.size("samples")).alias("n"), F.count("*").alias("channels")).first()
    if not first.channels:
        raise ParameterError(f"no trace of {file}")
    coord = Coord(first.n, first.start / 1e6, first.step / 1e6, "s")
    df = own.select("channel", F.col("channel").alias("channel_idx"), F.posexplode("samples").alias("time_idx", "value"))
    df = df.withColumn("time_idx", F.col("time_idx").cast("long")).withColumn("time", selecting.label(coord, "time"))
    return Patch.from_cells(df, ("channel", "time"), {"channel": Coord(first.channels), "time": coord})


def to_traces(patch: Patch, file: str) -> DataFrame:
    """A patch of time (seconds) and one other dimension, whose indices become channels; missing samples are NaN."""
    if len(patch.dims) != 2 or "time" not in patch.dims:
        raise PatchDimError("time and one other dimension are needed")
    (other,), coord = patch.others("time"), patch.coords["time"]
    value = F.coalesce("value", F.lit(float("nan"))).alias("value")
    rows = patch.df.groupBy(F.col(f"{other}_idx").alias("channel")).agg(F.array_sort(F.collect_list(F.struct("time_idx", value))).alias("t"))
    return rows.select(F.lit(file).alias("file"), "channel", F.lit(round(coord.start * 1e6)).cast("long").alias("time_min"), F.lit(round(coord.step * 1e6, 6)).cast("double").alias("time_step"), F.col("t.value").alias("samples"))


def _write_group(group: pd.DataFrame, folder: str, encode: Callable[[np.ndarray, int, float], bytes], ext: str) -> pd.DataFrame:
    group = group.sort_values("channel")
    b = encode(np.stack(group["samples"].to_list()), int(group["time_min"].min()), float(group["time_step"].iloc[0]))
    name = os.path.join(folder, f"{group['file'].iloc[0]}.{ext}")
    os.makedirs(os.path.dirname(name), exist_ok=True)
    temporary = f"{name}.{uuid.uuid4().hex}.part"
    with open(temporary, "wb") as out:
        out.write(b)
    os.replace(temporary, name)
    return pd.DataFrame({"file": [name], "bytes": [len(b)]})


def write(traces: DataFrame, folder: str, fmt: str) -> DataFrame:
    """A lazy frame (file, bytes); files are written when it is run."""
    if fmt not in WRITERS:
        raise UnknownFormatError(f"{fmt} is none of " + ", ".join(WRITERS))
    encode = WRITERS[fmt]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return _write_group(group, folder, encode, fmt)

    return traces.groupBy("file").applyInPandas(run, "file string, bytes long")


def write_wav(patch: Patch, folder: str, name: str, separate: bool = False) -> DataFrame:
    """Detrended and scaled to 1; one file of all channels, or one for each."""
    even = windows.normalize(windows.detrend(patch, "time"), "time", "max")
    traces = to_traces(even.new(even.df.withColumn("value", F.coalesce("value", F.lit(0.0)))), name)
    if separate:
        traces = traces.withColumn("file", F.concat_ws("_", "file", F.col("channel").cast("string")))
    return write(traces, folder, "wav")


def write_patch(patch: Patch, path: str) -> None:
    """Cells as Parquet, sorted so that ranges skip row groups, and one row of metadata."""
    meta = {"dims": patch.dims, "coords": {k: asdict(c) for k, c in patch.coords.items()}, "attrs": patch.attrs, "history": patch.history}
    patch.df.sortWithinPartitions(*(f"{d}_idx" for d in patch.dims)).write.mode("overwrite").parquet(f"{path}/cells")
    spark = patch.df.sparkSession
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def read_patch(spark: SparkSession, path: str, **ranges: tuple[float | None, float | None]) -> Patch:
    """Ranges of labels become filters on indices that reach the scan."""
    meta = json.loads(spark.read.parquet(f"{path}/meta").first().meta)
    patch = Patch(spark.read.parquet(f"{path}/cells"), tuple(meta["dims"]), {k: Coord(**c) for k, c in meta["coords"].items()}, meta["attrs"], tuple(meta["history"]))
    for dim, (low, high) in ranges.items():
        patch = selecting.select(patch, dim, low, high)
    return patch
