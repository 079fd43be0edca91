"""SimHash near-duplicate groups by tiled exact comparison.

A text's fingerprint is the bitwise majority of XXH64 (seed 42) over its word shingles.  Fingerprints that differ in
at most `radius` bits are linked; a group is what links connect.

Comparison is exact: fingerprints (each once) are laid out in tiles by the bit counts of their two halves.  The table
of counts has 33 x 33 cells at most, whatever the input, and is all the driver sees.  Tiles whose bit counts differ by
more than the radius are never paired.  Inside a pair, numpy compares blocks of equal quarter counts by exclusive-or
and bit count, again skipping blocks beyond the radius.  Each pair of tiles returns a spanning chain of the groups it
finds rather than all pairs.  Chains are joined by hooking to the smallest neighbour and pointer jumping.

Edge cases: a null text is empty; a text without words has fingerprint zero, linked like any other; fewer words than
a shingle has: the whole sequence; repeated rows share a fingerprint; a null doc_id gets a fingerprint and the
smallest doc_id of its group (null if the group has none); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiberlake.llm.common import Tables, slices, text_of

_STEP = 1 << 16


def fingerprint(text: str, words: int = 4) -> int:
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    size = min(words, len(tokens))
    joined = memoryview(b" ".join(tokens))
    bounds = np.cumsum([0, *(len(t) + 1 for t in tokens)])
    starts, ends = bounds[: len(tokens) - size + 1], bounds[size:] - 1
    bits, n = np.zeros(64, np.int64), len(starts)
    digest = xxhash.xxh64_intdigest
    for c in range(0, n, _STEP):
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts[c : c + _STEP].tolist(), ends[c : c + _STEP].tolist())], ">u8")
        bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > n).tobytes(), "big")


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "body", 1 << 22):
                found = np.array([fingerprint(t, words) for t in part.column("body").to_pylist()], np.uint64).view(np.int64)
                rest = [(n, part.column(n)) for n in part.schema.names if n != "body"]
                yield pa.RecordBatch.from_arrays([c for _, c in rest] + [pa.array(found)], names=[n for n, _ in rest] + ["fp"])

    return run


def _quarters(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint16).reshape(-1, 4)).astype(np.int16)


def linked(own: np.ndarray, other: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Chains over the groups that links from own (int64) to own and other make."""
    values = np.unique(np.concatenate([own, other])).view(np.uint64)
    quarters = _quarters(values)
    order = np.lexsort(quarters.T)
    values, quarters = values[order], quarters[order]
    cells, first, size = np.unique(quarters, axis=0, return_index=True, return_counts=True)
    by_place = np.argsort(first)
    cells, first, size = cells[by_place], first[by_place], size[by_place]
    mine = np.isin(values.view(np.int64), own)
    label, pairs = np.arange(len(values)), []
    for c in range(len(cells)):
        here = np.arange(first[c], first[c] + size[c])
        here = here[mine[here]]
        if not len(here):
            continue
        near = np.flatnonzero(np.abs(cells - cells[c]).sum(axis=1) <= radius)
        to = np.concatenate([np.arange(first[x], first[x] + size[x]) for x in near])
        for s in range(0, len(here), max(1, _STEP * 16 // len(to))):
            rows = here[s : s + max(1, _STEP * 16 // len(to))]
            i, j = np.nonzero(np.bitwise_count(values[rows][:, None] ^ values[to][None, :]) <= radius)
            i, j = rows[i], to[j]
            keep = i != j
            if keep.any():
                _merge(label, i[keep], j[keep])
    members = np.argsort(label, kind="stable")
    same = label[members][1:] == label[members][:-1]
    signed = values.view(np.int64)[members]
    return list(zip(signed[:-1][same].tolist(), signed[1:][same].tolist()))


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Labels become the smallest place that is connected; they always point at a root."""
    while True:
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            return
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def _tile_links(radius: int):
    def run(key, frame):
        import pandas as pd

        own = frame["fp"].to_numpy()[frame["own"].to_numpy()]
        return pd.DataFrame(linked(own, frame["fp"].to_numpy(), radius), columns=["a", "b"])

    return run


def near_links(fps: DataFrame, radius: int, tile: int) -> DataFrame:
    """(a, b): chains over groups of linked fingerprints.  fps: (fp), each once."""
    cell = fps.select("fp", F.bit_count(F.shiftrightunsigned("fp", 32)).alias("x"), F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).alias("y"))
    counts = {(r.x, r.y): r["count"] for r in cell.groupBy("x", "y").count().collect()}  # 33 x 33 rows at most
    spark = fps.sparkSession
    plan = []
    for (x, y), n in counts.items():
        near = [(u, v) for u, v in counts if abs(u - x) + abs(v - y) <= radius and (u, v) >= (x, y)]
        parts, shares = -(-n // tile), -(-sum(counts[c] for c in near) // (16 * tile))
        plan += [(u, v, x, y, parts, shares) for u, v in near]
    if not plan:
        return spark.createDataFrame([], "a long, b long")
    # where a fingerprint goes: to every tile near its own, there into one share of it; and into its own tile's part for each share
    plan = F.broadcast(spark.createDataFrame(plan, "x int, y int, tx int, ty int, parts long, shares long"))
    sent = cell.join(plan, ["x", "y"])
    share = F.pmod(F.xxhash64("fp"), F.col("shares"))
    others = sent.select("fp", "tx", "ty", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), share.alias("share"), F.lit(False).alias("own"))
    mine = sent.where("x = tx and y = ty").select("fp", "tx", "ty", F.pmod(F.xxhash64("fp", "x"), F.col("parts")).alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"), F.lit(True).alias("own"))
    return others.unionByName(mine).groupBy("tx", "ty", "part", "share").applyInPandas(_tile_links(radius), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the smallest node that is connected.

    Each round hooks every root to its smallest neighbouring root, jumps pointers until they rest, and contracts the
    links; roots at least halve.  Rounds are cut by written tables.
    """
    tables = Tables(links.sparkSession)
    edges = tables.put("edges", links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    known = None
    while not edges.isEmpty():
        hooks = tables.put("hooks", edges.groupBy("a").agg(F.min("b").alias("b")))
        while True:
            up = hooks.select(F.col("a").alias("b"), F.col("b").alias("c"))
            hooks = tables.put("hooks", hooks.select("a", "b").join(up, "b", "left").select("a", F.coalesce("c", "b").alias("b"), F.col("c").isNotNull().alias("moved")))
            if hooks.where("moved").isEmpty():
                break
        if known is None:
            known = tables.put("known", hooks.select(F.col("a").alias("node"), F.col("b").alias("root")))
        else:
            step = hooks.select(F.col("a").alias("root"), F.col("b").alias("to"))
            fresh = hooks.select(F.col("a").alias("node"), F.col("b").alias("root")).join(known.select("node"), "node", "left_anti")
            known = tables.put("known", known.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root")).unionByName(fresh))
        for end in ("a", "b"):
            step = hooks.select(F.col("a").alias(end), F.col("b").alias("to"))
            edges = edges.join(step, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        edges = tables.put("edges", edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    if known is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    roots = known.select("root").distinct().select(F.col("root").alias("node"), "root")
    return known.unionByName(roots.join(known.select("node"), "node", "left_anti"))


def simhash_groups(docs: DataFrame, words: int = 4, radius: int = 4, tile: int = 16384, columns: tuple[str, ...] = (), keep_text: bool = False) -> DataFrame:
    """doc_id, the named further columns, fp (long), fingerprint (16 hex digits) and component_id."""
    rest = [F.col(c) for c in columns if c not in ("doc_id", "text")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *rest, text_of().alias("body"), *([F.col("text")] if keep_text else []))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "body") + ", fp long"
    rows = rows.mapInArrow(_fingerprints(words), shape).persist(StorageLevel.DISK_ONLY)
    each = rows.groupBy("fp").agg(F.min("doc_id").alias("least")).persist(StorageLevel.DISK_ONLY)
    found = components(near_links(each.select("fp"), radius, tile))
    named = each.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.select("fp", "root").join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").withColumn("fingerprint", F.lower(F.lpad(F.hex("fp"), 16, "0")))
