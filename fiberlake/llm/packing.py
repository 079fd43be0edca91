"""Conflict-constrained best-fit packing of documents into bins of words.

A document longer than a bin is cut into pieces of a bin's length and a rest.  Items are dealt to shards of bounded
size by a hash; each shard packs its items, longest first, by best fit: bins stand in the order of their residuals,
and from the successor of the item's length the search goes on to the next larger residual until the bin's source
bitmap and duplicate-cluster bitmap allow the item.  If none does, a bin is opened.  A bin never holds two items of one
source, nor two of one duplicate cluster.

Edge cases: null or empty texts (no words) have no place in a bin: bin_id is null and n_words 0.  A null source
conflicts with nothing.  Rows that repeat doc_id, text and source are counted, told apart by `copy` and packed as often
as they occur.  Null doc_ids stay null.  Extra columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiberlake.llm.common import keyed

SPACE = r"[\x20\x09-\x0D]+"
_BINS = 1 << 24


def words_of(text: str) -> Column:
    return F.size(F.filter(F.split(F.col(text), SPACE), lambda w: w != "")).cast("long")


def cluster_of(text: str) -> Column:
    """Texts equal but for case and spacing are copies."""
    return F.xxhash64(F.regexp_replace(F.trim(F.lower(text)), SPACE, " "))


def best_fit(lengths: list[int], sources: list[int | None], clusters: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item; items come longest first."""
    source_bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(s for s in sources if s is not None))}
    cluster_bit = {c: 1 << i for i, c in enumerate(dict.fromkeys(clusters))}
    order: list[tuple[int, int]] = []  # (residual, bin)
    held_sources: list[int] = []
    held_clusters: list[int] = []
    out = []
    for n, source, cluster in zip(lengths, sources, clusters):
        s, c = source_bit.get(source, 0), cluster_bit[cluster]
        at = bisect_left(order, (n, -1))
        while at < len(order) and (held_sources[order[at][1]] & s or held_clusters[order[at][1]] & c):
            at += 1
        if at < len(order):
            room, b = order.pop(at)
        else:
            room, b = capacity, len(held_sources)
            held_sources.append(0)
            held_clusters.append(0)
        out.append((b, capacity - room))
        held_sources[b] |= s
        held_clusters[b] |= c
        if room > n:
            insort(order, (room - n, b))
    return out


def best_fit_pack(docs: DataFrame, capacity: int = 2048, shard_items: int = 4096) -> DataFrame:
    """bin_id, place (the item's first word in its bin), doc_id, copy, piece, start (its first word in the text), n_words, source."""
    rows = keyed(docs, F.col("source").cast("string").alias("source"))
    rows = rows.select("doc_id", "did", "rid", "source", words_of("text").alias("words"), cluster_of("text").alias("cluster"))
    rows = rows.groupBy("doc_id", "did", "rid", "source", "words", "cluster").agg(F.count("*").alias("n"))
    items = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).persist(StorageLevel.DISK_ONLY)
    total = items.agg(F.sum(F.ceil(F.col("words") / capacity))).first()[0] or 0
    shards = max(1, -(-int(total) // shard_items))
    pieces = items.where("words > 0").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("words") - 1) / capacity))))
    pieces = pieces.withColumn("start", F.col("piece") * capacity).withColumn("n_words", F.least(F.lit(capacity), F.col("words") - F.col("start")))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("did", "rid", "copy", "piece"), F.lit(shards)))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n_words", "did", "rid", "source", "copy", "piece"], ascending=[False] + [True] * 5, kind="stable", na_position="first")
        sources = [None if pd.isna(s) else s for s in frame["source"]]
        placed = best_fit(frame["n_words"].tolist(), sources, frame["cluster"].tolist(), capacity)
        frame["bin_id"] = [shard * _BINS + b for shard, (b, _) in zip(frame["shard"].tolist(), placed)]
        frame["place"] = [p for _, p in placed]
        return frame[["bin_id", "place", "did", "copy", "piece", "start", "n_words", "source"]]

    shape = "bin_id long, place long, did long, copy long, piece long, start long, n_words long, source string"
    packed = pieces.select("shard", "did", "rid", "copy", "piece", "start", "n_words", "source", "cluster").groupBy("shard").applyInPandas(pack, shape)
    empty = items.where("words = 0").select(F.lit(None).cast("long").alias("bin_id"), F.lit(0).cast("long").alias("place"), "did", "copy", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("n_words"), "source")
    out = packed.unionByName(empty)
    doc_id = F.when(F.col("did") != F.lit(-(2**63)), F.col("did")).alias("doc_id")
    return out.select("bin_id", "place", doc_id, "copy", "piece", "start", "n_words", "source")
