"""Suffix-array deduplication by longest-previous-factor arrays.

Each byte covered by a string of `min_bytes` that starts anywhere else too is removed; `keep="none"` removes every
occurrence, `keep="first"` leaves the first one (by doc_id, then row key, then offset).

How it spreads out.  A window of `min_bytes` is represented by the smallest hash among its k-grams (its anchor), so
equal windows have equal anchors at equal offsets.  Consecutive windows with the same anchor form a run; the bytes
that the run's windows cover are its context.

1. Every run emits (anchor, digest of its context).  Equal contexts are aggregated before the shuffle into one, with a
   count and its first place: to each of its copies the one before is a previous factor as long as the context.
2. Contexts that share an anchor but differ (the borders of copies) send one copy of their bytes to their anchor's
   group.  Groups are packed into blocks of bounded size; each block gets a suffix array (prefix doubling), capped
   LCPs and the longest-previous-factor array from previous and next smaller positions (for keep="none", that of
   larger positions too: the first of several has a later match only).
3. A group of more than `max_group` different contexts, or a MB of them, (a passage that a large share of all documents
   holds, in as many surroundings) fits into no block, so its suffixes are dealt out before they are compared: only
   suffixes with the same first `min_bytes` bytes can have a factor of that length, and they meet by a digest of these
   bytes, aggregated before the shuffle, with the smallest position of the class.  Left out are windows whose core, the
   bytes that all windows at about their distance from the anchor have, occurs once.

Edge cases: a null text is empty; texts shorter than `min_bytes` are kept whole; a repeated row is another document;
rows that repeat both doc_id and text get the same answer, and count as one place for keep="first"; a null doc_id
stays null; extra columns are ignored.  Very long texts are cut into pieces whose windows don't overlap.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiberlake.llm.common import bounded_batches, ensure_checkpoint_dir, keyed, lean, slices

#: Bytes of text that are worked on at once; their arrays take some sixty times as much.
_PIECE = 1 << 18
_ODD = 0x9E3779B97F4A7C15 | 1
_WORD = (1 << 64) - 1
_BYTES = np.frombuffer(b"".join(hashlib.blake2b(bytes([b]), digest_size=8).digest() for b in range(256)), np.uint64)


class _Powers:
    """Powers of the multiplier and of its inverse, as far as asked for."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            steps = np.full((2, n + 1), _ODD, np.uint64)
            steps[1] = pow(_ODD, -1, 1 << 64)
            steps[:, 0] = 1
            cls.up, cls.down = steps.cumprod(axis=1, dtype=np.uint64)
        return cls.up[:n], cls.down[:n]


def _kgram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    up, down = _Powers.to(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up, out=sums[1:])
    h = (sums[k:] - sums[:-k]) * down[: len(data) - k + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x)
    blocks = -(-n // w)
    padded = np.full(blocks * w, _WORD, np.uint64)
    padded[:n] = x
    grid = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def runs(data: np.ndarray, first: np.ndarray, last: np.ndarray, size: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of the run's first window, of its last, anchor) for pieces [first, last) of data; windows stay in their piece."""
    if len(data) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = _kgram_hashes(data, k)
    low = np.uint64((1 << 21) - 1)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    at = (_sliding_min(key, size - k + 1) & low).astype(np.int64)
    full = last - first >= size
    first, final = first[full], last[full] - size
    begins = np.zeros(len(at) + 1, bool)
    begins[1:-1] = at[1:] != at[:-1]
    begins[first] = True
    begins[final + 1] = True
    inside = np.zeros(len(at) + 1, np.int64)
    np.add.at(inside, first, 1)
    np.add.at(inside, final + 1, -1)
    inside = inside.cumsum() > 0
    marks = np.flatnonzero(begins)
    lo, hi = marks[:-1], marks[1:] - 1
    good = inside[lo]
    lo, hi = lo[good], hi[good]
    return lo, hi, h[at[lo]].view(np.int64)


def _anchors(size: int, k: int):
    longest = max(_PIECE, 4 * size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _PIECE):
                did, rid = (part.column(c).to_numpy() for c in ("did", "rid"))
                texts = [t.encode() for t in part.column("text").to_pylist()]
                if len(texts) == 1 and len(texts[0]) > longest:
                    whole = texts[0]
                    step = longest - size + 1
                    pieces = [(whole[c : c + longest], c) for c in range(0, max(1, len(whole) - size + 1), step)]
                    for piece, offset in pieces:
                        yield from _emit(piece, [0, len(piece)], did, rid, offset)
                else:
                    yield from _emit(b"".join(texts), np.cumsum([0, *map(len, texts)]), did, rid, 0)

    def _emit(data: bytes, bounds, did, rid, offset: int):
        bounds = np.asarray(bounds, np.int64)
        lo, hi, anchor = runs(np.frombuffer(data, np.uint8), bounds[:-1], bounds[1:], size, k)
        if not len(lo):
            return
        digest, view = hashlib.blake2b, memoryview(data)
        context = np.frombuffer(b"".join([digest(view[a : b + size], digest_size=8).digest() for a, b in zip(lo.tolist(), hi.tolist())]), np.int64)
        doc = np.searchsorted(bounds, lo, side="right") - 1
        shift = offset - bounds[doc]
        arrays = [did[doc], rid[doc], anchor, context, lo + shift, hi + shift]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in arrays], names=["did", "rid", "anchor", "context", "lo", "hi"])

    return run


def suffix_ranks(data: np.ndarray, ends: np.ndarray, length: int) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 5, 10, 20 ... bytes, up to `length` at least; none looks past its end in `ends`.

    A rank is the number of smaller suffixes, so that suffixes which no other equals keep theirs and need no more
    sorting.  A pair of ranks and the position share one 64-bit word: a plain sort of words does.
    """
    n = len(data)
    bits = int(n + 1).bit_length()
    if bits > 21:
        raise ValueError("a block has 2^21 bytes at most")
    here, shift, low = np.arange(n), np.uint64(bits), np.uint64((1 << bits) - 1)
    padded = np.zeros(n + 4, np.uint64)
    padded[:n] = data
    padded[:n] += np.uint64(1)
    code = padded[:n].copy()
    for j in range(1, 5):  # bytes count from 1, and 0 is past the end
        code *= np.uint64(257)
        code += np.where(here + j < ends, padded[j : n + j], np.uint64(0))
    code <<= shift  # in place from here on: a block's arrays are most of a worker's memory
    code |= here.view(np.uint64)
    code.sort()
    at = (code & low).view(np.int64)
    code >>= shift
    words = code
    del padded, code, here
    rank, h, levels = np.empty(n, np.int64), 5, []
    head = np.concatenate([[True], words[1:] != words[:-1]])
    rank[at] = np.flatnonzero(head)[head.cumsum() - 1]
    while True:
        levels.append(rank.astype(np.int32))
        # `at` is in the order of ranks; those alone in their class are done
        alone = head & np.concatenate([head[1:], [True]])
        at = at[~alone]
        if h >= length:
            return levels
        rank, beyond = rank.copy(), at + h
        fits = beyond < ends[at]
        after = np.where(fits, rank[np.where(fits, beyond, 0)] + 1, 0)
        words = rank[at].view(np.uint64)
        words <<= shift + shift
        words |= after.view(np.uint64) << shift
        words |= at.view(np.uint64)
        del beyond, fits, after
        words.sort()
        at = (words & low).view(np.int64)
        words >>= shift
        head = np.concatenate([[True], words[1:] != words[:-1]])[: len(at)]
        old = (words >> shift).astype(np.int64)
        first = np.concatenate([[True], old[1:] != old[:-1]])[: len(at)]
        place = np.arange(len(at))
        rank[at] = old + place[head][head.cumsum() - 1] - place[first][first.cumsum() - 1] if len(at) else 0
        h *= 2


def longest_previous_factors(data: np.ndarray, ends: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For the suffixes at `starts` (ascending): the longest match at an earlier one, and at a later one.

    Lengths are exact up to `length`, and at least `length` where they are longer.  The first array comes from the
    previous and next smaller positions in suffix order, the second from the larger ones.
    """
    levels = suffix_ranks(data, ends, length)
    order = np.argsort(levels[-1][starts], kind="stable")
    sa = starts[order]
    lcp = np.zeros(len(sa) + 1, np.int64)
    if len(sa) > 1:
        a, b = sa[:-1], sa[1:]
        got = np.zeros(len(a), np.int64)
        for level in range(len(levels) - 1, -1, -1):
            h = 5 << level
            x, y = a + got, b + got
            ok = (x + h <= ends[a]) & (y + h <= ends[b]) & (got < length)
            x, y = np.where(ok, x, 0), np.where(ok, y, 0)
            got[ok & (levels[level][x] == levels[level][y])] += h
        for _ in range(4):  # the last bytes, one by one
            x, y = a + got, b + got
            ok = (x < ends[a]) & (y < ends[b]) & (got < length)
            same = ok & (data[np.where(ok, x, 0)] == data[np.where(ok, y, 0)])
            if not same.any():
                break
            got[same] += 1
        lcp[1:-1] = got
    previous, following = np.zeros(len(sa), np.int64), np.zeros(len(sa), np.int64)
    for out, place in ((previous, sa), (following, -sa)):
        out[order] = np.maximum(_smaller(place, lcp[:-1]), _smaller(place[::-1], lcp[1:][::-1])[::-1])
    return previous, following


def _smaller(sa: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each rank, the least LCP on the way back to the nearest rank with a smaller position; 0 if there is none.

    lcp[r] is shared by ranks r-1 and r.  Pointers jump over what is known to be larger, all ranks at once.
    """
    at = np.arange(len(sa)) - 1
    least = lcp.copy()
    todo = np.flatnonzero(at >= 0)
    while True:
        todo = todo[(at[todo] >= 0)]
        todo = todo[sa[at[todo]] > sa[todo]]
        if not len(todo):
            break
        to = at[todo]
        new_at, new_least = at[to], np.minimum(least[todo], least[to])
        at[todo], least[todo] = new_at, new_least
    return np.where(at >= 0, least, 0)


def _contexts(size: int):
    """Cuts the contexts that a group asks for out of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _PIECE):
                rows = []
                for did, rid, text, wanted in zip(*(part.column(c).to_pylist() for c in ("did", "rid", "text", "wanted"))):
                    data = text.encode()
                    rows += [(did, rid, w["anchor"], w["lo"], w["hi"], w["large"], data[w["lo"] : w["hi"] + size]) for w in wanted]
                if rows:
                    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.binary()]
                    names = ["did", "rid", "anchor", "lo", "hi", "large", "bytes"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return run


def _block_factors(size: int, first: bool, block_bytes: int = 1 << 17):
    """Suffix arrays over blocks of whole groups; rows come sorted by anchor, did, rid, lo."""

    def solve(rows: list[tuple]) -> pa.RecordBatch | None:
        data = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
        sizes = np.array([len(r[5]) for r in rows])
        stops = sizes.cumsum()
        begins = stops - sizes
        ends = np.repeat(stops, sizes)
        windows = sizes - size + 1
        starts = np.repeat(begins - np.concatenate([[0], windows.cumsum()[:-1]]), windows) + np.arange(windows.sum())
        previous, following = longest_previous_factors(data, ends, starts, size)
        hit = (previous if first else np.maximum(previous, following)) >= size
        if not hit.any():
            return None
        owner = np.repeat(np.arange(len(rows)), windows)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
        # a run of hits may pass from one context into the next: cut there
        begin, stop = edge[::2], edge[1::2]
        cuts = np.flatnonzero(hit[1:] & hit[:-1] & (owner[1:] != owner[:-1])) + 1
        begin, stop = np.sort(np.concatenate([begin, cuts])), np.sort(np.concatenate([stop, cuts]))
        who = owner[begin]
        base = np.array([r[3] for r in rows])[who] - begins[who]
        did, rid = (np.array([r[i] for r in rows], np.int64)[who] for i in (1, 2))
        arrays = [did, rid, starts[begin] + base, starts[stop - 1] + base]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in arrays], names=["did", "rid", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, begun = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "did", "rid", "lo", "hi", "bytes"))):
                if row[0] != begun:
                    if held >= block_bytes:
                        if (out := solve(rows)) is not None:
                            yield out
                        rows, held = [], 0
                    begun = row[0]
                rows.append(row)
                held += len(row[5])
        if rows and (out := solve(rows)) is not None:
            yield out

    return run


def _cells(size: int, k: int, width: int):
    """Windows of contexts in groups too large for one task, in cells of `width` by their distance from the anchor.

    Equal windows lie in the same cell, and each window holds the core of its cell: the bytes that any window there has.
    So a window can only be repeated if its core is.  A row has the bytes of a context's windows in one cell.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in range(0, batch.num_rows, 2000):
                rows = []
                for did, rid, anchor, lo, data in zip(*(batch.slice(c, 2000).column(x).to_pylist() for x in ("did", "rid", "anchor", "lo", "bytes"))):
                    h, last = _kgram_hashes(np.frombuffer(data[:size], np.uint8), k), len(data) - size
                    at = int(np.argmin(h & ~np.uint64((1 << 21) - 1)))  # where the anchor of all windows starts
                    for cell in range((at - last) // width, at // width + 1):
                        near, far = cell * width, min(cell * width + width - 1, size - k)
                        core = hashlib.blake2b(data[at - near : at - far + size], digest_size=16).digest()
                        begin, end = max(0, at - far), min(last, at - near)
                        rows.append((did, rid, anchor, cell, core, lo + begin, data[begin : end + size]))
                kinds = [pa.int64()] * 4 + [pa.binary(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], names=["did", "rid", "anchor", "cell", "core", "lo", "bytes"])

    return run


def _windows(size: int):
    """Every window of the given bytes, as (anchor, digest of its bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in range(0, batch.num_rows, 2000):
                part = batch.slice(c, 2000)
                rows = []
                for did, rid, anchor, lo, data in zip(*(part.column(x).to_pylist() for x in ("did", "rid", "anchor", "lo", "bytes"))):
                    rows += [(did, rid, anchor, lo + i, hashlib.blake2b(data[i : i + size], digest_size=16).digest()) for i in range(len(data) - size + 1)]
                kinds = [pa.int64()] * 4 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], names=["did", "rid", "anchor", "at", "window"])

    return run


def _cut(size: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 8 * _PIECE):
                out = []
                for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist()):
                    data = text.encode()
                    merged: list[list[int]] = []
                    for s in sorted((s["lo"], s["hi"] + size) for s in spans or ()):
                        if merged and s[0] <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], s[1])
                        else:
                            merged.append(list(s))
                    kept, at = [], 0
                    for a, b in merged:
                        kept.append(data[at:a])
                        at = b
                    kept.append(data[at:])
                    rest = b"".join(kept)
                    out.append((len(data), len(data) - len(rest), len(merged), hashlib.sha256(rest).hexdigest(), rest.decode(errors="ignore") if texts and merged else text if texts else None))
                columns = [pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 3 + [pa.string()] * 2)]
                same = [i for i, n in enumerate(part.schema.names) if n not in ("text", "spans", "did", "rid")]
                names = [part.schema.names[i] for i in same] + ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["text"] * texts
                yield pa.RecordBatch.from_arrays([part.column(i) for i in same] + columns[: 4 + texts], names=names)

    return run


def _dealt_anew(rows: DataFrame, *keys: str) -> DataFrame:
    """Hides that rows are already dealt by the keys: a join then shuffles both sides, and Spark can split a hot key."""
    return rows.select(*(F.col(c).bitwiseXOR(F.lit(0).cast("long")).alias(c) if c in keys else c for c in rows.columns))


def repeated_runs(rows: DataFrame, min_bytes: int, keep: str, kgram: int, max_group: int) -> DataFrame:
    """(did, rid, lo, hi): windows lo..hi of the row are to go.  rows: from keyed()."""
    ints = "did long, rid long, anchor long, context long, lo long, hi long"
    found = rows.select("did", "rid", "text").where(F.octet_length("text") >= min_bytes)
    # worked out twice, for counts and for places: all runs of all texts would take much of the input's size on disk
    found = found.mapInArrow(lean(_anchors(min_bytes, kgram)), ints)
    place = F.struct("did", "rid", "lo")
    several = _dealt_anew(found.groupBy("anchor").count().where("count > 1"), "anchor").select("anchor")
    found = found.join(several, "anchor").persist(StorageLevel.DISK_ONLY)
    kinds = found.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    groups = _dealt_anew(kinds.groupBy("anchor").agg(F.count("*").alias("n_kinds")), "anchor")
    kinds = _dealt_anew(kinds.join(groups, "anchor"), "anchor", "context")
    # each of these feeds several branches; they hold repeated runs only
    marked = found.join(kinds, ["anchor", "context"]).select("did", "rid", "anchor", "lo", "hi", "n", "n_kinds", (F.col("first") == place).alias("is_first")).persist(StorageLevel.DISK_ONLY)
    whole = marked.where((F.col("n") > 1) & (F.lit(keep == "none") | ~F.col("is_first"))).select("did", "rid", "lo", "hi")
    wanted = marked.where(F.col("is_first") & (F.col("n_kinds") > 1)).groupBy("did", "rid").agg(F.collect_set(F.struct("anchor", "lo", "hi", (F.col("n_kinds") > max_group).alias("large"))).alias("wanted"))
    # rows that repeat id and text are one here: each would else find its passages in the others
    contexts = rows.select("did", "rid", "text").join(wanted, ["did", "rid"]).dropDuplicates(["did", "rid"])
    contexts = contexts.mapInArrow(lean(_contexts(min_bytes)), "did long, rid long, anchor long, lo long, hi long, large boolean, bytes binary")
    # all that follows would else have the plans before it several times over, and the driver describes them after each stage
    ensure_checkpoint_dir(rows.sparkSession)
    contexts = contexts.checkpoint()
    small = contexts.where(~F.col("large")).select("anchor", "did", "rid", "lo", "hi", "bytes").repartition("anchor").sortWithinPartitions("anchor", "did", "rid", "lo")
    parts = small.mapInArrow(lean(_block_factors(min_bytes, keep == "first")), "did long, rid long, lo long, hi long")
    # of the large groups, only windows whose cores are repeated are counted one by one
    width = max(8, math.isqrt(min_bytes))
    cells = contexts.where("large").select("did", "rid", "anchor", "lo", "bytes").mapInArrow(lean(_cells(min_bytes, kgram, width)), "did long, rid long, anchor long, cell long, core binary, lo long, bytes binary").persist(StorageLevel.DISK_ONLY)
    cores = _dealt_anew(cells.groupBy("anchor", "cell", "core").count().where("count > 1"), "anchor", "cell").select("anchor", "cell", "core")
    each = cells.join(cores, ["anchor", "cell", "core"]).select("did", "rid", "anchor", "lo", "bytes")
    each = each.mapInArrow(lean(_windows(min_bytes)), "did long, rid long, anchor long, at long, window binary").persist(StorageLevel.DISK_ONLY)
    spot = F.struct("did", "rid", "at")
    counts = _dealt_anew(each.groupBy("anchor", "window").agg(F.count("*").alias("n"), F.min(spot).alias("first")).where("n > 1"), "anchor")
    single = each.join(counts, ["anchor", "window"])
    single = single if keep == "none" else single.where(F.col("first") != spot)
    return whole.unionByName(parts).unionByName(single.select("did", "rid", F.col("at").alias("lo"), F.col("at").alias("hi")))


def suffix_dedup(docs: DataFrame, min_bytes: int = 400, keep: str = "none", texts: bool = True, columns: tuple[str, ...] = (), kgram: int | None = None, max_group: int = 1024) -> DataFrame:
    """doc_id, the named further columns, n_bytes, n_removed, n_spans, kept_sha256 and, with `texts`, the text that is left.

    Spans are in UTF-8 bytes; a character that a span cuts through goes from `text` too (kept_sha256 has its bytes).
    """
    if keep not in ("none", "first"):
        raise ValueError("keep is 'none' or 'first'")
    if not 16 <= min_bytes <= 1 << 18:
        raise ValueError("min_bytes is between 16 and 2^18")
    kgram = kgram or max(8, min_bytes // 2)
    max_group = max(1, min(max_group, (1 << 20) // (2 * min_bytes)))
    bounded_batches(docs.sparkSession)
    rows = keyed(docs, *(F.col(c) for c in columns if c not in ("doc_id", "text")))
    spans = repeated_runs(rows, min_bytes, keep, kgram, max_group)
    spans = spans.groupBy("did", "rid").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    joined = rows.join(spans, ["did", "rid"], "left")
    names = [c for c in rows.columns if c not in ("text", "did", "rid")]
    shape = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    shape += ", n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text string" * texts
    return joined.select(*names, "text", "spans").mapInArrow(lean(_cut(min_bytes, texts)), shape)


