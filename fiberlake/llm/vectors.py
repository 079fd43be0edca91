"""Exact top-k by inner product (threshold algorithm) and nearest neighbours (int8 block join).

Both take a stated query set against all rows, in blocks: candidates are dealt to blocks by a hash of vec_id, queries
to blocks of their own, and each pair of blocks is one bounded task.  Block sizes don't depend on the input; the
number of blocks does.  The best of each pair of blocks are merged by rank.

Edge cases: vectors that are null, or hold null, NaN or infinite components, and rows without vec_id take no part; so
do zero vectors in the nearest-neighbour search.  Only vectors of the query's length are its candidates.  Rows that
share the query's vec_id are the query's own.  Repeated candidates appear as often as they occur; a repeated query row
is one query, and rows of one vec_id with different vectors are queries of their own, each with ranks from 1.  Fewer
candidates than k: all of them.  Extra columns are ignored; an empty table gives no rows.

The work is the number of queries times that of rows, as an exact search of all rows is; what is shuffled is each row
once for every block of queries, so the blocks of queries are as large as a task's memory allows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RESULT = "query_id long, query_key long, vec_id long, score {}"


def usable(vectors: DataFrame, zero: bool) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)) & (F.size("embedding") > 0))
    if not zero:
        rows = rows.where(F.exists("embedding", lambda x: x != 0))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def block_join(rows: DataFrame, is_query: Column, solve, score: str, block_rows: int, query_rows: int) -> DataFrame:
    """solve(candidate ids, matrix, query ids, matrix) -> (place of the query, vec_id, score) for each pair of blocks."""
    sizes = rows.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    n_blocks, q_blocks = max(1, -(-sizes.n // block_rows)), max(1, -(-sizes.q // query_rows))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def dealt(n: int) -> Column:
        return F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")

    dim = F.size("v").alias("dim")
    left = rows.select("vec_id", "v", dim, dealt(n_blocks).alias("cb"), every(q_blocks).alias("qb"))
    queries = rows.where(is_query).select("vec_id", F.xxhash64("v").alias("query_key"), "v").dropDuplicates(["vec_id", "query_key"])
    right = queries.select("vec_id", "query_key", "v", dim, dealt(q_blocks).alias("qb"), every(n_blocks).alias("cb"))

    def pair(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "query_key", "vec_id", "score"]
        if not len(a) or not len(b):
            return pd.DataFrame({n: [] for n in names})
        a, ids, keys = a.sort_values("vec_id", kind="stable"), b["vec_id"].to_numpy(), b["query_key"].to_numpy()
        found = solve(a["vec_id"].to_numpy(), np.stack(a["v"].to_numpy()), ids, np.stack(b["v"].to_numpy()))
        return pd.DataFrame([(ids[j], keys[j], i, s) for j, i, s in found], columns=names)

    keys = ["dim", "cb", "qb"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(pair, _RESULT.format(score))


def ranked(found: DataFrame, k: int, best_first: Column) -> DataFrame:
    order = Window.partitionBy("query_id", "query_key").orderBy(best_first, F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def threshold_topk(ids: np.ndarray, matrix: np.ndarray, query: np.ndarray, k: int, order: np.ndarray, own: int) -> list[tuple]:
    """Fagin's threshold algorithm: (score, id) of the k best, ties to smaller ids.

    order[:, d] lists rows by component d, ascending.  Each list is read from the end that suits the query's sign, in
    steps that double; rows met for the first time are scored at once.  It stops when no unseen row can reach the kth
    score; one that could tie may have a smaller id, so equality goes on.
    """
    n = len(ids)
    dims = np.flatnonzero(query)
    if not len(dims):
        return heapq.nsmallest(k, ((0, i) for i in ids.tolist() if i != own), key=lambda x: x[1])
    up, weights = query[dims] > 0, query[dims]
    seen = np.zeros(n, bool)
    seen[ids == own] = True
    scores, rows, depth, step = [], [], 0, max(k, 8)
    kth = None
    while depth < n:
        to = min(n, depth + step)
        # only the part of the lists that this step reads
        part = np.where(up, order[::-1][depth:to], order[depth:to]) if len(dims) == order.shape[1] else np.where(up, order[::-1][depth:to, dims], order[depth:to, dims])
        met = np.zeros(n, bool)
        met[part] = True
        fresh = np.flatnonzero(met & ~seen)
        seen |= met
        scores.append(matrix[fresh] @ query)
        rows.append(fresh)
        depth, step = to, step * 2
        got = np.concatenate(scores)
        if len(got) >= k:
            kth = np.partition(got, len(got) - k)[len(got) - k] if got.dtype != object else sorted(got)[-k]
            if kth > (weights * matrix[part[-1], dims]).sum():
                break
    got, rows = np.concatenate(scores), np.concatenate(rows)
    if kth is not None:
        best = np.flatnonzero(got >= kth)
        got, rows = got[best], rows[best]
    return heapq.nsmallest(k, zip(got.tolist(), ids[rows].tolist()), key=lambda x: (-x[0], x[1]))


def exact_topk(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, block_rows: int = 16384, query_rows: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of floor(scale * x), for queries with vec_id % every = 0.

    Sums are exact: in floats while they stay below 2^24, in doubles below 2^53, else in Python integers, held within the range of long.
    """

    def solve(ids, matrix, query_ids, queries):
        most = max(1.0, float(np.abs(matrix).max()), float(np.abs(queries).max()))
        if most * most * matrix.shape[1] >= 2**53:
            matrix, queries = (np.array([[int(x) for x in row] for row in m], object) for m in (matrix, queries))
        elif most * most * matrix.shape[1] < 2**24:
            matrix, queries = matrix.astype(np.float32), queries.astype(np.float32)
        order = np.argsort(matrix.astype(float), axis=0, kind="stable").astype(np.int32)
        edge = 2**63 - 1
        return [(j, i, max(-edge, min(edge, int(s)))) for j, (q, v) in enumerate(zip(query_ids.tolist(), queries)) for s, i in threshold_topk(ids, matrix, v, k, order, q)]

    rows = usable(vectors, zero=True).select("vec_id", F.transform("v", lambda x: floor_of(x, scale)).alias("v"))
    found = block_join(rows, F.col("vec_id") % every == 0, solve, "long", block_rows, query_rows)
    return ranked(found, k, F.desc("score"))


def floor_of(x: Column, scale: int) -> Column:
    """floor(scale * x) as a double; beyond 2^53 every double is whole (floor to long would overflow)."""
    y = x * F.lit(float(scale))
    return F.when(F.abs(y) < float(2**53), F.floor(y).cast("double")).otherwise(y)


def quantised(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, lengths of what the codes stand for, and of what they miss."""
    scale = np.abs(matrix).max(axis=1) / 127
    scale[scale == 0] = 1
    codes = np.rint(matrix / scale[:, None]).astype(np.int8)
    near = codes * scale[:, None]
    return codes, scale, np.linalg.norm(near, axis=1), np.linalg.norm(matrix - near, axis=1)


def nearest(ids: np.ndarray, matrix: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, tile: int = 2048) -> list[tuple]:
    """(place of the query, id, distance) of the k nearest: int8 product tiles bound distances, survivors are measured, heaps merge.

    A distance adds its squares in the order of the components.
    """
    wide = np.float32 if matrix.shape[1] * 127 * 127 < 2**24 else np.float64
    qc, qs, qn, qe = quantised(queries)
    qq, q_codes = (queries**2).sum(axis=1), qc.astype(wide)
    q_len = np.sqrt(qq)
    heaps: list[list] = [[] for _ in query_ids]
    for t in range(0, len(ids), tile):
        part, names = matrix[t : t + tile], ids[t : t + tile]
        codes, scales, near, miss = quantised(part)
        size = (part**2).sum(axis=1)
        for s in range(0, len(query_ids), 512):
            cut = slice(s, s + 512)
            dots = (q_codes[cut] @ codes.T.astype(wide)).astype(np.float64) * qs[cut, None] * scales[None, :]
            error = qn[cut, None] * miss[None, :] + qe[cut, None] * np.sqrt(size)[None, :]
            total = qq[cut, None] + size[None, :]
            slack = 2 * error + 1e-9 * total + 1e-300
            middle = total - 2 * dots
            low, high = middle - slack, middle + slack
            own = query_ids[cut, None] == names[None, :]
            low[own] = high[own] = np.inf
            for j in range(low.shape[0]):
                heap = heaps[s + j]
                limit = heap[0][0] ** 2 * (1 + 1e-9) if len(heap) >= k else np.inf  # heap[0] is the worst kept, as negatives
                if names.shape[0] > k:
                    limit = min(limit, np.partition(high[j], k - 1)[k - 1])
                left = np.flatnonzero((low[j] <= limit) & ~own[j])
                if len(left):
                    gap = np.sqrt(((part[left] - queries[s + j]) ** 2).cumsum(axis=1)[:, -1])
                    best = np.lexsort((names[left], gap))[:k]
                    for d, i in zip((-gap[best]).tolist(), (-names[left][best]).tolist()):
                        if len(heap) < k:
                            heapq.heappush(heap, (d, i))
                        elif (d, i) > heap[0]:
                            heapq.heapreplace(heap, (d, i))
    return [(j, -i, -d) for j, heap in enumerate(heaps) for d, i in sorted(heap, reverse=True)]


def nearest_neighbours(vectors: DataFrame, every: int = 100, k: int = 10, block_rows: int = 16384, query_rows: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: the k smallest Euclidean distances, for queries with vec_id % every = 0.  Exact."""
    rows = usable(vectors, zero=False)
    found = block_join(rows, F.col("vec_id") % every == 0, lambda a, b, c, d: nearest(a, b, c, d, k), "double", block_rows, query_rows)
    return ranked(found, k, F.asc("score"))
