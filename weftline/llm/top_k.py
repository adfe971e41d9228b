"""Exact top-k by inner product over an impact-ordered index, score at a time.

Components become integers, floor(scale * x). Candidates lie in blocks; a block's index
holds a posting (row, component) for each component that isn't 0, in segments of equal
quantised impact, the number of binary digits of its size, highest first. A batch of
queries takes the segments in that order and adds up scores. After each segment the
postings that are left are smaller than its impact, so with the norm of a candidate's
postings that are left, the score of each candidate has an upper bound; the batch's
queries that have proof stop: only candidates whose bound reaches their k-th best exact
score can be members. Those are rescored exactly. Nothing is skipped without proof, so
the result is that of comparing each query with each row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches

#: Rows of a block of candidates, and queries that meet a block in one task.
BLOCK, QUERIES = 32_768, 1_024
#: Queries that go through a block's segments together, and rows of a block that do.
BATCH, TILE = 128, 16_384
#: So many lists of one query are merged by one step at most.
MERGED = 256
#: Larger components aren't exact in a double.
LARGEST = float(1 << 46)


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component; null for a vector that is null or holds null, a non-finite component or one beyond LARGEST."""
    x = F.transform(vector, lambda v: v.cast("double") * F.lit(float(scale)))
    sound = F.forall(x, lambda v: F.coalesce(F.abs(v) < F.lit(LARGEST), F.lit(False)))
    return F.when(sound, F.transform(x, lambda v: F.floor(v).cast("long")))


def _kind(bound: int):
    """The fastest number type in which sums up to `bound` are exact."""
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else object


class Index:
    """The impact-ordered postings of a tile of candidates (rows x components, integers)."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        impact = np.frexp(np.abs(rows).astype(np.float64))[1]  # binary digits of the size; 0 for 0
        self.segments = []
        left = (rows.astype(np.float64) ** 2).sum(1)
        for level in range(int(impact.max(initial=0)), 0, -1):
            row, dim = np.nonzero(impact == level)
            if len(row):
                value = rows[row, dim]
                left = left - np.bincount(row, value.astype(np.float64) ** 2, len(rows))
                # of the postings below this segment: their norm, a little up for rounding
                self.segments.append((row, dim, value, np.sqrt(np.maximum(left, 0) * (1 + 1e-9) + 1e-6)))

    def tile(self, k: int, kind) -> np.ndarray:
        """Postings of the k-th segment as a sparse tile, ready to be multiplied."""
        row, dim, value, _ = self.segments[k]
        out = np.zeros(self.rows.shape[::-1], kind)
        out[dim, row] = value
        return out


class Best:
    """The best k (score, id) of each query so far: more score first, then less id."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.ids = k, [np.zeros(0, np.int64)] * n, [np.zeros(0, np.int64)] * n

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.scores[q], scores]), np.concatenate([self.ids[q], ids])
        keep = np.lexsort((i, -s))[: self.k]
        self.scores[q], self.ids[q] = s[keep], i[keep]

    def least(self, q: int) -> float:
        """A score below which nothing gets in."""
        return float(self.scores[q][-1]) if len(self.scores[q]) == self.k else -np.inf


def _exact(queries: np.ndarray, rows: np.ndarray, bound: int) -> np.ndarray:
    """Inner products of paired rows, in integers that hold them."""
    if bound < 1 << 62:
        return np.einsum("ij,ij->i", queries, rows)
    made = (queries.astype(object) * rows.astype(object)).sum(1)
    if max(map(abs, made), default=0) >= 1 << 63:
        raise OverflowError("a score doesn't fit a long")
    return made.astype(np.int64)


def search(index: Index, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, best: Best, first: int) -> None:
    """Put what a tile holds for a batch of queries into `best`, from place `first` on. A row with the query's own id is none of its candidates."""
    rows, k = index.rows, best.k
    size = np.abs(queries).max(initial=0), np.abs(rows).max(initial=0)
    bound = int(size[0]) * int(size[1]) * rows.shape[1]
    kind, slack = _kind(bound), 1e-3 + bound * 1e-14  # the latter only tells where doubles round
    go, norm = np.arange(len(queries)), np.sqrt((queries.astype(np.float64) ** 2).sum(1)) * (1 + 1e-9)
    same = own[:, None] == ids[None, :] if len(np.intersect1d(own, ids)) else None
    scores = np.zeros((len(queries), len(rows)), kind)
    if same is not None:
        scores[same] = -np.inf if kind is not object else -(1 << 200)
    for s in range(len(index.segments) + (not index.segments)):
        if index.segments:
            scores[go] += queries[go].astype(kind) @ index.tile(s, kind)
        last = s + 1 >= len(index.segments)
        left = index.segments[s][3] if index.segments and not last else np.zeros(len(rows))
        now = scores[go].astype(np.float64)
        reach = now + norm[go][:, None] * left[None, :] + slack
        few = max(4 * k, len(rows) // 64)
        # a proof is tried where the best score so far, in place of the k-th best, would leave few
        tried = np.full(len(go), True) if last else (reach >= now.max(1)[:, None]).sum(1) <= few
        if not tried.any():
            continue
        asks, now, reach = go[tried], now[tried], reach[tried]
        # exact scores of the best by what is known so far: the k-th of them bounds the k-th best from below
        n = min(len(rows), k + 12)
        front = np.argpartition(now, len(rows) - n, axis=1)[:, len(rows) - n :] if n < len(rows) else np.tile(np.arange(len(rows)), (len(asks), 1))
        known = _exact(np.repeat(queries[asks], n, 0), rows[front.ravel()], bound).reshape(front.shape).astype(np.float64)
        if same is not None:
            known[same[asks[:, None], front]] = -np.inf  # the query's own rows
        floor = np.array([best.least(first + q) for q in asks])
        if n >= k:
            floor = np.maximum(floor, np.partition(known, n - k, axis=1)[:, n - k])
        # a bound that equals the floor may still win by its id
        may = (reach >= floor[:, None]) & (now > -1e50)
        stop = np.full(len(asks), True) if last else may.sum(1) <= few
        at, row = np.nonzero(may[stop])
        if len(at):
            q = asks[stop][at]
            # pairs are rescored in slices, so that they stay small
            made = np.concatenate([_exact(queries[q[i : i + 65_536]], rows[row[i : i + 65_536]], bound) for i in range(0, len(q), 65_536)])
            cuts = np.searchsorted(at, np.arange(int(stop.sum()) + 1))
            for j, query in enumerate(asks[stop]):
                a, z = cuts[j], cuts[j + 1]
                if z > a:
                    best.add(first + int(query), made[a:z], ids[row[a:z]])
        go = np.setdiff1d(go, asks[stop])
        if not len(go):
            return


def block_top_k(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Best:
    """The best k candidates of a block for each query."""
    best = Best(len(queries), k)
    for a in range(0, len(rows), TILE):
        index = Index(rows[a : a + TILE])
        for b in range(0, len(queries), BATCH):
            search(index, ids[a : a + TILE], queries[b : b + BATCH], query_ids[b : b + BATCH], best, b)
    return best


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of integers as rows, shorter ones filled with 0."""
    lists = pa.concat_arrays([*column.chunks, pa.array([], column.type)])
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(lists.offsets.to_numpy())
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def top_k(vectors: DataFrame, queries: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, k: int = 20, block: int = BLOCK, per_task: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows for each row that `queries` holds for.

    Scores are integer inner products of floor(scale * x), ties go to the smaller id. Vectors
    that are null or hold null, a non-finite component or one of 2 ** 46 / scale or more take
    no part, nor do rows without an id. Vectors of unequal lengths meet as if the shorter went
    on with 0; an empty one scores 0. All rows with a query's id count as its own and are none
    of its candidates; a repeated query is asked once, repeated candidates count each. A query
    with fewer candidates has fewer rows. Other columns aren't read. An empty table gives none.

    Data movement: distinct rows once, then each block of candidates once for each block of queries, integers only;
    lists of k are merged in steps of bounded size. The index of a block is made where it is
    used and holds about twice its rows.
    """
    bound_batches(vectors.sparkSession)
    sound = vectors.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("v"), queries.alias("asks")).where("id is not null and v is not null")
    n, asked = (int(x or 0) for x in sound.agg(F.count(F.lit(1)), F.count_if("asks")).first())
    blocks, groups = -(-n // block) or 1, -(-asked // per_task) or 1
    dealt = lambda salt, m: F.pmod(F.xxhash64(F.lit(salt), "id", "v"), F.lit(m))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)).cast("array<long>"))
    # equal rows move once, with their number, so that no block holds them all
    rows = sound.groupBy("id", "v").agg(F.count(F.lit(1)).alias("m"), F.max("asks").alias("asks"))
    candidates = rows.select("id", "v", F.least("m", F.lit(k)).alias("m"), dealt(1, blocks).alias("b"), every(groups).alias("g"))
    asking = rows.where("asks").select(F.col("id").alias("query_id"), F.col("v").alias("w"), dealt(2, groups).alias("g"), every(blocks).alias("b"))
    made = pa.schema([(name, pa.int64()) for name in ("query_id", "vec_id", "score", "b")])

    def meet(c: pa.Table, q: pa.Table) -> pa.Table:
        # a group is a block of candidates with a block of queries, both of bounded size
        if not c.num_rows or not q.num_rows:  # such a side comes without columns
            return made.empty_table()
        width = max(int(np.diff(chunk.offsets.to_numpy()).max(initial=0)) for x in (c.column("v"), q.column("w")) for chunk in x.chunks)
        asks = q.column("query_id").to_numpy()
        at = c.column("b")[0].as_py()
        copies = np.repeat(np.arange(c.num_rows), c.column("m").to_numpy())  # more than k of a row can't be among k
        found = block_top_k(c.column("id").to_numpy()[copies], _matrix(c.column("v"), width)[copies], asks, _matrix(q.column("w"), width), k)
        ids, scores = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (found.ids, found.scores))
        return pa.table([np.repeat(asks, [len(x) for x in found.ids]), ids, scores, np.full(len(ids), at)], schema=made)

    lists = candidates.groupBy("b", "g").cogroup(asking.groupBy("b", "g")).applyInArrow(meet, "query_id long, vec_id long, score long, b long")
    order = lambda *by: Window.partitionBy("query_id", *by).orderBy(F.desc("score"), "vec_id")
    while blocks > MERGED:
        blocks = -(-blocks // MERGED)
        lists = lists.withColumn("b", F.pmod("b", F.lit(blocks))).withColumn("rank", F.row_number().over(order("b"))).where(F.col("rank") <= k).drop("rank")
    return lists.withColumn("rank", F.row_number().over(order())).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
