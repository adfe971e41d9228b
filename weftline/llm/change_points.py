"""Penalised change points of many daily series by memoised branch and bound.

Daily sums are made by Spark, pre-aggregated before they move, so that a key with a
third of all rows moves one row per day and task. A series (one key) then lies sorted
in one partition, one row per day that has rows, and is cut by `best_cuts`: depth first
from the end of the series, each prefix solved once, starts of the last segment tried in
the order of a lower bound, and left as soon as the bound lies strictly above the best
so far.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

SHORTEST = 14
PENALTY = 40_000
#: Costs are made for so many ends at a time, and so many such blocks are kept.
ENDS, KEPT = 64, 24


class Costs:
    """Costs of all segments [start, end) of a series, and lower bounds of what any cuts of a prefix cost."""

    def __init__(self, values: np.ndarray, shortest: int, penalty: int):
        n = len(values)
        most = max((abs(int(v)) for v in (values.max(initial=0), values.min(initial=0))), default=0)
        # n * Q, the largest number, is at most (n * most) ** 2; beyond 62 bits Python's integers take over
        kind = np.int64 if (n * most) ** 2 < 1 << 62 else object
        v = values.astype(kind)
        zero = np.zeros(1, kind)
        self.sums, self.squares = np.concatenate([zero, np.cumsum(v)]), np.concatenate([zero, np.cumsum(v * v)])
        self.n, self.shortest, self.penalty, self.blocks = n, shortest, penalty, {}
        self.rest = self._rest()

    def _squares(self, start, end):
        """n and n * n * variance of segments, in exact integers."""
        n = end - start
        if self.sums.dtype == object:
            n = n.astype(object) if isinstance(n, np.ndarray) else int(n)
        s, q = self.sums[end] - self.sums[start], self.squares[end] - self.squares[start]
        return n, n * q - s * s

    def spread(self, start, end):
        """V of segments: 1 + floor(variance)."""
        n, x = self._squares(start, end)
        return 1 + x // (n * n)

    def cost(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        v = self.spread(start, end).astype(np.float64)
        return (end - start) * np.floor(1000.0 * np.log(v)).astype(np.int64)

    def _least(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """n * (1000 * g(SSE / n) - 1) with g(x) = ln x from 1 on and x - 1 below.

        g is concave, grows and lies below ln(1 + floor x); SSE only grows when a segment
        does, and that of two neighbours is at least the sum of theirs. So a segment costs
        at least what its pieces give here.
        """
        n, x = (np.asarray(c, np.float64) for c in self._squares(start, end))
        x = x / np.maximum(n * n, 1) * (1 - 1e-9)
        return n * (1000.0 * np.where(x >= 1, np.log(np.maximum(x, 1)), x - 1) - 1)

    def _rest(self) -> np.ndarray:
        """For each prefix a number that no cuts of it can go below.

        Windows of `shortest` days lie side by side, the last one up to the prefix's end. No two
        cuts fall into one, so a window is whole or cut once; what it costs at least adds up.
        """
        w = self.shortest
        end = np.arange(1, self.n + 1)
        start = (end - 1) // w * w
        low = self._least(start, end)
        if w > 1:
            cut = np.minimum(start[:, None] + np.arange(1, w)[None, :], end[:, None])
            once = self._least(start[:, None], cut) + self._least(cut, end[:, None])
            low = np.minimum(low, once.min(1) + self.penalty)
        whole = np.concatenate([[0.0], np.cumsum(low[w - 1 :: w])])
        low = np.maximum(whole[start // w] + low, 0)
        # rounding stays far below 1
        return np.concatenate([[0], np.floor(low * (1 - 1e-9)).astype(np.int64) - (low > 0)])

    def ending(self, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each start below `end`: the cost of [start, end), and a bound of the whole prefix with that last segment, out of reach where its length isn't allowed."""
        k = end // ENDS
        if k not in self.blocks:
            if len(self.blocks) >= KEPT:
                self.blocks.pop(next(iter(self.blocks)))
            first, last = max(1, k * ENDS), min(self.n, k * ENDS + ENDS - 1)
            ends, starts = np.arange(first, last + 1)[:, None], np.arange(last)[None, :]
            cost = self.cost(np.minimum(starts, ends - 1), ends)
            bound = cost + (self.rest[:last] + self.penalty)[None, :]
            bound[(starts < self.shortest) | (starts > ends - self.shortest)] = np.iinfo(np.int64).max
            bound[:, 0] = cost[:, 0]
            self.blocks[k] = (first, cost, bound)
        first, cost, bound = self.blocks[k]
        return cost[end - first, :end], bound[end - first, :end]


def best_cuts(values: np.ndarray, shortest: int = SHORTEST, penalty: int = PENALTY) -> tuple[int, list[tuple[int, int]]]:
    """(costs with penalties, segments [start, end) in order) of the best cuts of a series of at least one day.

    A subproblem is a prefix; its key is (costs, segments, starts from the last segment
    backwards), compared as a tuple, so ties go to fewer segments, then to earlier starts.
    A series shorter than `shortest` is one segment.
    """
    n, costs = len(values), Costs(values, shortest, penalty)
    known: dict[int, tuple[int, int, tuple]] = {}

    def ordered(end: int):
        """(bound, start, cost of the last segment) of the starts that can beat one segment, least bound first."""
        cost, bound = costs.ending(end)
        few = np.nonzero(bound <= bound[0])[0]
        few = few[np.argsort(bound[few], kind="stable")]
        return zip(bound[few].tolist(), few.tolist(), cost[few].tolist())

    # an explicit stack: a long series nests deeper than Python's calls; the starts of a key are nested pairs (last start, rest)
    stack = [[n, ordered(n), None, None]]
    while stack:
        top = stack[-1]
        end, options, best, waiting = top
        if waiting is not None:
            start, cost = waiting
            rest = known[start]
            key = (cost + penalty + rest[0], 1 + rest[1], (start, *rest[2]))
            best, waiting = key if best is None or key < best else best, None
        for bound, start, cost in options:
            if best is not None and bound > best[0]:
                break
            if start == 0:
                key = (cost, 1, (0,))
            elif start in known:
                rest = known[start]
                if best is not None and cost + penalty + rest[0] > best[0]:
                    continue
                key = (cost + penalty + rest[0], 1 + rest[1], (start, *rest[2]))
            else:
                waiting = (start, cost)
                break
            if best is None or key < best:
                best = key
        top[2], top[3] = best, waiting
        if waiting is not None:
            stack.append([waiting[0], ordered(waiting[0]), None, None])
        else:
            known[end] = best
            stack.pop()
    total, _, starts = known[n]
    ends = [n, *starts[:-1]]
    return total, list(zip(starts, ends))[::-1]


def daily(rows: DataFrame, key: str, at: str, amount: str) -> DataFrame:
    """(key, day, total): sums of `amount` per key and day since 1970, of rows that have both; counts are combined before they move."""
    return rows.where(F.col(at).isNotNull() & F.col(amount).isNotNull()).groupBy(F.col(key).alias("key"), F.unix_date(F.to_date(F.col(at))).cast("long").alias("day")).agg(F.sum(F.col(amount).cast("long")).alias("total"))


def _segments(key, days: list[int], totals: list[int], shortest: int, penalty: int) -> list[tuple]:
    first = days[0]
    values = np.zeros(days[-1] - first + 1, np.int64)
    values[np.array(days) - first] = totals
    best, cuts = best_cuts(values, shortest, penalty)
    costs = Costs(values, shortest, penalty)
    out = []
    for i, (a, z) in enumerate(cuts):
        v = int(costs.spread(a, z))
        out.append((key, i + 1, first + a, z - a, int(costs.sums[z] - costs.sums[a]), v, int(costs.cost(np.array([a]), np.array([z]))[0]), len(cuts), best))
    return out


def change_points(rows: DataFrame, *, key: str = "vendor_id", at: str = "shipped_at", amount: str = "quantity", shortest: int = SHORTEST, penalty: int = PENALTY) -> DataFrame:
    """(key, segment_no, first_day, n_days, total, spread, cost, n_segments, best_cost): each key's best segments.

    Rows without a time or an amount take no part, a null key is a key of its own, repeated
    rows count each, days between the first and the last of a key without rows are 0. A
    series shorter than `shortest` days is one segment. Ties go to fewer segments, then to
    earlier starts from the last segment backwards. An empty table, or one without such
    rows, gives no rows. Columns besides the three aren't read, so their names don't matter.

    Data movement: daily sums, once to add up, once by key. A partition holds sorted series
    and reads one at a time; the longest holds one row a day.
    """
    bound_batches(rows.sparkSession)
    kind = rows.schema[key].dataType
    sums = daily(rows, key, at, amount)
    sorted_series = sums.repartition("key").sortWithinPartitions("key", "day")

    def cut(batches):
        held: tuple | None = None  # key, days, totals of the series that may go on
        made: list[tuple] = []

        def batch(tuples):
            columns = list(zip(*tuples))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], key_type), pa.array(columns[1], pa.int32()), *[pa.array(c, pa.int64()) for c in columns[2:]]], names=names)

        key_type = None
        for b in batches:
            key_type = b.schema.field(0).type
            keys, days, totals = (c.to_pylist() for c in b.columns)
            i = 0
            while i < len(keys):
                j = i
                while j < len(keys) and keys[j] == keys[i]:
                    j += 1
                if held is not None and held[0] == keys[i]:
                    held = (keys[i], held[1] + days[i:j], held[2] + totals[i:j])
                else:
                    if held is not None:
                        made += _segments(*held, shortest, penalty)
                    held = (keys[i], days[i:j], totals[i:j])
                i = j
            if len(made) > 4000:
                yield batch(made)
                made = []
        if held is not None:
            made += _segments(*held, shortest, penalty)
        if made:
            yield batch(made)

    names = [key, "segment_no", "first_day", "n_days", "total", "spread", "cost", "n_segments", "best_cost"]
    return sorted_series.mapInArrow(cut, f"`{key}` {kind.simpleString()}, segment_no int, " + ", ".join(f"{n} long" for n in names[2:]))


def cost_of(n: Column, s: Column, q: Column) -> Column:
    """The cost of a segment of n days with sum s and sum of squares q, as an expression."""
    return n * F.floor(1000 * F.ln((1 + F.floor((n * q - s * s) / (n * n))).cast("double")))
