"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the word windows of the benchmark items. A shift table keyed by
blocks of two words says how far the search may jump; where the jump is zero,
the bucket of that suffix block (and of the block the window would begin with)
lists the windows to compare word by word.

The search is a narrow map over documents: nothing is shuffled. The benchmark is
read in blocks of bounded bytes, each with its own tables and its own broadcast,
so a large benchmark costs passes, not memory.
"""

from __future__ import annotations

import uuid
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, bound_batches, fresh, utf8

#: Bytes of benchmark text whose tables are broadcast at once.
BLOCK_BYTES = 2 << 20

#: Byte by byte: A-Z lower-cased, 0-9 and a-z and all non-ASCII kept, the rest blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class WuManber:
    """Search for the windows of one length in items, which are lists of words."""

    def __init__(self, items: list[tuple[str, list[bytes]]], length: int, size: int):
        self.m, self.block = length, min(2, length)
        self.jump = self.m - self.block + 1
        self.shift: dict[tuple, int] = {}
        #: by suffix and prefix block: the windows as places in their items, the ids of equal windows together
        self.bucket: dict[tuple, list[tuple[list[bytes], int, list[str]]]] = defaultdict(list)
        for item_id, w in items:
            if min(size, len(w)) != length:
                continue
            # a pair of words is as far from its window's end as that allows; over an item's windows the least counts
            for end in range(self.block, len(w) + 1):
                key, far = tuple(w[end - self.block : end]), max(0, self.m - end)
                if far < self.shift.get(key, self.jump):
                    self.shift[key] = far
            for start in range(len(w) - length + 1):
                bucket = self.bucket[tuple(w[start + length - self.block : start + length] + w[start : start + self.block])]
                for other, at, ids in bucket:
                    if other[at : at + length] == w[start : start + length]:
                        if item_id not in ids:
                            ids.append(item_id)
                        break
                else:
                    bucket.append((w, start, [item_id]))

    def search(self, w: list[bytes]):
        """(end position, item ids) of each occurrence."""
        m, b, n, jump, shift, bucket = self.m, self.block, len(w), self.jump, self.shift.get, self.bucket
        i = m
        while i <= n:
            key = tuple(w[i - b : i])
            step = shift(key, jump)
            if step:
                i += step
                continue
            for item, at, ids in bucket.get(key + tuple(w[i - m : i - m + b]), ()):
                if w[i - m : i] == item[at : at + m]:
                    yield i, ids
                    break
            i += 1


def _tables(block: list[tuple], size: int) -> list[WuManber]:
    """Of (item id, text) rows, a table for each length of window."""
    known: dict[bytes, bytes] = {}
    items = []
    for item_id, text in block:
        w = words(text.encode("utf-8", "surrogatepass")) if text is not None else []
        if w:
            items.append(("" if item_id is None else str(item_id), [known.setdefault(x, x) for x in w]))  # one object a word
    return [WuManber(items, n, size) for n in sorted({min(size, len(w)) for _, w in items})]


#: Tables of the block that a Python worker has met last, so that its next task finds them.
_last: dict[str, list[WuManber]] = {}


def scan(w: list[bytes], tables: list[WuManber]) -> tuple[list[list[int]], set[str]]:
    """Merged [start, end) word spans that occurrences cover, and the items' ids."""
    hits, ids = [], set()
    for t in tables:
        for end, found in t.search(w):
            hits.append((end - t.m, end))
            ids.update(found)
    return _merged(hits), ids


def _merged(hits) -> list[list[int]]:
    spans: list[list[int]] = []
    for a, b in sorted(hits):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    return spans


_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("item_ids", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(_SPAN)),
])
_ARROW = pa.struct([
    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("item_ids", pa.list_(pa.string())),
    ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
])


def _blocks(benchmark: DataFrame, most: int):
    held, size = [], 0
    for item_id, text in benchmark.toLocalIterator():
        n = len(text) if text else 0
        if held and size + n > most:
            yield held
            held, size = [], 0
        held.append((item_id, text))
        size += n
    yield held


def find_overlaps(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, name: str = "overlap", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`docs` with a struct column `name` (with underscores in front where `docs` has one): n_words, n_hit, item_ids (as strings, sorted), spans of hit words.

    Null or wordless texts have no words and no hits; items without words have no
    windows; an item of fewer words than a window is one window. Items that share
    an id count once. Repeated rows are rows each; texts of any length are read whole.
    An empty benchmark hits nothing, empty documents give no rows. Other columns pass through.
    """
    bound_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    items = benchmark.select(item_col, item_text_col)
    out, earlier = docs, None
    for block in _blocks(items, block_bytes):
        shared = sc.broadcast(block)  # block_bytes of text, or one item
        made = fresh(out, name if earlier is None else f"{name}_next")

        def make(shared=shared, number=uuid.uuid4().hex):
            if number not in _last:
                _last.clear()
                _last[number] = _tables(shared.value, window)
            tables = _last[number]

            def one(column):
                rows = []
                for text in utf8(column):
                    w = words(text)
                    spans, ids = scan(w, tables)
                    rows.append({"n_words": len(w), "n_hit": sum(b - a for a, b in spans), "item_ids": sorted(ids), "spans": [{"start": a, "end": b} for a, b in spans]})
                return pa.array(rows, _ARROW)

            return one

        out = annotate(out, text_col, make, RESULT, made)
        if earlier is not None:
            out = _joined(out, earlier, made)
            made = earlier
        earlier = made
    return out


def _joined(df: DataFrame, a: str, b: str) -> DataFrame:
    """Fold the result column `b` into `a`: all items, and the union of their spans."""
    ends = F.array_sort(F.concat(F.col(f"{a}.spans"), F.col(f"{b}.spans")))
    start = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc, x):
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (x["start"] <= F.try_element_at(acc, F.lit(-1))["end"]), grown).otherwise(F.concat(acc, F.array(x)))

    spans = F.aggregate(ends, start, step)
    ids = F.array_sort(F.array_union(F.col(f"{a}.item_ids"), F.col(f"{b}.item_ids")))
    hit = F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return df.withColumn(a, F.struct(F.col(f"{a}.n_words").alias("n_words"), hit.alias("n_hit"), ids.alias("item_ids"), spans.alias("spans"))).drop(b)


def contaminated(result: str, percent: int = 5) -> F.Column:
    """At least one hit word, and hit words at least `percent` of all."""
    hit, n = F.col(f"{result}.n_hit"), F.col(f"{result}.n_words")
    return (hit > 0) & (100 * hit >= percent * n)
