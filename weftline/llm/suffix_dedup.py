"""Repeated-substring removal by prefix-free parsing.

A rolling hash of 16 bytes picks triggers: the least hash among the positions of
each 50-byte window (ties: the first). A trigger rule of that kind, unlike "hash
divisible by p", leaves no 50 bytes without a trigger, and equal windows have
equal triggers. A phrase is the run of window starts that share a trigger,
together with the 49 bytes after it, so all windows of a phrase lie within it.

The dictionary is the set of distinct phrases; the parse is each document's list
of phrases. Suffixes need to be ordered to a depth of 50 bytes only, which the
dictionary alone decides; the parse adds the smallest document of each entry.
Suffixes with the same 50 bytes stand together in that order, and the smallest
document among them tells which occurrences are repeats.

Stages, each a shuffle of packed blobs: (1) which trigger hashes occur in two or
more documents (for all others no window repeats); (2) the dictionary entries at
those triggers, each shard's copies combined before they are sent; the suffix
array of each bucket's dictionary, and the smallest document per window back to
the shards; (3) spans per document. Texts are shuffled once, for (2) and (3).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, shards_for, slices, text_bytes, utf8

LENGTH = 50
GRAM = 16
#: Bytes of text in a shard of documents, and that one bucket of triggers answers for.
SHARD_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20
SLICE = 1 << 20

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)
_LOW = np.uint64(0xFFFFFFFF)
_LAST = np.iinfo(np.int64).max


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


class Parse:
    """The phrases of some texts: arrays `doc`, `at` (first window start within the document), `n` (window starts), `gram` and `key` (hashes of trigger and phrase)."""

    def __init__(self, texts: list[bytes], length: int = LENGTH, gram: int = GRAM, keys: bool = True):
        self.length = length
        self.buf = b"".join(texts)
        size = len(self.buf)
        self.first = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=self.first[1:])
        n = size - length + 1
        empty = np.zeros(0, np.int64)
        if n < 1:
            self.doc = self.at = self.n = self.pos = empty
            self.gram = self.key = empty.astype(np.uint64)
            return
        b = np.frombuffer(self.buf, np.uint8)
        h, step, p = b.astype(np.uint64), 1, int(_P)
        while step < gram:  # gram is a power of two
            h = h[:-step] + np.uint64(pow(p, step, 1 << 64)) * h[step:]
            step *= 2
        h = _mixed(h)
        packed = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        reach = length - gram + 1
        least, width = packed, 1
        while width * 2 <= reach:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < reach:
            least = np.minimum(least[: len(least) - (reach - width)], least[reach - width :])
        valid = np.ones(n, bool)
        for a, z in zip(self.first[:-1].tolist(), self.first[1:].tolist()):
            valid[max(a, z - length + 1) : z] = False
        starts = np.flatnonzero(valid)
        if not len(starts):
            self.doc = self.at = self.n = self.pos = empty
            self.gram = self.key = empty.astype(np.uint64)
            return
        trigger = (least[starts] & _LOW).astype(np.int64)
        heads = np.flatnonzero(np.concatenate([[True], trigger[1:] != trigger[:-1]]))
        self.pos = starts[heads]
        self.n = np.diff(np.append(heads, len(starts)))
        self.gram = h[trigger[heads]]
        self.doc = np.searchsorted(self.first, self.pos, side="right") - 1
        self.at = self.pos - self.first[self.doc]
        if keys:
            with np.errstate(over="ignore"):
                power = np.full(size + 1, _P, np.uint64)
                power[0] = 1
                np.cumprod(power, out=power)
                total = np.zeros(size + 1, np.uint64)
                np.cumsum(b * power[:-1], out=total[1:])
                power.fill(_PINV)
                power[0] = 1
                np.cumprod(power, out=power)
                end = self.pos + self.n + length - 1
                self.key = _mixed((total[end] - total[self.pos]) * power[self.pos] + self.n.astype(np.uint64) * _MIX) ^ self.gram

    def phrase(self, i: int) -> bytes:
        a = int(self.pos[i])
        return self.buf[a : a + int(self.n[i]) + self.length - 1]


def _as(blob, kind):
    return np.frombuffer(blob, kind)


def _short(g: np.ndarray) -> bytes:
    """The upper 48 bits of hashes: a clash costs a useless entry, never a wrong result."""
    return np.ascontiguousarray(g.view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def _long(column) -> np.ndarray:
    raw = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(x, np.uint8) for x in column.to_pylist())]).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, 2:] = raw
    return out.view(np.uint64).ravel()


def _all(column, kind):
    return np.concatenate([np.zeros(0, kind), *(_as(x, kind) for x in column.to_pylist())])


def _grouped(values: np.ndarray):
    """(value, slice) of each run of a sorted array."""
    if len(values):
        cut = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(values)]):
            yield int(values[a]), slice(a, z)


def _bucket(gram: np.ndarray, n: int) -> np.ndarray:
    return ((gram >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


def _rows(names, kinds, rows):
    cols = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.table([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=names)


def smallest_docs(gram: np.ndarray, key: np.ndarray, n: np.ndarray, low: np.ndarray, texts: list[bytes], length: int = LENGTH):
    """For dictionary entries (with repeats): segments (entry, first, last, doc) of window starts with one smallest document.

    Entries that share no trigger with another phrase are one segment. For the
    rest, the suffix array of their windows (to depth `length`) is sorted, and the
    smallest document of equal neighbours goes back to each window.
    """
    if not len(gram):
        z = np.zeros(0, np.int64)
        return z, z, z, z
    uniq, first, entry = np.unique(key, return_index=True, return_inverse=True)
    best = np.full(len(uniq), _LAST)
    np.minimum.at(best, entry, low)
    g = gram[first]
    order = np.argsort(g, kind="stable")
    sizes = np.zeros(len(uniq), np.int64)
    for _, s in _grouped_fast(g[order]):
        sizes[order[s]] = s.stop - s.start
    single = sizes == 1
    many = np.flatnonzero(~single)
    seg_e, seg_a, seg_z, seg_d = [np.flatnonzero(single)], [np.zeros(int(single.sum()), np.int64)], [n[first[single]] - 1], [best[single]]
    if len(many):
        count = n[first[many]]
        joined = b"".join(texts[i] for i in first[many].tolist()) + b"\0" * 8
        lens = count + length - 1
        base = np.concatenate([[0], np.cumsum(lens)[:-1]])
        of = np.repeat(np.arange(len(many)), count)
        off = np.arange(int(count.sum())) - np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]), count)
        at = base[of] + off
        raw = np.frombuffer(joined, np.uint8)
        words = np.lib.stride_tricks.sliding_window_view(raw, 8)
        keys = []
        for k in range(0, length, 8):
            if k + 8 <= length:
                w = words[at + k]
            else:
                w = words[at + k].copy()
                w[:, length - k :] = 0
            keys.append(np.ascontiguousarray(w).view(">u8").ravel().astype(np.uint64))
        suffixes = np.lexsort(keys[::-1])
        same = np.ones(len(suffixes), bool)
        same[0] = False
        for k in keys:
            s = k[suffixes]
            same[1:] &= s[1:] == s[:-1]
        starts = np.flatnonzero(~same)
        least = np.minimum.reduceat(best[many][of[suffixes]], starts)
        mind = np.empty(len(suffixes), np.int64)
        mind[suffixes] = np.repeat(least, np.diff(np.append(starts, len(suffixes))))
        cut = np.flatnonzero(np.concatenate([[True], (mind[1:] != mind[:-1]) | (of[1:] != of[:-1])]))
        end = np.append(cut[1:], len(mind)) - 1
        seg_e.append(many[of[cut]])
        seg_a.append(off[cut])
        seg_z.append(off[end])
        seg_d.append(mind[cut])
    e, a, z, d = (np.concatenate(x) for x in (seg_e, seg_a, seg_z, seg_d))
    return uniq[e], a, z, d


def _grouped_fast(values):
    cut = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(values)]):
        yield None, slice(a, z)


RESULT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
    T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()),
])
_FULL = T.StructType([*RESULT.fields, T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))), T.StructField("kept", T.BinaryType())])


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and spans, kept bytes).

    A byte goes where a `length`-byte string covers it that also starts in a
    document with a smaller id. Null texts are empty. Rows with equal ids don't
    remove each other's text; a null id is larger than every other. Texts shorter
    than `length` stay whole, longer ones are read whole whatever their length. An empty
    table gives no rows. Only the two named columns are read, so others of any name don't matter.
    """
    bound_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = text_bytes(base, "text")
    shards, buckets = shards_for(total, SHARD_BYTES, 4), shards_for(total, BUCKET_BYTES, 4)
    dealt = base.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).select("shard", "id", "text")

    def triggers(batches):
        held, size = [], 0

        def flush():
            g, s = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((g, s, _bucket(g, buckets)))
            g, s = g[order], s[order]
            third = np.zeros(len(g), bool)  # two of a shard are enough to tell
            third[2:] = (g[2:] == g[1:-1]) & (g[1:-1] == g[:-2]) & (s[2:] == s[1:-1]) & (s[1:-1] == s[:-2])
            g, s = g[~third], s[~third]
            rows = [(b, _short(g[x]), s[x].tobytes()) for b, x in _grouped(_bucket(g, buckets))]
            return _rows(["bucket", "gram", "shard"], [pa.int32(), pa.binary(), pa.binary()], rows).to_batches()

        for batch in batches:
            for part in slices(batch, 2, SLICE):
                shard = np.array(part.column(0).to_pylist(), np.int32)
                parse = Parse(utf8(part.column(2)), length, keys=False)
                order = np.lexsort((parse.gram, parse.doc))
                g, d = parse.gram[order], parse.doc[order]
                new = np.ones(len(g), bool)
                new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
                held.append((g[new], shard[d[new]]))
                size += int(new.sum())
            if size > 1_000_000:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    def repeated(t: pa.Table) -> pa.Table:
        g, s = _long(t.column("gram")), _all(t.column("shard"), np.int32)
        order = np.argsort(g, kind="stable")
        g, s = g[order], s[order]
        twice = np.zeros(len(g), bool)
        twice[1:] = g[1:] == g[:-1]
        twice[:-1] |= twice[1:]
        g, s = g[twice], s[twice]
        order = np.lexsort((g, s))
        g, s = g[order], s[order]
        rows = [(b, _short(np.unique(g[x]))) for b, x in _grouped(s)]
        return _rows(["shard", "gram"], [pa.int32(), pa.binary()], rows)

    marks = dealt.mapInArrow(triggers, "bucket int, gram binary, shard binary").groupBy("bucket").applyInArrow(repeated, "shard int, gram binary")

    def parts(t: pa.Table):
        for batch in t.combine_chunks().to_batches():
            for part in slices(batch, 2, SLICE):
                ids = [_LAST if i is None else i for i in part.column(1).to_pylist()]
                texts = utf8(part.column(2))
                yield part, np.array(ids, np.int64), texts, Parse(texts, length)

    def entries(left: pa.Table, right: pa.Table) -> pa.Table:
        known = np.unique(_long(right.column("gram")))
        got, pack = [], zstandard.ZstdCompressor(level=3).compress
        shard = left.column("shard")[0].as_py() if left.num_rows else 0
        if len(known) and left.num_rows:
            for _, ids, _, parse in parts(left):
                short = parse.gram & ~np.uint64(0xFFFF)
                at = np.minimum(np.searchsorted(known, short), len(known) - 1)
                i = np.flatnonzero(known[at] == short)
                if not len(i):
                    continue
                d = ids[parse.doc[i]]
                key, first, inverse = np.unique(parse.key[i], return_index=True, return_inverse=True)
                low = np.full(len(key), _LAST)
                high = np.full(len(key), np.iinfo(np.int64).min)
                np.minimum.at(low, inverse, d)
                np.maximum.at(high, inverse, d)
                i = i[first]
                got.append((parse.gram[i], key, parse.n[i].astype(np.int32), low, high, [parse.phrase(x) for x in i.tolist()]))
        rows = []
        if got:
            g, key, n, low, high = (np.concatenate([x[k] for x in got]) for k in range(5))
            text = [p for x in got for p in x[5]]
            # copies of a phrase in the shard's slices are one entry
            key, first, inverse = np.unique(key, return_index=True, return_inverse=True)
            least, most = np.full(len(key), _LAST), np.full(len(key), np.iinfo(np.int64).min)
            np.minimum.at(least, inverse, low)
            np.maximum.at(most, inverse, high)
            g, n, low, high, text = g[first], n[first], least, most, [text[i] for i in first.tolist()]
            bucket = _bucket(g, buckets)
            order = np.argsort(bucket, kind="stable")
            for b, x in _grouped(bucket[order]):
                o = order[x]
                rows.append((b, shard, g[o].tobytes(), key[o].tobytes(), n[o].tobytes(), low[o].tobytes(), high[o].tobytes(), pack(b"".join(text[j] for j in o.tolist()))))
        return _rows(["bucket", "shard", "gram", "key", "n", "low", "high", "text"], [pa.int32(), pa.int32()] + [pa.binary()] * 6, rows)

    docs_by = dealt.groupBy("shard")
    dictionary = docs_by.cogroup(marks.groupBy("shard")).applyInArrow(entries, "bucket int, shard int, gram binary, key binary, n binary, low binary, high binary, text binary")

    def ordered(t: pa.Table) -> pa.Table:
        counts = [len(x) // 8 for x in t.column("gram").to_pylist()]
        shard = np.repeat(np.array(t.column("shard").to_pylist(), np.int64), counts)
        g, key, n = _all(t.column("gram"), np.uint64), _all(t.column("key"), np.uint64), _all(t.column("n"), np.int32).astype(np.int64)
        low, high = _all(t.column("low"), np.int64), _all(t.column("high"), np.int64)
        texts, k = [], 0
        for packed in t.column("text").to_pylist():
            blob, at = zstandard.decompress(packed), 0
            while at < len(blob):
                z = at + int(n[k]) + length - 1
                texts.append(blob[at:z])
                at, k = z, k + 1
        s_key, s_a, s_z, s_d = smallest_docs(g, key, n, low, texts, length)
        order = np.argsort(s_key, kind="stable")
        s_key, s_a, s_z, s_d = s_key[order], s_a[order], s_z[order], s_d[order]
        lo, hi = np.searchsorted(s_key, key, "left"), np.searchsorted(s_key, key, "right")
        times = hi - lo
        who = np.repeat(np.arange(len(key)), times)
        seg = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times) + np.repeat(lo, times)
        useful = s_d[seg] < high[who]  # for others no document of the shard loses anything
        who, seg = who[useful], seg[useful]
        order = np.argsort(shard[who], kind="stable")
        who, seg = who[order], seg[order]
        rows = [(b, key[who[x]].tobytes(), s_a[seg[x]].astype(np.int32).tobytes(), s_z[seg[x]].astype(np.int32).tobytes(), s_d[seg[x]].tobytes()) for b, x in _grouped(shard[who])]
        return _rows(["shard", "key", "a", "z", "low"], [pa.int32()] + [pa.binary()] * 4, rows)

    answers = dictionary.groupBy("bucket").applyInArrow(ordered, "shard int, key binary, a binary, z binary, low binary")

    def removed(left: pa.Table, right: pa.Table) -> pa.Table:
        key, a, z, low = _all(right.column("key"), np.uint64), _all(right.column("a"), np.int32), _all(right.column("z"), np.int32), _all(right.column("low"), np.int64)
        order = np.lexsort((low, z, a, key))
        key, a, z, low = key[order], a[order].astype(np.int64), z[order].astype(np.int64), low[order]
        out = []
        for part, ids, texts, parse in parts(left):
            lo, hi = np.searchsorted(key, parse.key, "left"), np.searchsorted(key, parse.key, "right")
            times = hi - lo
            who = np.repeat(np.arange(len(times)), times)
            seg = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times) + np.repeat(lo, times)
            hit = low[seg] < ids[parse.doc[who]]
            who, seg = who[hit], seg[hit]
            doc, s, e = parse.doc[who], parse.at[who] + a[seg], parse.at[who] + z[seg] + length
            order = np.lexsort((e, s, doc))
            doc, s, e = doc[order], s[order].tolist(), e[order].tolist()
            spans: dict[int, list] = {}
            for d, x, y in zip(doc.tolist(), s, e):
                mine = spans.setdefault(d, [])
                if mine and x <= mine[-1][1]:
                    mine[-1][1] = max(mine[-1][1], y)
                else:
                    mine.append([x, y])
            for i, (doc_id, text) in enumerate(zip(part.column(1).to_pylist(), texts)):
                mine, at, kept = spans.get(i, []), 0, []
                for x, y in mine:
                    kept.append(text[at:x])
                    at = y
                kept.append(text[at:])
                rest = b"".join(kept)
                row = (doc_id, len(text), len(text) - len(rest), len(mine), hashlib.sha256(rest).hexdigest())
                out.append((*row, [{"start": x, "end": y} for x, y in mine], rest) if with_text else row)
        kinds = [pa.int64()] * 4 + [pa.string()] + ([pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.binary()] if with_text else [])
        return _rows((_FULL if with_text else RESULT).names, kinds, out)

    return docs_by.cogroup(answers.groupBy("shard")).applyInArrow(removed, _FULL if with_text else RESULT)
