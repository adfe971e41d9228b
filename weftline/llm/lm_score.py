"""Language-model scoring with a hashed maximum-entropy model and a class-factored softmax.

The model of classes gives P(class | history) P(token | class). The most frequent words
are classes of their own, all others fall into classes by their endings; the end of
a text is a class too. P(class | history) is a softmax over hashed features of the
classes before: the last, the last two, and (skipping one) the one before. P(token
| class) is the token's share of its class. A token that training has never seen is
one outcome more, with the share that words seen once have in training.

Evidence of words on words is put on top, level by level: the word before the last
(a skip), the last, and both. A level with n training tokens after its history gives
P = (n(history, token) + b P') / (n + b), with P' of the level below. b is so chosen that P'
gets over all of training what Good and Turing's estimate takes from seen counts. The counts are of all training rows, by hashes
of history and token whose space grows with the input: 2**32 for each bucket.

Texts are read once: their tokens go to a table, a row for each shard of documents, as
numbers into the shard's own list of word hashes. Everything is learned from all
training rows: each shard sends, bucket by bucket, the hashes it holds with their counts,
and is answered with the counts of the whole training corpus; so the one shuffle that
counts is also the one that asks, and no table of all words is ever in one place.
Training of the class model is full gradient descent on the class-trigram counts that
decide its likelihood: each step sends the weights to the partitions of those counts and
adds up their gradients.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, checkpointed, release, shards_for, slices, text_bytes, utf8

TOP = 40
TAILS = 56
CLASSES = 1 + TOP + TAILS  # the end of a text is class 0
START = CLASSES  # stands for what is before the text, in histories only
ROWS = 1 << 13
STEPS = 30
PRIOR = 2.0  # inverse variance of the weights
PARTS = 6  # tasks of a gradient step: the class counts have a fixed size
SHARD_BYTES = 6 << 20
BUCKET_BYTES = 8 << 20
SLICE = 1 << 20
END_KEY = 0
#: Stands for what is before the text in the hashes of words.
START_KEY = 0x2545F4914F6CDD1D
#: New words expected after n tokens grow as n ** HEAPS (Heaps' law), by a factor fitted for each level.
HEAPS = 0.75
BINS = 48
#: Numbers of events that occur 1, 2, ... times are kept below this, for Good and Turing's estimate.
OFTEN = 10


def words(text: bytes) -> list[bytes]:
    return text.lower().split()


def word_key(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) or 1


def tail_class(word: bytes) -> int:
    """By the ending without closing punctuation, and whether there was any."""
    stem = word.rstrip(b".,;:!?\"')")
    return xxhash.xxh3_64_intdigest(stem[-3:], 1 + (len(stem) < len(word))) % TAILS


def _feature_rows() -> np.ndarray:
    """Weight rows of each history (class before last, last class): bias, last, both, skip."""
    c2, c1 = (x.ravel() for x in np.indices((CLASSES + 1, CLASSES + 1)))

    def hashed(kind, a, b):
        h = np.uint64(kind * 0x9E3779B97F4A7C15 % (1 << 64)) ^ (a.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + b.astype(np.uint64) * np.uint64(0x165667B19E3779F9))
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return 1 + ((h ^ (h >> np.uint64(32))) % np.uint64(ROWS - 1)).astype(np.int64)

    zero = np.zeros_like(c1)
    return np.stack([zero, hashed(1, c1, zero), hashed(2, c1, c2), hashed(3, c2, zero)], 1)


def class_log_probs(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Natural-log softmax over classes, a line per history in `rows`."""
    z = weights[rows].sum(1)
    z -= z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def gradient(weights: np.ndarray, history: np.ndarray, counts: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, float]:
    """Of the log likelihood, for class counts by history."""
    rows = features[history]
    logp = class_log_probs(weights, rows)
    diff = counts - counts.sum(1, keepdims=True) * np.exp(logp)
    out = np.zeros_like(weights)
    for k in range(rows.shape[1]):
        order = np.argsort(rows[:, k], kind="stable")
        r = rows[order, k]
        cut = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        out[r[cut]] += np.add.reduceat(diff[order], cut, axis=0)
    return out, float((counts * logp).sum())


@dataclass
class Model:
    tokens: int
    known: int
    unseen: float
    top: dict[int, int]
    mass: np.ndarray
    weights: np.ndarray


def _rows(names, kinds, rows):
    cols = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.table([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=names)


def _bucket(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(20)) % np.uint64(n)).astype(np.int64)


def _runs(values):
    if len(values):
        cut = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])).tolist()
        for a, z in zip(cut, [*cut[1:], len(values)]):
            yield int(values[a]), slice(a, z)


def _cat(column, kind):
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x in column.to_pylist() if x)])


def pack(a: np.ndarray, rising: bool = False) -> bytes:
    """Whole numbers (or their steps, where they rise) by byte planes, compressed."""
    a = np.diff(a, prepend=a.dtype.type(0)) if rising else a
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.dtype.itemsize).T).tobytes())


def unpack(blob: bytes, kind, rising: bool = False) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    a = np.ascontiguousarray(planes.T).reshape(-1).view(kind)
    return np.cumsum(a, dtype=kind) if rising else a


def _mixed(kind: int, a: np.ndarray, b: np.ndarray, c: np.ndarray | None = None) -> np.ndarray:
    h = a * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(kind * 0x9E3779B97F4A7C15 % (1 << 64))
    for x in (b,) if c is None else (b, c):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) + x
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(31))) & np.uint64(0xFFFFFFFFFFFFFFFC)) | np.uint64(kind)  # the kind stays readable


def feature_keys(keys: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of skip, pair and triple at each token; `keys` of tokens of texts in a row (ends included), `place` of each in its text.

    There is no skip at the first two tokens and no triple at the first: their lines are not to be used.
    """
    one = np.where(place >= 1, np.roll(keys, 1), np.uint64(START_KEY))
    two = np.where(place >= 2, np.roll(keys, 2), np.uint64(START_KEY))
    return _mixed(1, two, keys), _mixed(2, one, keys), _mixed(3, two, one, keys)


def _bins(n: np.ndarray) -> np.ndarray:
    """Tokens by the binary logarithm of their counts."""
    return np.bincount(np.log2(np.maximum(n, 1)).astype(np.int64), weights=n, minlength=BINS).astype(np.int64)


def left_share(times: np.ndarray, tokens: int) -> float:
    """Of the tokens, what the level below gets; times[r]: events that occur r times (r < OFTEN).

    That is what new events need and, for counts that mostly tell of chance, what the
    slope of r* = (r + 1) times[r + 1] / times[r] over r lacks to 1.
    """
    new = (times[1] + 1) / (tokens + 2)
    r = np.flatnonzero(times[:-1] * (np.arange(len(times) - 1) > 0))
    if len(r) < 2:
        return new
    weight = r * times[r]
    star = (r + 1) * times[r + 1] / times[r]
    mean = lambda x: (weight * x).sum() / weight.sum()
    slope = mean((r - mean(r)) * (star - mean(star))) / mean((r - mean(r)) ** 2)
    return min(0.999, new + (1 - new) * min(1, weight.sum() / max(1, tokens)) * (1 - min(1, max(0, slope))))


def fit_spread(bins: np.ndarray, times: np.ndarray) -> float:
    """The factor of n ** HEAPS that leaves the level below its share of the tokens, by counts of their histories."""
    n = 2.0 ** np.arange(BINS) * np.where(np.arange(BINS) > 0, 1.4, 1)
    share = left_share(times, int(bins.sum()))
    low, high = -12.0, 12.0
    for _ in range(60):
        mid = (low + high) / 2
        b = np.exp(mid) * n**HEAPS
        low, high = (mid, high) if (bins * b / (n + b)).sum() < share * bins.sum() else (low, mid)
    return float(np.exp(high))


def _placed(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket, then 32 bits of the hash."""
    return (((keys >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF))


def tokens(docs: DataFrame) -> DataFrame:
    """One row per shard of (id, text, held): ids, held, lens (tokens of each text, its end among them), and packed tokens.

    Tokens are numbers into `keys` and `tails`, the hashes and tail classes of the shard's
    words in order of their hashes; the end is the first of them. A shard is about
    SHARD_BYTES of text, or one text that is longer.
    """

    def run(batches):
        number: dict[bytes, int] = {}
        ids, held, lens, got, size, made = [], [], [], [], 0, 0

        def flush():
            ws = [*number]
            keys = np.array([END_KEY, *map(word_key, ws)], np.uint64)
            tails = np.array([0, *map(tail_class, ws)], np.uint8)
            order = np.argsort(keys, kind="stable")
            place = np.empty(len(keys), np.uint32)
            place[order] = np.arange(len(keys), dtype=np.uint32)
            row = ((TaskContext.get().partitionId() << 32) + made, ids, held, lens, pack(keys[order], True), tails[order].tobytes(), pack(place[np.concatenate(got)]))
            return _rows(_TOKENS.names, [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()], [row]).to_batches()

        for batch in batches:
            for part in slices(batch, 1, SLICE):
                for doc_id, text, out in zip(part.column(0).to_pylist(), utf8(part.column(1)), part.column(2).to_pylist()):
                    ws = words(text)
                    try:
                        found = [number[w] for w in ws]
                    except KeyError:
                        for w in ws:
                            if w not in number:
                                number[w] = len(number) + 1
                        found = [number[w] for w in ws]
                    found.append(0)
                    got.append(np.array(found, np.uint32))
                    ids.append(doc_id)
                    held.append(out)
                    lens.append(len(found))
                    size += len(text)
                    if size > SHARD_BYTES:
                        yield from flush()
                        number.clear()
                        ids, held, lens, got, size, made = [], [], [], [], 0, made + 1
        if ids:
            yield from flush()

    return docs.select("id", "text", "held").mapInArrow(run, _TOKENS)


_TOKENS = T.StructType([
    T.StructField("shard", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("held", T.ArrayType(T.BooleanType())), T.StructField("lens", T.ArrayType(T.IntegerType())),
    T.StructField("keys", T.BinaryType()), T.StructField("tails", T.BinaryType()), T.StructField("tokens", T.BinaryType()),
])


class Shard:
    """A row of tokens()."""

    def __init__(self, row: dict):
        self.number, self.ids, self.held = row["shard"], row["ids"], row["held"]
        self.lens = np.array(row["lens"], np.int64)
        self.keys, self.tails = unpack(row["keys"], np.uint64, True), np.frombuffer(row["tails"], np.uint8)
        self.tokens = unpack(row["tokens"], np.uint32)
        self.starts = np.cumsum(self.lens) - self.lens
        self.place = np.arange(len(self.tokens)) - np.repeat(self.starts, self.lens)
        self.training = ~np.repeat(np.array(self.held, bool), self.lens)

    def words(self, buckets: int):
        """Bucket by bucket: the lines of its words."""
        bucket = _bucket(self.keys, buckets)
        order = np.argsort(bucket, kind="stable")
        return [(b, order[s]) for b, s in _runs(bucket[order])]

    def hashes(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Of skips, pairs and triples of all tokens, then of the end as skip of each text's last word: place (see _placed), and whether it counts.

        With those ends a word has as many skips as tokens. The first tokens' skips, and the
        first's triple, never count.
        """
        keys = self.keys[self.tokens]
        skip, pair, triple = feature_keys(keys, self.place)
        ends = self.starts + self.lens - 1
        ends = ends[self.lens > 1]
        counts = [self.training & (self.place >= 2), self.training, self.training & (self.place >= 1), self.training[ends]]
        return _placed(np.concatenate([skip, pair, triple, _mixed(1, keys[ends - 1], keys[ends])]), buckets), np.concatenate(counts)


def _shards(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield Shard(batch.slice(i, 1).to_pylist()[0])


def _shrunk(n: np.ndarray) -> bytes:
    """Counts, in the least width that holds them; the first byte tells which."""
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if not len(n) or int(n.max()) <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + pack(n.astype(kind))


def _grown(blob: bytes) -> np.ndarray:
    return unpack(blob[1:], {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[blob[0]]).astype(np.int64)


def word_totals(tokens: DataFrame, buckets: int) -> DataFrame:
    """Per bucket of word hashes: a row for each shard, with the training counts of its words there, and one (null shard) with sums."""

    def count(batches):
        for shard in _shards(batches):
            n = np.bincount(shard.tokens[shard.training], minlength=len(shard.keys))
            rows = [(b, shard.number, pack(shard.keys[at], True), shard.tails[at].tobytes(), _shrunk(n[at])) for b, at in shard.words(buckets)]
            yield from _rows(["bucket", "shard", "key", "tail", "n"], [pa.int32(), pa.int64()] + [pa.binary()] * 3, rows).to_batches()

    def total(t: pa.Table) -> pa.Table:
        shards = t.column("shard").to_pylist()
        asked = [unpack(x, np.uint64, True) for x in t.column("key").to_pylist()]
        key, at, where = np.unique(np.concatenate(asked), return_index=True, return_inverse=True)
        n = np.bincount(where, np.concatenate([_grown(x) for x in t.column("n").to_pylist()]), len(key)).astype(np.int64)  # exact up to 2^53
        tail = _cat(t.column("tail"), np.uint8)[at]
        word = key != END_KEY
        mass = np.bincount(tail[word], n[word], TAILS).astype(np.int64)
        best = np.lexsort((key[word], -n[word]))[:TOP]
        top = [{"key": int(k) - (1 << 63), "n": int(c), "tail": int(z)} for k, c, z in zip(key[word][best], n[word][best], tail[word][best]) if c]
        cut = np.cumsum([0, *map(len, asked)])
        bucket = t.column("bucket")[0].as_py()
        rows = [(bucket, s, _shrunk(n[where[a:z]]), None, None, None, None, None, None) for s, a, z in zip(shards, cut, cut[1:])]
        rows.append((bucket, None, None, int(n.sum()), int((n > 0).sum()), int((n == 1).sum()), mass.tolist(), top, _bins(n[n > 0]).tolist()))
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.struct([("key", pa.int64()), ("n", pa.int64()), ("tail", pa.int32())])), pa.list_(pa.int64())]
        return _rows(["bucket", "shard", "n", "tokens", "known", "once", "mass", "top", "bins"], kinds, rows)

    packed = tokens.mapInArrow(count, "bucket int, shard long, key binary, tail binary, n binary")
    return packed.groupBy("bucket").applyInArrow(total, "bucket int, shard long, n binary, tokens long, known long, once long, mass array<long>, top array<struct<key:long,n:long,tail:int>>, bins array<long>")


def feature_totals(tokens: DataFrame, buckets: int) -> DataFrame:
    """Per bucket of hashes of skips, pairs and triples: a row for each shard, with the training counts of its hashes there in rising order, and one (null shard) with sums."""

    def count(batches):
        for shard in _shards(batches):
            at, counts = shard.hashes(buckets)
            both = (at << np.uint64(1)) | counts
            both.sort()
            at = both >> np.uint64(1)
            cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            n = np.add.reduceat((both & np.uint64(1)).astype(np.int64), cut)
            at = at[cut]
            rows = [(b, shard.number, pack(at[s].astype(np.uint32), True), _shrunk(n[s])) for b, s in _runs((at >> np.uint64(32)).astype(np.int64))]
            yield from _rows(["bucket", "shard", "fkey", "fn"], [pa.int32(), pa.int64(), pa.binary(), pa.binary()], rows).to_batches()

    def total(t: pa.Table) -> pa.Table:
        asked = [unpack(x, np.uint32, True) for x in t.column("fkey").to_pylist()]
        sizes = [len(x) for x in asked]
        key = np.concatenate(asked)
        del asked
        n = np.concatenate([_grown(x) for x in t.column("fn").to_pylist()])
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sums, kind = np.add.reduceat(n, cut), key[cut] & np.uint32(3)
        times = np.bincount(kind[sums < OFTEN] * OFTEN + sums[sums < OFTEN], minlength=4 * OFTEN).tolist()
        n[order] = np.repeat(sums, np.diff(np.append(cut, len(key))))  # back in the order asked
        ends = np.cumsum([0, *sizes])
        bucket = t.column("bucket")[0].as_py()
        rows = [(bucket, s, _shrunk(n[a:z]), None, None) for s, a, z in zip(t.column("shard").to_pylist(), ends, ends[1:])]
        rows.append((bucket, None, None, times, _bins(sums[(kind == 2) & (sums > 0)]).tolist()))
        return _rows(["bucket", "shard", "fn", "ftimes", "fbins"], [pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())], rows)

    asked = tokens.mapInArrow(count, "bucket int, shard long, fkey binary, fn binary")
    return asked.groupBy("bucket").applyInArrow(total, "bucket int, shard long, fn binary, ftimes array<long>, fbins array<long>")


def spreads(totals: DataFrame, features: DataFrame) -> tuple[float, float, float]:
    """Of skip, pair and triple. Histories of the first two are words (or starts, as many as ends), of the last pairs."""

    def summed(table, column, n):
        got = {r["i"]: r["x"] for r in table.select(F.posexplode(column).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()}
        return np.array([got.get(i, 0) for i in range(n)], np.int64)

    by_word, by_pair, times = summed(totals, "bins", BINS), summed(features, "fbins", BINS), summed(features, "ftimes", 4 * OFTEN).reshape(4, OFTEN)
    return fit_spread(by_word, times[1]), fit_spread(by_word, times[2]), fit_spread(by_pair, times[3])


def classes_of(keys: np.ndarray, tails: np.ndarray, top: dict[int, int]) -> np.ndarray:
    """Class numbers of words; `top` has those of the most frequent, by hash."""
    out = 1 + TOP + tails.astype(np.int64)
    if top:
        best = np.array(sorted(top), np.uint64)
        at = np.minimum(np.searchsorted(best, keys), len(best) - 1)
        out = np.where(best[at] == keys, np.array([top[int(k)] for k in best])[at], out)
    return np.where(keys == END_KEY, 0, out)


def _history(cls: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Of each token: the number of the history (class before last, last)."""
    return np.where(place >= 2, np.roll(cls, 2), START) * (CLASSES + 1) + np.where(place >= 1, np.roll(cls, 1), START)


def class_counts(tokens: DataFrame, top: dict[int, int]) -> DataFrame:
    """(group, counts): class counts by history of all training rows, a group per class before last."""
    shared = tokens.sparkSession.sparkContext.broadcast(top)  # TOP numbers
    size = (CLASSES + 1) ** 2 * CLASSES
    each = (CLASSES + 1) * CLASSES

    def count(batches):
        held = np.zeros(size, np.int64)
        for shard in _shards(batches):
            cls = classes_of(shard.keys, shard.tails, shared.value)[shard.tokens]
            held += np.bincount((_history(cls, shard.place) * CLASSES + cls)[shard.training], minlength=size)
        at = np.flatnonzero(held)
        rows = [(g, (at[s] - g * each).astype(np.int32).tobytes(), held[at[s]].tobytes()) for g, s in _runs(at // each)]
        yield from _rows(["group", "at", "n"], [pa.int32(), pa.binary(), pa.binary()], rows).to_batches()

    def total(t: pa.Table) -> pa.Table:
        out = np.zeros(each, np.int64)
        for at, n in zip(t.column("at").to_pylist(), t.column("n").to_pylist()):
            out[np.frombuffer(at, np.int32)] += np.frombuffer(n, np.int64)
        return _rows(["group", "counts"], [pa.int32(), pa.binary()], [(t.column("group")[0].as_py(), out.tobytes())])

    return tokens.mapInArrow(count, "group int, at binary, n binary").groupBy("group").applyInArrow(total, "group int, counts binary")


def fit(counts: DataFrame, prior: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Weights by full-gradient Adagrad over the distributed class counts, from the class shares on."""
    sc = counts.sparkSession.sparkContext
    weights = np.zeros((ROWS, CLASSES), np.float32)
    weights[0] = np.log(np.maximum(prior, 1e-12))
    squares = np.full_like(weights, 1e-8)
    table = checkpointed(counts)
    dealt = table.coalesce(PARTS)
    for _ in range(steps):
        shared = sc.broadcast(weights)

        def step(batches, shared=shared):
            features, total, ll, seen = _feature_rows(), None, 0.0, 0
            for batch in batches:
                for g, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    n = np.frombuffer(blob, np.int64).reshape(CLASSES + 1, CLASSES)
                    used = np.flatnonzero(n.sum(1))
                    grad, value = gradient(shared.value, g * (CLASSES + 1) + used, n[used].astype(np.float32), features)
                    total = grad if total is None else total + grad
                    ll, seen = ll + value, seen + int(n.sum())
            if total is not None:
                rows = np.flatnonzero(total.any(1))  # most of a task's rows are 0: they need no way to the driver
                yield from _rows(["at", "grad", "ll", "seen"], [pa.binary(), pa.binary(), pa.float64(), pa.int64()], [(rows.tobytes(), total[rows].tobytes(), ll, seen)]).to_batches()

        # PARTS rows of at most the weights' fixed size, whatever the input
        got = dealt.mapInArrow(step, "at binary, grad binary, ll double, seen long").collect()
        if not got:
            break
        grad = np.zeros(weights.shape)
        for r in got:
            grad[np.frombuffer(r["at"], np.int64)] += np.frombuffer(r["grad"], np.float32).reshape(-1, CLASSES)
        grad[1:] -= PRIOR * weights[1:]  # rare histories stay with the class shares
        grad /= max(1, sum(r["seen"] for r in got))
        squares += (grad * grad).astype(np.float32)
        weights = (weights + 0.4 * grad / np.sqrt(squares)).astype(np.float32)
        shared.unpersist()
    release(table)
    return weights


def train(tokens: DataFrame, totals: DataFrame, steps: int = STEPS) -> Model:
    """`totals`: the word_totals of `tokens`, in a table."""
    sums = totals.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "known", "once")]).first()
    best = totals.select(F.explode("top").alias("t")).select("t.*").orderBy(F.desc("n"), "key").limit(TOP).collect()
    tails = {r["i"]: r["m"] for r in totals.select(F.posexplode("mass").alias("i", "m")).groupBy("i").agg(F.sum("m").alias("m")).collect()}
    top = {(r["key"] + (1 << 63)): 1 + i for i, r in enumerate(best)}
    mass = np.zeros(CLASSES)
    for i, r in enumerate(best):
        mass[1 + i] = r["n"]
    for i in range(TAILS):
        mass[1 + TOP + i] = tails.get(i, 0) - sum(r["n"] for r in best if r["tail"] == i)
    mass[0] = sums["tokens"] - mass.sum()
    share = (mass + 0.5) / (mass.sum() + 0.5 * CLASSES)
    weights = fit(class_counts(tokens, top), share, steps) if sums["tokens"] else np.zeros((ROWS, CLASSES), np.float32)
    unseen = (sums["once"] + 1) / (sums["tokens"] + 2)
    return Model(sums["tokens"], sums["known"], unseen, top, mass, weights)


def stacked(p: np.ndarray, n: np.ndarray, of_history: np.ndarray, factor: float) -> np.ndarray:
    """`p` with a level's evidence: n tokens of of_history were seen. A level without its history changes nothing."""
    spread = factor * np.maximum(of_history, 1) ** HEAPS
    return np.where(of_history > 0, (np.minimum(n, of_history) + spread * p) / (of_history + spread), p)


RESULT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
    T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()),
])


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, steps: int = STEPS) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (see the module).

    Rows whose crc32 of the id (as text) mod `folds` is 0 are held out; all others
    train, those with a null id too. A null or empty text is its end alone. Rows
    with equal ids are scored, and counted, each for itself. With nothing to train
    on, every token is unseen.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(False))
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), held.alias("held"))
    buckets = shards_for(text_bytes(base, "text"), BUCKET_BYTES, 4)
    table = checkpointed(tokens(base))
    totals = checkpointed(word_totals(table, buckets))
    features = checkpointed(feature_totals(table, buckets))
    spread = spreads(totals, features)
    model = spark.sparkContext.broadcast(train(table, totals, steps))  # of a fixed size

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        m, out = model.value, []
        for shard in _shards(left.to_batches()):
            told = sorted(zip(right.column("bucket").to_pylist(), right.column("n").to_pylist(), right.column("fn").to_pylist()), key=lambda r: r[0])
            c = np.zeros(len(shard.keys), np.int64)
            for (_, at), n in zip(shard.words(buckets), (n for _, n, _ in told if n)):
                c[at] = _grown(n)
            counts = np.concatenate([_grown(x) for _, _, x in told if x])
            tok, place = shard.tokens, shard.place
            at, _ = shard.hashes(buckets)
            order = np.argsort(at)
            rising = at[order]
            of_hash = np.empty(len(at), np.int64)
            of_hash[order] = counts[np.cumsum(np.concatenate([[0], rising[1:] != rising[:-1]]))]
            del order, rising, at
            skip, pair, triple = of_hash[: 3 * len(tok)].reshape(3, -1)
            classes = classes_of(shard.keys, shard.tails, m.top)
            base_term = np.log10((c + 0.1) / (m.tokens + 0.1 * (m.known + 1)))
            seen = c > 0
            own = np.where(seen, np.log10(np.maximum(c, 1) / np.maximum(m.mass[classes], 1)) + np.log10(1 - m.unseen), np.log10(m.unseen))
            of_token, cls = c[tok], classes[tok]
            levels = ((skip, np.where(place >= 2, np.roll(of_token, 2), 0)), (pair, np.where(place >= 1, np.roll(of_token, 1), c[0])), (triple, np.where(place >= 1, np.roll(pair, 1), 0)))
            log_class = class_log_probs(m.weights, _feature_rows()) / np.log(10)
            p = 10.0 ** (own[tok] + np.where(seen[tok], log_class[_history(cls, place), cls], 0))
            for (got, of_history), factor in zip(levels, spread):
                p = stacked(p, got, of_history, factor)
            sums = zip(*(np.add.reduceat(x, shard.starts).tolist() for x in (seen[tok].astype(np.int64), base_term[tok], np.log10(p))))
            out += [(doc_id, out_, n, n_seen, m.tokens, of_base, of_model) for doc_id, out_, n, (n_seen, of_base, of_model) in zip(shard.ids, shard.held, shard.lens.tolist(), sums)]
        return _rows(RESULT.names, [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()], out)

    told = totals.select("shard", "bucket", "n").unionByName(features.select("shard", "bucket", "fn"), allowMissingColumns=True).where("shard is not null")
    return table.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(judge, RESULT)
