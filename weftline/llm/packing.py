"""Packing token sequences with Karmarkar-Karp multiway differencing.

A document becomes token ids and a final separator. Full windows are cut off its
front; what is left is cut into pieces of bounded length, and batches of pieces
are dealt over windows by differencing: the two partial partitions with the
largest imbalance merge, largest sums against smallest, until one is left. Where
a window would exceed the capacity, the window count rises and the batch is dealt
again. Nothing is shuffled: each task packs its own documents, batch by batch.
"""

from __future__ import annotations

import heapq
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, slices

CAPACITY = 2048
SEPARATOR = 1
#: Pieces are at most this long, and a batch fills so many windows up to this share.
PIECE = 512
WINDOWS = 96
SLACK = 12


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Deal items over k subsets with near-equal sums (largest differencing method).

    Returns the item numbers of each subset. A partial partition is a vector of k
    sums in descending order with a vector of tree nodes; merging adds the largest
    sums of one to the smallest of the other.
    """
    n = len(sizes)
    if k <= 1 or n == 0:
        return [list(range(n))] + [[] for _ in range(k - 1)]
    left, right = [0] * n, [0] * n  # nodes 0..n-1 are items
    heap, parts = [], {}
    for i, s in enumerate(sizes):
        heap.append((-s, i))
        parts[i] = (np.array([s]), np.array([i]))
    heapq.heapify(heap)
    serial = n
    while len(heap) > 1:
        a_sums, a_nodes = parts.pop(heapq.heappop(heap)[1])
        b_sums, b_nodes = parts.pop(heapq.heappop(heap)[1])
        la, lb = len(a_sums), len(b_sums)
        if la + lb <= k:  # no two subsets need to meet
            sums, nodes = np.concatenate([a_sums, b_sums]), np.concatenate([a_nodes, b_nodes])
        else:  # vectors hold no trailing zeros: pad a in front of the turned b
            sums, nodes = np.zeros(k, np.int64), np.full(k, -1, np.int64)
            sums[:la], nodes[:la] = a_sums, a_nodes
            met = nodes[k - lb :]
            turned = b_nodes[::-1]
            both = np.flatnonzero(met >= 0)
            if len(both):
                first = len(left)
                left.extend(met[both].tolist())
                right.extend(turned[both].tolist())
                fresh = turned.copy()
                fresh[both] = np.arange(first, len(left))
                nodes[k - lb :] = fresh
            else:
                nodes[k - lb :] = turned
            sums[k - lb :] += b_sums[::-1]
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        parts[serial] = (sums, nodes)
        spread = int(sums[0]) - (int(sums[-1]) if len(sums) == k else 0)
        heapq.heappush(heap, (-spread, serial))
        serial += 1
    _, nodes = parts.popitem()[1]
    out = []
    for root in nodes.tolist():
        items, todo = [], [root]
        while todo:
            x = todo.pop()
            if x < n:
                items.append(x)
            else:
                todo += (left[x], right[x])
        out.append(items)
    return out + [[] for _ in range(k - len(out))]


def windows_for(sizes: list[int], capacity: int) -> list[list[int]]:
    """The fewest windows, from the lower bound up, in which differencing keeps the capacity."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        dealt = differencing(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in dealt):
            return [w for w in dealt if w]
        k += 1


#: What the cached path relies on, as tokenizer files spell it: blanks, their replacement, the words and how they are cut, bytes as they are.
_FORM = [{"Regex": r"\s+"}, " ", {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "Removed", True, False, False]


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes, by a cache of words where that is exact.

    The cached path is taken only for tokenizers of the known form (NFC, white
    space dropped, lower case, words or runs of other characters, byte-level BPE)
    and for texts of printable ASCII and composed Latin letters, where a word
    between blanks has the same ids wherever it stands. All other texts go to the
    tokenizer whole.
    """

    #: Cached words; beyond this the cache starts anew, which changes no result.
    MOST = 400_000

    def __init__(self, path: str):
        import re

        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.whole = Tokenizer.from_file(path)
        form = json.loads(self.whole.to_str())
        steps = [x["type"] for x in (form.get("normalizer") or {}).get("normalizers", [])]
        cuts = [x["type"] for x in (form.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.known = steps == ["NFC", "Replace", "Lowercase"] and cuts == ["Split", "ByteLevel"] and _FORM == [
            form["normalizer"]["normalizers"][1].get("pattern"), form["normalizer"]["normalizers"][1].get("content"),
            *(form["pre_tokenizer"]["pretokenizers"][0].get(k) for k in ("pattern", "behavior", "invert")),
            *(form["pre_tokenizer"]["pretokenizers"][1].get(k) for k in ("add_prefix_space", "use_regex")),
        ]
        self.marks = [t["content"] for t in form.get("added_tokens", [])]
        self.plain = re.compile("[\t\n\r -~À-ÖØ-öø-ÿ]*").fullmatch
        self.model = self.whole.model
        # byte-level models spell bytes that don't print as code points from 256 up
        prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self.visible = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in prints)}
        self.cut = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+").findall
        self.words: dict[str, bytes] = {}
        self.chunks = _Chunks(self)

    def word(self, w: str) -> bytes:
        got = self.words.get(w)
        if got is None:
            if len(self.words) >= self.MOST:
                self.words.clear()
            tokens = self.model.tokenize(w.encode().decode("latin-1").translate(self.visible))
            got = self.words[w] = np.array([t.id for t in tokens], "<u4").tobytes()
        return got

    def __call__(self, text: str) -> bytes:
        if self.known and self.plain(text) and not any(m in text for m in self.marks):
            if len(self.chunks) >= self.MOST:
                self.chunks.clear()
            return b"".join(map(self.chunks.__getitem__, text.lower().split()))
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


class _Chunks(dict):
    """Ids by what stands between blanks."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, chunk: str) -> bytes:
        word = self.encoder.word
        stem = chunk.rstrip(".,;:!?")
        if stem.isalpha():
            ids = word(stem) + (word(chunk[len(stem) :]) if len(stem) < len(chunk) else b"")
        else:
            ids = b"".join(map(word, self.encoder.cut(chunk)))
        if len(chunk) <= 40:
            self[chunk] = ids
        return ids


RESULT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
])
RESULT_IDS = T.StructType([*RESULT.fields, T.StructField("ids", T.BinaryType())])


class Packer:
    """Packs a stream of documents; `rows` collects the pieces that have their place."""

    def __init__(self, first_sequence: int, capacity: int = CAPACITY, piece: int = PIECE, windows: int = WINDOWS, slack: int = SLACK):
        self.next, self.capacity, self.piece = first_sequence, capacity, min(piece, capacity)
        # a batch leaves a few tokens of each window free, so that near-equal sums fit
        self.room = windows * max(1, capacity - slack)
        self.rows: list[tuple] = []
        self.held: list[tuple] = []
        self.sum = 0

    def add(self, doc_id, ids: bytes) -> None:
        n = len(ids) // 4
        at = 0
        while n - at >= self.capacity:
            self.rows.append((doc_id, at, self.capacity, ids[4 * at : 4 * (at + self.capacity)], n, self.next, 0))
            self.next += 1
            at += self.capacity
        while at < n:
            k = min(self.piece, n - at, self.room - self.sum)
            self.held.append((doc_id, at, k, ids[4 * at : 4 * (at + k)], n))
            self.sum += k
            at += k
            if self.sum == self.room:
                self.deal()

    def deal(self) -> None:
        for window in windows_for([h[2] for h in self.held], self.capacity):
            offset = 0
            for i in window:
                self.rows.append((*self.held[i], self.next, offset))
                offset += self.held[i][2]
            self.next += 1
        self.held, self.sum = [], 0

    def take(self, with_ids: bool) -> pa.RecordBatch:
        cols = list(zip(*self.rows)) if self.rows else [[]] * 7
        self.rows = []
        made = [pa.array(list(cols[i]), pa.int64()) for i in (0, 1, 2)] + [pa.array([zlib.crc32(b) for b in cols[3]], pa.int64())] + [pa.array(list(cols[i]), pa.int64()) for i in (4, 5, 6)]
        if with_ids:
            made.append(pa.array(list(cols[3]), pa.binary()))
        return pa.RecordBatch.from_arrays(made, names=(RESULT_IDS if with_ids else RESULT).names)


_encoders: dict[str, Encoder] = {}


def pack(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, separator: int = SEPARATOR, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    `tokenizer` is the path of a tokenizer file that every executor can read. A
    null text is empty: its document is the separator alone. Rows with equal or
    null ids are separate documents; a text of any length is encoded whole. An empty table
    gives no rows. Only the two named columns are read, so others of any name don't matter. Sequence ids carry the task's partition in
    their upper bits, so they are unique and the same when a task runs again.
    """
    bound_batches(docs.sparkSession)
    only = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    end = np.array([separator], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoders.setdefault(tokenizer, None) or _encoders.__setitem__(tokenizer, Encoder(tokenizer)) or _encoders[tokenizer]
        packer = Packer(TaskContext.get().partitionId() << 32, capacity)
        for batch in batches:
            for part in slices(batch, 1):
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    packer.add(doc_id, (encode(text) if text else b"") + end)
                yield packer.take(with_ids)
        if packer.held:
            packer.deal()
        yield packer.take(with_ids)

    return only.mapInArrow(run, RESULT_IDS if with_ids else RESULT)
