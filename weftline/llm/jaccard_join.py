"""N-gram Jaccard join with PartEnum signatures.

Sets whose Jaccard likeness is at least t differ in few elements: at most
k = (1-t)/(1+t) times the sum of their sizes. Sizes are cut into bands whose ends
stand in the ratio t, so two such sets lie in one band or in neighbours; every set
is signed for its own band and for the next. Within a band the element domain is
partitioned by a hash into more than k parts, and the projections of a set on
single parts are its signatures: of more than k parts that hold elements of a
set, at least one has no difference.

Parts with one element say little, so only parts with two or more are signed
where a set has more than k of those, else all that are not empty; a set that
falls short under one hash is signed under further ones as well. A pair is found
as soon as one of the two suffices, hence no link is lost.

Signatures travel as packed 64-bit numbers. Groups of sets that share one are
joined in two rounds: first each set with the best-connected member of its groups,
then, between the components so found, those that still share a signature and whose
elements that occur anywhere else would be enough: pair by pair where few sets of a
group are outside its main component, else by blocks. Likeness is always computed from whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, checkpointed, fresh, release, shards_for, slices, text_bytes, utf8, with_class
from .components import components

NUM, DEN = 80, 100
SHINGLE = 5
BUCKET_BYTES = 8 << 20
SLICE = 1 << 20
SEEDS = 64
#: Groups with at most this many sets outside their main component are compared as rows of pairs, others in tiles.
FEW = 64
#: A side of a tile: about this many sets, and about this many elements.
BLOCK_SETS, BLOCK_ELEMENTS = 1024, 400_000
#: Cells of the matrices that a tile multiplies at a time.
PRODUCT = 8 << 20

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xC2B2AE3D27D4EB4F)
_C = np.uint64(0x165667B19E3779F9)
_IDX = np.uint64((1 << 24) - 1)


def _mix(h):
    h = (h ^ (h >> np.uint64(31))) * _B
    h = (h ^ (h >> np.uint64(29))) * _C
    return h ^ (h >> np.uint64(32))


class Shingler:
    """Sets of word n-grams as sorted arrays of 64-bit hashes."""

    MOST = 500_000  # cached words; beyond this the cache starts anew

    def __init__(self, size: int = SHINGLE):
        self.size = size
        self.cache: dict[bytes, int] = {}

    def hashes(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        n = len(words)
        if not n:
            return np.zeros(0, np.uint64)
        cache = self.cache
        try:
            w = np.array([cache[x] for x in words], np.uint64)
        except KeyError:
            if len(cache) > self.MOST:
                cache.clear()
            for x in words:
                if x not in cache:
                    cache[x] = xxhash.xxh3_64_intdigest(x)
            w = np.array([cache[x] for x in words], np.uint64)
        size = min(n, self.size)
        h = np.zeros(n - size + 1, np.uint64)
        for i in range(size):
            h = (h + w[i : n - size + 1 + i]) * _A
        return np.unique(_mix(h + np.uint64(size)))


def bands(most: int, num: int = NUM, den: int = DEN) -> list[tuple[int, int]]:
    """[(least, largest size)] up to the size `most` and one band more."""
    out, lo = [], 1
    while not out or out[-1][0] <= most:
        hi = max(lo, lo * den // num)
        out.append((lo, hi))
        lo = hi + 1
    return out


def signatures(sets: list[np.ndarray], num: int = NUM, den: int = DEN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(2 * set number + step, 64-bit signature) of all sets, and per set and step how many must be shared.

    step is 0 for the own band and 1 for the next. A set that signs its parts of
    two or more elements shares at least their number less k with any set like it.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    need = np.ones(2 * len(sets), np.int64)
    if not sizes.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), need
    table = bands(int(sizes.max()), num, den)
    lows = np.array([b[0] for b in table])
    band = np.searchsorted(lows, sizes, side="right") - 1
    who, what = [], []
    for step in (0, 1):
        target = band + step
        hi = np.array([b[1] for b in table] + [0])[np.minimum(target, len(table) - 1)]
        lo = lows[np.minimum(target, len(table) - 1)]
        # as the smaller of a pair: only if sizes of the next band can be like it
        todo = np.flatnonzero((sizes > 0) & ((step == 0) | ((target < len(table)) & (sizes * den >= lo * num))))
        # a third more parts than the largest difference, so that enough of them hold two elements
        parts = 27 * 2 * (den - num) * hi // (20 * (den + num)) + 2
        reach = np.minimum(hi, sizes * den // num)
        k = (den - num) * (sizes + reach) // (den + num)
        for seed in range(SEEDS):
            if not len(todo):
                break
            todo = _sign(sets, todo, parts, k, target, seed, step, who, what, need)
        for i in todo.tolist():  # no seed sufficed: two like sets share an element at least
            who.append(np.full(len(sets[i]), 2 * i + step))
            what.append(_mix(sets[i] * _A + np.uint64(target[i] * 131 + 977)))
    return np.concatenate(who), np.concatenate(what), need


def _sign(sets, todo, parts, k, target, seed, step, who, what, need) -> np.ndarray:
    """Sign the sets in `todo` under one seed; returns those it doesn't suffice for."""
    lens = np.array([len(sets[i]) for i in todo.tolist()])
    e = np.concatenate([sets[i] for i in todo.tolist()])
    of = np.repeat(np.arange(len(todo)), lens)
    n = parts[todo]
    base = np.cumsum(n) - n
    part = base[of] + (_mix(e + np.uint64(seed) * _A) % n[of].astype(np.uint64)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    part, of, e = part[order], of[order], e[order]
    cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    count = np.diff(np.append(cut, len(part)))
    total = np.add.reduceat(_mix(e * _B + np.uint64(7)), cut)
    owner = of[cut]
    place = (part[cut] - base[owner]).astype(np.uint64)
    pairs = np.bincount(owner[count >= 2], minlength=len(todo))
    strong = pairs > k[todo]
    if seed == 0:
        need[2 * todo + step] = np.where(strong, pairs - k[todo], 1)
    enough = strong | (np.bincount(owner, minlength=len(todo)) > k[todo])
    kept = (count >= 2) | ~strong[owner]
    owner, total, place = owner[kept], total[kept], place[kept]
    tag = (target[todo][owner].astype(np.uint64) * np.uint64(SEEDS + 1) + np.uint64(seed)) * _C
    who.append(2 * todo[owner] + step)
    what.append(_mix(total + _mix(place * _A + tag)))
    return todo[~enough]


def _rows(names, kinds, rows):
    cols = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.table([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=names)


def set_sizes(docs: DataFrame) -> DataFrame:
    """(id, n, d1, d2) per row of (id, text): the size of its set and a 128-bit digest of it."""

    def run(batches):
        make = Shingler().hashes
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                rows = []
                for doc_id, text in zip(part.column(0).to_pylist(), utf8(part.column(1))):
                    s = make(text)
                    d = xxhash.xxh3_128_intdigest(s.tobytes())
                    rows.append((doc_id, len(s), (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63)))
                yield from _rows(["id", "n", "d1", "d2"], [pa.int64()] * 4, rows).to_batches()

    return docs.mapInArrow(run, "id long, n long, d1 long, d2 long")


def shared_groups(docs: DataFrame, buckets: int, num: int, den: int) -> DataFrame:
    """(g, n_g, id): distinct groups of ids, two or more, whose (different) sets share a signature that counts; a row per member.

    Prefix filter: where a set must share m signatures with any set like it, the
    m - 1 last of its signatures in an order common to all sets (rarest first) can
    be left out, and all of them if fewer than m are shared with anyone. So common
    passages don't make groups of texts that have nothing else in common.
    """

    def sign(batches):
        make = Shingler().hashes
        seen: set[bytes] = set()
        held, ids, digests, needs, size = [], [], [], [], 0

        def flush():
            who, sig = (np.concatenate(x) for x in zip(*held))
            bucket = (_mix(sig) % np.uint64(buckets)).astype(np.int64)
            packed = (_mix(sig ^ _B) & ~_IDX) | who.astype(np.uint64)
            order = np.lexsort((packed, bucket))
            packed, bucket = packed[order], bucket[order]
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist()
            all_ids, all_digests, all_needs = np.array(ids, np.int64), np.array(digests, np.uint64), np.concatenate(needs).astype(np.int32)
            rows = []
            for a, z in zip(cut, [*cut[1:], len(packed)]):
                p = packed[a:z]
                used, new = np.unique((p & _IDX).astype(np.int64), return_inverse=True)
                rows.append((int(bucket[a]), ((p & ~_IDX) | new.astype(np.uint64)).tobytes(), (used & 1).astype(np.int8).tobytes(), all_ids[used >> 1].tobytes(), all_digests[used >> 1].tobytes(), all_needs[used].tobytes()))
            return _rows(["bucket", "packed", "steps", "ids", "digests", "needs"], [pa.int32()] + [pa.binary()] * 5, rows).to_batches()

        for batch in batches:
            for part in slices(batch, 1, SLICE):
                sets, start = [], len(ids)
                for doc_id, text in zip(part.column(0).to_pylist(), utf8(part.column(1))):
                    s = make(text)
                    if not len(s) or doc_id is None:
                        continue
                    d = xxhash.xxh3_128_digest(s.tobytes())
                    if d in seen:  # an equal set of this task is signed already
                        continue
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(d)
                    ids.append(doc_id)
                    digests.append(int.from_bytes(d[:8], "little"))
                    sets.append(s)
                who, sig, need = signatures(sets, num, den)
                held.append((who + 2 * start, sig))
                needs.append(need)
                size += len(sig)
                if size > 2_000_000:
                    yield from flush()
                    held, ids, digests, needs, size = [], [], [], [], 0
        if size:
            yield from flush()

    def meet(t: pa.Table) -> pa.Table:
        got = []
        for p, k, i, d, n in zip(*(t.column(c).to_pylist() for c in ("packed", "steps", "ids", "digests", "needs"))):
            p = np.frombuffer(p, np.uint64)
            at = (p & _IDX).astype(np.int64)
            got.append((p & ~_IDX, *(np.frombuffer(x, kind)[at] for x, kind in ((k, np.int8), (i, np.int64), (d, np.uint64), (n, np.int32)))))
        cols = [np.concatenate(x) for x in zip(*got)]
        order = np.argsort(cols[0], kind="stable")
        sig = cols[0][order]
        twice = np.zeros(len(sig), bool)
        twice[1:] = sig[1:] == sig[:-1]
        twice[:-1] |= twice[1:]
        sig, step, doc, dig, need = (c[order[twice]] for c in cols)
        order = np.lexsort((doc, dig, sig))
        first = np.ones(len(order), bool)  # of an equal set: its least id only
        first[1:] = (sig[order[1:]] != sig[order[:-1]]) | (dig[order[1:]] != dig[order[:-1]])
        sig, step, doc, need = (c[order[first]] for c in (sig, step, doc, need))
        cut = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
        size = np.repeat(np.diff(np.append(cut, len(sig))), np.diff(np.append(cut, len(sig))))
        many = size > 1
        sig = (sig | np.uint64(t.column("bucket")[0].as_py() & int(_IDX)))[many]
        return pa.table([pa.array(sig.view(np.int64)), pa.array(doc[many]), pa.array(step[many].astype(np.int32)), pa.array(need[many].astype(np.int32)), pa.array(size[many].astype(np.int32))], names=["sig", "id", "step", "need", "size"])

    packed = docs.mapInArrow(sign, "bucket int, packed binary, steps binary, ids binary, digests binary, needs binary")
    met = packed.groupBy("bucket").applyInArrow(meet, "sig long, id long, step int, need int, size int")
    own = Window.partitionBy("id", "step")
    ranked = met.withColumn("m", F.count(F.lit(1)).over(own)).withColumn("rank", F.row_number().over(own.orderBy("size", "sig")))
    kept = ranked.where(F.col("rank") <= F.col("m") - F.col("need") + 1)
    table = checkpointed(kept.select("sig", "id"))
    # groups with the same members: told by their number, ends and the sum of their hashes, never as lists
    told = table.groupBy("sig").agg(F.count(F.lit(1)).alias("n_g"), F.min("id").alias("a"), F.max("id").alias("z"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("h"))
    once = told.where("n_g > 1").groupBy("n_g", "a", "z", "h").agg(F.min("sig").alias("sig")).select("sig", "n_g")
    members = checkpointed(table.join(once, "sig").select(F.col("sig").alias("g"), F.col("n_g").cast("int").alias("n_g"), "id"))
    release(table)
    return members


def verified(pairs: DataFrame, texts: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets are like enough, from the texts (id, text)."""

    def run(batches):
        make = Shingler().hashes
        for batch in batches:
            for part in slices(batch, 2, SLICE):
                rows, last = [], (None, None)
                for a, b, ta, tb in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), utf8(part.column(2)), utf8(part.column(3))):
                    if last[0] != a:
                        last = (a, make(ta))
                    x, y = last[1], make(tb)
                    small, large = min(len(x), len(y)), max(len(x), len(y))
                    if not small or den * small < num * large:
                        continue
                    both = np.concatenate([x, y])
                    both.sort()
                    same = int((both[1:] == both[:-1]).sum())
                    if den * same >= num * (len(x) + len(y) - same):
                        rows.append((a, b))
                yield from _rows(["a", "b"], [pa.int64()] * 2, rows).to_batches()

    with_b = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    full = with_b.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    return full.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def shared_elements(texts: DataFrame, buckets: int) -> DataFrame:
    """(id, c): how many elements of each set of (id, text) are in another row's set as well: a bound on any intersection."""

    def elements(batches):
        make = Shingler().hashes
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                ids = np.array(part.column(0).to_pylist(), np.int64)
                sets = [make(t) for t in utf8(part.column(1))]
                e, who = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
                bucket = (_mix(e) % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((who, bucket))
                cut = np.flatnonzero(np.diff(bucket[order], prepend=-1)).tolist()
                rows = [(int(bucket[order[a]]), e[order[a:z]].tobytes(), who[order[a:z]].astype(np.int32).tobytes(), ids.tobytes()) for a, z in zip(cut, [*cut[1:], len(order)])]
                yield from _rows(["bucket", "e", "who", "ids"], [pa.int32()] + [pa.binary()] * 3, rows).to_batches()

    def count(t: pa.Table) -> pa.Table:
        e = np.concatenate([np.frombuffer(x, np.uint64) for x in t.column("e").to_pylist()])
        doc = np.concatenate([np.frombuffer(i, np.int64)[np.frombuffer(w, np.int32)] for i, w in zip(t.column("ids").to_pylist(), t.column("who").to_pylist())])
        order = np.argsort(e, kind="stable")
        s = e[order]
        twice = np.zeros(len(s), bool)
        twice[1:] = s[1:] == s[:-1]
        twice[:-1] |= twice[1:]
        ids, n = np.unique(doc[order[twice]], return_counts=True)
        return pa.table([pa.array(ids), pa.array(n)], names=["id", "c"])

    return texts.mapInArrow(elements, "bucket int, e binary, who binary, ids binary").groupBy("bucket").applyInArrow(count, "id long, c long").groupBy("id").agg(F.sum("c").alias("c"))


def common_counts(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of `xs` shares with each of `ys`."""
    e = np.concatenate([*xs, *ys])
    of = np.repeat(np.arange(len(xs) + len(ys)), [len(s) for s in xs + ys])
    _, column = np.unique(e, return_inverse=True)
    in_x = of < len(xs)
    width = int(column.max()) + 1
    both = (np.bincount(column[in_x], minlength=width) > 0) & (np.bincount(column[~in_x], minlength=width) > 0)
    kept = both[column]
    column, of = (np.cumsum(both) - 1)[column[kept]], of[kept]
    order = np.argsort(column, kind="stable")
    column, of = column[order], of[order]
    out = np.zeros((len(xs), len(ys)), np.float32)  # exact up to 2^24 elements
    step = max(1, PRODUCT // (len(xs) + len(ys)))
    for start in range(0, int(both.sum()), step):
        a, z = np.searchsorted(column, [start, start + step])
        m = np.zeros((len(xs) + len(ys), step), np.float32)
        m[of[a:z], column[a:z] - start] = 1
        out += m[: len(xs)] @ m[len(xs) :].T
    return out.astype(np.int64)


def paired(members: DataFrame, known: DataFrame, texts: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) in groups with at most FEW members outside their main component, hence at most FEW rows a member; those in `known` are left out."""
    left, right = (members.select("g", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "label", "n", "c", "out")]) for s in "xy")
    total = F.col("n_x") + F.col("n_y")
    # of two sets in different components one is outside the main component of their group
    met = left.where("out_x = 1").join(
        right,
        (left["g"] == right["g"]) & (F.col("label_x") != F.col("label_y")) & (den * F.least("n_x", "n_y") >= num * F.greatest("n_x", "n_y")) & ((num + den) * F.least("c_x", "c_y") >= num * total),
    )
    pairs = checkpointed(met.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct().join(known, ["a", "b"], "left_anti"))
    found = checkpointed(verified(pairs, texts, num, den))
    release(pairs)
    return found


def tiled(members: DataFrame, texts: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) in larger groups, enough of them to connect what all links of a tile connect.

    The members outside the main component are cut into blocks, and so are all
    members; each block of the former meets each of the latter in one task, which
    counts common elements as a matrix product. No pair leaves the task unless it
    links, and a tile holds two blocks, whatever the size of the group.
    """

    def blocks(n, elements):
        return F.ceil(F.greatest(F.col(n) / BLOCK_SETS, F.col(elements) / BLOCK_ELEMENTS)).cast("int")

    def compare(t: pa.Table) -> pa.Table:
        ids, label, out = (t.column(c).to_numpy() for c in ("id", "label", "x"))
        x, y = np.flatnonzero(out == 1), np.flatnonzero(out == 0)
        make = Shingler().hashes
        sets = [make(b) for b in utf8(t.column("text").combine_chunks())]
        links: list[tuple[int, int]] = []
        if len(x) and len(y):
            n = np.array([len(s) for s in sets], np.int64)
            same = common_counts([sets[i] for i in x.tolist()], [sets[i] for i in y.tolist()])
            like = (den + num) * same >= num * (n[x][:, None] + n[y][None, :])
            i, j = np.nonzero(like & (label[x][:, None] != label[y][None, :]))
            i, j = x[i], y[j]
            ends = np.stack([np.minimum(label[i], label[j]), np.maximum(label[i], label[j])], 1)
            _, where = np.unique(ends, axis=0, return_index=True)
            root: dict[int, int] = {}

            def find(v):
                while root.get(v, v) != v:
                    root[v] = root.get(root[v], root[v])
                    v = root[v]
                return v

            for k in where.tolist():
                p, q = find(int(ends[k, 0])), find(int(ends[k, 1]))
                if p != q:
                    root[p] = q
                    links.append((int(min(ids[i[k]], ids[j[k]])), int(max(ids[i[k]], ids[j[k]]))))
        return _rows(["a", "b"], [pa.int64()] * 2, links)

    cut = members.withColumn("kx", blocks("n_out", "e_out")).withColumn("ky", blocks("n_all", "e_all"))
    tiles_x = cut.where("out = 1").select("g", F.pmod(F.xxhash64("id"), "kx").alias("i"), F.explode(F.sequence(F.lit(0), F.col("ky") - 1)).alias("j"), "id", "label", F.lit(1).alias("x"))
    tiles_y = cut.select("g", F.explode(F.sequence(F.lit(0), F.col("kx") - 1)).alias("i"), F.pmod(F.xxhash64("id"), "ky").alias("j"), "id", "label", F.lit(0).alias("x"))
    tiles = tiles_x.select("g", F.col("i").cast("int").alias("i"), "j", "id", "label", "x").unionByName(tiles_y.select("g", "i", F.col("j").cast("int").alias("j"), "id", "label", "x"))
    return tiles.join(texts, "id").groupBy("g", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def similar_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", num: int = NUM, den: int = DEN) -> DataFrame:
    """Per row: id_col, n_shingles, component_id (smallest id reachable by links, itself included).

    Two rows link when den * intersection >= num * union of their sets of 5-word
    shingles (a shorter text is one shingle). Null and wordless texts have empty
    sets and link with nothing: their component is their own id. Rows with a null
    id link with nothing and have a null component. Rows with equal ids are one
    node, and each keeps its row.
    """
    bound_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sizes = checkpointed(set_sizes(base))
    digest = F.struct("d1", "d2")
    several = sizes.where("id is not null").groupBy("id").agg(F.min(digest).alias("a"), F.max(digest).alias("z")).where("a <> z")
    if several.limit(1).count():
        found = _of_ids_with_several_texts(base, num, den)
        release(sizes)
    else:
        found = _components(base, sizes, num, den)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def _of_ids_with_several_texts(base: DataFrame, num: int, den: int) -> DataFrame:
    """As _components(), where rows of one id have different sets: their texts are nodes of their own first, and are tied by their id then."""
    node = F.when(F.col("id").isNotNull(), F.xxhash64("id", "text"))
    rows = checkpointed(base.select(node.alias("node"), "id", "text"))
    nodes = rows.select(F.col("node").alias("id"), "text")
    found = checkpointed(_components(nodes, checkpointed(set_sizes(nodes)), num, den).where("id is not null").groupBy("id").agg(F.max("component").alias("root")))
    of = rows.where("node is not null").select("node", "id").distinct().join(found.withColumnRenamed("id", "node"), "node")
    of = checkpointed(of.groupBy("id", "root").agg(F.min("node").alias("node")))
    ties = of.groupBy("id").agg(F.min("root").alias("a"), F.max("root").alias("z")).where("a <> z").select("id", "a").join(of.select("id", F.col("root").alias("b")), "id").select("a", "b")
    tops = components(ties).select(F.col("id").alias("root"), F.col("component").alias("top"))
    grouped = of.join(tops, "root", "left").select("id", F.coalesce("top", "root").alias("top"))
    least = grouped.groupBy("top").agg(F.min("id").alias("component"), F.count(F.lit(1)).alias("n_rows"))
    by_id = with_class(grouped, least, ["top"], "n_rows").groupBy("id").agg(F.min("component").alias("component"))
    sized = set_sizes(rows.select("id", "text")).select("id", "n")
    return sized.join(by_id, "id", "left").select("id", "n", "component")


def _components(base: DataFrame, sizes: DataFrame, num: int, den: int) -> DataFrame:
    """(id, n, component) per row of (id, text); `sizes`: its set_sizes, in a table. Rows of one id have equal sets."""
    buckets = shards_for(text_bytes(base, "text"), BUCKET_BYTES, 4)
    at = shared_groups(base, buckets, num, den)
    wanted = at.select("id").distinct()
    texts = checkpointed(base.join(wanted, "id", "left_semi").dropDuplicates(["id"]))
    # first round: each set with the best-connected member of its groups, where a group of copies meets its original
    score = at.groupBy("id").agg(F.sum(F.col("n_g") - 1).alias("score"))
    rated = at.join(score, "id").withColumn("rate", F.struct("score", (-F.col("id")).alias("minus")))
    heads = rated.groupBy("g").agg(F.max("rate").alias("head"))
    best = rated.join(heads, "g").where(-F.col("head.minus") != F.col("id")).groupBy("id").agg(F.max("head").alias("head"))
    first = checkpointed(best.select(F.least("id", -F.col("head.minus")).alias("a"), F.greatest("id", -F.col("head.minus")).alias("b")).distinct())
    links = checkpointed(verified(first, texts, num, den))
    labels = components(links)
    # second round: sets that share a signature and are not yet one component
    known = at.join(labels, "id", "left").select("g", "id", F.coalesce("component", "id").alias("label"))
    by_label = known.groupBy("g", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("g").agg(F.max(F.struct("c", "label"))["label"].alias("main"), F.count(F.lit(1)).alias("labels"))
    mixed = known.join(by_label.where("labels > 1"), "g").join(sizes.groupBy("id").agg(F.max("n").alias("n")), "id")
    mixed = checkpointed(mixed.select("g", "main", "id", "label", "n"))
    n_elements = mixed.select("id", "n").distinct().agg(F.sum("n")).first()[0] or 0
    common = shared_elements(texts.join(mixed.select("id").distinct(), "id", "left_semi"), shards_for(8 * n_elements, 4 * BUCKET_BYTES))
    open_ = mixed.join(common, "id").where(F.col("c") * den >= F.col("n") * num)
    open_ = open_.withColumn("out", (F.col("label") != F.col("main")).cast("long"))
    counts = open_.groupBy("g").agg(F.count(F.lit(1)).alias("n_all"), F.sum("n").alias("e_all"), F.sum("out").alias("n_out"), F.sum(F.col("out") * F.col("n")).alias("e_out"))
    open_ = checkpointed(open_.join(counts.where("n_out > 0 and n_all > 1"), "g"))
    more = paired(open_.where(F.col("n_out") <= FEW), first, texts, num, den).unionByName(checkpointed(tiled(open_.where(F.col("n_out") > FEW), texts, num, den)))
    release(at, texts, first, mixed, open_)
    # equal sets, whatever their texts: each with the least id of its digest
    classes = sizes.where("n > 0 and id is not null").groupBy("d1", "d2").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n_rows"))
    member = checkpointed(with_class(sizes, classes, ["d1", "d2"], "n_rows").select("id", "n", F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("least")))
    release(sizes)
    of = member.where("n > 0 and id is not null").select("id", "least").distinct()
    by_class = links.unionByName(more).join(of.select(F.col("id").alias("a"), F.col("least").alias("p")), "a").join(of.select(F.col("id").alias("b"), F.col("least").alias("q")), "b")
    roots = components(by_class.select(F.col("p").alias("a"), F.col("q").alias("b")))
    sizes_of = member.groupBy("least").agg(F.count(F.lit(1)).alias("n_rows")).join(roots.withColumnRenamed("id", "least"), "least")
    found = with_class(member, sizes_of, ["least"], "n_rows")
    return found.select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("component", "least")).alias("component"))


def representatives(docs: DataFrame, **options) -> DataFrame:
    """One row of `docs` for each group of rows that links connect: that with the smallest id, the first as it lies of several.

    Rows with null ids, and texts without words, are like nothing and stay; repeated ids
    say nothing about their texts, so a text goes only where a like one stays.
    """
    id_col, text_col = options.pop("id_col", "doc_id"), options.pop("text_col", "text")
    repeated = docs.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not repeated.limit(1).count():
        found = similar_components(docs, id_col=id_col, text_col=text_col, **options)
        return docs.join(found.where(F.col(id_col) != F.col("component_id")).select(id_col), id_col, "left_anti").select(*docs.columns)
    row = fresh(docs, "row")
    table = checkpointed(docs.withColumn(row, F.monotonically_increasing_id()))  # the numbers hold from here on
    found = similar_components(table.where(F.col(id_col).isNotNull()), id_col=row, text_col=text_col, **options)
    placed = found.join(table.select(row, F.col(id_col).alias("_id")), row)
    heads = placed.groupBy("component_id").agg(F.min(F.struct("_id", row)).alias("head")).select(F.col(f"head.{row}").alias(row))
    gone = found.select(row).join(heads, row, "left_anti")
    return table.join(gone, row, "left_anti").select(*docs.columns)
