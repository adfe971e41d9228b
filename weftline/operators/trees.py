"""Classification trees with exact thresholds and no limit of depth.

Large nodes grow level by level. Rows stay where they are: each level finds their nodes by
the tree so far, and what moves is counts of classes per node, feature and range of values.
The score is convex in the counts, so its bound within a range is at a corner of them; only
values of ranges that could still hold the best threshold move and are judged one by one. A
node with few enough rows is finished by the task that gets its rows. So the tree is that of
a plain recursion over all rows, whatever the number of rows or values.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import checkpointed, release, workers_find_us

#: More labels than this are no classes.
MOST_CLASSES = 1000
#: A node with so many rows or fewer is finished in one task.
LOCAL_ROWS = 50_000
#: Rows of a range of a feature's values, and ranges of a feature over all nodes of a level at most: with more rows ranges grow.
RANGE_ROWS, MOST_RANGES = 5_000, 2_000
#: Counts (ranges of all features times classes) of a level at most, beside one range for each node and feature.
MOST_COUNTS = 16_000_000
#: Values that a task turns into an array at a time.
SLICE_VALUES = 4_000_000
#: Corners are tried for so many classes or fewer; the bound for more is looser.
CORNER_CLASSES = 10
#: A tree of so many nodes or fewer is held by each task that predicts; rows are joined with a larger one, step by step.
HELD_NODES = 100_000

#: Nodes: (tree, node) is a node's key; a leaf has no feature. Children are keys too. `counts`: rows by class.
NODES = "tree long, node long, depth int, feature int, threshold double, left_tree long, left_node long, right_tree long, right_node long, prediction double, counts array<long>"


def _middle(a, b):
    """A threshold that parts a from the larger b: their middle, or a where rounding gives b."""
    m = a / 2 + b / 2
    return np.where((m >= b) | ~np.isfinite(m), a, m)


def best_split(x: np.ndarray, y: np.ndarray, k: int) -> tuple[int, float] | None:
    """(feature, threshold) of the purest split by Gini, rows with x <= threshold left; of equal ones the first feature, then the least threshold."""
    best = None
    n = len(y)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v = x[order, f]
        ends = np.nonzero(v[1:] > v[:-1])[0]
        if not len(ends):
            continue
        left = np.cumsum(np.eye(k, dtype=np.int64)[y[order]], axis=0)
        right = left[-1] - left[ends]
        left = left[ends]
        score = (left * left).sum(1) / (ends + 1) + (right * right).sum(1) / (n - ends - 1)
        i = int(np.argmax(score))
        if best is None or score[i] > best[0]:
            best = (score[i], f, float(_middle(v[ends[i]], v[ends[i] + 1])))
    return best and best[1:]


def grow(tree: int, depth: int, x: np.ndarray, y: np.ndarray, k: int, max_depth: int | None) -> list[tuple]:
    """Nodes below a root with these rows, as rows of NODES but for the prediction, which is a class's place."""
    out, todo, made = [], [(0, depth, np.arange(len(y)))], 1
    while todo:
        node, level, rows = todo.pop()
        counts = np.bincount(y[rows], minlength=k)
        split = None
        if (counts > 0).sum() > 1 and (max_depth is None or level < max_depth):
            split = best_split(x[rows], y[rows], k)
        here = (tree, node, level)
        if split is None:
            out.append((*here, None, None, None, None, None, None, int(counts.argmax()), counts.tolist()))
            continue
        f, t = split
        to_left = x[rows, f] <= t
        out.append((*here, f, t, tree, made, tree, made + 1, int(counts.argmax()), counts.tolist()))
        todo += [(made, level + 1, rows[to_left]), (made + 1, level + 1, rows[~to_left])]
        made += 2
    return out


@dataclass
class ExactTree:
    nodes: DataFrame
    features: list[str]
    n_nodes: int

    def transform(self, df: DataFrame) -> DataFrame:
        """`df` with `prediction`: the commonest class of a row's leaf, the least of equally common ones."""
        x = F.array(*[F.col(c).cast("double") for c in self.features])
        if self.n_nodes > HELD_NODES:
            return self._joined(df, x)
        workers_find_us(df.sparkSession)
        rows = [tuple(r) for r in self.nodes.select("tree", "node", "feature", "threshold", "left_tree", "left_node", "right_tree", "right_node", "prediction").collect()]  # at most HELD_NODES
        place = {(r[0], r[1]): i for i, r in enumerate(rows)}
        feature = np.array([-1 if r[2] is None else r[2] for r in rows])
        threshold = np.array([np.nan if r[3] is None else r[3] for r in rows])
        left, right = (np.array([place.get((r[a], r[a + 1]), 0) for r in rows]) for a in (4, 6))
        told, root = np.array([r[8] for r in rows]), place.get((0, 0), 0)

        @F.pandas_udf("double")
        def predict(v):
            import pandas as pd

            if not len(v):
                return pd.Series([], dtype="float64")
            m = np.array(v.tolist(), dtype=np.float64)
            at = np.full(len(m), root)
            while True:
                open_ = np.nonzero(feature[at] >= 0)[0]
                if not len(open_):
                    return pd.Series(told[at])
                i = at[open_]
                at[open_] = np.where(m[open_, feature[i]] <= threshold[i], left[i], right[i])

        return df.withColumn("prediction", predict(x))

    def _joined(self, df: DataFrame, x) -> DataFrame:
        columns = df.columns
        open_ = df.withColumn("_x", x).withColumn("_t", F.lit(0).cast("long")).withColumn("_n", F.lit(0).cast("long"))
        done: DataFrame | None = None
        while True:
            met = checkpointed(open_.join(self.nodes.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), "feature", "threshold", "left_tree", "left_node", "right_tree", "right_node", "prediction"), ["_t", "_n"]))
            leaves = met.where("feature is null").select(*columns, "prediction")
            done = leaves if done is None else done.unionByName(leaves)
            low = F.expr("_x[feature] <= threshold")
            open_ = met.where("feature is not null").select(*columns, "_x", F.when(low, F.col("left_tree")).otherwise(F.col("right_tree")).alias("_t"), F.when(low, F.col("left_node")).otherwise(F.col("right_node")).alias("_n"))
            if not open_.limit(1).count():
                return done


def _reached(x: np.ndarray, feature, threshold, left, right) -> np.ndarray:
    """The node at which each row ends, from node 0; nodes without a split have feature -1."""
    at = np.zeros(len(x), dtype=np.int64)
    while True:
        open_ = np.nonzero(feature[at] >= 0)[0]
        if not len(open_):
            return at
        i = at[open_]
        at[open_] = np.where(x[open_, feature[i]] <= threshold[i], left[i], right[i])


def _purity(left: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The score of parting `total` (rows by class) into `left` and the rest: squares of the counts by rows, of either side."""
    right = total - left
    return sum((side * side).sum(-1) / np.maximum(side.sum(-1), 1) for side in (left, right))


def _bounds(before: np.ndarray, c: np.ndarray, total: np.ndarray) -> np.ndarray:
    """No cut within a range scores more: `before` are the counts below the range, `c` those in it, a row each.

    The score is convex in the counts on the left, so it is greatest where each class of the range is whole on one
    side. With many classes: a row that changes sides changes the score by 2 at most.
    """
    k = c.shape[1]
    if k > CORNER_CLASSES:
        return (_purity(before, total) + _purity(before + c, total)) / 2 + c.sum(1)
    corners = (np.arange(2**k)[:, None] >> np.arange(k)) & 1
    return np.concatenate([_purity(before[i : i + 64, None] + corners * c[i : i + 64, None], total).max(1) for i in range(0, len(c), 64)])


def _matrix(column, k: int) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy() for c in column.chunks]).reshape(-1, k)


def _slices(batches, width: int):
    """(x, y) of Arrow batches, a bounded number of values at a time."""
    step = max(1, SLICE_VALUES // width)
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield part.column("x").flatten().to_numpy().reshape(-1, width), part.column("y").to_numpy()


def _edges(rows: DataFrame, ranges: int, width: int) -> list[np.ndarray]:
    """Values that part each feature into about equally full ranges. Any would do: what they part is judged exactly."""
    at = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    cuts = rows.select(F.posexplode("x").alias("f", "v")).groupBy("f").agg(F.percentile_approx("v", at, 10 * ranges).alias("e"))
    found = {r.f: np.unique(r.e) for r in cuts.collect()}  # at most MOST_RANGES a feature
    return [found[f] for f in range(width)]


def _best_of_nodes(rows: DataFrame, top: tuple, sizes: dict[int, int], edges: list[np.ndarray], fine: int, range_rows: int, k: int) -> dict[int, tuple]:
    """node -> (f, threshold, rows by class on the left) of the best split of each node in `sizes`; nodes with one value of each feature have none.

    A cell is a range of a feature's values in a node; a node has the fewer, the fewer rows it has.
    """
    width = len(edges)
    nodes = np.array(sorted(sizes))
    parts = np.array([min(fine, -(-sizes[n] // range_rows)) for n in nodes])
    first = np.concatenate([[0], np.cumsum(parts * width)])
    place = np.full(len(top[0]), -1)
    place[nodes] = np.arange(len(nodes))

    def cells(batches):
        for x, y in _slices(batches, width):
            j = place[_reached(x, *top)]
            x, y, j = x[j >= 0], y[j >= 0], j[j >= 0]
            at = np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], axis=1)
            b = parts[j][:, None]
            yield x, y, first[j][:, None] + np.arange(width) * b + at * b // fine

    def count(batches):
        n = int(first[-1])
        counts, low, high = np.zeros(n * k, dtype=np.int64), np.full(n, np.inf), np.full(n, -np.inf)
        for x, y, cell in cells(batches):
            counts += np.bincount((cell * k + y[:, None]).ravel(), minlength=n * k)
            np.minimum.at(low, cell.ravel(), x.ravel())
            np.maximum.at(high, cell.ravel(), x.ravel())
        counts = counts.reshape(n, k)
        held = np.nonzero(counts.any(1))[0]
        j = np.searchsorted(first, held, side="right") - 1
        f = (held - first[j]) // parts[j]
        for at in range(0, len(held), 10_000):
            h = held[at : at + 10_000]
            c = pa.ListArray.from_arrays(np.arange(0, (len(h) + 1) * k, k, dtype=np.int32), counts[h].ravel())
            yield pa.record_batch([pa.array(nodes[j[at : at + 10_000]]), pa.array(f[at : at + 10_000], pa.int32()), pa.array(h), pa.array(low[h]), pa.array(high[h]), c], names=["node", "f", "cell", "low", "high", "c"])

    def judge(table):
        table = table.sort_by("cell")
        c, low, high = _matrix(table.column("c"), k), table.column("low").to_numpy(), table.column("high").to_numpy()
        upto = np.cumsum(c, axis=0)
        total, before = upto[-1], upto - c
        # the cut behind each range but the last
        edge = [*_purity(upto, total)[:-1].tolist(), None]
        after = [*low[1:].tolist(), None]
        lists = lambda m: pa.array(list(m), pa.list_(pa.int64()))
        return pa.table(
            [*(table.column(n) for n in ("node", "f", "cell", "low", "high")), lists(before), lists(upto), lists(np.broadcast_to(total, c.shape)), pa.array(edge, pa.float64()), pa.array(after, pa.float64()), pa.array(_bounds(before, c, total))],
            names=["node", "f", "cell", "low", "high", "before", "l", "total", "score", "b", "bound"],
        )

    total = F.array(*[F.sum(F.col("c")[i]) for i in range(k)])
    summed = rows.mapInArrow(count, "node long, f int, cell long, low double, high double, c array<long>").groupBy("node", "f", "cell").agg(F.min("low").alias("low"), F.max("high").alias("high"), total.alias("c"))
    judged = summed.groupBy("node", "f").applyInArrow(judge, "node long, f int, cell long, low double, high double, before array<long>, l array<long>, total array<long>, score double, b double, bound double")
    judged = checkpointed(judged)
    best = judged.groupBy("node").agg(F.max("score").alias("best"))
    open_ = judged.join(F.broadcast(best), "node").where("low < high and (best is null or bound >= best * (1 - 1e-9))").select("node", "f", "cell", "before", "total")
    alive = np.zeros(int(first[-1]), dtype=bool)
    alive[[r[0] for r in open_.select("cell").collect()]] = True  # at most MOST_RANGES a feature, and one a node and feature

    def pick(batches):
        """The values of open cells, equal ones of a class once with their number."""
        for x, y, cell in cells(batches):
            row, f = np.nonzero(alive[cell])
            if not len(row):
                continue
            c, v, y = cell[row, f], x[row, f], y[row]
            order = np.lexsort((y, v, c))
            c, v, y = c[order], v[order], y[order]
            new = np.concatenate([[True], (c[1:] != c[:-1]) | (v[1:] != v[:-1]) | (y[1:] != y[:-1])])
            starts = np.nonzero(new)[0]
            n = np.diff(np.append(starts, len(c))).astype(np.int32)
            c, v, y = c[starts], v[starts], y[starts].astype(np.int32)
            of = np.nonzero(np.concatenate([[True], c[1:] != c[:-1]]))[0]
            offsets = np.append(of, len(c)).astype(np.int32)
            yield pa.record_batch([pa.array(c[of]), *(pa.ListArray.from_arrays(offsets, pa.array(a)) for a in (v, y, n))], names=["cell", "v", "y", "n"])

    def exact(values, cell):
        v, y, n = (np.concatenate([c.flatten().to_numpy() for c in values.column(name).chunks]) for name in ("v", "y", "n"))
        distinct, at = np.unique(v, return_inverse=True)
        c = np.bincount(at * k + y, weights=n, minlength=len(distinct) * k).astype(np.int64).reshape(-1, k)
        left = (_matrix(cell.column("before"), k)[0] + np.cumsum(c, axis=0))[:-1]
        score = _purity(left, _matrix(cell.column("total"), k)[0])
        i = int(np.argmax(score))
        return pa.table([cell.column("node"), cell.column("f"), pa.array([score[i]]), pa.array([distinct[i]]), pa.array([distinct[i + 1]]), pa.array([left[i].tolist()], pa.list_(pa.int64()))], names=["node", "f", "score", "a", "b", "l"])

    cuts = judged.where("score is not null").select("node", "f", "score", F.col("high").alias("a"), "b", "l")
    if alive.any():
        picked = rows.mapInArrow(pick, "cell long, v array<double>, y array<int>, n array<int>").groupBy("cell")
        cuts = cuts.unionByName(picked.cogroup(open_.groupBy("cell")).applyInArrow(exact, "node long, f int, score double, a double, b double, l array<long>"))
    best = cuts.groupBy("node").agg(F.min(F.struct((-F.col("score")).alias("minus"), "f", "a", "b", "l")).alias("s"))
    out = {r.node: (r.s.f, float(_middle(np.float64(r.s.a), np.float64(r.s.b))), list(r.s.l)) for r in best.collect()}  # fewer than rows / local_rows
    release(judged)
    return out


def exact_tree(df: DataFrame, features: list[str], label: str, *, max_depth: int | None = None, local_rows: int | None = None) -> ExactTree:
    """A tree by Gini impurity. Nodes are split while they hold two classes and two values of a feature.

    Thresholds lie between neighbouring values; of equally good splits the first feature,
    then the least threshold counts. Rows without a label are left out; a feature that is
    null or NaN is an error. An empty table gives one leaf without a prediction.
    """
    local_rows = LOCAL_ROWS if local_rows is None else local_rows
    spark = df.sparkSession
    workers_find_us(spark)
    labelled = df.where(F.col(label).isNotNull())
    classes = sorted(float(r[0]) for r in labelled.select(F.col(label).cast("double")).distinct().limit(MOST_CLASSES + 1).collect())
    if len(classes) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes")
    if not classes:
        return ExactTree(spark.createDataFrame([(0, 0, 0, None, None, None, None, None, None, None, [])], NODES), features, 1)
    k, width = len(classes), len(features)
    x = F.array(*[F.col(c).cast("double") for c in features])
    y = F.array_position(F.lit(classes), F.col(label).cast("double")).cast("int") - 1
    rows = checkpointed(labelled.select(y.alias("y"), x.alias("x")))
    if rows.where(F.exists("x", lambda v: v.isNull() | F.isnan(v))).limit(1).count():
        raise ValueError("a feature is null or NaN")
    of_class = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    counts = [[of_class.get(c, 0) for c in range(k)]]  # rows by class of each node of the upper part, by the node's number
    n = sum(counts[0])
    # the upper part is held here: nodes of more than local_rows rows and their children
    depth, split = [0], {}  # node -> (feature, threshold, left child; the right one is the next)
    at, edges = [0] if n > local_rows else [], None
    range_rows = max(RANGE_ROWS, -(-n // max(1, min(MOST_RANGES, MOST_COUNTS // (width * k)))))
    while at:
        sizes = {i: sum(counts[i]) for i in at if sum(c > 0 for c in counts[i]) > 1 and (max_depth is None or depth[i] < max_depth)}
        if not sizes:
            break
        if edges is None:
            fine = -(-n // range_rows)
            edges = _edges(rows, fine, width)
        at = []
        for i, (f, t, left) in sorted(_best_of_nodes(rows, _arrays(split, len(counts)), sizes, edges, fine, range_rows, k).items()):
            split[i] = (f, t, len(counts))
            for c in (left, [a - b for a, b in zip(counts[i], left)]):
                if sum(c) > local_rows:
                    at.append(len(counts))
                counts.append(c)
                depth.append(depth[i] + 1)
    small = [sum(c) <= local_rows for c in counts]
    nodes = _finished(rows, _arrays(split, len(counts)), np.array(small), np.array(depth), width, k, max_depth)
    release(rows)
    # a node of the upper part is (0, number); the root of a finished part is (its number, 0)
    key = lambda i: (i, 0) if small[i] else (0, i)
    upper = []
    for i, c in enumerate(counts):
        if not small[i]:
            ways = (split[i][0], split[i][1], *key(split[i][2]), *key(split[i][2] + 1)) if i in split else (None,) * 6
            upper.append((0, i, depth[i], *ways, int(np.argmax(c)), c))
    if upper:
        nodes = nodes.unionByName(spark.createDataFrame(upper, _PLACED))
    made = nodes.withColumn("prediction", F.element_at(F.lit(classes), F.col("place") + 1))
    names = [c.split()[0] for c in NODES.split(", ")]
    kept = checkpointed(made.select(*names))
    return ExactTree(kept, features, kept.count())


def _arrays(split: dict[int, tuple], n: int) -> tuple:
    """The upper part for _reached()."""
    feature, threshold, left = np.full(n, -1), np.full(n, np.nan), np.zeros(n, dtype=np.int64)
    for i, (f, t, child) in split.items():
        feature[i], threshold[i], left[i] = f, t, child
    return feature, threshold, left, left + 1


#: Nodes with a class's place for the prediction.
_PLACED = NODES.replace("prediction double", "place int")


def _finished(rows: DataFrame, top: tuple, small: np.ndarray, depth: np.ndarray, width: int, k: int, max_depth: int | None) -> DataFrame:
    """The parts of the tree below nodes with few rows: each node's rows, which move once, in one task."""
    names = [c.split()[0] for c in _PLACED.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())]

    def deal(batches):
        for x, y in _slices(batches, width):
            node = _reached(x, *top)
            x, y, node = x[small[node]], y[small[node]], node[small[node]]
            yield pa.record_batch([pa.array(node), pa.array(y), pa.ListArray.from_arrays(np.arange(0, (len(x) + 1) * width, width, dtype=np.int32), x.ravel())], names=["node", "y", "x"])

    def build(key, table):
        node = key[0].as_py()
        made = grow(node, int(depth[node]), _matrix(table.column("x"), width), table.column("y").to_numpy(), k, max_depth)
        return pa.table([pa.array(list(c), t) for c, t in zip(zip(*made), kinds)], names=names)

    return checkpointed(rows.mapInArrow(deal, "node long, y int, x array<double>").groupBy("node").applyInArrow(build, _PLACED))
