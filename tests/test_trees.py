import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import trees


def plain_tree(x, y, max_depth=None, depth=0):
    """A plain recursion: nested (feature, threshold, left, right), or the commonest class."""
    classes, counts = np.unique(y, return_counts=True)
    told = float(classes[counts.argmax()])
    if len(classes) == 1 or depth == max_depth:
        return told
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for a, b in zip(values, values[1:]):
            low = x[:, f] <= a
            score = sum(sum(int((y[side] == c).sum()) ** 2 for c in classes) / int(side.sum()) for side in (low, ~low))
            t = a / 2 + b / 2
            if best is None or score > best[0]:
                best = (score, f, float(a if t >= b else t), low)
    if best is None:
        return told
    _, f, t, low = best
    return (f, t, plain_tree(x[low], y[low], max_depth, depth + 1), plain_tree(x[~low], y[~low], max_depth, depth + 1))


def nested(model):
    rows = {(r.tree, r.node): r for r in model.nodes.collect()}
    assert len(rows) == model.n_nodes

    def of(key):
        r = rows[key]
        return r.prediction if r.feature is None else (r.feature, r.threshold, of((r.left_tree, r.left_node)), of((r.right_tree, r.right_node)))

    return of((0, 0))


def table(spark, x, y):
    return spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], ", ".join(f"f{i} double" for i in range(x.shape[1])) + ", y double")


@pytest.mark.parametrize("seed,values,max_depth", [(1, 40, None), (2, 3, 2)])
def test_tree_against_plain_recursion(spark, seed, values, max_depth, monkeypatch):
    rnd = np.random.default_rng(seed)
    x, y = rnd.integers(0, values, (70, 3)) / 7, rnd.integers(0, 3, 70)
    y = np.where(x[:, 0] > x[:, 1], y, 5)
    df = table(spark, x, y)
    want = plain_tree(x, y, max_depth)
    whole = trees.exact_tree(df, ["f0", "f1", "f2"], "y", max_depth=max_depth)
    assert nested(whole) == want
    # level by level until nodes have 25 rows, values in ranges of a few
    monkeypatch.setattr(trees, "RANGE_ROWS", 30)
    parted = trees.exact_tree(df, ["f0", "f1", "f2"], "y", max_depth=max_depth, local_rows=25)
    assert nested(parted) == want
    answers = lambda m: sorted(tuple(r) for r in m.transform(df.withColumn("id", F.monotonically_increasing_id())).select("id", "prediction").collect())
    held = answers(parted)
    monkeypatch.setattr(trees, "HELD_NODES", 0)
    assert answers(parted) == held == answers(whole)


def test_tree_edges(spark):
    x, y = np.array([[1.0], [1.0], [2.0]]), np.array([1, 0, 0])
    assert nested(trees.exact_tree(table(spark, x, y), ["f0"], "y")) == (0, 1.5, 0.0, 0.0)  # equally common: the least
    assert nested(trees.exact_tree(table(spark, x[:1], y[:1]), ["f0"], "y")) == 1.0
    none = trees.exact_tree(table(spark, x, y).limit(0), ["f0"], "y")
    assert none.transform(table(spark, x, y)).where("prediction is null").count() == 3
    with pytest.raises(ValueError, match="null or NaN"):
        trees.exact_tree(spark.createDataFrame([(1.0, 1.0), (None, 0.0)], "f0 double, y double"), ["f0"], "y")
    near = np.nextafter(1.0, 2.0)
    assert nested(trees.exact_tree(table(spark, np.array([[1.0], [near]]), np.array([0, 1])), ["f0"], "y")) == (0, 1.0, 0.0, 1.0)


def test_levels_leave_rows_where_they_are(spark, monkeypatch):
    """A level of large nodes writes counts of ranges, not all rows and values again."""
    rnd = np.random.default_rng(3)
    x = rnd.random((2000, 3))
    y = (x[:, 0] > 0.5) * 6 + (x[:, 1] > 0.3) * 3 + (x[:, 2] * 12 > rnd.integers(0, 12, 2000))
    monkeypatch.setattr(trees, "RANGE_ROWS", 200)
    written, kept = [], trees.checkpointed

    def counted(df):
        made = kept(df)
        written.append(made.count())
        return made

    monkeypatch.setattr(trees, "checkpointed", counted)
    model = trees.exact_tree(table(spark, x, y), ["f0", "f1", "f2"], "y", max_depth=3, local_rows=400)
    assert written[0] == 2000 and model.nodes.where("tree = 0 and feature is not null").count() >= 3
    assert sum(written[1:]) < 1000
    assert nested(model) == nested(trees.exact_tree(table(spark, x, y), ["f0", "f1", "f2"], "y", max_depth=3))


@pytest.mark.parametrize("k", [4, 12])
def test_no_cut_beats_its_bound(k):
    rnd = np.random.default_rng(k)
    for _ in range(50):
        y = rnd.integers(0, rnd.integers(2, k + 1), 60)
        a, b = sorted(rnd.integers(1, 59, 2))
        upto = np.cumsum(np.eye(k, dtype=np.int64)[y], axis=0)
        total, before, c = upto[-1], upto[a - 1], upto[b - 1] - upto[a - 1]
        bound = trees._bounds(before[None], c[None], total)[0]
        assert bound >= trees._purity(upto[a - 1 : b], total).max() * (1 - 1e-9)
