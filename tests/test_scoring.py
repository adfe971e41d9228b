"""Running sums, vocabularies, text classifiers, curves and the stopped lasso against plain code."""

import math
import os
import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import features, models


def test_running_sums(spark, monkeypatch):
    monkeypatch.setattr(features, "RANGE_ROWS", 7)
    rnd = random.Random(1)
    rows = [(k, rnd.randrange(5), rnd.randrange(3)) for k in rnd.sample(range(100), 60)]
    got = features.running(spark.createDataFrame(rows, "k int, a int, b int"), [F.col("k")], {"sum_a": "a", "sum_b": "b"}, ahead=["a"]).orderBy("k").collect()
    a = b = 0
    rows.sort()
    for r, (k, x, y), after in zip(got, rows, [*rows[1:], (None, None, None)], strict=True):
        a, b = a + x, b + y
        assert tuple(r) == (k, x, y, a, b, after[1])
    assert features.running(spark.createDataFrame([], "k int, a int"), [F.col("k")], {"s": "a"}).count() == 0


def test_vocabulary_and_vectors(spark, monkeypatch):
    monkeypatch.setattr(features, "RANGE_ROWS", 3)
    texts = [(1, "Zeta alpha alpha ünder"), (2, ""), (3, "alpha beta 😀😀 ﬀﬀ"), (4, None), (5, "zeta zeta")]
    counts = features.word_counts(spark.createDataFrame(texts, "id int, text string"), "id", "text")
    v = features.vocabulary(counts)
    ids = {r.word: r.id for r in v.collect()}
    assert ids == {w: i for i, w in enumerate(sorted(ids))} and {"alpha", "beta", "zeta", "ünder", "ﬀﬀ"} <= set(ids)
    new = features.word_counts(spark.createDataFrame([(1, "beta alpha beta other"), (2, "other")], "id int, text string"), "id", "text")
    assert [(r.id, list(r.ids), list(r.counts)) for r in features.count_vectors(new, "id", v).collect()] == [(1, [ids["alpha"], ids["beta"]], [1, 2])]


@pytest.mark.parametrize("small", [True, False])
def test_text_bayes(spark, small, monkeypatch):
    if not small:
        monkeypatch.setattr(models, "BROADCAST_BYTES", 0)
    texts = [(1, "win cash now", 1), (2, "meet at noon", 0), (3, "cash prize win win", 1), (4, "noon lunch", 0), (5, "", 0), (6, "lunch cash", 2)]
    df = spark.createDataFrame(texts, "id int, text string, y int")
    model = models.text_bayes(features.word_counts(df, "id", "text", "y"), df, "y")
    asked = spark.createDataFrame([(10, "win a cash lunch"), (11, "unknown"), (12, None), (13, "noon noon")], "id int, text string")
    got = {r.id: (r.prediction, r.probability) for r in model.predict(features.word_counts(asked, "id", "text"), asked, "id").collect()}
    words = sorted({w for _, t, _ in texts for w in t.split()})
    for i, text in ((10, "win cash lunch"), (11, ""), (12, ""), (13, "noon noon")):
        logs = []
        for c in (0, 1, 2):
            mine = [t.split() for _, t, y in texts if y == c]
            flat = [w for t in mine for w in t]
            logs.append(math.log(len(mine) / len(texts)) + sum(math.log((flat.count(w) + 1) / (len(flat) + len(words))) for w in text.split()))
        p = np.exp(logs) / np.exp(logs).sum()
        assert got[i][0] == int(np.argmax(logs)) and got[i][1] == pytest.approx(list(p))
    with pytest.raises(ValueError, match="no labelled text"):
        models.text_bayes(features.word_counts(df, "id", "text", "y"), df.limit(0), "y")


def test_roc_curve_at_every_score(spark, monkeypatch):
    monkeypatch.setattr(features, "RANGE_ROWS", 5)
    rnd = random.Random(4)
    rows = [(rnd.choice([0, 1, 1]), rnd.randrange(25) / 25) for _ in range(120)] + [(None, 0.5), (1, None), (1, 2.0), (1, 1.9), (1, 1.8)]
    got = sorted(tuple(r) for r in models.roc_curve(spark.createDataFrame(rows, "y int, s double"), "y", "s").collect())[::-1]
    kept = [(y, s) for y, s in rows if y is not None and s is not None]
    scores = sorted({s for _, s in kept}, reverse=True)
    p, n = sum(y for y, _ in kept), sum(1 - y for y, _ in kept)
    steps = [(sum(1 for y, s in kept if s == t and y == 0), sum(1 for y, s in kept if s == t and y == 1)) for t in scores]
    want = [(math.inf, 0.0, 0.0)]
    for i, t in enumerate(scores):
        if i == 0 or i == len(scores) - 1 or steps[i] != steps[i + 1]:
            want.append((t, sum(x for x, _ in steps[: i + 1]) / n, sum(x for _, x in steps[: i + 1]) / p))
    assert got == want and len(want) < len(scores) + 1
    assert models.roc_curve(spark.createDataFrame([], "y int, s double"), "y", "s").count() == 0


def test_stopped_lasso(spark):
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(80, 4)) * [1, 5, 0.1, 1]
    y = x @ [2.0, -1.0, 0.0, 0.5] + rnd.normal(size=80) + 7
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "a double, b double, c double, d double, y double")
    w, b, rounds = models.stopped_lasso(df, list("abcd"), "y", 0.3, max_iter=1000, tol=1e-9)
    # of the optimum: a coefficient's correlation with the residual is alpha at its sign, below it at 0
    r = (y - y.mean()) - (x - x.mean(0)) @ w
    pull = (x - x.mean(0)).T @ r / 80
    assert all(abs(p - 0.3 * np.sign(c)) < 1e-4 if c else abs(p) <= 0.3 + 1e-6 for p, c in zip(pull, w)) and b == pytest.approx(y.mean() - x.mean(0) @ w)
    early, _, few = models.stopped_lasso(df, list("abcd"), "y", 0.3)
    assert few < rounds and not np.allclose(early, w, atol=1e-6)
    again, _, one = models.stopped_lasso(df, list("abcd"), "y", 0.3, tol=1e-6, start=w)
    assert one == 1 and np.allclose(again, w, atol=1e-6)
    nothing, _, rounds = models.stopped_lasso(df, list("abcd"), "y", 1e6)
    assert not nothing.any() and rounds == 1


def test_checkpointed_without_any_setting(tmp_path):
    """A fresh local session that names no folder."""
    code = (
        "from pyspark.sql import SparkSession; from weftline.session import checkpointed, release, shared_folder\n"
        "spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "assert spark.conf.get('spark.checkpoint.dir', None) is None\n"
        "t = checkpointed(spark.range(3)); assert t.count() == 3 and shared_folder(spark) == shared_folder(spark); release(t)\n"
    )
    (tmp_path / "conf").mkdir()
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path / "conf"), "PYTHONPATH": os.pathsep.join([os.getcwd(), os.environ.get("PYTHONPATH", "")])}
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=240, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert done.returncode == 0, done.stderr[-2000:]


def test_many_columns_as_matrix_products(spark, monkeypatch):
    from weftline.operators import profile

    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(50, 5)) + 1000
    rows = [(*(float(v) if rnd.random() > 0.1 else None for v in r[:4]), float(r[4]), 3.0) for r in x]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, same double").repartition(3)
    whole = df.where("a is not null and b is not null and c is not null and d is not null")
    told = lambda: {(r.a, r.b): r["corr"] for r in profile.correlations(df, ["a", "b", "e", "same"]).collect()}
    plain, fit, v = told(), models.ols(whole, ["a", "b"], "e"), models.vif(whole, ["a", "b", "c"])
    for module in (profile, models):
        monkeypatch.setattr(module, "MOST_EXPRESSIONS", 0)
    made = told()
    assert all(made[k] == pytest.approx(plain[k]) if plain[k] is not None else made[k] is None for k in plain) and set(made) == set(plain)
    again = models.ols(whole, ["a", "b"], "e")
    assert again.coefficients == pytest.approx(fit.coefficients) and again.r2 == pytest.approx(fit.r2) and models.vif(whole, ["a", "b", "c"]) == pytest.approx(v)


def test_threshold_sweep(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice([0, 1, None]), rnd.choice([None, *[i / 10 for i in range(11)]])) for _ in range(80)]
    got = {r.threshold: (r.tp, r.fp, r.fn, r.tn) for r in models.threshold_sweep(spark.createDataFrame(rows, "y int, s double"), "y", "s", (0.7, 0.3, 0.3, 2.0)).collect()}
    kept = [(y, s) for y, s in rows if y is not None and s is not None]
    assert got == {t: tuple(sum(1 for y, s in kept if (y, s >= t) == c) for c in ((1, True), (0, True), (1, False), (0, False))) for t in (0.3, 0.7, 2.0)}
