"""Models: least squares, regularised and logistic regression, naive Bayes, trees, and their metrics.

Least squares works on the cross-product matrix, which one aggregate over the
table yields; the solve is on a matrix of features, not of rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, NaiveBayes
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.features import running
from weftline.operators.profile import MOST_EXPRESSIONS, pair_sums
from weftline.session import checkpointed

#: Classes of a naive Bayes model at most: a word's counts of all of them are one row.
MOST_CLASSES = 1000


@dataclass(frozen=True)
class Linear:
    features: list[str]
    coefficients: np.ndarray
    intercept: float
    r2: float
    adjusted_r2: float
    standard_errors: np.ndarray
    t_values: np.ndarray
    n: int
    intercept_error: float = float("nan")

    @property
    def p_values(self) -> np.ndarray:
        """Two-sided, of Student's t with n - k - 1 degrees of freedom."""
        return np.array([student_p(t, self.n - len(self.features) - 1) for t in self.t_values])

    def summary(self) -> list[dict]:
        """One row per term: coefficient, standard error, t and p; the constant first."""
        with np.errstate(divide="ignore", invalid="ignore"):
            t0 = np.float64(self.intercept) / self.intercept_error
        terms = [("const", self.intercept, self.intercept_error, t0)] + list(zip(self.features, self.coefficients, self.standard_errors, self.t_values))
        free = self.n - len(self.features) - 1
        return [{"term": a, "coefficient": float(b), "standard_error": float(c), "t": float(d), "p": student_p(d, free)} for a, b, c, d in terms]

    def predict(self) -> Column:
        return sum((F.col(c) * float(w) for c, w in zip(self.features, self.coefficients)), F.lit(float(self.intercept)))


def student_p(t: float, free: int) -> float:
    """Two-sided tail of Student's t by the continued fraction of the incomplete beta function."""
    if free <= 0 or math.isnan(t):
        return float("nan")
    x = free / (free + t * t)
    a, b = free / 2, 0.5
    swap = x > (a + 1) / (a + b + 2)
    if swap:
        a, b, x = b, a, 1 - x
    if x <= 0:
        return 1.0 if swap else 0.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d, f = 1.0, 0.0, 1.0  # Lentz's method
    for i in range(400):
        m = i // 2
        step = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + step * d) or 1e-300)
        c = (1 + step / c) or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    tail = front * (f - 1)
    return 1 - tail if swap else tail


def _moments(df: DataFrame, cols: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, means and centred cross products of columns: two aggregates, the second around the means of the first."""
    n, *means = df.agg(F.count(F.lit(1)), *[F.avg(c) for c in cols]).first()
    if len(cols) > MOST_EXPRESSIONS:
        return n, np.array(means, float), pair_sums(df, cols, [m or 0.0 for m in means])["p"]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    at = [F.col(c) - F.lit(m) for c, m in zip(cols, means)]
    sums = df.agg(*[F.sum(at[i] * at[j]) for i, j in pairs]).first()
    cross = np.zeros((len(cols), len(cols)))
    for (i, j), v in zip(pairs, sums):
        cross[i, j] = cross[j, i] = v
    return n, np.array(means, float), cross


def ols(df: DataFrame, features: list[str], label: str) -> Linear:
    """Ordinary least squares with intercept: coefficients, standard errors, t values, R2."""
    n, mean, cross = _moments(df, [*features, label])
    k = len(features)
    xx, xy, yy = cross[:k, :k], cross[:k, k], cross[k, k]
    w = np.linalg.lstsq(xx, xy, rcond=None)[0]
    b = mean[k] - mean[:k] @ w
    rss = max(0.0, yy - w @ xy)
    r2 = 1 - rss / yy if yy else 0.0
    free = n - k - 1
    errors = np.sqrt(np.diag(np.linalg.pinv(xx)) * rss / free) if free > 0 else np.full(k, np.nan)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = w / errors
    constant = float(np.sqrt((1 / n + mean[:k] @ np.linalg.pinv(xx) @ mean[:k]) * rss / free)) if free > 0 else float("nan")
    return Linear(features, w, float(b), r2, 1 - (1 - r2) * (n - 1) / free if free > 0 else float("nan"), errors, t, n, constant)


def backward_elimination(df: DataFrame, features: list[str], label: str, *, most_p: float = 0.05, most_vif: float = 5.0) -> tuple[Linear, list[dict]]:
    """Drop one feature at a time: the least significant above `most_p`, else the one most explained by others above `most_vif`.

    Returns the last model and what went: feature, p and vif at that time.
    """
    kept, gone = list(features), []
    while True:
        model = ols(df, kept, label)
        p = dict(zip(kept, model.p_values))
        v = vif(df, kept) if len(kept) > 1 else dict.fromkeys(kept, 1.0)
        bad = [f for f in kept if p[f] > most_p or v[f] > most_vif]
        if not bad or len(kept) == 1:
            return model, gone
        worst = max(bad, key=lambda f: (p[f] > most_p, p[f] if p[f] > most_p else v[f]))
        gone.append({"feature": worst, "p": float(p[worst]), "vif": float(v[worst])})
        kept.remove(worst)


def top_coefficients(features: list[str], coefficients, k: int = 10) -> list[tuple[str, float]]:
    """The k largest by size, names on ties."""
    return sorted(zip(features, map(float, coefficients)), key=lambda x: (-abs(x[1]), x[0]))[:k]


def vif(df: DataFrame, features: list[str]) -> dict[str, float]:
    """Variance inflation with uncentred R2 (the regressions have no constant)."""
    if len(features) > MOST_EXPRESSIONS:
        m = pair_sums(df, features, [0.0] * len(features))["p"]
    else:
        pairs = [(i, j) for i in range(len(features)) for j in range(i, len(features))]
        sums = df.agg(*[F.sum(F.col(features[i]).cast("double") * F.col(features[j])) for i, j in pairs]).first()
        m = np.zeros((len(features),) * 2)
        for (i, j), v in zip(pairs, sums):
            m[i, j] = m[j, i] = v
    out = {}
    for i, f in enumerate(features):
        rest = [j for j in range(len(features)) if j != i]
        fit = m[i, rest] @ np.linalg.lstsq(m[np.ix_(rest, rest)], m[rest, i], rcond=None)[0]
        out[f] = float(m[i, i] / (m[i, i] - fit))
    return out


def compare(models: dict[str, Callable[[DataFrame], Callable[[DataFrame], dict]]], train: DataFrame, test: DataFrame) -> list[dict]:
    """One row per model: its name and the measures of the test table. Each model maps a training table to a function of a test table."""
    return [{"model": name, **fit(train)(test)} for name, fit in models.items()]


def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error").transform(df)


def lasso(df: DataFrame, features: list[str], label: str, alpha: float):
    return LinearRegression(featuresCol="features", labelCol=label, elasticNetParam=1.0, regParam=alpha, standardization=False, maxIter=500, tol=1e-9).fit(assemble(df, features))


def ridge(df: DataFrame, features: list[str], label: str, alpha: float) -> tuple[np.ndarray, float]:
    """min |y - Xw|^2 + alpha |w|^2 with a free intercept."""
    _, mean, cross = _moments(df, [*features, label])
    k = len(features)
    w = np.linalg.solve(cross[:k, :k] + alpha * np.eye(k), cross[:k, k])
    return w, float(mean[k] - mean[:k] @ w)


def logistic(df: DataFrame, features: list[str], label: str, c: float = 1.0, max_iter: int = 1000):
    """L2 with inverse strength c, the intercept free."""
    n = df.count()
    return LogisticRegression(featuresCol="features", labelCol=label, regParam=1.0 / (n * c), elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=1e-10).fit(assemble(df, features))


def gaussian_nb(df: DataFrame, features: list[str], label: str):
    return NaiveBayes(featuresCol="features", labelCol=label, modelType="gaussian").fit(assemble(df, features))


def tree(df: DataFrame, features: list[str], label: str, bins: int = 256):
    """Depth up to Spark's largest; thresholds between up to `bins` values, all of them where a column has no more."""
    return DecisionTreeClassifier(featuresCol="features", labelCol=label, maxDepth=30, maxBins=bins, impurity="gini", seed=0).fit(assemble(df, features))


@dataclass
class Steps:
    """Preparation and a model, with the verbs fit, predict and score.

    prepare(table, train) returns the numeric table; fit(table, features, label) returns
    something with transform(assembled table), or with predict() as a column.
    """

    prepare: Callable[[DataFrame, DataFrame], DataFrame]
    fit_model: Callable[[DataFrame, list[str], str], object]
    label: str
    train: DataFrame | None = None
    features: list[str] | None = None
    model: object = None

    def fit(self, train: DataFrame) -> Steps:
        made = self.prepare(train, train)
        features = [c for c in made.columns if c != self.label]
        return Steps(self.prepare, self.fit_model, self.label, train, features, self.fit_model(made, features, self.label))

    def predict(self, table: DataFrame) -> DataFrame:
        """The prepared table with `prediction`; rows of any origin, with or without the label."""
        made = self.prepare(table, self.train)
        if isinstance(self.model, Linear):
            return made.withColumn("prediction", self.model.predict())
        return self.model.transform(assemble(made, self.features))

    def score(self, table: DataFrame) -> float:
        """R2 of a linear model, accuracy of a classifier."""
        got = self.predict(table)
        if isinstance(self.model, Linear):
            return regression_metrics(got, self.label, "prediction").first()["r2"]
        return got.agg(F.avg((F.col(self.label).cast("double") == F.col("prediction")).cast("double"))).first()[0]


def pipeline(*stages) -> Pipeline:
    """Spark's own pipeline of transformers and an estimator."""
    return Pipeline(stages=list(stages))


def misclassified(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Rows whose prediction is not their label."""
    return df.where(~F.col(label).cast("double").eqNullSafe(F.col(prediction).cast("double")))


def probability(model_output: DataFrame) -> DataFrame:
    return model_output.withColumn("p", vector_to_array("probability")[1])


def multinomial_nb(counts: DataFrame, label: str, alpha: float = 1.0) -> DataFrame:
    """(label, word, log_prob) from (label, word, n): additive smoothing over the whole vocabulary, class by class."""
    by = counts.groupBy(label, "word").agg(F.sum("n").alias("n"))
    found = by.groupBy(label).agg(F.sum("n").alias("total")).limit(MOST_CLASSES + 1).collect()
    if len(found) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes")
    if not found:
        return by.select(label, "word", F.lit(0.0).alias("log_prob"))
    # a word's counts of all classes are one small map, spread over the classes again with zeros filled in
    of_word = by.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct(F.col(label), "n"))).alias("counts"))
    size = of_word.agg(F.count(F.lit(1))).first()[0]
    kind = by.schema[label].dataType
    classes = F.array(*[F.struct(F.lit(r[label]).cast(kind).alias(label), F.lit(int(r["total"])).alias("total")) for r in found])
    full = of_word.select("word", "counts", F.explode(classes).alias("c")).select("word", f"c.{label}", "c.total", F.coalesce(F.try_element_at("counts", F.col(f"c.{label}")), F.lit(0)).alias("n"))
    return full.select(label, "word", F.log((F.col("n") + alpha) / (F.col("total") + alpha * size)).alias("log_prob"))


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """r2, mae, mse and rmse (its root) in one row."""
    e = F.col(label) - F.col(prediction)
    mse = F.avg(e * e)
    return df.agg((1 - F.sum(e * e) / (F.var_pop(label) * F.count(label))).alias("r2"), F.avg(F.abs(e)).alias("mae"), mse.alias("mse"), F.sqrt(mse).alias("rmse"))


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(label, predicted_0, predicted_1)."""
    return df.groupBy(F.col(label).alias("label")).agg(F.count_if(F.col(prediction) == 0).alias("predicted_0"), F.count_if(F.col(prediction) == 1).alias("predicted_1"))


def _rates(counted: DataFrame, *by: str) -> DataFrame:
    from weftline.operators.alignment import prf

    pr, rc, f1 = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return counted.select(*by, "tp", "fp", "fn", "tn", ((F.col("tp") + F.col("tn")) / n).alias("accuracy"), pr.alias("precision"), rc.alias("recall"), f1.alias("f1"))


def binary_metrics(df: DataFrame, label: str, prediction: Column, *by: str) -> DataFrame:
    """accuracy, precision, recall, f1 (0 where undefined), per group if any."""
    y, p = F.col(label) == 1, prediction == 1
    counted = (df.groupBy(*by) if by else df).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    return _rates(counted, *by)


def threshold_sweep(df: DataFrame, label: str, score: str, thresholds=(0.3, 0.5, 0.7)) -> DataFrame:
    """binary_metrics at each threshold. Rows are counted once, by how many thresholds their score reaches; the counts are few."""
    at = sorted(set(thresholds))
    told = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    reached = F.size(F.filter(F.lit(at), lambda t: F.col(score) >= t))
    counts = told.groupBy(F.col(label).alias("_y"), reached.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    wide = counts.select("_y", "_b", "_n", F.posexplode(F.lit(at)).alias("_i", "threshold"))
    y, p = F.col("_y") == 1, F.col("_b") > F.col("_i")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("_n"))), F.lit(0).cast("long"))
    return _rates(wide.groupBy("threshold").agg(total(y & p).alias("tp"), total(~y & p).alias("fp"), total(y & ~p).alias("fn"), total(~y & ~p).alias("tn")), "threshold")


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the curve by ranks with ties halved.

    Counts by score are combined first; running sums are taken within 1000 ranges
    of the score, and over the ranges' totals, so no task sorts all scores.
    """
    from pyspark.sql import Window

    at = df.groupBy(score).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    ends = at.agg(F.min(score).cast("double").alias("lo"), F.max(score).cast("double").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / 1000
    ranged = at.join(F.broadcast(ends)).withColumn("b", F.when(width > 0, F.floor((F.col(score) - F.col("lo")) / width)).otherwise(F.lit(0)))
    totals = ranged.groupBy("b").agg(F.sum("neg").alias("t"))
    below = totals.withColumn("base", F.coalesce(F.sum("t").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("t")
    inside = F.coalesce(F.sum("neg").over(Window.partitionBy("b").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = ranged.withColumn("inside", inside).join(F.broadcast(below), "b").withColumn("won", F.col("pos") * (F.col("base") + F.col("inside") + F.col("neg") / 2))
    return ranked.agg((F.sum("won") / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def roc_curve(df: DataFrame, label: str, score: str, steps: int | None = None) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score, from infinity down, or at evenly spaced thresholds of a score from 0 to 1.

    Of the former, a point between two equal steps (as many of either label before it as
    after) says nothing and is left out, the first and the last are not. Rows without label or
    score don't count; a rate whose label no row has is 0.
    """
    if steps is not None:
        swept = threshold_sweep(df, label, score, tuple(i / steps for i in range(steps + 1)))
        return swept.select("threshold", F.coalesce(F.try_divide(F.col("fp"), F.col("fp") + F.col("tn")), F.lit(0.0)).alias("fpr"), F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0)).alias("tpr"))
    at = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("threshold")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    told = checkpointed(running(at, [-F.col("threshold")], {"tp": "pos", "fp": "neg"}, ahead=["pos", "neg"]))
    ends = told.agg(F.max("tp").alias("p"), F.max("fp").alias("n"), F.max("threshold").alias("high"))
    kept = told.join(F.broadcast(ends.select("high"))).where("next_pos is null or pos <> next_pos or neg <> next_neg or threshold = high").select("threshold", "tp", "fp")  # one row
    begin = told.sparkSession.range(1).select(F.lit(float("inf")).alias("threshold"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"))
    rate = lambda c, n: F.coalesce(F.try_divide(F.col(c).cast("double"), F.col(n)), F.lit(0.0))
    return kept.unionByName(begin).join(F.broadcast(ends)).where("p is not null").select("threshold", rate("fp", "n").alias("fpr"), rate("tp", "p").alias("tpr"))  # one row


@dataclass
class TextBayes:
    """Multinomial naive Bayes over words: (word, logs: one for each class) and the classes' priors, by class."""

    words: DataFrame
    classes: list
    priors: list[float]
    label: str

    def predict(self, counts: DataFrame, texts: DataFrame, key: str) -> DataFrame:
        """`texts` with `prediction` and `probability` (by class) from their words (key, word, n). Unknown words don't count; a text without known ones has the priors.

        Sums are taken per text; the words' table is broadcast if it is measured to be small,
        joined by word otherwise. Equally likely classes: the least.
        """
        size = self.words.agg(F.sum(F.octet_length("word") + 8 * len(self.classes) + 16).cast("long")).first()[0] or 0
        table = F.broadcast(self.words) if size <= BROADCAST_BYTES else self.words
        at = counts.join(table, "word").groupBy(key).agg(*[F.sum(F.col("n") * F.col("logs")[i]).alias(f"_l{i}") for i in range(len(self.classes))])
        joined = texts.join(at, key, "left")
        logs = F.array(*[F.coalesce(f"_l{i}", F.lit(0.0)) + F.lit(p) for i, p in enumerate(self.priors)])
        most = F.array_max("_logs")
        # log-sum-exp around the largest
        norm = most + F.log(F.aggregate("_logs", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.array_max("_logs"))))
        told = joined.withColumn("_logs", logs).withColumn("_norm", norm)
        place = F.array_position("_logs", most).cast("int")
        return told.select(*texts.columns, F.element_at(F.lit(self.classes), place).alias("prediction"), F.transform("_logs", lambda x: F.exp(x - F.col("_norm"))).alias("probability"))


#: A table of words is broadcast up to so many bytes.
BROADCAST_BYTES = 8 << 20


def text_bayes(counts: DataFrame, labels: DataFrame, label: str, alpha: float = 1.0) -> TextBayes:
    """Naive Bayes from words (key, word, n, label) and the texts' labels (one row a text, also those without words)."""
    sizes = sorted((r[0], r[1]) for r in labels.where(F.col(label).isNotNull()).groupBy(label).count().limit(MOST_CLASSES + 1).collect())
    if len(sizes) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes")
    if not sizes:
        raise ValueError("no labelled text")
    classes, n = [c for c, _ in sizes], sum(k for _, k in sizes)
    of_word = checkpointed(counts.groupBy("word").agg(*[F.coalesce(F.sum(F.when(F.col(label) == c, F.col("n"))), F.lit(0)).alias(f"_n{i}") for i, c in enumerate(classes)]))
    size, *totals = of_word.agg(F.count(F.lit(1)), *[F.sum(f"_n{i}") for i in range(len(classes))]).first()
    logs = F.array(*[F.log((F.col(f"_n{i}") + alpha) / F.lit(float((t or 0) + alpha * size))) for i, t in enumerate(totals)])
    return TextBayes(checkpointed(of_word.select("word", logs.alias("logs"))), classes, [math.log(k / n) for _, k in sizes], label)


def stopped_lasso(df: DataFrame, features: list[str], label: str, alpha: float, *, max_iter: int = 100, tol: float = 0.1, start: np.ndarray | None = None) -> tuple[np.ndarray, float, int]:
    """(coefficients, intercept, rounds) of min |y - Xw|^2 / 2n + alpha |w|_1 by cyclic coordinate descent that stops early.

    The table is read for its centred cross products only. A round updates each coefficient in
    turn by the soft threshold; once no coefficient moved by more than `tol` of the largest,
    or in the last round, the duality gap is compared with tol * |y|^2. `start`: the
    coefficients to begin with, for a path over alphas.
    """
    n, mean, cross = _moments(df, [*features, label])
    k = len(features)
    w, rounds = _descend(cross[:k, :k], cross[:k, k], cross[k, k], alpha * n, max_iter, tol, start)
    return w, float(mean[k] - mean[:k] @ w), rounds


def _descend(q: np.ndarray, xy: np.ndarray, yy: float, penalty: float, max_iter: int, tol: float, start: np.ndarray | None) -> tuple[np.ndarray, int]:
    w = np.zeros(len(xy)) if start is None else np.array(start, float)
    for rounds in range(1, max_iter + 1):
        moved = 0.0
        for j in np.nonzero(np.diag(q) > 0)[0]:
            pull = xy[j] - q[j] @ w + q[j, j] * w[j]
            new = np.sign(pull) * max(abs(pull) - penalty, 0.0) / q[j, j]
            moved, w[j] = max(moved, abs(new - w[j])), new
        largest = np.abs(w).max(initial=0.0)
        if largest == 0 or moved < tol * largest or rounds == max_iter:
            residual = yy - 2 * (w @ xy) + w @ q @ w
            dual = np.abs(xy - q @ w).max(initial=0.0)
            scale = penalty / dual if dual > penalty else 1.0
            gap = 0.5 * residual * (1 + scale * scale) + penalty * np.abs(w).sum() - scale * (yy - w @ xy)
            if gap < tol * yy:
                break
    return w, rounds
