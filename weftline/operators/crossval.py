"""Cross-validation with deterministic folds."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.features import numbered, split


def cross_validate(folded: DataFrame, k: int, fit: Callable[[DataFrame], Callable[[DataFrame], float]]) -> dict[str, object]:
    """Scores of k folds (column `fold`), with mean and population deviation. fit(train) returns a function of the test table."""
    cached = folded.persist()
    try:
        scores = [fit(cached.where(F.col("fold") != i))(cached.where(F.col("fold") == i)) for i in range(k)]
    finally:
        cached.unpersist()
    return {"scores": scores, "mean": float(np.mean(scores)), "std": float(np.std(scores)), "min": min(scores), "max": max(scores)}


def grid(options: list[dict], score: Callable[[dict], float]) -> list[dict]:
    """Each option with its score on one holdout, best first; equal scores keep their order."""
    return sorted(({**o, "score": score(o)} for o in options), key=lambda r: -r["score"])


def shuffled_folds(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """`df` with `fold` of a shuffled k-fold: blocks of equal size in the order of a hash of the key, the first ones a row longer."""
    keyed = numbered(df.withColumn("_key", F.xxhash64(F.lit(seed), F.col(key))), "_key", name="_at")
    n = df.count()
    size, long_ = n // k, n % k
    at, edge = F.col("_at"), long_ * (size + 1)
    fold = F.when(at < edge, F.floor(at / (size + 1))).otherwise(F.floor((at - edge) / max(1, size)) + long_)
    return keyed.withColumn("fold", fold.cast("int")).drop("_key", "_at")


def split_sensitivity(df: DataFrame, key: str, test_percent: int, seeds: list[int], fit: Callable[[DataFrame], Callable[[DataFrame], float]]) -> dict[str, object]:
    """Scores of single splits by several seeds, and how far apart they lie."""
    scores = []
    for seed in seeds:
        train, test = split(df, key, test_percent, seed)
        scores.append(fit(train)(test))
    return {"scores": scores, "min": min(scores), "max": max(scores), "range": max(scores) - min(scores), "mean": float(np.mean(scores)), "std": float(np.std(scores))}


def search(options: list[dict], make: Callable[[dict], Callable[[DataFrame], Callable[[DataFrame], float]]], train: DataFrame, test: DataFrame) -> list[dict]:
    """grid() over models: make(option) fits on `train` and is scored on `test`."""
    return grid(options, lambda o: make(o)(train)(test))


def accuracy(predictions: DataFrame, label: str) -> float:
    return predictions.agg(F.avg((F.col(label).cast("double") == F.col("prediction")).cast("double"))).first()[0]
