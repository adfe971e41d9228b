"""Preprocessing: filling, encoding, scaling, splitting, text features.

What is fitted (means, levels, scales) is computed on a training table and applied
as plain expressions, so applying it is a narrow map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.profile import CUTS, quantiles
from weftline.session import checkpointed, release

#: A column with more distinct values than this is no category.
MOST_LEVELS = 10_000


def _fitted(df: DataFrame, col: str, kind: str):
    if kind == "median":
        found = quantiles(df, [], col, [0.5]).first()
        return found["q"][0] if found else None
    if kind == "mode":  # the least of several, from counts by value
        found = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), col).limit(1).first()
        return found[0] if found else None
    if kind == "mean":
        return df.agg(F.avg(col)).first()[0]
    raise ValueError(f"unknown kind of fill: {kind}")


def fill(df: DataFrame, cols: dict[str, str], train: DataFrame | None = None) -> DataFrame:
    """Nulls by the training table's mean, exact median or mode (the least of several): {column: kind}."""
    values = {c: _fitted(df if train is None else train, c, k) for c, k in cols.items()}
    return df.select(*[F.coalesce(F.col(c), F.lit(values[c])).alias(c) if c in cols else F.col(c) for c in df.columns])


def fill_const(df: DataFrame, cols: dict[str, object]) -> DataFrame:
    return df.na.fill(cols)


def drop_nulls(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=cols)


def levels(df: DataFrame, col: str, most: int = MOST_LEVELS) -> list:
    """Sorted distinct values of a category; an error beyond `most` of them."""
    found = [r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{col} has more than {most} levels: it is no category")
    return sorted(found)


def one_hot(df: DataFrame, cols: list[str], *, drop: str = "none", train: DataFrame | None = None) -> DataFrame:
    """Indicators of the training table's levels; an unknown value has none.

    drop: 'none', 'first' (each column's first level) or 'binary' (the first of two).
    """
    made = []
    for c in cols:
        found = levels(df if train is None else train, c)
        kept = found[1:] if drop == "first" or (drop == "binary" and len(found) == 2) else found
        made += [F.coalesce((F.col(c) == v).cast("int"), F.lit(0)).alias(f"{c}_{v}") for v in kept]
    return df.select(*[c for c in df.columns if c not in cols], *made)


def min_max(df: DataFrame, cols: list[str], train: DataFrame | None = None) -> DataFrame:
    """(x - min) / (max - min) of the training table, unclipped; 0 where that is constant, null where it has no value."""
    t = df if train is None else train
    s = t.agg(*[F.min(c).alias(f"lo_{c}") for c in cols], *[F.max(c).alias(f"hi_{c}") for c in cols]).first()

    def scale(c):
        lo, hi = s[f"lo_{c}"], s[f"hi_{c}"]
        return F.lit(None).cast("double") if lo is None else (F.col(c) - lo) / (float(hi - lo) or 1.0)

    return df.select(*[scale(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def standardize(df: DataFrame, cols: list[str], train: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population standard deviation of the training table; 0 where that is constant, null where it has no value."""
    t = df if train is None else train
    s = t.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"d_{c}") for c in cols]).first()
    scale = lambda c: F.lit(None).cast("double") if s[f"m_{c}"] is None else (F.col(c) - s[f"m_{c}"]) / (s[f"d_{c}"] or 1.0)
    return df.select(*[scale(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def fold(key: Column, k: int) -> Column:
    """A fold by an integer key, the same in any engine."""
    return F.pmod(key, F.lit(k)).cast("int")


def hash_percent(key: Column, seed: int = 0) -> Column:
    """0 to 99 from the MD5 of seed and key: the same in any engine."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), key.cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(100)).cast("int")


def split(df: DataFrame, key: str, test_percent: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(train, test) by a hash of the key: the same rows whatever the partitions."""
    at = hash_percent(F.col(key), seed)
    return df.where(at >= test_percent), df.where(at < test_percent)


def numbered(df: DataFrame, key: str, by: list[str] | None = None, name: str = "number") -> DataFrame:
    """`df` with `name`: 0, 1, 2, ... in the order of a numeric key, without gaps, in each group of `by`.

    A sketch cuts the keys into ranges, counts of the ranges (few rows) give each its first
    number, and rows are ranked within their range: no task sorts a whole group. Null keys
    come first; rows with equal keys take their numbers in any order.
    """
    by = by or []
    cuts = df.agg(F.percentile_approx(F.col(key).cast("double"), F.array(*[F.lit(i / CUTS) for i in range(1, CUTS)]), 10 * CUTS)).first()[0]
    bounds = F.array(*[F.lit(float(c)) for c in sorted(set(cuts or []))]).cast("array<double>")
    ranged = df.withColumn("_r", F.when(F.col(key).isNull(), -1).otherwise(F.size(F.filter(bounds, lambda c: c < F.col(key).cast("double")))))
    totals = ranged.groupBy(*by, "_r").agg(F.count(F.lit(1)).alias("_t"))
    before = F.sum("_t").over(Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(*by, "_r", F.coalesce(before, F.lit(0)).alias("_below"))
    rank = F.row_number().over(Window.partitionBy(*by, "_r").orderBy(key))
    joined = ranged.withColumn("_k", rank).join(totals, [*by, "_r"])
    return joined.select(*df.columns, (F.col("_below") + F.col("_k") - 1).alias(name))


#: Rows of a range of sorted keys.
RANGE_ROWS = 500_000


def running(df: DataFrame, keys: list[Column], sums: dict[str, str], *, ahead: list[str] | None = None) -> DataFrame:
    """`df` with running sums over the order of `keys` (ties in any order, the row itself counts): {new name: column}.

    Columns named in `ahead` get `next_{column}`, that of the row after; null for the last.
    Rows are dealt by ranges of the keys; sums and firsts of the ranges, a row each, carry over,
    so no task sorts all rows.
    """
    ahead = ahead or []
    held = checkpointed(df)
    ranges = -(-held.count() // RANGE_ROWS) or 1
    names = [f"_k{i}" for i in range(len(keys))]
    placed = held.select("*", *[k.alias(n) for k, n in zip(keys, names)]).repartitionByRange(ranges, *names).withColumn("_r", F.spark_partition_id())
    placed = checkpointed(placed)
    release(held)
    first = lambda c: F.min_by(F.struct(c), F.struct(*names))[c]
    totals = placed.groupBy("_r").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()], *[first(c).alias(f"_f_{c}") for c in ahead], F.count(F.lit(1)).alias("_n"))
    over = Window.orderBy("_r")  # a row for each range
    below = totals.select("_r", *[(F.sum(f"_t_{n}").over(over.rowsBetween(Window.unboundedPreceding, 0)) - F.col(f"_t_{n}")).alias(f"_b_{n}") for n in sums], *[F.lead(f"_f_{c}").over(over).alias(f"_a_{c}") for c in ahead])
    inside = Window.partitionBy("_r").orderBy(*names)
    told = placed.select("*", *[F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias(n) for n, c in sums.items()], *[F.lead(c).over(inside).alias(f"_l_{c}") for c in ahead])
    joined = told.join(below, "_r")
    return joined.select(*df.columns, *[(F.col(n) + F.col(f"_b_{n}")).alias(n) for n in sums], *[F.coalesce(f"_l_{c}", f"_a_{c}").alias(f"next_{c}") for c in ahead])


def stratified_folds(df: DataFrame, label: str, key: str, k: int, seed: int | None = None) -> DataFrame:
    """`df` with `fold`: each label's rows dealt in turn, by a numeric key or by a hash of it."""
    keyed = df.withColumn("_key", F.col(key) if seed is None else F.xxhash64(F.lit(seed), F.col(key)))
    return numbered(keyed, "_key", [label], "_at").withColumn("fold", F.pmod("_at", F.lit(k)).cast("int")).drop("_key", "_at")


def stratified_split(df: DataFrame, label: str, key: str, test_percent: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(train, test): of each label's rows the given percentage, rounded, in the order of a hash of the key."""
    keyed = numbered(df.withColumn("_key", F.xxhash64(F.lit(seed), F.col(key))), "_key", [label], "_at")
    sizes = df.groupBy(label).agg(F.round(F.count(F.lit(1)) * test_percent / 100).alias("_test"))
    told = keyed.join(sizes, label).withColumn("_in", F.col("_at") < F.col("_test"))
    return told.where(~F.col("_in")).select(*df.columns), told.where("_in").select(*df.columns)


def transform_columns(df: DataFrame, parts: list[tuple[str, list[str]]], train: DataFrame | None = None, rest: str = "drop") -> DataFrame:
    """Each group of columns by its own steps, fitted on the training table: [(steps, columns)].

    Steps are joined by `+`: mean, median, mode, scale, min_max, onehot, onehot_first,
    onehot_binary. Columns that no group names are dropped, or kept in front (`rest="keep"`).
    """
    t = df if train is None else train
    kept = {c for _, cols in parts for c in cols}
    out, fit = df, t
    for steps, cols in parts:
        for step in steps.split("+"):
            if step in ("mean", "median", "mode"):
                out, fit = fill(out, dict.fromkeys(cols, step), fit), fill(fit, dict.fromkeys(cols, step), fit)
            elif step in ("scale", "min_max"):
                made = standardize if step == "scale" else min_max
                out, fit = made(out, cols, fit), made(fit, cols, fit)
            elif step.startswith("onehot"):
                drop = step.partition("_")[2] or "none"
                out, fit = one_hot(out, cols, drop=drop, train=fit), one_hot(fit, cols, drop=drop, train=fit)
            else:
                raise ValueError(f"unknown step: {step}")
    plain = [c for c in df.columns if c not in kept]
    return out if rest == "keep" else out.drop(*plain)


def words(text: Column) -> Column:
    """Lower-case runs of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def word_counts(df: DataFrame, key: str, text: str, *keep: str) -> DataFrame:
    """(key, word, n, ...): the sparse term-count matrix in long form."""
    return df.select(key, *keep, F.explode(words(F.col(text))).alias("word")).groupBy(key, *keep, "word").agg(F.count(F.lit(1)).alias("n"))


def tf_idf(counts: DataFrame, key: str, n_docs: int) -> DataFrame:
    """(key, word, tfidf): smooth idf, rows of unit length."""
    df_ = counts.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    raw = counts.join(df_, "word").withColumn("w", F.col("n") * (F.log((F.lit(1.0) + n_docs) / (1.0 + F.col("df"))) + 1.0))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, key).select(key, "word", (F.col("w") / F.col("norm")).alias("tfidf"))


def vocabulary(counts: DataFrame) -> DataFrame:
    """(word, id): the distinct words of (word, ...) with gapless numbers from 0 in the order of their code points; null is no word."""
    words_ = counts.where(F.col("word").isNotNull()).select("word").distinct().withColumn("_one", F.lit(1))
    return running(words_, [F.col("word")], {"id": "_one"}).select("word", (F.col("id") - 1).alias("id"))


def count_vectors(counts: DataFrame, key: str, vocabulary_: DataFrame) -> DataFrame:
    """(key, ids, counts): one sparse row per key of (key, word, n), ids ascending. Words outside the vocabulary, as of texts that it wasn't made of, don't count.

    A row holds a text's distinct words; keys without a known word have none.
    """
    at = counts.join(vocabulary_.withColumnRenamed("id", "_id"), "word").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_id", "n"))).alias("v"))
    return at.select(key, F.transform("v", lambda x: x["_id"]).alias("ids"), F.transform("v", lambda x: x["n"]).alias("counts"))
