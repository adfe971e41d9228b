"""Profiles of tables: summaries, null counts, values, correlations, bins, boxes."""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import workers_find_us

#: Cut points of a sketch: a column's values are ranked within so many ranges, whatever their number.
CUTS = 200


def quantiles(df: DataFrame, by: list[str], col: str, probs: list[float]) -> DataFrame:
    """(by..., q): exact quantiles with linear interpolation of each group, as an array in the order of `probs`.

    Values are counted first. A sketch (small, whatever the input) cuts each group's values
    into ranges; the ranges' totals tell which ranges hold the wanted ranks, and only those
    are sorted. So neither all values nor all of a group's are ever in one task.
    """
    x = F.col(col).cast("double")
    rows = df.select(*by, x.alias("_x")).where("_x is not null")
    cuts = F.percentile_approx("_x", F.array(*[F.lit(i / CUTS) for i in range(1, CUTS)]), 10 * CUTS)
    group = (lambda d: d.groupBy(*by)) if by else (lambda d: d.groupBy())
    sketch = group(rows).agg(cuts.alias("_cuts"), F.count(F.lit(1)).alias("_all"))
    counts = rows.groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("_n"))
    told = counts.join(sketch, by) if by else counts.join(F.broadcast(sketch))  # one row
    ranged = told.withColumn("_r", F.size(F.filter("_cuts", lambda c: c < F.col("_x")))).drop("_cuts")
    totals = ranged.groupBy(*by, "_r").agg(F.sum("_n").alias("_t"), F.first("_all").alias("_all"))
    own = Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_below", F.coalesce(F.sum("_t").over(own), F.lit(0)))  # CUTS rows a group at most
    ranks = [(F.floor(F.lit(float(p)) * (F.col("_all") - 1)), F.ceil(F.lit(float(p)) * (F.col("_all") - 1)), F.lit(float(p)) * (F.col("_all") - 1)) for p in probs]
    held = F.lit(False)
    for low, high, _ in ranks:
        held = held | ((F.col("_below") <= high) & (low < F.col("_below") + F.col("_t")))
    wanted = totals.where(held).select(*by, "_r", "_below")
    inside = Window.partitionBy(*by, "_r").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.join(wanted, [*by, "_r"]).withColumn("_end", F.col("_below") + F.sum("_n").over(inside))
    ends = group(placed).agg(F.first("_all").alias("_all"), *[F.min(F.when(F.col("_end") > r, F.col("_x"))).alias(f"_{k}{i}") for i, pair in enumerate(ranks) for k, r in zip("lh", pair)])
    value = lambda i: F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * (ranks[i][2] - ranks[i][0])
    return ends.select(*by, F.array(*[value(i) for i in range(len(probs))]).alias("q"))


def _long(df: DataFrame, cols: list[str], name: str = "column") -> DataFrame:
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias(name), F.col(f"`{c}`").cast("double").alias("x")) for c in cols])).alias("v")).select("v.*")


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """count, mean, std (sample), min, exact quartiles and max of each column."""
    made = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    x = lambda c: F.col(f"`{c}`").cast("double")
    one = df.agg(*[F.struct(F.lit(c).alias("column"), *[f(x(c)).alias(n) for n, f in made.items()]).alias(f"c{i}") for i, c in enumerate(cols)])
    agg = one.select(F.explode(F.array(*[f"c{i}" for i in range(len(cols))])).alias("v")).select("v.*")
    both = agg.join(quantiles(_long(df, cols), ["column"], "x", [0.25, 0.5, 0.75]), "column", "left")
    return both.select("column", "count", "mean", "std", "min", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "max")


def describe_text(df: DataFrame, group: str, col: str) -> DataFrame:
    """Per group of a text column: count, distinct values, the commonest (the least of several) and how often."""
    values = df.where(F.col(col).isNotNull()).groupBy(group, col).agg(F.count(F.lit(1)).alias("n"))
    best = F.min_by(F.col(col), F.struct((-F.col("n")).alias("n"), F.col(col).alias("v")))
    return values.groupBy(group).agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"), best.alias("top"), F.max("n").alias("freq"))


def null_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    one = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in cols])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("nulls")) for c in cols])).alias("v")).select("v.*")


def columns_with_nulls(df: DataFrame, cols: list[str]) -> DataFrame:
    return null_counts(df, cols).where("nulls > 0").select("column")


def distinct_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct non-null values of each column, in one pass."""
    one = df.agg(*[F.count_distinct(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(cols)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("distinct_values")) for i, c in enumerate(cols)])).alias("v")).select("v.*")


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Values with counts and shares, commonest first."""
    counted = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    return counted.join(F.broadcast(total)).select(col, "n", (F.col("n") / F.col("_total")).alias("share")).orderBy(F.desc("n"), col)  # one row


#: With more columns than this, sums over pairs of columns are made as matrix products instead of an expression a pair.
MOST_EXPRESSIONS = 24


def pair_sums(df: DataFrame, cols: list[str], centres: list[float]) -> dict[str, np.ndarray]:
    """Over the rows that have both columns of a pair: their number (n), and the sums of the first (s), its square (q) and the product (p), of values less their centres.

    Each task multiplies its batches and puts out a row a column; rows of a column meet to be
    added. Only the four matrices of columns by columns reach the driver.
    """
    k = len(cols)
    workers_find_us(df.sparkSession)
    values = df.select(*[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    shift = np.array(centres, float)

    def partial(batches):
        total = np.zeros((4, k, k))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            there = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
            x = np.where(there > 0, x - shift, 0.0)
            total += np.stack([there.T @ there, x.T @ there, (x * x).T @ there, x.T @ x])
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(list(total.transpose(1, 0, 2).reshape(k, 4 * k)), pa.list_(pa.float64()))], names=["i", "sums"])

    def added(key, table):
        rows = np.concatenate([c.flatten().to_numpy() for c in table.column("sums").chunks]).reshape(-1, 4 * k)
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([rows.sum(0)], pa.list_(pa.float64()))], names=["i", "sums"])

    found = values.mapInArrow(partial, "i int, sums array<double>").groupBy("i").applyInArrow(added, "i int, sums array<double>").collect()
    made = np.zeros((4, k, k))
    for r in found:  # one row a column
        made[:, r["i"]] = np.array(r["sums"]).reshape(4, k)
    return dict(zip("nsqp", made))


def correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """(a, b, corr) for all pairs of columns over the rows that have both; null where one doesn't vary."""
    pairs = list(combinations_with_replacement(cols, 2))
    if len(cols) > MOST_EXPRESSIONS:
        means = df.agg(*[F.avg(F.col(f"`{c}`").cast("double")) for c in cols]).first()
        m = pair_sums(df, cols, [x or 0.0 for x in means])
        with np.errstate(divide="ignore", invalid="ignore"):
            both = m["p"] - m["s"] * m["s"].T / m["n"]
            own = m["q"] - m["s"] ** 2 / m["n"]
            corr = both / np.sqrt(own * own.T)
        at = {c: i for i, c in enumerate(cols)}
        told = [(a, b, float(corr[at[a], at[b]])) for a, b in pairs]
        return df.sparkSession.createDataFrame([(a, b, v if np.isfinite(v) else None) for a, b, v in told], "a string, b string, corr double")

    def corr(a: str, b: str) -> Column:
        x, y = F.col(a).cast("double"), F.col(b).cast("double")
        # corr() fails where a column doesn't vary
        return F.try_divide(F.covar_pop(x, y), F.stddev_pop(F.when(y.isNotNull(), x)) * F.stddev_pop(F.when(x.isNotNull(), y)))

    one = df.agg(*[corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)]
    return one.select(F.explode(F.array(*rows)).alias("v")).select("v.*")


def histogram(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """(bin, low, n): equal widths between least and greatest; the last bin holds the greatest."""
    ends = df.agg(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi"))
    x = df.where(F.col(col).isNotNull()).join(F.broadcast(ends))  # one row
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col(col) - F.col("lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    return x.groupBy(at.cast("int").alias("bin")).agg(F.min(F.col("lo") + at * width).alias("low"), F.count(F.lit(1)).alias("n"))


def boxplot(df: DataFrame, by: list[str], col: str) -> DataFrame:
    agg = df.groupBy(*by).agg(F.min(col).alias("least"), F.max(col).alias("greatest"), F.count(col).alias("n"))
    both = agg.join(quantiles(df, by, col, [0.25, 0.5, 0.75]), by, "left")
    return both.select(*by, "least", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "greatest", "n")


def group_mean(df: DataFrame, by: str, value: F.Column, name: str) -> DataFrame:
    return df.groupBy(by).agg(F.avg(value).alias(name))


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def info(df: DataFrame) -> DataFrame:
    """(position, column, type, non_null) of each column."""
    one = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)])
    rows = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(f"c{i}").alias("non_null")) for i, (c, t) in enumerate(df.dtypes)]
    return one.select(F.explode(F.array(*rows)).alias("v")).select("v.*")


def sample_per_group(df: DataFrame, by: str, key: str, n: int = 5, seed: int = 0) -> DataFrame:
    """n rows of each group: those with the least MD5 of seed and key, any engine's sample. Rows beyond n a task are dropped before the shuffle."""
    w = Window.partitionBy(by).orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), key)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
