"""Connected components of a link table, distributed, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, release


def components(links: DataFrame) -> DataFrame:
    """(id, component): for every id in `links` (a, b: long), the smallest id that links reach.

    Each round has a shuffle of the links and cuts its lineage through the
    checkpoint folder; the number of rounds grows with the logarithm of the
    longest path. Links and labels stay distributed throughout.
    """
    edges = checkpointed(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: larger neighbours of a link to a's smallest
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: smaller neighbours of a, and a, link to the smallest
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        after = checkpointed(small)
        moved = after.join(edges, ["a", "b"], "left_anti").limit(1).count() or edges.join(after, ["a", "b"], "left_anti").limit(1).count()
        release(edges)
        edges = after
        if not moved:
            break
    stars = edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "id")
    roots = edges.select(F.col("b").alias("id")).distinct().join(stars, "id", "left_anti").select("id", F.col("id").alias("component"))
    return stars.unionByName(roots)
