"""Queries over the graph tables: counts, degrees, search, patterns, paths, subgraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.session import checkpointed


def dealt(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """`df` by keys over so many tasks, where a caller knows how many it takes: a join or an aggregate by these keys keeps them."""
    return df if tasks is None else df.repartition(tasks, *keys)


def incidence(relations: DataFrame) -> DataFrame:
    """(id, other, type, out): each relation once from either end."""
    one = relations.select(F.col("src").alias("id"), F.col("tgt").alias("other"), "type", F.lit(True).alias("out"))
    return one.unionByName(relations.select(F.col("tgt").alias("id"), F.col("src").alias("other"), "type", F.lit(False).alias("out")))


def degrees(entities: DataFrame, relations: DataFrame, tasks: int | None = None) -> DataFrame:
    """`entities` with `connections`: relations at either end, 0 without any. Counted before the join, in so many tasks."""
    ends = dealt(relations.select(F.explode(F.array("src", "tgt")).alias("id")), tasks, "id").groupBy("id").agg(F.count(F.lit(1)).alias("connections"))
    return entities.join(ends, "id", "left").withColumn("connections", F.coalesce("connections", F.lit(0).cast("long")))


def stats(t: dict[str, DataFrame]) -> DataFrame:
    """(what, n) for documents, chunks, entities and relationships."""
    names = {"documents": "documents", "chunks": "chunks", "entities": "entities", "relationships": "relations"}
    parts = [t[v].agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("what"), "n") for k, v in names.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def type_counts(entities: DataFrame) -> DataFrame:
    return entities.groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type")


def top_degree(entities: DataFrame, relations: DataFrame, k: int = 10, tasks: int | None = None) -> DataFrame:
    """The k best-connected (name, type); equal names of a type count together, as they read."""
    d = dealt(degrees(entities, relations, tasks).select("name", "type", "connections"), tasks, "name", "type").groupBy("name", "type").agg(F.sum("connections").alias("connections"))
    return d.orderBy(F.desc("connections"), "name", "type").limit(k)


def search(entities: DataFrame, relations: DataFrame, query: str, k: int = 15, tasks: int | None = None) -> DataFrame:
    """Entities whose name or type contains the query, whatever the case; `%` and `_` are plain characters."""
    q = F.lit(query.strip().lower())
    hits = entities.where(F.contains(F.lower("name"), q) | F.contains(F.lower(F.coalesce("type", F.lit(""))), q))
    out = degrees(hits, relations, tasks).select("id", "name", "type", F.coalesce("description", F.lit("")).alias("description"), F.coalesce("mentions", F.lit(1).cast("long")).alias("mentions"), "connections")
    return out.orderBy(F.desc("connections"), "id").limit(k)


def edge_list(entities: DataFrame, relations: DataFrame, k: int | None = 100) -> DataFrame:
    """Relations with both names; the limit is taken before the joins."""
    r = relations if k is None else relations.orderBy("src", "type", "tgt").limit(k)
    s, t = (entities.select(F.col("id").alias(x), F.col("name").alias(f"{x}_name"), F.col("type").alias(f"{x}_type")) for x in ("src", "tgt"))
    return r.join(s, "src").join(t, "tgt").select("src", "src_name", "src_type", F.col("type").alias("relation"), "tgt", "tgt_name", "tgt_type")


def provenance(documents: DataFrame, chunks: DataFrame, mentions: DataFrame, entities: DataFrame, tasks: int | None = None) -> DataFrame:
    """Document, chunk and entity along the path that leads from one to the other; mentions meet entities in so many tasks."""
    d = documents.select(F.col("file_hash").alias("doc_hash"), "filename")
    # chunks meet their documents first: there are fewer of them than mentions, and no hash goes along with those
    c = chunks.select(F.col("id").alias("chunk_id"), "doc_hash").join(d, "doc_hash").select("chunk_id", "filename")
    return dealt(mentions.join(c, "chunk_id"), tasks, "entity_id").join(entities.select(F.col("id").alias("entity_id"), "name"), "entity_id").select("filename", "chunk_id", "entity_id", "name")


def between_labels(entities: DataFrame, relations: DataFrame, a: str, b: str, tasks: int | None = None) -> DataFrame:
    """Relations, in either direction, between an entity of type `a` and one of type `b`; they meet the former in so many tasks."""
    ends = dealt(incidence(relations).select("id", "other", "type"), tasks, "id")
    p = entities.where(F.col("type") == a).select("id", F.col("name").alias("name_a"))
    q = entities.where(F.col("type") == b).select(F.col("id").alias("other"), F.col("name").alias("name_b"))
    return ends.join(p, "id").join(q, "other").select("name_a", F.col("type").alias("relation"), "name_b")


def within(relations: DataFrame, start: DataFrame, hops: int = 2, tasks: int | None = None) -> DataFrame:
    """(id, hops): nodes at the end of a path of up to `hops` relations from `start` (id) that uses none twice, with the fewest.

    A search by breadth from all start nodes at once: each node is reached once and keeps its
    start node and the first relation of its path, one row whatever the number of paths. A
    shortest path uses nothing twice. Only a start node may be met again by a longer one, from
    another start node or round a cycle: where a relation joins two nodes that were reached
    from different ones, or by different first relations, their distances and it add up to
    the length of such a path, and the shortest one is among those. Nulls in `start` reach nothing.
    Relations are made distinct, and meet the reached nodes, in so many tasks.
    """
    edges = checkpointed(dealt(relations.select("src", "tgt", F.xxhash64("src", "tgt", "type").alias("e")), tasks, "src", "tgt").distinct())
    ends = edges.select(F.col("src").alias("id"), F.col("tgt").alias("to"), "e").unionByName(edges.select(F.col("tgt").alias("id"), F.col("src").alias("to"), "e"))
    front = checkpointed(start.select("id").where("id is not null").distinct().select("id", F.col("id").alias("of"), F.lit(None).cast("long").alias("first"), F.lit(0).alias("d")))
    known = front
    for k in range(1, hops + 1):
        step = front.join(ends, "id").select(F.col("to").alias("id"), "of", F.coalesce("first", "e").alias("first"))
        new = step.groupBy("id").agg(F.min(F.struct("of", "first")).alias("v")).join(known.select("id"), "id", "left_anti")
        front = checkpointed(new.select("id", "v.of", "v.first", F.lit(k).alias("d")))
        known = known.unionByName(front)
    side = lambda end, s: known.select(F.col("id").alias(end), *[F.col(c).alias(f"{c}_{s}") for c in ("of", "first", "d")])
    both = dealt(dealt(edges, tasks, "src").join(side("src", "a"), "src"), tasks, "tgt").join(side("tgt", "b"), "tgt")
    loop = F.col("src") == F.col("tgt")
    # the relation by which a node was first reached from its start node makes no cycle with itself
    way = lambda s: F.coalesce(f"first_{s}", "e")
    meet = both.where(loop & (F.col("d_a") == 0) | ~loop & ((F.col("of_a") != F.col("of_b")) | (way("a") != way("b"))))
    length = F.when(loop, 1).otherwise(F.col("d_a") + F.col("d_b") + 1)
    again = meet.select(F.explode(F.array_distinct(F.array("of_a", "of_b"))).alias("id"), length.alias("hops")).groupBy("id").agg(F.min("hops").alias("hops")).where(F.col("hops") <= hops)
    return known.where("d > 0").select("id", F.col("d").alias("hops")).unionByName(again)


def subgraph(entities: DataFrame, relations: DataFrame, k: int = 150) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the first k relations in (src, type, tgt) order."""
    edges = relations.orderBy("src", "type", "tgt").limit(k)
    ids = edges.select(F.explode(F.array("src", "tgt")).alias("id")).distinct()
    nodes = entities.join(ids, "id", "left_semi").select("id", F.col("name").alias("label"), F.coalesce("type", F.lit("CONCEPT")).alias("type"), F.coalesce("description", F.lit("")).alias("desc"), F.coalesce("mentions", F.lit(1).cast("long")).alias("mentions"))
    return nodes, edges.select(F.col("src").alias("from"), F.col("tgt").alias("to"), F.col("type").alias("label"), F.coalesce("description", F.lit("")).alias("desc"))


def neighbourhood(relations: DataFrame, entities: DataFrame, node: str) -> DataFrame:
    """Relations at a node: direction, type and the name of the other end (its id where it has none)."""
    near = incidence(relations.where((F.col("src") == node) | (F.col("tgt") == node))).where(F.col("id") == node)
    names = entities.select(F.col("id").alias("other"), "name")
    return near.join(names, "other", "left").select("other", F.coalesce("name", "other").alias("name"), "type", "out")


def visible(nodes: DataFrame, query: str = "", types: list[str] | None = None) -> DataFrame:
    """Nodes whose label or description contains the query, of the given types."""
    q = F.lit(query.strip().lower())
    out = nodes.where(F.contains(F.lower("label"), q) | F.contains(F.lower("desc"), q)) if query.strip() else nodes
    return out.where(F.col("type").isin(types)) if types is not None else out


#: Named queries over the temporary views documents, chunks, entities, mentions and relations.
CATALOGUE = {
    "relations": "SELECT s.name AS source, r.type AS relation, t.name AS target FROM relations r JOIN entities s ON r.src = s.id JOIN entities t ON r.tgt = t.id ORDER BY r.src, r.type, r.tgt LIMIT 100",
    "provenance": "SELECT d.filename, m.chunk_id, e.name FROM documents d JOIN chunks c ON c.doc_hash = d.file_hash JOIN mentions m ON m.chunk_id = c.id JOIN entities e ON e.id = m.entity_id",
    "most_mentioned": "SELECT name, type, mentions FROM entities ORDER BY mentions DESC, id LIMIT 10",
}


def run_sql(spark: SparkSession, tables: dict[str, DataFrame], query: str, params: dict | None = None) -> DataFrame:
    """A named or literal SQL query over the graph tables, with named parameters. The caller's views of the same names are as before afterwards."""
    before = {name: spark.table(name) for name in tables if any(t.isTemporary and t.name == name for t in spark.catalog.listTables())}
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    try:
        return spark.sql(CATALOGUE.get(query, query), args=params or {})  # names are resolved here
    finally:
        for name in tables:
            if name in before:
                before[name].createOrReplaceTempView(name)
            else:
                spark.catalog.dropTempView(name)
