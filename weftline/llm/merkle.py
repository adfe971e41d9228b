"""Merkle manifest of a table: a tree of runs of three per source, and one over the sources.

A leaf's digest is an expression of its row, so texts don't move. Leaves are numbered per
source by ranges, and lie in aligned buckets of 3 ** DEPTH: executors give each Arrow batch
of whole buckets to DuckDB, whose level queries (ordered string_agg, sha256) make a
bucket's root and each leaf's proof in it. The roots of a source's buckets are the nodes of
a smaller forest of the same kind, and so on; Spark joins the proofs of these outer levels.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, checkpointed, release, with_class

#: Nodes of a run, and levels of a bucket.
ARITY, DEPTH = 3, 7
#: DuckDB gets whole buckets of so many rows together, and one bucket at least.
BATCH_ROWS = 30_000
#: Rows of a range of the numbering, of a partition of buckets; outer proofs are broadcast up to so many bytes, and joined by bucket beyond.
RANGE_ROWS, BROADCAST_BYTES = 50_000, 4 << 20


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts in a row."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value as leaves hold it: `-` for null, else its UTF-8 bytes' number, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


#: Level l of a forest of buckets: runs of the nodes below, and what they give to each leaf. `levels`: how many levels a bucket has.
_LEVEL = """
CREATE OR REPLACE TEMP TABLE runs AS
  SELECT b, p // {arity} AS p, string_agg(h, '' ORDER BY p) AS run FROM nodes WHERE levels > {level} GROUP BY b, p // {arity};
CREATE OR REPLACE TEMP TABLE leaves AS
  SELECT l.b, l.i, l.levels, l.p // {arity} AS p,
    l.proof || coalesce(left(run, 64 * (l.p % {arity})) || substr(run, 64 * (l.p % {arity}) + 65), '') AS proof,
    CASE WHEN run IS NULL THEN l.fold ELSE sha256(left(run, 64 * (l.p % {arity})) || l.fold || substr(run, 64 * (l.p % {arity}) + 65)) END AS fold
  FROM leaves l LEFT JOIN runs r ON l.b = r.b AND l.p // {arity} = r.p AND l.levels > {level};
CREATE OR REPLACE TEMP TABLE nodes AS
  SELECT r.b, r.p, sha256(r.run) AS h, t.levels FROM runs r JOIN tops t ON r.b = t.b
  UNION ALL SELECT b, p, h, levels FROM nodes WHERE levels <= {level};
"""


def block_engine():
    """A function of a table (b, p, levels, h, fold: of leaves in whole buckets) that gives root, proof and fold of each leaf, in order."""
    import duckdb

    db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})

    def run(rows: pa.Table) -> pa.Table:
        db.register("given", rows)
        db.execute("CREATE OR REPLACE TEMP TABLE nodes AS SELECT b, p, h, levels FROM given")
        db.execute("CREATE OR REPLACE TEMP TABLE tops AS SELECT b, max(levels) AS levels FROM given GROUP BY b")
        db.execute("CREATE OR REPLACE TEMP TABLE leaves AS SELECT b, i, levels, p, '' AS proof, fold FROM given")
        db.unregister("given")
        for level in range(db.execute("SELECT coalesce(max(levels), 0) FROM tops").fetchall()[0][0]):
            db.execute(_LEVEL.format(arity=ARITY, level=level))
        return db.sql("SELECT n.h AS root, l.proof, l.fold FROM leaves l JOIN nodes n USING (b) ORDER BY l.i").to_arrow_table()

    return run


def numbered(rows: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """`rows` (a table that is read again as it is) with `at`, 0, 1, ... per key in the order of `order`, and `of`, the key's number of rows.

    Rows are dealt by ranges of key and order; the counts of the ranges give each its first
    number. A key may fill many ranges, so no task gets it whole.
    """
    spread = rows.withColumn("_any", F.monotonically_increasing_id())  # equal rows may part
    ranged = spread.repartitionByRange(-(-n // RANGE_ROWS) or 1, key, *order, "_any").sortWithinPartitions(key, *order).drop("_any")
    place = F.monotonically_increasing_id()
    held = checkpointed(ranged.withColumn("_range", F.shiftright(place, 33)).withColumn("_place", place.bitwiseAND(F.lit((1 << 33) - 1))))
    counts = held.groupBy(key, "_range").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    of_key = Window.partitionBy(key)  # a row for each range of a key
    counts = counts.select(key, "_range", "_first", (F.sum("_n").over(of_key.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_below"), F.sum("_n").over(of_key).alias("of"))
    made = held.join(counts, [key, "_range"]).select(*rows.columns, (F.col("_place") - F.col("_first") + F.col("_below")).alias("at"), "of")
    made._under = held
    return made


def _levels(n: Column) -> Column:
    """How many levels a forest of n nodes has: until one is left."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(40)), F.lit(0), lambda acc, k: F.when(F.pow(F.lit(float(ARITY)), k - 1) < n, k).otherwise(acc))


def _buckets(nodes: DataFrame, rest: list[str], depth: int, n: int) -> DataFrame:
    """Nodes (key, at, of, h, fold, rest) through the block engine: (key, bucket, of, rest, root, proof, fold), a checkpointed table."""
    width = ARITY**depth
    placed = nodes.select(
        "key", F.expr(f"at div {width}").alias("bucket"), "of", (F.col("at") % width).cast("int").alias("p"),
        F.least(_levels(F.col("of")), F.lit(depth)).alias("levels"), "h", "fold", *rest,
    )
    dealt = placed.repartition(-(-n // RANGE_ROWS) or 1, "key", "bucket").sortWithinPartitions("key", "bucket", "p")
    out = dealt.select("key", "bucket", "of", *rest, *[F.lit(None).cast("string").alias(c) for c in ("root", "proof", "fold")]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine, held, count = block_engine(), [], 0

        def told(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            keys, buckets = rows.column("key").to_pylist(), rows.column("bucket").to_pylist()
            b, last, k = [], None, -1
            for pair in zip(keys, buckets):
                k += pair != last
                last = pair
                b.append(k)
            given = pa.table({"b": pa.array(b, pa.int64()), "i": pa.array(range(len(b)), pa.int64()), **{c: rows.column(c) for c in ("p", "levels", "h", "fold")}})
            made = engine(given)
            columns = [rows.column(c) for c in ("key", "bucket", "of", *rest)] + [made.column(c).cast(pa.string()) for c in ("root", "proof", "fold")]
            yield from pa.table(columns, names=out.names).to_batches(max_chunksize=4000)

        for batch in batches:
            # rows are sorted, so a bucket ends where the next begins; only whole buckets go on
            part = pa.Table.from_batches([batch])
            held.append(part)
            count += part.num_rows
            if count >= BATCH_ROWS:
                every = pa.concat_tables(held).combine_chunks()
                keys, buckets = every.column("key").to_pylist(), every.column("bucket").to_pylist()
                cut = count
                while cut and (keys[cut - 1], buckets[cut - 1]) == (keys[-1], buckets[-1]):
                    cut -= 1
                if cut:
                    yield from told(every.slice(0, cut))
                held, count = [every.slice(cut)], count - cut
        if count:
            yield from told(pa.concat_tables(held).combine_chunks())

    return checkpointed(dealt.mapInArrow(run, out))


def _forest(nodes: DataFrame, rest: list[str], depth: int, n: int) -> DataFrame:
    """Nodes (key, at, of, h, fold, rest) with the root of their key: (key, rest, root, proof, fold).

    While a key has more than one bucket, the buckets' roots are nodes of the next round. Each
    round has a bucket's width fewer rows.
    """
    inner = _buckets(nodes, rest, depth, n)
    width = ARITY**depth
    if inner.agg(F.max("of")).first()[0] is None or inner.where(F.col("of") > width).limit(1).count() == 0:
        return inner.drop("bucket", "of")
    roots = inner.groupBy("key", "bucket").agg(F.min("root").alias("h"), F.min(F.expr(f"(of + {width - 1}) div {width}")).alias("of"))
    tops = roots.select("key", F.col("bucket").alias("at"), "of", "h", F.lit("").alias("fold"), F.col("bucket").alias("_bucket"))
    count = int(roots.count())
    # folds of leaves go on from their bucket's fold: outer levels give siblings left and right
    outer = _sides(tops, depth, count)
    size = outer.agg(F.sum(F.octet_length("key") + F.octet_length("root") + F.size("sides") * 140).cast("long")).first()[0] or 0
    outer = outer.select("key", F.col("_bucket").alias("bucket"), F.col("root").alias("_root"), "sides")
    if size <= BROADCAST_BYTES:
        outer = F.broadcast(outer)  # its size has just been measured
    both = inner.join(outer, ["key", "bucket"])
    proof = F.concat("proof", F.aggregate("sides", F.lit(""), lambda acc, s: F.concat(acc, s["left"], s["right"])))
    fold = F.aggregate("sides", F.col("fold"), lambda acc, s: digest(s["left"], acc, s["right"]))
    return both.select("key", *rest, F.col("_root").alias("root"), proof.alias("proof"), fold.alias("fold"))


def _sides(nodes: DataFrame, depth: int, n: int) -> DataFrame:
    """(key, _bucket, root, sides) of nodes (key, at, of, h, fold, _bucket): siblings left and right of each level's run, from the node up.

    A marker as fold would be hashed; so the sides are read off the proof, whose runs are known
    from the node's place: `at` and `of` tell how many siblings stand on either side.
    """
    told = _forest(nodes.withColumn("_at", F.col("at")).withColumn("_of", F.col("of")), ["_bucket", "_at", "_of"], depth, n)
    level = F.sequence(F.lit(0), _levels(F.col("_of")) - 1)
    power = lambda k: F.pow(F.lit(float(ARITY)), k).cast("long")
    at = lambda k: F.floor(F.col("_at") / power(k))  # noqa: E731  place of the node's ancestor at level k
    last = lambda k: F.ceil(F.col("_of") / power(k)) - 1  # noqa: E731  last place at level k
    before = lambda k: (at(k) % ARITY).cast("int")
    after = lambda k: F.least(F.lit(ARITY - 1) - before(k), last(k) - at(k)).cast("int")
    counts = F.transform(level, lambda k: F.struct(before(k).alias("l"), after(k).alias("r")))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<left:string,right:string>>").alias("out"))

    def cut(acc, c):
        left = F.substring(F.col("proof"), acc["at"], c["l"] * 64)
        right = F.substring(F.col("proof"), acc["at"] + c["l"] * 64, c["r"] * 64)
        return F.struct((acc["at"] + (c["l"] + c["r"]) * 64).alias("at"), F.array_append(acc["out"], F.struct(left.alias("left"), right.alias("right"))).alias("out"))

    sides = F.when(F.col("_of") > 1, F.aggregate(counts, start, cut)["out"]).otherwise(start["out"])
    return told.select("key", "_bucket", "root", sides.alias("sides"))


def manifest(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tampered: Column | None = None, altered: dict[str, Column] | None = None, depth: int = DEPTH) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified), one row per row of `docs`.

    `fields` make a leaf. `altered` maps fields to what they have become where `tampered`
    holds; folded_root is made of that leaf and the original siblings. Nulls are `-`, also a
    null source, which is a source of its own and comes first; a null id comes before all
    others. Rows of one id and source are ordered by their leaves, equal rows count each.
    Texts are hashed whole where they lie. An empty table gives none. Other columns aren't
    read, whatever their names.

    Data movement: digests only, by ranges of source and id, then by bucket.
    """
    bound_batches(docs.sparkSession)
    leaf = digest(*[field(F.col(c)) for c in fields])
    changed = digest(*[field((altered or {}).get(c, F.col(c))) for c in fields])
    # the first character tells null from text, so keys sort as bytes with null first
    key = F.coalesce(F.concat(F.lit("1"), F.col(source_col).cast("string")), F.lit("0"))
    fold = F.when(tampered, changed) if tampered is not None else F.lit(None).cast("string")
    leaves = checkpointed(docs.select(key.alias("key"), F.col(id_col).alias("id"), leaf.alias("h"), fold.alias("_changed")))
    n = leaves.count()
    places = numbered(leaves, "key", ["id", "h"], n)
    nodes = places.withColumn("fold", F.coalesce("_changed", "h")).select("key", "at", "of", "h", "fold", "id")
    # the leaf goes along as its own column: h is what the engine hashes
    of_source = checkpointed(_forest(nodes.withColumn("leaf", F.col("h")), ["id", "leaf"], depth, n))
    release(leaves, places._under)
    subroots = checkpointed(of_source.groupBy("key").agg(F.min("root").alias("h"), F.count(F.lit(1)).alias("n")))
    count = subroots.count()
    tops = numbered(subroots.select(F.lit("").alias("key"), F.col("key").alias("source"), "h"), "key", ["source"], count)
    outer = _sides(tops.select("key", "at", "of", "h", F.lit("").alias("fold"), F.col("source").alias("_bucket")), depth, count)
    outer = outer.select(F.col("_bucket").alias("key"), F.col("root").alias("_top"), "sides").join(subroots.select("key", "n"), "key")
    both = with_class(of_source, outer, ["key"], "n")
    proof = F.concat("proof", F.aggregate("sides", F.lit(""), lambda acc, s: F.concat(acc, s["left"], s["right"])))
    folded = F.aggregate("sides", F.col("fold"), lambda acc, s: digest(s["left"], acc, s["right"]))
    # a generator keeps the folded digest from being made twice
    made = both.select("id", "leaf", F.col("root").alias("subroot"), F.col("_top").alias("root"), F.sha2(proof, 256).alias("proof_sha256"), F.explode(F.array(folded)).alias("folded_root"))
    return made.select(F.col("id").alias(id_col), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
