"""Document fingerprints: a canonical exact digest.

The canonical form is NFKC, case-folded, white space folded to single spaces and
trimmed; its fingerprint is the 128-bit xxhash. Equal fingerprints name a bucket;
inside a bucket canonical bytes decide. The likeness of two fingerprints of an
exact digest is 1 or 0.
"""

from __future__ import annotations

import hashlib
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, bound_batches, checkpointed, fresh, shards_for, text_bytes, with_class


def canonical(text: str | None) -> bytes:
    """NFKC, case folding (and NFKC again, which folding may undo), white space runs to one space."""
    if not text:
        return b""
    if text.isascii():
        return " ".join(text.lower().split()).encode()
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode("utf-8", "surrogatepass")


def digest(canon: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(canon)


def add_fingerprint(docs: DataFrame, *, text_col: str = "text", name: str = "print") -> DataFrame:
    """`docs` with a struct column `name` (fingerprint, n_chars); a null text counts as empty. A narrow map."""
    bound_batches(docs.sparkSession)
    kind = T.StructType([T.StructField("fingerprint", T.StringType()), T.StructField("n_chars", T.LongType())])

    def make():
        def one(column):
            texts = [t or "" for t in column.to_pylist()]
            return pa.StructArray.from_arrays([pa.array([digest(canonical(t)) for t in texts], pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["fingerprint", "n_chars"])

        return one

    return annotate(docs, text_col, make, kind, fresh(docs, name))


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, fingerprint, group_id (smallest id with equal canonical bytes).

    Fingerprints select buckets (small rows, combined before the shuffle). Only the
    members of buckets of two or more are compared: the canonical bytes of the
    bucket's leader, compressed, are joined to its members (large buckets by broadcast), and
    members whose bytes differ are grouped again by their full SHA-256. Null and empty
    texts are equal; rows that repeat an id keep a row each; null ids keep a null group; an
    empty table gives none. Only the two named columns are read.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    every = checkpointed(add_fingerprint(texts, name="p").select("id", F.col("p.fingerprint").alias("fingerprint")))
    printed = every.where("id is not null")
    leaders = printed.groupBy("fingerprint").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("n"))
    kind = T.StructType([T.StructField("canon", T.BinaryType()), T.StructField("mark", T.StringType())])

    def make():
        def one(column):
            canons = [canonical(t) for t in column.to_pylist()]
            packed = [zstandard.compress(c, 1) for c in canons]  # equal bytes pack alike
            return pa.StructArray.from_arrays([pa.array(packed, pa.binary()), pa.array([digest(c) for c in canons], pa.string())], names=["canon", "mark"])

        return one

    sized = with_class(printed, leaders.withColumn("m", F.col("n")), ["fingerprint"], "n")
    ids = sized.where("m > 1").select("id").distinct()
    shared = annotate(texts.join(ids, "id", "left_semi"), "text", make, kind, "c").select("id", F.col("c.mark").alias("fingerprint"), F.col("c.canon").alias("canon"))
    many = checkpointed(shared)
    # the least id's bytes stand for a bucket, combined before the shuffle; rows that only share an id with a bucket are alone in theirs
    heads = many.groupBy("fingerprint").agg(F.min("id").alias("leader"), F.min_by("canon", F.struct("id", "canon")).alias("head"), F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")
    compared = with_class(many, heads, ["fingerprint"], "n_rows").where("leader is not null")
    same = compared.where(F.col("canon") == F.col("head")).select("id", "fingerprint", F.col("leader").alias("group_id"))
    differ = compared.where(~F.coalesce(F.col("canon") == F.col("head"), F.lit(False))).select("id", "fingerprint", F.sha2("canon", 256).alias("sha"))
    split = differ.withColumn("group_id", F.min("id").over(Window.partitionBy("fingerprint", "sha"))).drop("sha")
    alone = sized.where("m = 1").select("id", "fingerprint", F.col("id").alias("group_id"))
    nameless = every.where("id is null").select("id", "fingerprint", F.lit(None).cast(texts.schema["id"].dataType).alias("group_id"))
    return alone.unionByName(same).unionByName(split).unionByName(nameless).withColumnRenamed("id", id_col)


_OUT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
    T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
    T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()),
])

#: Bytes of text in one range of consecutive ids. Ranges are sorted with spilling and read in order, so their size costs no memory.
RANGE_BYTES = 8 << 20

#: Bounds of ranges come from one sketch, which holds so many; with more text than that many ranges hold, ranges are longer.
MOST_RANGES = 20_000


def compare_with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", edit_part: int = 4) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness (see the module).

    The edited text has the last floor(n/edit_part) code points replaced by as many
    of the next document's first (all, if it has fewer). Next means ascending id;
    equal ids go by text, null ids first; after the last comes the first. A lone
    document is its own next. Texts move once: rows go to ranges of ids, and the
    first row of each range goes to the range before it as well.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = min(MOST_RANGES, shards_for(text_bytes(base, "text"), RANGE_BYTES))
    probs = F.array(*[F.lit(i / n) for i in range(1, n)])
    cuts = sorted(set(base.select(F.percentile_approx("id", probs, 10 * n)).first()[0] or [])) if n > 1 else []
    shared = spark.sparkContext.broadcast(np.array(cuts, np.int64))  # MOST_RANGES numbers at most

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        known = ids.notna()
        found = np.searchsorted(shared.value, ids.where(known, 0).astype("int64"), side="right")
        return pd.Series(np.where(known, found, 0).astype("int32"))

    # ids alone pass through Python; a null id belongs to the first range
    placed = base.withColumn("at", range_of("id")) if cuts else base.withColumn("at", F.lit(0))
    ends = placed.groupBy("at").agg(F.min(F.struct(F.col("id").isNotNull().alias("has"), "id")).alias("low")).orderBy("at").collect()
    # one row a range: bounded by the number of ranges
    ranges = [r["at"] for r in ends]
    before = {at: ranges[i - 1] for i, at in enumerate(ranges)}
    if not ranges:
        return spark.createDataFrame([], _OUT)
    route = spark.createDataFrame([(r["at"], before[r["at"]], bool(r["low"]["has"]), r["low"]["id"], i == 0) for i, r in enumerate(ends)], "at int, back int, has boolean, low long, wraps boolean")
    joined = placed.join(F.broadcast(route), "at")  # one small row a range
    heads = F.col("id").eqNullSafe(F.col("low"))
    copies = F.when(heads, F.array(F.struct(F.col("at").alias("to"), F.lit(0).alias("guest")), F.struct(F.col("back").alias("to"), F.lit(1).alias("guest")))).otherwise(F.array(F.struct(F.col("at").alias("to"), F.lit(0).alias("guest"))))
    dealt = joined.select("id", "text", F.explode(copies).alias("c")).select(F.col("c.to").alias("to"), F.col("c.guest").alias("guest"), "id", "text")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * n)
    sorted_ = dealt.repartition(parts, "to").sortWithinPartitions("to", "guest", F.col("id").asc_nulls_first(), "text")

    def run(batches):
        def flush(rows):
            cols = list(zip(*rows)) if rows else [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], names=_OUT.names)

        rows, last, done = [], None, None

        def emit(prev, nxt):
            _, doc_id, text, canon, mark = prev
            ncanon, nmark, ntext = nxt
            k = len(text) // edit_part
            edited = text[: len(text) - k] + ntext[:k] if k else text
            ecanon = canonical(edited)
            emark = digest(ecanon)
            rows.append((doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), mark, emark, float(emark == mark and ecanon == canon), float(nmark == mark and ncanon == canon)))

        for batch in batches:
            for to, guest, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                if guest and done == to:
                    continue  # a later row of the next range's head group
                canon = canonical(text)
                mark = digest(canon)
                if last is not None and last[0] == to:
                    emit(last, (canon, mark, text))
                    last = None
                if guest:
                    done = to
                else:
                    last = (to, doc_id, text, canon, mark)
            if rows:
                yield flush(rows)
                rows = []

    return sorted_.mapInArrow(run, _OUT)
