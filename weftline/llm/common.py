"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.session import checkpointed, release, shared_folder  # noqa: F401  the operators take them from here

#: Rows are handed to Python code in slices of about this many text bytes.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that no column of `df` has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for long texts (a user's own setting stays), and let Python workers find this package."""
    here = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if here not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (known, here) if x)
    for key, value, default in (
        ("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20), "67108864b"),
        ("spark.sql.execution.arrow.maxRecordsPerBatch", "4000", "10000"),
    ):
        if spark.conf.get(key, default) in (default, default.rstrip("b")):
            spark.conf.set(key, value)


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; a null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b or b"" for b in column.cast(kind).to_pylist()]


def slices(batch: pa.RecordBatch, index: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each slice has about `most` bytes of the column at `index` (one row at least)."""
    import pyarrow.compute as pc

    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(index)), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    yield batch.slice(start)


def annotate(df: DataFrame, text_col: str, make: Callable[[], Callable[[pa.Array], pa.StructArray]], kind: T.StructType, name: str) -> DataFrame:
    """`df` with one struct column more, made from the text column alone in Arrow batches.

    `make` is called once a task and returns the function of a text array. All
    other columns pass through, so a filter on the new column needs no join.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(name, kind)])
    index = df.columns.index(text_col)

    def run(batches):
        fn = make()
        for batch in batches:
            for part in slices(batch, index):
                made = fn(part.column(index))
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*part.schema.names, name])

    return df.mapInArrow(run, schema)


def text_bytes(df: DataFrame, text_col: str) -> int:
    """UTF-8 bytes of a text column, over all rows."""
    return df.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0


def shards_for(n_bytes: int, each: int, least: int = 1) -> int:
    """How many shards of about `each` bytes: grows with the input, without a cap."""
    return max(least, -(-n_bytes // each))


#: A class is large if it holds more than one in so many of all rows, so fewer than so many classes are.
LARGE_SHARE = 1000


def with_class(rows: DataFrame, classes: DataFrame, keys: list[str], count: str) -> DataFrame:
    """`rows` left-joined with `classes` (keys, count, ...) on keys, though a few classes may hold most rows.

    Classes with more than a LARGE_SHARE-th of all rows, of which there are fewer than
    LARGE_SHARE, are broadcast; no other can fill a task.
    """
    large = F.col(count) * LARGE_SHARE > F.lit(rows.count())
    told = [c for c in classes.columns if c not in keys and c != count]
    few, most = (classes.where(x).select(*keys, F.struct(*told).alias("_of")) for x in (large, ~large))
    marked = rows.join(F.broadcast(few), keys, "left")  # fewer than LARGE_SHARE rows
    rest = marked.where("_of is null").drop("_of").join(most, keys, "left")
    return marked.where("_of is not null").unionByName(rest).select(*rows.columns, *[F.col(f"_of.{c}").alias(c) for c in told])
