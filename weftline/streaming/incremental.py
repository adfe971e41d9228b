"""Incremental ingest: documents that arrive as files go into the graph store, batch by batch."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from weftline.operators.graph_store import GraphStore
from weftline.sources.pages import chunk_documents


def ingest_stream(spark: SparkSession, source: str, schema: StructType | str, store: str, checkpoint: str, *, extractor=None, text_col: str = "text", name_col: str = "doc_id", files_per_batch: int = 16) -> StreamingQuery:
    """Read Parquet files as they come, and upsert each batch once.

    A batch that runs again after a failure writes over its own former files, and one
    that the store holds whole changes nothing; a document that is in the store already
    is left out by its content hash.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        chunks = chunk_documents(batch.dropDuplicates([text_col]), text_col=text_col, name_col=name_col)
        GraphStore(spark, store).ingest(chunks, extractor, run_id=f"batch-{number}", at=str(datetime(2000, 1, 1) + timedelta(seconds=number)))

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
