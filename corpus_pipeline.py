"""From `documents` to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the docs of the next. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontaminate, jaccard_join, packing, secret_scan, toxicity
from weftline.llm.common import checkpointed, fresh, release, table
from weftline.llm.queries import tokenizer_path


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier predicts as toxic go; it learns from the labels of the training fold."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    name = fresh(docs, "toxicity")
    return toxicity.add_score(docs, model, name=name).where(F.col(f"{name}.predicted") == 0).select(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: that with the smallest id. Texts without words stay."""
    return jaccard_join.representatives(docs).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark items cover by a twentieth of their words go."""
    name = fresh(docs, "overlap")
    found = decontaminate.find_overlaps(docs, table(spark, sf_dir, "benchmark"), name=name)
    return found.where(~decontaminate.contaminated(name)).select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets that few owners hold are masked in the text, length for length; all documents stay."""
    return secret_scan.mask(docs).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in its training sequence, with its ids."""
    return packing.pack(docs, tokenizer_path(spark), with_ids=True)


STAGES = [
    ("toxicity", clean),
    ("near_duplicates", distinct),
    ("decontamination", decontaminated),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: A classifier, similarity joins and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. Between two the rows lie as Parquet in the shared folder of the cluster, until the next has been written."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        made = checkpointed(stage(spark, docs, sf_dir))
        if k:
            release(docs)
        docs = made
    return docs
