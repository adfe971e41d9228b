"""CSV readers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from weftline.operators.features import numbered

#: Columns of the tabular examples, in file order.
SCHEMAS = {
    "homeprices": "area INT, price INT",
    "areas": "area INT",
    "income": "year INT, income DOUBLE",
    "homeprices3": "area INT, bedrooms INT, age INT, price INT",
    "hiring": "experience STRING, test_score INT, interview_score INT, salary INT",
    "housing": "price INT, area INT, bedrooms INT, bathrooms INT, stories INT, mainroad STRING, guestroom STRING, basement STRING, hotwaterheating STRING, airconditioning STRING, parking INT, prefarea STRING, furnishingstatus STRING",
    "iris": "sepal_length DOUBLE, sepal_width DOUBLE, petal_length DOUBLE, petal_width DOUBLE, variety STRING",
}


def read_csv(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """With a schema, columns are taken by place, which also mends damaged header names. Without one, types are inferred."""
    reader = spark.read.option("header", True).option("enforceSchema", True)
    return reader.schema(SCHEMAS.get(schema, schema) if isinstance(schema, str) else schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def write_csv(df: DataFrame, path: str, *, index_by: str | None = None) -> None:
    """CSV with a header; `index_by` puts 0, 1, 2, ... in the order of that numeric column in front."""
    if index_by:
        made = numbered(df, index_by, name="index")
        df = made.select("index", *df.columns).repartitionByRange("index").sortWithinPartitions("index")
    df.write.mode("overwrite").option("header", True).csv(path)
