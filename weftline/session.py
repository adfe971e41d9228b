"""Sessions and tables."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def local_session(cores: str = "8", memory: str = "8g", **conf: str) -> SparkSession:
    """A session for one machine; on a cluster, make your own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("weftline")
    settings = {"spark.sql.shuffle.partitions": cores, "spark.driver.memory": memory, "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", **conf}
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def workers_find_us(spark: SparkSession) -> None:
    """Let Python workers import this package where they see the same file system; elsewhere install it."""
    here = str(Path(__file__).resolve().parents[1])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if here not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (known, here) if x)


#: Rows of a batch that become Python objects at a time.
SLICE = 64


def slices(batch):
    """An Arrow batch in pieces of SLICE rows: what a worker makes of rows is then bounded, however many a batch has."""
    return (batch.slice(at, SLICE) for at in range(0, batch.num_rows, SLICE))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders of local applications whose session names none.
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, one machine has a folder of its own; a cluster has none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            import tempfile

            _OWN[app] = tempfile.mkdtemp(prefix="shared")
        found = _OWN[app]
    return found.rstrip("/")


#: Spark's own switch to delete the shuffle files of a query that has ended.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage by a table in the shared folder, which is computed once (checkpoint() would run the plan twice).

    The shuffle files behind the table go as soon as it is written: it needs them no more.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEAN_UP)
        else:
            spark.conf.set(_CLEAN_UP, before)
    made = spark.read.schema(df.schema).parquet(path)
    made._weftline_table = path
    return made


def release(*tables: DataFrame) -> None:
    """Delete tables that checkpointed() made. Nothing that is still to be computed may read them."""
    for made in tables:
        spark = made.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(made._weftline_table)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
