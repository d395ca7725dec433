"""Intermediate tables in the folder that the whole cluster shares: they cut lineage, so that a lost executor costs a re-read only."""

from __future__ import annotations

import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

#: Rows that cross to a Python worker at once while a table is written; Spark bounds the bytes of a batch besides.
ROWS_PER_BATCH = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a folder below the warehouse.

    On a cluster a warehouse on local disks is refused: executors would not see each other's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if machine_local(spark.sparkContext.master, warehouse):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that the cluster shares; {warehouse} is on each machine's own disk")
        folder = f"{warehouse}/checkpoints"
    return folder.rstrip("/")


def machine_local(master: str, folder: str) -> bool:
    """Whether executors of other machines would miss what is written to the folder."""
    return not (master == "local" or master.startswith("local[")) and urlparse(folder).scheme in ("", "file")


def scratch(spark: SparkSession, name: str = "table") -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/corpusloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written as Parquet and read back: what it holds is settled. The session's batch size is as before afterwards."""
    spark = df.sparkSession
    path, before = scratch(spark, name), spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(int(before), ROWS_PER_BATCH) if int(before) > 0 else ROWS_PER_BATCH))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete the files of tables that ``written`` returned and nothing reads any more."""
    for table in tables:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
