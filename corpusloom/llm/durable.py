"""What the operators of this subpackage use of the shared store."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..sources.store import release, written

__all__ = ["durable", "read_table", "release", "with_columns"]


def durable(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below the shared folder and read back."""
    return written(df, name)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_columns(docs: DataFrame, text: str, fields: list[T.StructField], of: Callable[[pa.Array], Iterator[tuple[int, int, list[pa.Array]]]]) -> tuple[DataFrame, list[str]]:
    """``docs`` with columns made from a text column, and their names, which no column of ``docs`` has.

    ``of`` takes a batch's texts and gives (first row, row after the last, values of each field) part by part. No row
    moves to another task.
    """
    names = [f.name for f in fields]
    while set(names) & set(docs.columns):
        names = [f"_{n}" for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, made in of(batch.column(text).cast(pa.string())):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(n, f.dataType) for n, f in zip(names, fields))])), names
