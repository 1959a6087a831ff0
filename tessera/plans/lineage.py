"""Cutting lineage of iterative jobs in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


_OPEN: list[list[str]] = []


def noted(path: str) -> str:
    """Says that a table is being written there, to the innermost scratch() there is."""
    if _OPEN:
        _OPEN[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes at its end the tables that were written on the way: for whoever has all that he wants from them by then.

    Gives the list of their folders; what is taken out of it stays. Without it tables stay until the shared folder is cleared.
    """
    made: list[str] = []
    _OPEN.append(made)
    try:
        yield made
    finally:
        _OPEN.remove(made)
        for folder in made:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def new_folder(spark: SparkSession) -> str:
    """A name in the shared folder; a local session without spark.checkpoint.dir gets a folder of its own."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/cut-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back."""
    spark, path = df.sparkSession, noted(new_folder(df.sparkSession))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_ranges(df: DataFrame, *order: str) -> DataFrame:
    """df with a column range: all rows of a lower range come before those of a higher one. It is written once, so that ranges stay as they are."""
    return checkpointed(df.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))


def _lower(held: DataFrame, size: Column) -> DataFrame:
    """For each range the sum over the ranges before it: a row a range."""
    before = F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    return held.groupBy("__range").agg(size.alias("n")).select("__range", F.coalesce(before, F.lit(0)).alias("__lower"))


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with each row's place, from 0, in the order of some columns.

    Rows are dealt to ranges, sorted there and written once; a place is that within the range and the number of rows in lower
    ranges, so no task sees more than its range. Planning the ranges reads df once more: save it first where it is dear.
    """
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # Spark counts a partition's rows in the low 33 bits
    held = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__range": F.spark_partition_id(), "__within": within}))
    lower = _lower(held, F.count("*"))
    return held.join(F.broadcast(lower), "__range").select(*df.columns, (F.col("__lower") + F.col("__within")).alias(name))


def cumulated(df: DataFrame, weight: str, name: str, *order: str) -> DataFrame:
    """df with the sum of weight over all rows before each, in the order of some columns that tell rows apart; dealt as in numbered()."""
    held = checkpointed(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    lower = _lower(held, F.sum(weight))
    within = F.sum(weight).over(Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return held.withColumn("__within", F.coalesce(within, F.lit(0))).join(F.broadcast(lower), "__range").select(*df.columns, (F.col("__lower") + F.col("__within")).alias(name))
