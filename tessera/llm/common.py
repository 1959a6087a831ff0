"""What the operators share: tables, and cutting lineage in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.lineage import noted

BROADCAST_ROWS = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of the data folder, with only the columns asked for (all, if none)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, where it is set.

    Only a local session without that setting gets a folder of its own, as in tests.
    """
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="tessera-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: a cut of the lineage that outlives executors."""
    spark = df.sparkSession
    path = noted(new_folder(spark, name))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_saved(*tables: DataFrame) -> None:
    """Deletes the files of tables that save() returned, once nothing reads them any more."""
    spark = tables[0].sparkSession
    for folder in {f.rsplit("/", 1)[0] for df in tables for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def beside(saved: DataFrame) -> DataFrame:
    """A saved table as the side of a join: broadcast if it has few rows (of a few numbers each), otherwise left to the planner.

    Without the hint both sides are shuffled before the planner learns how small one is.
    """
    return F.broadcast(saved) if saved.count() <= BROADCAST_ROWS else saved


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def apart(df: DataFrame, *values: Column) -> DataFrame:
    """df's rows as one column, row, beside values: no name of df's can clash with one used on the way."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), *values)


def together(df: DataFrame, columns: list[str], *added: str) -> DataFrame:
    """The columns of row and the columns added, which replace those of their names."""
    return df.select(*(F.col(f"row.`{c}`").alias(c) for c in columns if c not in added), *added)


def sums_of(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The sum of values from each place in at to the next, as double. It does not depend on what else is in values."""
    out = np.zeros((len(at) - 1, *values.shape[1:]))
    some = np.flatnonzero(np.diff(at))
    if len(some):
        out[some] = np.add.reduceat(values, at[:-1][some], axis=0, dtype=np.float64)
    return out
