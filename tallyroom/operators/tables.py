"""Tables written on the way, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one only in local mode, an error elsewhere."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return (named or f"file://{tempfile.gettempdir()}/tallyroom-tables").rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder and read from there."""
    path = f"{shared_folder(df.sparkSession)}/tallyroom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts_for(rows: DataFrame, each: int = 500_000) -> int:
    """How many partitions give each about ``each`` rows, no fewer than there are cores; of a Parquet table only the footers are read.

    Partitions of a number that is asked for are not put together again, so what a task holds does not grow with the table.
    """
    return max(-(-rows.count() // each), rows.sparkSession.sparkContext.defaultParallelism)


def stated_list(rows: DataFrame, most: int = 10_000) -> DataFrame:
    """A list that someone states, such as queries, to be met with all rows of a table: written, and sent to them if it has at most ``most`` rows.

    A longer one is met block by block, which Spark's product of partitions does.
    """
    table = saved(rows)
    return F.broadcast(table) if table.count() <= most else table
