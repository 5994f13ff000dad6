"""Access to the input tables and to the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, read lazily so that filters and columns reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where the session names none and is of one machine (tests)."""
    context = spark.sparkContext
    found = context.getCheckpointDir()
    if not found:
        if not spark.conf.get("spark.checkpoint.dir", None) and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="tidewell-"))
        found = context.getCheckpointDir()
    return found


#: Whether Spark drops a query's shuffle files as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    The result has a short lineage and known statistics, and survives the loss of any executor. Shuffle files of the
    write are dropped when it has ended: the table stands for them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


#: Rows, and numbers in their arrays, up to which a counted table is broadcast.
BROADCAST_ROWS, BROADCAST_NUMBERS = 200_000, 2_000_000


def broadcast_if_small(df: DataFrame, numbers: Column | None = None) -> DataFrame:
    """``df``, a table that is cheap to read twice, with a broadcast hint if it has proved small; ``numbers``: the size of a row's arrays."""
    if df.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return df
    if numbers is not None and (df.agg(F.sum(numbers)).first()[0] or 0) > BROADCAST_NUMBERS:
        return df
    return F.broadcast(df)
