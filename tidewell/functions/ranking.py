"""Ranks within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rank_by_id(df: DataFrame, group: str, id_col: str, name: str = "rank", width: int = 1 << 17) -> DataFrame:
    """Add ``name``: 1, 2, ... by ``id_col`` within ``group``. Ids are cut into ranges of ``width``.

    Rows are ranked within their range and shifted by the counts of the ranges before, so a group of most rows
    is spread over many tasks. Ids should be distinct and dense.
    """
    cut = df.withColumn("_r", F.floor(F.col(id_col) / width))
    before = Window.partitionBy(group).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    base = cut.groupBy(group, "_r").agg(F.count(F.lit(1)).alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy(group, "_r").orderBy(id_col))
    return cut.withColumn("_k", within).join(base, [group, "_r"]).withColumn(name, F.col("_base") + F.col("_k")).drop("_r", "_k", "_base")
