"""Splitting a sample budget over strata by largest remainders. Strata are a few rows: one a layer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def hamilton(strata: DataFrame, total, key: str = "layer", weight: str = "w", name: str = "t_i", by: list[str] | None = None) -> DataFrame:
    """Add ``name``: the whole quotas of ``total`` by weight, what is left by largest fraction, then by least key.

    All zero if the total or the weights are not positive. ``by``: columns within whose values a total is split. Weights
    are added up by ascending key: with fractions that are equal, the last digit of the sum decides, and rows come in any order.
    """
    total = F.lit(total) if isinstance(total, int) else total
    everything = Window.partitionBy(*(by or [F.lit(0)]))
    in_order = everything.orderBy(key).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = strata.withColumn("_sum", F.sum(weight).over(in_order)).withColumn("_q", F.when(F.col("_sum") > 0, total * F.col(weight) / F.col("_sum")).otherwise(0.0))
    df = df.withColumn("_f", F.floor("_q")).withColumn("_left", F.greatest(total - F.sum("_f").over(everything), F.lit(0)))
    order = everything.orderBy((F.col("_q") - F.col("_f")).desc(), F.col(key))
    extra = F.when((F.col("_sum") > 0) & (F.row_number().over(order) <= F.col("_left")), 1).otherwise(0)
    return df.withColumn(name, F.when(total > 0, F.col("_f") + extra).otherwise(0).cast("long")).drop("_sum", "_q", "_f", "_left")


def guaranteed(strata: DataFrame, total: int, key: str = "layer", count: str = "n", weight: str = "w", name: str = "t_i", by: list[str] | None = None) -> DataFrame:
    """One seat for each stratum that has rows, the rest by ``hamilton``. Fails if there are fewer seats than such strata."""
    by = by or []
    filled = strata.where(F.col(count) > 0).withColumn("_s", F.count(F.lit(1)).over(Window.partitionBy(*(by or [F.lit(0)]))))
    enough = F.when(F.col("_s") > total, F.raise_error(F.lit("the budget is smaller than the number of strata"))).otherwise(F.col("_s"))
    shared = hamilton(filled.withColumn("_s", enough.cast("long")), F.lit(total) - F.col("_s"), key, weight, "_e", by)
    shared = shared.select(*by, key, (1 + F.col("_e")).alias(name))
    return strata.join(shared, [*by, key], "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))


def allocation_stats(strata: DataFrame, total: int, by: list[str] | None = None) -> DataFrame:
    """(layer, n, w, t_i, is_full, n_drawn): the allocation, which strata it covers, and the samples each will take."""
    return guaranteed(strata, total, by=by).withColumn("is_full", F.col("t_i") >= F.col("n")).withColumn("n_drawn", F.least("t_i", "n"))
