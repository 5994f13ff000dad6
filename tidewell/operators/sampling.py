"""Estimators of the Chamfer sum from few exact distances.

Draws depend on the seed and their number alone. Distances are computed once for each drawn row, after the draw.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.functions.ranking import rank_by_id
from tidewell.functions.vectors import unit_draw
from tidewell.operators.allocate import allocation_stats
from tidewell.operators.exact import nearest
from tidewell.operators.lsh import Projection, scale, strata
from tidewell.tables import materialize


def stratified_draws(collisions: DataFrame, allocation: DataFrame, seed: int, a_id: str = "a_id") -> DataFrame:
    """(layer, t, a_id): all rows of strata that are covered in full, else t_i uniform draws with replacement."""
    ranked = rank_by_id(collisions.where("layer >= 0"), "layer", a_id, "rank")
    pick = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_drawn")))
    asked = allocation.where("n_drawn > 0").select("layer", "n", "is_full", pick.alias("t"))
    rank = F.when(F.col("is_full"), F.col("t")).otherwise(1 + F.floor(unit_draw(seed, "stratum", "layer", "t") * F.col("n")))
    return asked.withColumn("rank", rank.cast("long")).join(ranked, ["layer", "rank"]).select("layer", "t", a_id)


def distances_of(draws: DataFrame, a: DataFrame, b: DataFrame, a_id: str = "a_id") -> DataFrame:
    """``draws`` with ``dist``; a row drawn again is measured once."""
    wanted = a.join(draws.select(a_id).distinct(), a_id, "left_semi")
    return draws.join(nearest(wanted, b, a_id).select(a_id, "dist"), a_id)


def stratified(a: DataFrame, b: DataFrame, collisions: DataFrame, p: Projection, total: int, seed: int) -> DataFrame:
    """One row, ``estimate``: of each stratum its full sum, or the mean of its draws times its size."""
    # Both are read several times: collisions are costly, and the allocation is one row a layer.
    collisions = materialize(collisions)
    allocation = materialize(allocation_stats(strata(collisions, p), total))
    measured = distances_of(materialize(stratified_draws(collisions, allocation, seed)), a, b)
    sums = measured.groupBy("layer").agg(F.sum("dist").alias("s"))
    part = F.when(F.col("is_full"), F.col("s")).otherwise(F.col("n") / F.col("t_i") * F.col("s"))
    return allocation.join(sums, "layer").agg(F.coalesce(F.sum(part), F.lit(0.0)).alias("estimate"))


def importance_draws(collisions: DataFrame, p: Projection, total: int, seed: int, a_id: str = "a_id") -> DataFrame:
    """(t, layer, factor, a_id): ``total`` draws, the layer in proportion to its weight, then a row of it; factor = D / scale."""
    own = strata(collisions, p)
    running = Window.partitionBy(F.lit(0)).orderBy("layer").rowsBetween(Window.unboundedPreceding, 0)
    bounds = own.withColumn("hi", F.sum("w").over(running)).withColumn("d", F.sum("w").over(Window.partitionBy(F.lit(0)))).withColumn("lo", F.col("hi") - F.col("w"))
    draws = collisions.sparkSession.range(1, total + 1).select(F.col("id").alias("t"), unit_draw(seed, "layer", "id").alias("u"), unit_draw(seed, "row", "id").alias("v"))
    # The bounds are one row a layer.
    met = draws.join(F.broadcast(bounds), (F.col("u") * F.col("d") >= F.col("lo")) & (F.col("u") * F.col("d") < F.col("hi")))
    met = met.select("t", "layer", (F.col("d") / scale(F.col("layer"), p)).alias("factor"), (1 + F.floor(F.col("v") * F.col("n"))).alias("rank"))
    return met.join(rank_by_id(collisions.where("layer >= 0"), "layer", a_id, "rank"), ["layer", "rank"]).select("t", "layer", "factor", a_id)


def importance(a: DataFrame, b: DataFrame, collisions: DataFrame, p: Projection, total: int, seed: int) -> DataFrame:
    """One row, ``estimate``: the mean of factor times distance over the draws; 0 where all of A is in B."""
    measured = distances_of(materialize(importance_draws(materialize(collisions), p, total, seed)), a, b)
    return measured.agg(F.coalesce(F.avg(F.col("factor") * F.col("dist")), F.lit(0.0)).alias("estimate"))


def uniform_draws(a: DataFrame, total: int, seed: int, a_id: str = "a_id") -> DataFrame:
    n = a.count()
    ranked = rank_by_id(a.select(a_id, F.lit(0).alias("_all")), "_all", a_id, "rank").select(a_id, "rank")
    draws = a.sparkSession.range(1, total + 1).select(F.col("id").alias("t"), (1 + F.floor(unit_draw(seed, "uniform", "id") * n)).alias("rank"))
    return draws.join(ranked, "rank").select("t", a_id)


def uniform(a: DataFrame, b: DataFrame, total: int, seed: int) -> DataFrame:
    """One row, ``estimate``: |A| times the mean distance of uniform draws with replacement; 0 if A is empty."""
    n = a.count()
    measured = distances_of(materialize(uniform_draws(a, total, seed)), a, b)
    return measured.agg(F.coalesce(F.lit(n) / F.lit(total) * F.sum("dist"), F.lit(0.0)).alias("estimate"))
