"""Centroid, outlier, range and levels of point sets."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.functions.vectors import l2, widen


def centroid(a: DataFrame) -> DataFrame:
    """(pos, mean): the mean of each component; partial sums are made before the shuffle."""
    return a.select(F.posexplode(widen("vec"))).groupBy("pos").agg(F.avg("col").alias("mean"))


def outlier(a: DataFrame, id_col: str, factor: float = 0.1) -> DataFrame:
    """One row, ``vec``: c + factor * |A| * (first row - c), with c the centroid; ``first`` is the least id."""
    first = a.orderBy(id_col).limit(1).select(F.posexplode(widen("vec")).alias("pos", "x"))
    n = a.count()
    # Both sides have one row a component.
    moved = centroid(a).join(F.broadcast(first), "pos").select("pos", (F.col("mean") + factor * n * (F.col("x") - F.col("mean"))).alias("y"))
    return moved.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "y"))), lambda s: s["y"]).alias("vec"))


def inject_outlier(a: DataFrame, id_col: str, factor: float = 0.1) -> DataFrame:
    """``a`` (id, vec) and the outlier as its last row, under the next id."""
    top = a.agg(F.max(id_col)).first()[0]
    kind = a.schema[id_col].dataType
    extra = outlier(a, id_col, factor).select(F.lit((top if top is not None else -1) + 1).cast(kind).alias(id_col), "vec")
    return a.select(id_col, widen("vec").alias("vec")).unionByName(extra)


def reach(points: DataFrame, anchor: DataFrame) -> DataFrame:
    """One row, ``reach``: the largest distance of ``points`` from the one row of ``anchor``; twice it bounds the diameter."""
    first = anchor.limit(1).select(F.col("vec").alias("_o"))
    return points.join(F.broadcast(first), F.lit(True)).agg(F.max(l2("vec", "_o")).alias("reach"))


def reach_by_step(points: DataFrame, anchor: DataFrame, window: int, every: int) -> DataFrame:
    """(step, reach): at each query step the largest distance from the anchor of any row that has come so far; it never shrinks.

    ``points``: step, vec; rows that were there before have a negative step. Rows are brought down to one a query step
    before the running maximum is taken over those few.
    """
    first = anchor.limit(1).select(F.col("vec").alias("_o"))
    due = (F.ceil(F.greatest(F.col("step"), F.lit(window)) / every) * every).cast("long")
    far = points.join(F.broadcast(first), F.lit(True)).groupBy(due.alias("step")).agg(F.max(l2("vec", "_o")).alias("_far"), F.max("step").alias("_last"))
    running = Window.partitionBy(F.lit(0)).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(F.lit(0))
    rows = far.withColumn("reach", F.max("_far").over(running)).withColumn("_end", F.max("_last").over(whole))
    return rows.where(F.col("step") <= F.col("_end")).select("step", "reach")


def level_of(reach_, rho: float):
    """``levels`` of a column."""
    span = F.greatest(2 * reach_ - F.lit(1e-15), F.lit(rho)) / F.lit(rho)
    return F.greatest(F.lit(0), F.ceil(F.log2(span))).cast("int")


def levels(reach_: float, rho: float) -> int:
    """The least L with rho * 2^L >= 2 * reach - 1e-15."""
    return max(0, math.ceil(math.log2(max(2 * reach_ - 1e-15, rho) / rho)))


def aspect_ratio(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: diameter (at most twice too large), the least positive distance between the sides, their ratio, and the depth of a tree of halved cells that tells the two apart."""
    from tidewell.operators.exact import nearest, without_exact_match

    first = a.orderBy("a_id").limit(1)
    wide = reach(a.select("vec").unionByName(b.select("vec")), first).select((2 * F.col("reach")).alias("diameter"))
    # Rows that lie on one of B are left out: what matters to others is not nearer than their nearest.
    least = nearest(without_exact_match(a, b), b).agg(F.min("dist").alias("least"))
    rows = wide.join(F.broadcast(least), F.lit(True)).withColumn("ratio", F.col("diameter") / F.col("least"))
    return rows.withColumn("depth", F.greatest(F.lit(1), F.ceil(F.log2("ratio")) + 1).cast("int"))
