"""Strata kept up to date under inserts and deletes on both sides, from counts of buckets.

The state is one row for each bucket that holds a point, with its rows of A and of B; exact coordinates are buckets of
a layer of their own. A change is a table of the same form with counts of +1 and -1. Adding it costs an aggregation of
state and change; no point of the state is looked at again. Strata follow from the counts alone: buckets are nested,
so the rows of A that have met B up to a layer are those in buckets of that layer that B is in. Coarser layers open
from the keys of the present top.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.functions.vectors import widen
from tidewell.operators.lsh import Projection, scale, with_h0, with_layers

SAME = -2
_COLUMNS = ["layer", "key", "cell", "a_count", "b_count"]


def change(points: DataFrame, p: Projection, side: str, sign: int = 1) -> DataFrame:
    """(layer, key, cell, a_count, b_count): what inserting (1) or deleting (-1) the rows (vec) on side "a" or "b" adds to the counts."""
    own = points.where("vec IS NOT NULL").select("vec")
    layers = with_layers(with_h0(own, p).select("h0"), p).select("layer", "key", F.lit(None).cast("array<double>").alias("cell"))
    cells = own.select(F.lit(SAME).alias("layer"), F.lit(None).cast("array<bigint>").alias("key"), widen("vec").alias("cell"))
    counts = [F.lit(sign if side == s else 0).cast("long").alias(f"{s}_count") for s in ("a", "b")]
    return layers.unionByName(cells).select("layer", "key", "cell", *counts)


def applied(state: DataFrame | None, *changes: DataFrame) -> DataFrame:
    """The state after changes; buckets that are empty on both sides are gone. A count below zero is an error: what is deleted must be there."""
    rows = state
    for c in changes:
        rows = c if rows is None else rows.unionByName(c)
    summed = rows.groupBy("layer", "key", "cell").agg(*(F.sum(f"{s}_count").alias(f"{s}_count") for s in ("a", "b")))
    wrong = F.raise_error(F.lit("a row was deleted that is not there")).cast("long")
    checked = summed.withColumns({f"{s}_count": F.when(F.col(f"{s}_count") >= 0, F.col(f"{s}_count")).otherwise(wrong) for s in ("a", "b")})
    return checked.where("a_count > 0 OR b_count > 0")


def strata(state: DataFrame, p: Projection) -> DataFrame:
    """(layer, n, w) of the strata at a positive distance, from the counts."""
    met = state.where("b_count > 0 AND a_count > 0").groupBy("layer").agg(F.sum("a_count").alias("m"))
    total = state.where(F.col("layer") == SAME).agg(F.coalesce(F.sum("a_count"), F.lit(0)).alias("total"))
    # One row a layer, and one with the total.
    layers = state.sparkSession.range(1).select(F.explode(F.array(F.lit(SAME), *(F.lit(i) for i in range(p.top + 2)))).alias("layer"))
    rows = layers.join(met, "layer", "left").join(F.broadcast(total), F.lit(True))
    upto = F.when(F.col("layer") > p.top, F.col("total")).otherwise(F.coalesce("m", F.lit(0)))
    sized = rows.withColumn("upto", upto).withColumn("n", F.col("upto") - F.lag("upto", 1, 0).over(Window.partitionBy(F.lit(0)).orderBy("layer")))
    return sized.where("layer >= 0 AND n > 0").select("layer", F.col("n").cast("long").alias("n"), (F.col("n") * scale(F.col("layer"), p)).alias("w"))


def _parent(p: Projection, layer: int):
    bits = F.array(*(F.lit(int(x)).cast("long") for x in p.bits[layer]))
    return F.zip_with("key", bits, lambda k, x: F.shiftright(k + x, 1))


def opened(state: DataFrame, old: Projection, new: Projection) -> DataFrame:
    """The state with the layers up to ``new.top``, from the buckets of the top layer of ``old``; both have one seed."""
    top = state.where(F.col("layer") == old.top)
    for layer in range(old.top, new.top):
        top = top.withColumn("key", _parent(new, layer)).groupBy("key").agg(F.sum("a_count").alias("a_count"), F.sum("b_count").alias("b_count"))
        top = top.select(F.lit(layer + 1).alias("layer"), "key", F.lit(None).cast("array<double>").alias("cell"), "a_count", "b_count")
        state = state.unionByName(top)
    return state


def children(state: DataFrame, p: Projection) -> DataFrame:
    """(layer, key, n_children, a_children): for each bucket above the finest layer the buckets below it, and those of them that hold rows of A but none of B."""
    named = state.where((F.col("layer") >= 0) & (F.col("layer") < p.top))
    parent = F.lit(None).cast("array<bigint>")
    for layer in range(p.top):
        parent = F.when(F.col("layer") == layer, _parent(p, layer)).otherwise(parent)
    up = named.select((F.col("layer") + 1).alias("layer"), parent.alias("key"), "a_count", "b_count")
    frontier = F.when((F.col("a_count") > 0) & (F.col("b_count") == 0), 1).otherwise(0)
    return up.groupBy("layer", "key").agg(F.count(F.lit(1)).alias("n_children"), F.sum(frontier).alias("a_children"))
