"""Nested Euclidean hashing: keys of all layers, first collisions, strata.

Layer i's key follows from the finest one alone: (h + sum of 2^t xi_t for t < i) >> i. No layer waits for another.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.ranking import rank_by_id
from tidewell.functions.vectors import widen
from tidewell.operators.geometry import levels
from tidewell.tables import broadcast_if_small, materialize


@dataclass(frozen=True)
class Projection:
    """``k`` random directions in ``dim`` dimensions with offsets and the carries of ``top`` coarser layers, all from the seed."""

    k: int
    dim: int
    rho: float
    top: int
    seed: int = 7

    @cached_property
    def directions(self) -> np.ndarray:
        return np.random.default_rng([self.seed, 1]).normal(size=(self.k, self.dim))

    @cached_property
    def starts(self) -> np.ndarray:
        return np.random.default_rng([self.seed, 2]).uniform(0, self.k * self.rho, self.k)

    @cached_property
    def bits(self) -> np.ndarray:
        """(top, k): what is added to a layer's key before it is halved; a projection of more layers begins with the same."""
        return np.random.default_rng([self.seed, 3]).integers(0, 2, (self.top, self.k), dtype=np.int64)

    @cached_property
    def carries(self) -> np.ndarray:
        """(top + 1, k): what is added to the finest key before it is shifted."""
        out = np.zeros((self.top + 1, self.k), np.int64)
        out[1:] = np.cumsum(self.bits << np.arange(self.top)[:, None], axis=0)
        return out


def with_h0(df: DataFrame, p: Projection, vec: str = "vec") -> DataFrame:
    """Add ``h0``, the finest key: one matrix product for each Arrow batch."""
    g, s, width = p.directions, p.starts, p.k * p.rho

    @F.pandas_udf("array<bigint>")
    def h0(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        x = np.stack(v.to_numpy()).astype(np.float64)
        return pd.Series(list(np.floor((x @ g.T + s) / width).astype(np.int64)))

    return df.withColumn("h0", h0(vec))


def with_layers(df: DataFrame, p: Projection, h0: str = "h0") -> DataFrame:
    """A row for each row and layer 0 to ``top``, with ``layer`` and ``key``."""
    carries = F.array(*(F.array(*(F.lit(int(c)).cast("long") for c in row)) for row in p.carries))
    layer = F.explode(F.sequence(F.lit(0), F.lit(p.top))).alias("layer")
    rows = df.select("*", layer)
    # A shift by the layer is a floor division by a power of two, of negative keys too.
    key = F.zip_with(F.col(h0), F.get(carries, F.col("layer")), lambda h, c: F.call_function("shiftright", h + c, F.col("layer")))
    return rows.withColumn("key", key)


def bucket_names(df: DataFrame) -> DataFrame:
    """The key as 128 bits: what is joined and shuffled instead of long arrays."""
    return df.withColumn("k1", F.xxhash64("layer", "key")).withColumn("k2", F.xxhash64(F.lit(9), "key", "layer")).drop("key")


def bucket_counts(a: DataFrame, b: DataFrame, p: Projection) -> DataFrame:
    """(layer, key, a_count, b_count) of all buckets that hold a point. Buckets are told apart by 128 bits; the key, which is long, goes along once."""
    side = lambda df, x, y: with_layers(with_h0(df, p).select("h0"), p).select("layer", "key", F.lit(x).alias("x"), F.lit(y).alias("y"))
    both = side(a, 1, 0).unionByName(side(b, 0, 1))
    named = both.withColumn("k1", F.xxhash64("layer", "key")).withColumn("k2", F.xxhash64(F.lit(9), "key", "layer"))
    summed = named.groupBy("layer", "k1", "k2").agg(F.first("key").alias("key"), F.sum("x").alias("a_count"), F.sum("y").alias("b_count"))
    return summed.select("layer", "key", "a_count", "b_count")


def postings(a: DataFrame, p: Projection, a_id: str = "a_id") -> DataFrame:
    """(layer, k1, k2, a_id) of every row and layer: the members of buckets. Written by layer, a bucket is read from its layer alone."""
    return bucket_names(with_layers(with_h0(a.where("vec IS NOT NULL"), p).select(a_id, "h0"), p)).select("layer", "k1", "k2", a_id)


def members(posted: DataFrame, buckets: DataFrame) -> DataFrame:
    """The postings of ``buckets`` (layer, k1, k2), all at once; few buckets are broadcast, so none is gathered."""
    wanted = materialize(buckets.select("layer", "k1", "k2").distinct())
    return posted.join(broadcast_if_small(wanted), ["layer", "k1", "k2"], "left_semi")


def placed(posted: DataFrame, a_id: str = "a_id") -> DataFrame:
    """Postings with ``place``: 1, 2, ... in the order of ids within a bucket of any size."""
    ranked = rank_by_id(posted.withColumn("_g", F.struct("layer", "k1", "k2")), "_g", a_id, "place")
    return ranked.drop("_g")


def first_collision(a: DataFrame, b: DataFrame, p: Projection, a_id: str = "a_id") -> DataFrame:
    """(a_id, layer): -2 where the coordinates are in ``b``, else the finest layer whose bucket holds a row of ``b``, else top + 1."""
    name = lambda df: df.withColumn("_c1", F.xxhash64(widen("vec"))).withColumn("_c2", F.xxhash64(F.lit(9), widen("vec")))
    cells = name(b.where("vec IS NOT NULL").select("vec")).select("_c1", "_c2").distinct().withColumn("_same", F.lit(True))
    # Coordinates are compared by 128 bits, so that no vector is shuffled.
    keyed = name(with_h0(a.where("vec IS NOT NULL"), p)).select(a_id, "h0", "_c1", "_c2")
    rows = keyed.join(broadcast_if_small(cells), ["_c1", "_c2"], "left").select(a_id, "h0", F.coalesce("_same", F.lit(False)).alias("_same"))
    held = materialize(bucket_names(with_layers(with_h0(b.where("vec IS NOT NULL").select("vec"), p).select("h0").distinct(), p)).select("layer", "k1", "k2").distinct())
    # A coarse bucket may hold all of A: where the buckets of B are few they are broadcast, and A is not dealt by them.
    met = bucket_names(with_layers(rows.where("NOT _same").select(a_id, "h0"), p)).join(broadcast_if_small(held), ["layer", "k1", "k2"], "left_semi")
    least = met.groupBy(a_id).agg(F.min("layer").alias("_least"))
    layer = F.when(F.col("_same"), F.lit(-2)).otherwise(F.coalesce("_least", F.lit(p.top + 1))).cast("int")
    return rows.join(least, a_id, "left").select(a_id, layer.alias("layer"))


def projection_for(n_max: int, dim: int, reach: float, rho: float = 1e-4, seed: int = 7, k: int | None = None) -> Projection:
    """The projection for at most ``n_max`` points a side within ``reach`` of the first: as many directions and layers as they need."""
    wanted = max(1, math.ceil(4 * math.log(8 * n_max * n_max)))
    return Projection(k=k or wanted, dim=dim, rho=rho, top=levels(reach, rho), seed=seed)


def scale(layer, p: Projection):
    """The distance a layer stands for; twice the top one for the fallback; 0 for exact matches."""
    return F.when(layer == -2, F.lit(0.0)).otherwise(F.lit(p.rho) * F.pow(F.lit(2.0), layer.cast("double")))


def strata(collisions: DataFrame, p: Projection) -> DataFrame:
    """(layer, n, w) of the strata at a positive distance."""
    return collisions.where("layer >= 0").groupBy("layer").agg(F.count(F.lit(1)).alias("n")).withColumn("w", F.col("n") * scale(F.col("layer"), p))
