"""DataFrame helpers shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def text_crc(col: str) -> Column:
    """CRC-32 of the UTF-8 bytes; null counts as empty."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def fold(col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``: the documents' fixed folds; a null id is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(n)), F.lit(0)).cast("int")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names`` with as many underscores behind each as keep them apart from all columns of ``df``, whatever their case."""
    taken = {c.lower() for c in df.columns}
    names = list(names)
    while taken & {n.lower() for n in names}:
        names = [n + "_" for n in names]
    return names


#: A run of equal rows is dealt out in pieces of so many numbers.
RUN = 1 << 16


def number_in_groups(df: DataFrame, group: list[str], order: list[str], name: str, buckets: int = 4096) -> DataFrame:
    """Add ``name``: gapless numbers from 0 within each group, though one group may hold most rows.

    Equal rows are counted first and numbered as a run, so a row that repeats without bound is one row
    while it is dealt out; runs of more than RUN are then dealt out anew, a piece a row. A group is split into
    ``buckets`` by a hash of ``order``; rows are numbered in their bucket, behind the rows of all earlier buckets.
    ``df`` should be a narrow table that is cheap to read twice. The offsets are one row for each group and bucket;
    Spark broadcasts them only if they prove small.
    """
    keys = [*group, *(c for c in order if c not in group)]
    rest = [F.first(c).alias(c) for c in df.columns if c not in keys]
    hashed = F.conv(F.substring(F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in order))), 1, 8), 16, 10)
    bucket = (hashed.cast("long") % buckets).alias("_b")
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *rest).withColumn("_b", bucket)
    start = (
        df.withColumn("_b", bucket)
        .groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_m"))
        .withColumn("_from", F.sum("_m").over(Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)))
    )
    start = start.select(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(group)), F.col("_b").alias("_gb"), F.coalesce("_from", F.lit(0)).alias("_from"))
    here = Window.partitionBy(*group, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("_at", F.coalesce(F.sum("_n").over(here), F.lit(0)))
    same = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group)]
    joined = placed.join(start, [*same, F.col("_b") == F.col("_gb")]).withColumn("_first", F.col("_from") + F.col("_at"))
    numbers = lambda first, n: F.explode(F.sequence(first, first + n - 1)).alias(name)
    short = joined.where(F.col("_n") <= RUN).select(*df.columns, numbers(F.col("_first"), F.col("_n")))
    if df.groupBy(*keys).count().where(F.col("count") > RUN).isEmpty():
        return short
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(RUN).cast("long"))).alias("_piece")
    pieces = joined.where(F.col("_n") > RUN).select(*df.columns, "_first", "_n", piece).repartition(F.col("_first") + F.col("_piece"))
    return short.unionByName(pieces.select(*df.columns, numbers(F.col("_first") + F.col("_piece"), F.least(F.lit(RUN), F.col("_n") - F.col("_piece")))))


def posterior_floor(n: int, threshold: float, tolerance: float) -> int:
    """The fewest matches among ``n`` MinHash values at which P(similarity >= threshold) is at least ``tolerance``.

    The prior is uniform, so the posterior is Beta(m+1, n-m+1), whose tail is a binomial sum.
    """
    for m in range(n + 1):
        above = sum(math.comb(n + 1, i) * threshold**i * (1 - threshold) ** (n + 1 - i) for i in range(m + 1))
        if above >= tolerance:
            return m
    return n + 1


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once: as a lambda's variable it can't be inlined into loops over it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
