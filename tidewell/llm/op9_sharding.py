"""Sharding by rendezvous hashing: each record goes to the shard whose keyed draw for it is the best.

Built from DataFrame expressions only. Every shard draws a number from the record's key; weights enter as
-w / ln(u), so a shard is chosen in proportion to its weight. A new shard can only take records to itself,
and a shard that goes gives up only its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.frames import number_in_groups, text_crc
from tidewell.tables import materialize, table


def rendezvous(key: Column, weights: Sequence[float], seed: int = 17) -> Column:
    """The number of the shard, 0 to len(weights) - 1, that ``key`` belongs to; a null key is a key like others.

    Draws are the first 52 bits of an md5. Equal keys meet in one shard. Ties of the draws, should they occur, go to the
    higher shard number. Weights must be positive and there must be at least one.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive, at least one")
    text = F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("n"))

    def draw(i: int, w: float) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}|{i}"), text)), 1, 13), 16, 10).cast("long")
        unit = (bits + F.lit(0.5)) / F.lit(float(1 << 52))
        return F.struct((-F.lit(float(w)) / F.ln(unit)).alias("v"), F.lit(i).alias("i"))

    if len(weights) == 1:
        return F.lit(0)
    return F.greatest(*(draw(i, w) for i, w in enumerate(weights)))["i"]


def assign_shards(df: DataFrame, key_col: str, weights: Sequence[float], name: str = "shard", seed: int = 17) -> DataFrame:
    """``df`` with its shard in the column ``name``: a projection, without a shuffle. All other columns stay.

    Rows repeat with equal keys in one shard; an empty table stays empty; a null key has a shard too.
    """
    return df.withColumn(name, rendezvous(F.col(key_col), weights, seed))


def op9_rendezvous_shards(spark: SparkSession, sf_dir: str, shards: int = 8) -> DataFrame:
    """All documents in shards 0 to 7 under the law ``key``: doc_id and the number of shards decide.

    Null texts have size 1. Rows that repeat a doc_id share its shard and have slots of their own.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    narrow = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        text_crc("text").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = assign_shards(assign_shards(narrow, "doc_id", [1.0] * shards), "doc_id", [1.0] * (shards + 1), "grown_shard")
    placed = materialize(placed)
    numbered = number_in_groups(placed, ["shard"], ["doc_id", "text_crc32", "size"], "slot")
    return numbered.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


_DRAW = "-1.0 / ln((('0x' || substr(md5('17|' || i || '|' || coalesce('k' || doc_id, 'n')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)"
_SHARD = "list_max(list_transform(range(0, {n}), lambda i: {{'v': " + _DRAW + ", 'i': i}})).i::INTEGER"
#: Slots are numbered by bucket, then by the columns; the CRC is computed bit by bit and byte by byte.
ORACLE = f"""
WITH c AS (SELECT list_transform(range(0, 256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(3988292384, x >> 1) ELSE x >> 1 END)) AS tbl),
d AS (SELECT doc_id, (coalesce(strlen(text), 0) + 1)::BIGINT AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes FROM documents),
s AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, bytes), lambda x, y: xor(x >> 8, tbl[(xor(x, y) & 255) + 1])), 4294967295) AS text_crc32, {_SHARD.format(n=8)} AS shard, {_SHARD.format(n=9)} AS grown_shard FROM d, c),
b AS (SELECT *, ('0x' || substr(md5(concat_ws('|', doc_id, text_crc32, size)), 1, 8))::BIGINT % 4096 AS b FROM s)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY b, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM b
"""
