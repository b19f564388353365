"""Sharding: rendezvous hashing of stable record keys over weighted shards.

A key's score on a shard is -weight / ln(u), u being a hash of key and shard in (0, 1); the shard with the highest
score has the key. One more shard so takes keys only to itself, and each shard has keys in proportion to its weight.
Only the key and the shards decide, and no state is kept.

Slots number a shard's rows without gaps: rows are numbered within (shard, bucket) groups, and each group starts where
the groups before it end. Buckets are by hash of the key and of the columns that order its rows, so that a key of very
many rows, such as null, is dealt over all buckets; only rows that are equal in all of these share one.

Defined results: a null key is a key like any other; rows that repeat a key share its shard and have slots of their
own; a null text has size 1 and no checksum; an empty table gives an empty table;
further columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

#: Rows that a (shard, bucket) group has on average at most.
GROUP_ROWS = 50_000
_SALT = "shard"


def rendezvous(key: str | Column, weights: Mapping[int, float]) -> Column:
    """The shard of a key; weights: shard to weight above 0."""
    if not weights or min(weights.values()) <= 0:
        raise ValueError("each shard needs a weight above 0")
    scored = []
    for shard, weight in weights.items():
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(_SALT), key, F.lit(int(shard))), 11)  # 53 bits, exact as double
        u = (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
        scored.append(F.struct((F.lit(-float(weight)) / F.log(u)).alias("score"), F.lit(-int(shard)).alias("shard")))
    best = F.greatest(*scored) if len(scored) > 1 else scored[0]
    return (-best["shard"]).cast("int")


def assign(rows: DataFrame, key: str, shards: Mapping[int, float], order: list[str]) -> DataFrame:
    """rows with shard int and slot long, gapless from 0 in each shard; order: columns that order rows of one key."""
    n = rows.select(F.count(F.lit(1))).first()[0]
    buckets = max(1, math.ceil(n / GROUP_ROWS / len(shards)))
    placed = rows.withColumn("shard", rendezvous(key, shards)).withColumn("_bucket", F.pmod(F.xxhash64(F.lit("slot"), key, *order), F.lit(buckets)).cast("int"))
    # counted per group with partial sums; one row a group is left, bounded by n / GROUP_ROWS + shards
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "_bucket").count().select("shard", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("shard", "_bucket").orderBy(F.col(key).asc_nulls_first(), *order)
    return (
        placed.withColumn("_row", F.row_number().over(within) - 1)
        .join(starts, ["shard", "_bucket"])
        .withColumn("slot", (F.col("_start") + F.col("_row")).cast("long"))
        .drop("_bucket", "_start", "_row")
    )


def op1_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.read_table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"),
    )
    out = assign(rows, "doc_id", dict.fromkeys(range(8), 1.0), ["size", "text_crc32"])
    grown = rendezvous("doc_id", dict.fromkeys(range(9), 1.0))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", grown.alias("grown_shard"))
