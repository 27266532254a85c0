"""Rendezvous hashing of record keys over weighted shards.

Each (key, shard) pair gets a number from the key's hash and the shard's, and the shard with the largest number, scaled by
the shard's weight, takes the record: -weight / ln(u) for u uniform in (0, 1). A further shard only competes for records, so
it takes some from each of the others and moves none between them.

A shard's rows are numbered without a task that holds the shard: rows are dealt by (shard, bucket), counted by bucket, and
numbered within the bucket from the sum of the counts before it. A bucket comes from the hash of key, checksum and size, so
rows that share a key but not a text are spread.

Defined results: null keys share one hash and so one shard; a null text has size 1 and the checksum of no bytes; repeated
rows go to the same shard and get slots of their own; an empty table gives no rows; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of a shard: the counts table has shards * BUCKETS rows at any size.
BUCKETS = 1024


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard, counted from 0, that takes the key. Weights must be positive."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    hashed = F.xxhash64(key.cast("string"))

    def strength(shard: int) -> Column:
        # 53 bits of the pair's hash, in (0, 1)
        u = (F.shiftrightunsigned(F.xxhash64(hashed, F.lit(shard)), 11).cast("double") + 0.5) / float(1 << 53)
        return F.struct((F.lit(-float(weights[shard])) / F.ln(u)).alias("s"), F.lit(-shard).alias("n"))

    every = [strength(i) for i in range(len(weights))]
    return -(F.greatest(*every) if len(every) > 1 else every[0])["n"]


def numbered(df: DataFrame, group: str, order: Sequence[str], slot: str, buckets: int = BUCKETS) -> DataFrame:
    """df with slot: 0, 1, 2 ... within each group, in the order of (bucket, order). The groups must be few."""
    bucket = "__bucket"
    rows = df.withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = rows.groupBy(group, bucket).agg(F.count(F.lit(1)).alias("__n"))
    upto = Window.partitionBy(group).orderBy(bucket)
    before = counts.select(F.col(group).alias("__g"), F.col(bucket).alias("__b"), (F.sum("__n").over(upto) - F.col("__n")).alias("__before"))
    own = Window.partitionBy(group, bucket).orderBy(*order)
    placed = rows.withColumn("__own", F.row_number().over(own))
    joined = placed.join(F.broadcast(before), (F.col(group) == F.col("__g")) & (F.col(bucket) == F.col("__b")))
    return joined.withColumn(slot, F.col("__before") + F.col("__own") - 1).drop(bucket, "__g", "__b", "__before", "__own")


def shard(df: DataFrame, weights: Sequence[float] = (1.0,) * 8, grown: Sequence[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, shard, slot, grown_shard (by the weights in grown, by default one more shard of weight 1)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        rendezvous(F.col(id_col), weights).alias("shard"),
        rendezvous(F.col(id_col), grown or [*weights, 1.0]).alias("grown_shard"),
    )
    return numbered(rows, "shard", ["id", "text_crc32", "size"], "slot").withColumnRenamed("id", id_col)


def route(df: DataFrame, key: str, n_shards: int) -> DataFrame:
    """df, its rows dealt to n_shards partitions by rendezvous hashing of key, for a writer that makes a file for each."""
    return df.withColumn("shard", rendezvous(F.col(key), [1.0] * n_shards)).repartition(n_shards, "shard")


__all__ = ["BUCKETS", "numbered", "rendezvous", "route", "shard"]
