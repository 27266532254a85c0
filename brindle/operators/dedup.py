"""Keep-first, subsumption and set operations on rows with an order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, key: Column | Sequence[Column], order: Sequence[str]) -> DataFrame:
    """Of rows with equal keys the first. Null keys are equal."""
    keys = [key] if isinstance(key, Column) else list(key)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def keep_first_ids(df: DataFrame, key: Column, id_col: str) -> DataFrame:
    """E1 by an aggregate: the smallest id of each key and how many rows share it. Map-side combining makes hot keys cheap."""
    return df.groupBy(key.alias("__k")).agg(F.min(id_col).alias(id_col), F.count(F.lit(1)).alias("copies")).drop("__k")


def keep_first_capped(df: DataFrame, key: Sequence[Column], order: Sequence[str], most: int) -> DataFrame:
    """Keep-first, then the first rows overall."""
    return keep_first(df, key, order).orderBy(*order).limit(most)


def capped(df: DataFrame, group: str, order: Sequence[Column | str], most: int) -> DataFrame:
    """The first rows of each group, with the group's size and how many are left out."""
    w = Window.partitionBy(group)
    rows = df.withColumns({"rn": F.row_number().over(w.orderBy(*order)), "group_size": F.count(F.lit(1)).over(w)})
    return rows.where(F.col("rn") <= most).withColumn("n_more", F.greatest(F.col("group_size") - most, F.lit(0)))


def small_groups(df: DataFrame, group: str, most: int) -> DataFrame:
    """The rows of groups of at most that size."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") <= most)
    return df.join(sizes.select(group), group, "left_semi")


def merged(*sources: DataFrame, key: Column, order: str) -> DataFrame:
    """Union of sources, keep-first by key in the order of (source, order)."""
    rows = None
    for i, s in enumerate(sources):
        part = s.withColumn("source_rank", F.lit(i))
        rows = part if rows is None else rows.unionByName(part)
    return keep_first(rows, key, ["source_rank", order])


def last_wins(*sources: DataFrame, key: str, value: str) -> DataFrame:
    """Dictionary update: of equal keys the value of the last source."""
    rows = None
    for i, s in enumerate(sources):
        part = s.select(key, F.col(value).alias("__v"), F.lit(i).alias("__rank"))
        rows = part if rows is None else rows.union(part)
    return rows.groupBy(key).agg(F.max_by("__v", "__rank").alias(value))


def subsumed(df: DataFrame, pos: str, lhs: str, rhs: str, names: str) -> DataFrame:
    """Rows (lhs == rhs under the condition names, a sorted array, empty if unconditional) that stay.

    A conditional row goes if its pair holds unconditionally (A) or another value does (C). Of unconditional rows with one
    lhs the first value stays (C2; all their values count for C, also those that go). Of conditional rows with one pair those
    go whose names are a strict subset of another's (B)."""
    rows = df.select(pos, lhs, rhs, F.col(names).alias("__n"), (F.size(names) > 0).alias("__if"))
    always = rows.where("NOT __if").groupBy(lhs).agg(F.min_by(rhs, pos).alias("__first"), F.collect_set(rhs).alias("__values"))
    held = rows.join(always, lhs, "left")
    stays = held.where(F.when(F.col("__if"), F.col("__values").isNull()).otherwise(F.col("__first") == F.col(rhs)))
    # strict supersets: distinct name sets only, exploded to names, counted by equi-join
    sets = stays.where("__if").select(lhs, rhs, "__n").distinct()
    one = sets.select(lhs, rhs, F.col("__n").alias("__small"), F.explode("__n").alias("__name"))
    two = sets.select(lhs, rhs, F.col("__n").alias("__large"), F.explode("__n").alias("__name"))
    inside = one.join(two, [lhs, rhs, "__name"]).groupBy(lhs, rhs, "__small", "__large").agg(F.count(F.lit(1)).alias("__c"))
    narrow = inside.where("__c = size(__small) AND size(__small) < size(__large)").select(lhs, rhs, F.col("__small").alias("__n")).distinct()
    kept = stays.join(narrow, [lhs, rhs, "__n"], "left_anti")
    return kept.select(pos, lhs, rhs, F.col("__n").alias(names))


def set_sizes(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Sizes of union, intersection and differences of two key sets, and whether a lies strictly within b."""
    both = a.select(key).distinct().withColumn("__a", F.lit(1)).join(b.select(key).distinct().withColumn("__b", F.lit(1)), key, "full")
    one, two = F.col("__a").isNotNull(), F.col("__b").isNotNull()
    made = both.agg(F.count(F.lit(1)).alias("n_union"), F.count_if(one & two).alias("n_both"), F.count_if(one & ~two).alias("n_only_a"), F.count_if(~one & two).alias("n_only_b"))
    return made.withColumn("strict_subset", (F.col("n_only_a") == 0) & (F.col("n_only_b") > 0))
