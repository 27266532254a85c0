"""Operations that depend on the order of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_counter(df: DataFrame, keys: Sequence[str], order: Sequence[str], action: str, delta: str) -> DataFrame:
    """E5: extract and add raise, remove lowers by the absolute value, keep sets, anything else leaves the counter."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    a, d = F.col(action), F.col(delta)
    rows = df.withColumn("__seg", F.sum((a == "keep").cast("int")).over(w))
    part = F.when(a.isin("extract", "add", "keep"), d).when(a == "remove", -F.abs(d)).otherwise(F.lit(0).cast("long"))
    own = Window.partitionBy(*keys, "__seg").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("remaining", F.sum(part).over(own)).drop("__seg")


def merge_roles(df: DataFrame, keys: Sequence[str], turn: str, role: Column, text: str) -> DataFrame:
    """Consecutive rows of one role become one, their texts joined by newlines."""
    w = Window.partitionBy(*keys).orderBy(turn)
    rows = df.withColumn("role", role).withColumn("__new", F.coalesce((F.lag("role").over(w) != F.col("role")).cast("int"), F.lit(1))).withColumn("__run", F.sum("__new").over(w))
    return rows.groupBy(*keys, "__run").agg(F.min(turn).alias(turn), F.first("role").alias("role"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.col(text).alias("x")))), lambda s: s["x"]), "\n").alias(text), F.count(F.lit(1)).alias("n_merged")).drop("__run")


def deltas(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """The change against the row before; the first row's change is its value."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("delta", F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0)))


def carried(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, own: bool = True) -> DataFrame:
    """The last value that isn't null, from this row or one before it."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def seen_before(df: DataFrame, keys: Sequence[str], order: Sequence[str], test: Column, name: str, back: int = 3) -> DataFrame:
    """Whether the test held in one of the rows just before."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-back, -1)
    return df.withColumn(name, F.coalesce(F.max(test.cast("int")).over(w) == 1, F.lit(False)))


def last_match(df: DataFrame, key: str, order: str, value: Column, none: int = -1) -> DataFrame:
    """The value of the last row that has one."""
    return df.groupBy(key).agg(F.coalesce(F.max_by(value, F.when(value.isNotNull(), F.col(order))), F.lit(none)).alias("value"))


def first_definition(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The first definition of each name."""
    return df.groupBy(key).agg(F.min_by(value, order).alias(value))


def batches(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int = 40) -> DataFrame:
    """Contiguous batches."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size))


def totals(df: DataFrame, keys: Sequence[str], prompt: Column, completion: Column, total: Column | None = None) -> DataFrame:
    """Token sums and calls (rows with any tokens); a missing total is prompt + completion."""
    p, c = F.coalesce(prompt, F.lit(0)), F.coalesce(completion, F.lit(0))
    all_ = p + c if total is None else F.coalesce(total, p + c)
    return df.groupBy(*keys).agg(F.sum(p).alias("prompt_tokens"), F.sum(c).alias("completion_tokens"), F.sum(all_).alias("total_tokens"), F.count_if((p > 0) | (c > 0)).alias("llm_calls"))
