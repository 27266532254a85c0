"""Run statistics, roll-ups and scores (aggregations of per-run and per-file rows)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.text import safe_ratio


def fold(value: Column, prefix: str = "") -> list[Column]:
    """n, mean, median, std, min, max (D9): nulls and NaN out; the sample deviation is 0 below two values; all 0 when empty."""
    v = F.when(~F.isnan(value), value)
    zero = F.lit(0.0)
    made = {"n": F.count(v), "mean": F.coalesce(F.avg(v), zero), "median": F.coalesce(F.median(v), zero), "std": F.coalesce(F.stddev_samp(v), zero), "min": F.coalesce(F.min(v), zero), "max": F.coalesce(F.max(v), zero)}
    return [c.alias(prefix + k) for k, c in made.items()]


def cell_stats(df: DataFrame, keys: Sequence[str], measures: Sequence[str], code: str, ok: str = "0") -> DataFrame:
    """Runs, succeeded (code equals the string ok), rate, and the fold of each measure."""
    good = F.count_if(F.col(code) == ok)
    every = [c for m in measures for c in fold(F.col(m).cast("double"), f"{m}_")]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("runs"), good.alias("succeeded"), (good / F.count(F.lit(1))).alias("rate"), *every)


def macro(cells: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """The mean of cell means; null cells are left out, all null gives null."""
    return cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cells"), *[F.avg(m).alias(m) for m in measures])


def totals(df: DataFrame, keys: Sequence[str], top: str, bottom: str) -> DataFrame:
    """Sums and ratio of sums for each key prefix and in all (ROLLUP; level 0 is the finest)."""
    level = F.grouping_id().cast("int").alias("level")
    return df.rollup(*keys).agg(level, F.sum(top).alias("top"), F.sum(bottom).alias("bottom"), safe_ratio(F.sum(top), F.sum(bottom)).alias("ratio"))


def positive_mean(value: Column) -> Column:
    """The mean over positive values only, 0 without any. D6 takes all values instead."""
    return F.coalesce(F.avg(F.when(value > 0, value)), F.lit(0.0))


def status_counts(df: DataFrame, keys: Sequence[str], status: str) -> DataFrame:
    """Counts by status; score = killed / (total - stillborn - error); rate = killed / (total - stillborn)."""
    is_ = lambda s: F.count_if(F.col(status) == s)
    made = df.groupBy(*keys) if keys else df.groupBy()
    made = made.agg(F.count(F.lit(1)).alias("total"), *[is_(s).alias(s) for s in ("killed", "survived", "stillborn", "timeout", "error")])
    base = F.col("total") - F.col("stillborn")
    score = F.when(base - F.col("error") > 0, F.col("killed") / (base - F.col("error"))).otherwise(0.0)
    return made.withColumns({"score": F.round(score, 4), "rate": F.round(safe_ratio(F.col("killed"), base), 4)})


def quality_product(files: DataFrame, keys: Sequence[str], useful: str, domains: str) -> DataFrame:
    """The mean over runs of useful x domains (a mean of products)."""
    return files.groupBy(*keys).agg(F.avg(F.col(useful) * F.col(domains)).alias("quality"))


def weighted_score(simple: Column, complex_: Column, docs: Column, weights: tuple[float, float, float] = (1, 2, 1)) -> Column:
    """D8."""
    return simple * weights[0] + complex_ * weights[1] + docs * weights[2]


def file_fold(df: DataFrame, key: str, pos: str, text: str, norm: Column, domain: Column, trivial: Column, complex_: Column) -> DataFrame:
    """Total, unique, trivial, complex, useful rows and domains of each file. Domains count before duplicates go, the rest after."""
    w = Window.partitionBy(key, "__norm").orderBy(pos)
    rows = df.select(key, pos, norm.alias("__norm"), domain.alias("__domain"), trivial.alias("__trivial"), complex_.alias("__complex")).withColumn("__first", F.row_number().over(w) == 1)
    first = F.col("__first")
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(first).alias("n_unique"),
        F.count_if(first & F.col("__trivial")).alias("n_trivial"),
        F.count_if(first & F.col("__complex")).alias("n_complex"),
        F.count_if(first & ~F.col("__trivial")).alias("n_usable"),
        F.countDistinct("__domain").alias("n_domains"),
    )


def tier_one(df: DataFrame, key: str, pos: str, norm: Column, *axes: Column) -> DataFrame:
    """Rows that hold on all axes and are the first of their normal form. Rows that fail an axis still claim their form."""
    w = Window.partitionBy(key, "__norm").orderBy(pos)
    rows = df.select(key, pos, norm.alias("__norm"), *[a.alias(f"__a{i}") for i, a in enumerate(axes)])
    rows = rows.withColumn("__unique", F.row_number().over(w) == 1)
    good = F.col("__unique")
    for i in range(len(axes)):
        good = good & F.coalesce(F.col(f"__a{i}"), F.lit(False))
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.count_if("__unique").alias("n_unique"), F.count_if(good).alias("tier_one"))


def kind_counts(df: DataFrame, key: str, kind: str, hit: Column, kinds: Sequence[str]) -> DataFrame:
    """Rows and hits of each kind, and of all."""
    each = [c for k in kinds for c in (F.count_if(F.col(kind) == k).alias(f"{k}_total"), F.count_if((F.col(kind) == k) & hit).alias(f"{k}_hit"))]
    return df.groupBy(key).agg(*each, F.count(F.lit(1)).alias("total"), F.count_if(hit).alias("hit"))


def sampled_counts(df: DataFrame, code: str, sample: str, order: str, most: int = 3) -> DataFrame:
    """Rows of each code with the first few samples, the most frequent first."""
    w = Window.partitionBy(code).orderBy(order)
    rows = df.select(code, sample, F.row_number().over(w).alias("__rn"))
    listed = F.array_sort(F.collect_list(F.when(F.col("__rn") <= most, F.struct("__rn", F.col(sample).alias("s")))))
    return rows.groupBy(code).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(listed, lambda x: x["s"].cast("string")), "|").alias("samples"))


def membership(df: DataFrame, key: str, a: Column, b: Column, names=("comb", "seq", "mixed")) -> DataFrame:
    """Which of two kinds a key's rows are: one, the other or both."""
    made = df.groupBy(key).agg(F.bool_or(a).alias("__a"), F.bool_or(b).alias("__b"))
    return made.select(key, F.when(F.col("__a") & F.col("__b"), names[2]).when(F.col("__a"), names[0]).when(F.col("__b"), names[1]).alias("kind"))


def upsert_counts(old: DataFrame, new: DataFrame, key: str, n: str) -> DataFrame:
    """Two counter tables added up."""
    joined = old.select(key, F.col(n).alias("__o")).join(new.select(key, F.col(n).alias("__n")), key, "full")
    return joined.select(key, (F.coalesce("__o", F.lit(0)) + F.coalesce("__n", F.lit(0))).alias(n))


def denylist(counts: DataFrame, key: str, n: str, known: DataFrame, most: int) -> DataFrame:
    """The most frequent names that are still unknown, by (-count, name)."""
    return counts.join(known.select(key).distinct(), key, "left_anti").orderBy(F.desc(n), key).limit(most)
