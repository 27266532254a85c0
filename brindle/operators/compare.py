"""Joins that compare, look up and fall back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import reduction


def status_join(items: DataFrame, results: DataFrame, key: str, status: str, default: str = "error") -> DataFrame:
    """Items with their results' status; the default where there is none. Spark broadcasts results only if they are small."""
    found = results.select(key, F.col(status).alias("__s"))
    return items.join(found, key, "left").withColumn(status, F.coalesce("__s", F.lit(default))).drop("__s")


def ab_delta(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """A, b, a - b and which is better by label; a label of one run only counts 0 in the other."""
    joined = a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key, "full")
    one, two = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    mark = F.when(one > two, "worse").when(one < two, "better").otherwise("")
    return joined.select(key, one.alias("a"), two.alias("b"), (one - two).alias("delta"), mark.alias("mark"))


def pivot_reduction(df: DataFrame, key: str, variant: str, value: str, ours: str, naive: str) -> DataFrame:
    """Sums of two variants side by side, and the reduction as text."""
    wide = df.groupBy(key).agg(F.sum(F.when(F.col(variant) == ours, F.col(value))).alias("ours"), F.sum(F.when(F.col(variant) == naive, F.col(value))).alias("naive"))
    return wide.withColumn("reduction", F.coalesce(reduction(F.col("ours"), F.col("naive")), F.lit("n/a")))


def lookup(items: DataFrame, table: DataFrame, exact: Sequence[str], loose: Sequence[str], value: str) -> DataFrame:
    """Value by all of exact, else by loose alone (rows of table whose other keys are empty)."""
    rest = [k for k in exact if k not in loose]
    best = table.select(*exact, F.col(value).alias("__e"))
    wide = table.where(" AND ".join(f"`{k}` = ''" for k in rest)).select(*loose, F.col(value).alias("__l"))
    return items.join(best, list(exact), "left").join(wide, list(loose), "left").withColumn(value, F.coalesce("__e", "__l")).drop("__e", "__l")


def fan_out(table: DataFrame, run: str, method: str, value: str, pos: str) -> DataFrame:
    """A10: each row under its run id with and without leading zeros, and under its method and none; later rows win."""
    runs = F.array_distinct(F.array(F.col(run), F.regexp_replace(run, "^0+(?=.)", "")))
    rows = table.select(F.explode(runs).alias("run"), F.col(method).alias("__m"), F.col(value).alias("__v"), F.col(pos).alias("__p"))
    rows = rows.select("run", F.explode(F.array_distinct(F.array(F.col("__m"), F.lit("")))).alias("method"), "__v", "__p")
    return rows.groupBy("run", "method").agg(F.max_by("__v", "__p").alias(value))


def suffix_partners(names: DataFrame, name: str, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Initiator and responder that differ in a pair of suffixes. The longest suffix counts; one match for each initiator."""
    ordered = sorted(rules, key=lambda r: (-len(r[0]), r))
    cases = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate(ordered)])
    known = names.select(F.col(name).alias("n")).distinct()
    guesses = known.select("n", F.explode(cases).alias("r")).where(F.col("n").endswith(F.col("r.a")))
    guesses = guesses.select(F.col("n").alias("initiator"), F.expr("concat(substring(n, 1, char_length(n) - char_length(r.a)), r.b)").alias("n"), F.col("r.rank").alias("rank"))
    hits = guesses.join(known, "n").where("initiator <> n").groupBy("initiator").agg(F.min(F.struct("rank", F.col("n").alias("responder"))).alias("best"))
    pairs = hits.select("initiator", F.col("best.responder").alias("responder"), F.col("best.rank").alias("rank"))
    return pairs.groupBy(F.least("initiator", "responder").alias("lo"), F.greatest("initiator", "responder").alias("hi")).agg(F.min(F.struct("rank", "initiator", "responder")).alias("p")).select("p.initiator", "p.responder")


def glob_matches(globs: DataFrame, pattern: str, keys: DataFrame, key: str, literals: DataFrame | None = None, most: int = 30) -> DataFrame:
    """Keys that match a glob, in the order of patterns and keys, then literals, the first few of each group. globs: a small rules table."""
    as_regex = F.concat(F.lit("(?i)^"), F.replace(F.replace(F.col(pattern), F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))
    from pyspark.sql import Window

    hits = keys.join(F.broadcast(globs.withColumn("__re", as_regex)), F.expr(f"`{key}` rlike __re"))
    w = Window.partitionBy("group").orderBy("pos", key)
    first = hits.groupBy("group", key).agg(F.min("pos").alias("pos"))
    return first.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)


def scope_filter(rows: DataFrame, module: str, depths: DataFrame, most: int) -> DataFrame:
    """Rows of modules at most that deep; a negative depth takes all."""
    if most < 0:
        return rows
    return rows.join(depths.where(F.col("depth") <= most).select(F.col("module").alias(module)), module, "left_semi")


def tolerant(value: Column) -> Column:
    """Missing or null numbers count 0."""
    return F.coalesce(value.try_cast("double"), F.lit(0.0))
