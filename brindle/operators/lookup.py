"""Lookups, ranked sections and unions over name tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.text import IDENT


def glob_pattern(glob: str) -> str:
    """The regular expression of a file glob: * and ? cross folders, [...] is a set and [!...] its complement."""
    out, i = "", 0
    while i < len(glob):
        c, i = glob[i], i + 1
        end = glob.find("]", i + 1 + (glob[i : i + 1] == "!")) if c == "[" else -1
        if c == "[" and end >= 0:
            held = glob[i:end].replace("\\", r"\\").replace("[", r"\[").replace("&", r"\&")
            out, i = out + "[" + ("^" + held[1:] if held[0] == "!" else held) + "]", end + 1
        else:
            out += ".*" if c == "*" else "." if c == "?" else re.escape(c)
    return f"(?s)^{out}$"


def by_globs(df: DataFrame, name: Column, include: tuple[str, ...] = ("*",), exclude: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose name matches some glob of include and none of exclude."""
    some = lambda globs: name.rlike("|".join(map(glob_pattern, globs))) if globs else F.lit(False)
    return df.where(some(include) & ~some(exclude))


def containing(df: DataFrame, name: str, part: str) -> DataFrame:
    """The rows whose name holds part in either case, found true; if there is none, all rows, found false."""
    hit = F.contains(F.lower(name), F.lit(part.lower()))
    any_ = df.agg(F.coalesce(F.max(hit), F.lit(False)).alias("found"))  # one row
    return df.crossJoin(F.broadcast(any_)).where(hit | ~F.col("found"))


def exactly(wanted: DataFrame, df: DataFrame, name: str) -> DataFrame:
    """The rows of each wanted name; a name without rows is one row, found false."""
    return wanted.select(name).distinct().join(df.withColumn("found", F.lit(True)), name, "left").fillna(False, ["found"])


def base_identifier(target: Column) -> Column:
    """The first name of a target, without selects and braces."""
    return F.trim(F.get(F.split(F.trim(F.regexp_replace(target, r"\[.*?\]|\{.*?\}", "")), ","), F.lit(0)))


# Kinds of statements that only allowed names keep.
TRIVIAL_KINDS = ("direct_assign", "wire_passthrough", "comb_comparison")


def of_allowed(rows: DataFrame, kind: str, target: str, allowed: DataFrame, name: str) -> DataFrame:
    """Rows of a trivial kind stay only if the base identifier of their target is allowed or empty; without any allowed name all stay."""
    names = allowed.select(F.col(name).alias("__base")).distinct().withColumn("__known", F.lit(True))
    any_ = names.agg((F.count(F.lit(1)) > 0).alias("__any"))  # one row
    base = base_identifier(F.col(target))
    joined = rows.crossJoin(F.broadcast(any_)).join(names, base == F.col("__base"), "left")
    stays = ~F.col("__any") | ~F.col(kind).isin(*TRIVIAL_KINDS) | (base == "") | F.col("__known").isNotNull()
    return joined.where(stays).select(*rows.columns)


def participation(ports: DataFrame, bodies: DataFrame, connections: DataFrame) -> DataFrame:
    """C17: name, module: the modules of which a name is a port, in whose body it stands, or which a connection of it joins.

    ports, bodies: name, module; connections: name, parent, child."""
    ends = connections.select("name", F.explode(F.array("parent", "child")).alias("module"))
    return ports.select("name", "module").union(bodies.select("name", "module")).union(ends).where("module IS NOT NULL AND module <> ''").distinct()


def name_counts(df: DataFrame, text: str) -> DataFrame:
    """Name, n: how often each identifier occurs, most first, then by name."""
    names = df.select(F.explode(F.regexp_extract_all(text, F.lit(rf"\b({IDENT})\b"), F.lit(1))).alias("name"))
    return names.groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name")


def listed(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The sorted distinct names of each group, and their number."""
    distinct = df.select(*keys, name).where(F.col(name).isNotNull()).distinct()
    return distinct.groupBy(*keys).agg(F.array_sort(F.collect_list(name)).alias("names"), F.count(F.lit(1)).alias("n"))


def run_matrix(runs: DataFrame, cell: list[str], ok: Column) -> DataFrame:
    """Runs, succeeded and failed of each cell."""
    return runs.groupBy(*cell).agg(F.count(F.lit(1)).alias("runs"), F.count_if(ok).alias("succeeded"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("failed"))


def denylist_totals(df: DataFrame, name: str, count: str) -> DataFrame:
    """One row: distinct names, and the sum of the counts that are numbers (their whole part)."""
    number = F.expr(f"cast(try_cast(`{count}` AS double) AS bigint)")
    return df.agg(F.countDistinct(name).alias("n_names"), F.coalesce(F.sum(number), F.lit(0)).alias("total"))


def ranked_properties(props: DataFrame, signals: str, sentence: str, priority: DataFrame, name: str, most: int = 12) -> DataFrame:
    """the first properties by most priority signals, most signals, then the sentence, with their place."""
    each = props.withColumn("__k", F.monotonically_increasing_id())
    hits = each.select("__k", F.explode(F.array_distinct(signals)).alias("__s")).join(priority.select(F.col(name).alias("__s")).distinct(), "__s", "left_semi").groupBy("__k").agg(F.count(F.lit(1)).alias("n_priority"))
    top = each.join(hits, "__k", "left").fillna(0, ["n_priority"]).withColumn("n_signals", F.size(signals)).orderBy(F.desc("n_priority"), F.desc("n_signals"), sentence).limit(most)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n_priority"), F.desc("n_signals"), sentence))).drop("__k")  # most rows


def ranked_pairs(pairs: DataFrame, frequencies: DataFrame, important: DataFrame, most: int = 12, bonus: int = 100) -> DataFrame:
    """the first pairs of high confidence by score, then initiator: both ends' frequencies and the bonus for each important end.

    pairs: initiator, responder, confidence; frequencies: name, freq; important: name."""
    worth = frequencies.select("name", F.col("freq").alias("w")).union(important.select("name", F.lit(bonus).cast("long"))).groupBy("name").agg(F.sum("w").alias("w"))
    out = pairs.where("confidence = 'high'")
    for end in ("initiator", "responder"):
        out = out.join(worth.select(F.col("name").alias(end), F.col("w").alias(f"__{end}")), end, "left")
    score = F.coalesce("__initiator", F.lit(0)) + F.coalesce("__responder", F.lit(0))
    return out.withColumn("score", score).select(*pairs.columns, "score").orderBy(F.desc("score"), "initiator", "responder").limit(most)


def ends(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first and the last n rows in order (which may overlap), with which of the two."""
    first = df.orderBy(F.col(order)).limit(n).withColumn("end", F.lit("head"))
    return first.unionByName(df.orderBy(F.col(order).desc()).limit(n).withColumn("end", F.lit("tail")))


def coverage_events(resets: DataFrame, documents: DataFrame, cases: DataFrame, key: str) -> DataFrame:
    """Kind, key: events of three sources, each key of a kind once; cases need a selector, a target and a condition."""
    whole = cases.where("selector IS NOT NULL AND selector <> '' AND lhs IS NOT NULL AND lhs <> '' AND condition IS NOT NULL AND condition <> ''")
    kinds = (("reset", resets), ("documented", documents), ("case", whole))
    made = [df.select(F.lit(k).alias("kind"), F.col(key).alias("key")).where("key IS NOT NULL").distinct() for k, df in kinds]
    return made[0].union(made[1]).union(made[2])


def appended(rows: DataFrame, more: DataFrame, pos: str) -> DataFrame:
    """Rows with more behind them, each cleaned on its own before; nothing is compared across."""
    return rows.withColumn("part", F.lit(0)).unionByName(more.withColumn("part", F.lit(1))).orderBy("part", pos)
