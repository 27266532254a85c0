"""Set-overlap coverage by equi-joins on tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.graph import cut


def need(n: Column) -> Column:
    """ceil(n / 2), at least 1."""
    return F.greatest(F.ceil(n / 2), F.lit(1))


def overlap(events: DataFrame, event: str, wanted: str, texts: DataFrame, text: str, given: str) -> DataFrame:
    """C4: for each event whether some text holds at least need() of its tokens, and the most any text holds.

    An event's tokens are taken from the rarest on: of its n tokens a text without the p rarest holds n - p at most. So the first
    n - need() + 1 bring all texts that could cover it, and with the best of those, b, the first n - b all that could hold more: common
    tokens, which nearly all texts hold, mostly meet no text at all. A text that is brought is counted in full only if what it may
    still hold reaches the event's best. Tokens of no event never leave their stage (semi-join)."""
    of_event = events.select(F.col(event).alias("e"), F.explode(F.array_distinct(wanted)).alias("t")).distinct()
    of_text = cut(texts.select(F.col(text).alias("x"), F.explode(F.array_distinct(given)).alias("t")).join(of_event.select("t").distinct(), "t", "left_semi").distinct())
    rarity = of_text.groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    w = Window.partitionBy("e")
    ranked = of_event.join(rarity, "t", "left").withColumns({"i": F.row_number().over(w.orderBy(F.coalesce("df", F.lit(0)), "t")), "n": F.count(F.lit(1)).over(w)})
    ranked = cut(ranked.withColumns({"p": F.col("n") - need(F.col("n")) + 1, "best": F.lit(0).cast("long")}))
    first = cut(_most(ranked, of_text))
    known = ranked.drop("best").join(first, "e", "left").withColumn("best", F.coalesce("best", F.lit(0).cast("long")))
    rest = cut(known.where("best < n - p").withColumn("p", F.col("n") - F.col("best")))
    best = first if rest.isEmpty() else first.union(_most(rest, of_text)).groupBy("e").agg(F.max("best").alias("best"))
    out = events.select(F.col(event).alias("e"), F.size(F.array_distinct(wanted)).alias("n")).join(best, "e", "left")
    return out.select(F.col("e").alias(event), "n", F.coalesce("best", F.lit(0)).alias("best"), ((F.col("n") > 0) & (F.coalesce("best", F.lit(0)) >= need(F.col("n")))).alias("covered"))


def brought(ranked: DataFrame, of_text: DataFrame) -> DataFrame:
    """e, x, c, n, p, best: texts that hold c (one or more) of an event's p rarest tokens (ranked: e, t, i, n, p, best; of_text: x, t)."""
    return ranked.where("i <= p").join(of_text, "t").groupBy("e", "x").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n"), F.first("p").alias("p"), F.first("best").alias("best"))


def _most(ranked: DataFrame, of_text: DataFrame) -> DataFrame:
    """e, best: the most tokens that any brought text holds."""
    pairs = cut(brought(ranked, of_text))
    least = pairs.groupBy("e").agg(F.max(F.greatest("c", "best")).alias("least"))
    open_ = pairs.join(least, "e").where("c + n - p >= least").select("e", "x", "c")
    more = open_.join(ranked.where("i > p").select("e", "t"), "e").join(of_text, ["x", "t"], "left_semi").groupBy("e", "x").agg(F.count(F.lit(1)).alias("more"))
    return open_.join(more, ["e", "x"], "left").groupBy("e").agg(F.max(F.col("c") + F.coalesce("more", F.lit(0))).alias("best"))


def subset(events: DataFrame, event: str, wanted: str, texts: DataFrame, given: str) -> DataFrame:
    """For each event whether all its tokens occur in the texts together."""
    all_ = texts.select(F.explode(given).alias("t")).distinct()
    missing = events.select(F.col(event).alias("e"), F.explode(F.array_distinct(wanted)).alias("t")).join(all_, "t", "left_anti").groupBy("e").agg(F.count(F.lit(1)).alias("n_missing"))
    out = events.select(F.col(event).alias("e"), F.size(F.array_distinct(wanted)).alias("n")).join(missing, "e", "left")
    return out.select(F.col("e").alias(event), "n", F.coalesce("n_missing", F.lit(0)).alias("n_missing"), ((F.col("n") > 0) & F.col("n_missing").isNull()).alias("covered"))


def majority_known(rows: DataFrame, row: str, tokens: str, known: DataFrame, word: str, share: float = 0.5) -> DataFrame:
    """Each row's tokens, how many are known, and whether it stays (a row with exactly the share stays, one without tokens too)."""
    each = rows.select(F.col(row).alias("r"), F.explode(F.array_distinct(tokens)).alias("t"))
    marked = each.join(known.select(F.col(word).alias("t")).distinct().withColumn("k", F.lit(1)), "t", "left")
    counts = marked.groupBy("r").agg(F.count(F.lit(1)).alias("n"), F.count("k").alias("n_known"))
    out = rows.select(F.col(row).alias("r")).join(counts, "r", "left").fillna(0, ["n", "n_known"])
    return out.select(F.col("r").alias(row), "n", "n_known", ((F.col("n") == 0) | (F.col("n_known") >= share * F.col("n"))).alias("kept"))


def unknown_names(rows: DataFrame, tokens: str, known: DataFrame, word: str) -> DataFrame:
    """Unknown tokens and the number of rows that hold them."""
    each = rows.select(F.explode(F.array_distinct(tokens)).alias(word))
    return each.join(known.select(word).distinct(), word, "left_anti").groupBy(word).agg(F.count(F.lit(1)).alias("n"))


def out_of_scope(rows: DataFrame, row: str, tokens: str, names: DataFrame, word: str, patterns: tuple[str, ...] = ()) -> DataFrame:
    """Rows that hold none of the names and no token that a pattern matches."""
    listed = rows.select(F.col(row).alias("r"), F.explode(tokens).alias("t"))
    bad = listed.join(names.select(F.col(word).alias("t")).distinct(), "t", "left_semi").select("r")
    if patterns:
        bad = bad.union(listed.where(F.col("t").rlike("|".join(f"(?:{p})" for p in patterns))).select("r"))
    return rows.join(bad.distinct().withColumnRenamed("r", row), row, "left_anti")


def pair_links(rows: DataFrame, row: str, tokens: str, edges: DataFrame) -> DataFrame:
    """Of the pairs of a row's tokens (few) the share that an edge (a, b; both directions count) links."""
    pairs = F.flatten(F.transform(tokens, lambda a: F.transform(F.filter(tokens, lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    each = rows.select(F.col(row).alias("r"), F.explode(pairs).alias("p")).select("r", "p.a", "p.b")
    known = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().withColumn("hit", F.lit(1))
    return each.join(known, ["a", "b"], "left").groupBy("r").agg(F.count(F.lit(1)).alias("n_pairs"), F.count("hit").alias("n_linked")).withColumnRenamed("r", row)
