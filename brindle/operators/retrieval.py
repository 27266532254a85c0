"""Cosine and BM25 retrieval, rank fusion and two-stage retrieval."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.operators.clean import bound
from brindle.operators.graph import cut

# Okapi BM25's parameters and the rank fusion constant.
K1, B, RRF_K = 1.5, 0.75, 60


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def dense_topk(queries: DataFrame, rows: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", block: int = 4096) -> DataFrame:
    """L1/F1: query, id, score, rank of the k nearest by cosine. queries: query, q. Blocks of queries meet blocks of rows, and the k best of each meeting are
    merged. Scores are rounded to 12 digits before they are ranked. Vectors with a null, without a length or of no element take no part."""
    fine = lambda df, c: df.where(F.coalesce(F.size(c) > 0, F.lit(False)) & F.forall(c, lambda x: x.isNotNull()) & (dot(F.col(c), F.col(c)) > 0))
    asks = fine(queries.select("query", F.col("q").cast("array<double>").alias("v")), "v")
    held = fine(rows.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v")), "v")
    n_asks, n_held = max(1, -(-asks.count() // block)), max(1, -(-held.count() // block))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asks = asks.withColumn("a", F.pmod(F.xxhash64("query"), F.lit(n_asks)).cast("int")).withColumn("b", each(n_held))
    held = held.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(n_held)).cast("int")).withColumn("a", each(n_asks))

    def meet(_: tuple, qs: pd.DataFrame, vs: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query": qs["query"][:0], "id": vs["id"][:0], "score": np.zeros(0)})]
        for size, q in qs.groupby(qs.v.map(len)):
            v = vs[vs.v.map(len) == size].sort_values("id", kind="stable")
            if not len(v):
                continue
            x, y = np.stack(q.v), np.stack(v.v)
            scores = np.round(x @ y.T / np.sqrt(np.outer((x * x).sum(1), (y * y).sum(1))), 12)
            for n, s in zip(q["query"], scores):
                at = np.argsort(-s, kind="stable")[:k]
                out.append(pd.DataFrame({"query": n, "id": v["id"].array.take(at), "score": s[at]}))
        return pd.concat(out)

    kinds = f"query {dict(queries.dtypes)['query']}, id {dict(rows.dtypes)[id_col]}, score double"
    made = asks.groupBy("a", "b").cogroup(held.groupBy("a", "b")).applyInPandas(meet, kinds)
    return ranked(made.withColumnRenamed("id", id_col), k, id_col)


def ranked(scored: DataFrame, k: int, id_col: str) -> DataFrame:
    """rank counts from 0; ties go to the smaller id."""
    w = Window.partitionBy("query").orderBy(F.desc("score"), id_col)
    # the filter on the row number itself lets each task keep its own k best before the shuffle
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)


def postings(rows: DataFrame, id_col: str, tokens: str) -> DataFrame:
    """Term, id, tf, length: a table to be written once."""
    each = rows.select(id_col, F.size(tokens).alias("length"), F.explode(tokens).alias("term"))
    return each.groupBy("term", id_col).agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))


def counted(tokens: Column) -> Column:
    """term, tf of the distinct tokens, in one array, by one sort. Null tokens are no terms."""

    def starts(said: Column) -> Column:
        return F.filter(F.transform(said, lambda _, i: i), lambda i: (i == 0) | (F.get(said, i) != F.get(said, i - 1)))

    def runs(said: Column) -> Column:
        return bound(starts(said), lambda at: F.transform(at, lambda i, k: F.struct(F.get(said, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(said)) - i).cast("long").alias("tf"))))

    return bound(F.array_sort(F.array_compact(tokens)), runs)


def bm25(rows: DataFrame, id_col: str, tokens: str, queries: DataFrame, n_docs: DataFrame, epsilon: float = 0.25) -> DataFrame:
    """L2/F2: query, id, score. rows: id, tokens (an array); queries: query, term. n_docs: one row n, mean_length.

    idf = ln((n - df + 0.5) / (df + 0.5)), where negative epsilon times the mean idf of all terms. A row's terms are counted once, in the row, and
    written; a row's hits stay in its task, so that what is shuffled is a score for each query and row, not one for each term of it. Rows of
    one id are one row, with the length of one of them."""
    held = cut(rows.select(id_col, F.size(tokens).alias("length"), counted(F.col(tokens)).alias("counts")))
    each = held.select(id_col, "length", F.inline("counts"))
    df = held.select(F.explode("counts.term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    terms = df.crossJoin(F.broadcast(n_docs)).withColumn("raw", F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5))  # one row
    mean = terms.agg(F.avg("raw").alias("mean_raw"))
    wanted = terms.join(queries.select("term").distinct(), "term", "left_semi").crossJoin(F.broadcast(mean))
    idf = wanted.select("term", "mean_length", F.when(F.col("raw") < 0, epsilon * F.col("mean_raw")).otherwise(F.col("raw")).alias("idf"))
    asked = cut(queries.join(idf, "term"))
    if not held.groupBy(id_col).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").isEmpty():
        each = each.groupBy("term", id_col).agg(F.sum("tf").alias("tf"), F.first("length").alias("length"))
    hits = each.join(asked, "term")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    return hits.groupBy("query", id_col).agg(F.sum(part).alias("score"))


def fuse(dense: DataFrame, sparse: DataFrame, k: int, id_col: str) -> DataFrame:
    """Reciprocal-rank fusion of two ranked tables, 1 / (60 + rank) with ranks from 0; ties go to the smaller id.

    With the text as id_col the lists meet where their texts are equal."""
    both = dense.select("query", id_col, F.col("rank").alias("d")).join(sparse.select("query", id_col, F.col("rank").alias("s")), ["query", id_col], "full")
    part = lambda c: F.coalesce(1 / (RRF_K + F.col(c)), F.lit(0.0))
    return ranked(both.select("query", id_col, (part("d") + part("s")).alias("score")), k, id_col)


def built_or_loaded(spark: SparkSession, path: str, stamp: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at path if it was built under this stamp (a checksum of what it is made from), else built and written there.

    The stamp is written last, so a table whose writing failed is built again."""
    try:
        if spark.read.text(f"{path}/stamp").collect() == [(stamp,)]:  # one row
            return spark.read.parquet(f"{path}/table")
    except AnalysisException:  # there is none yet
        pass
    build().write.mode("overwrite").parquet(f"{path}/table")
    spark.createDataFrame([(stamp,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/stamp")
    return spark.read.parquet(f"{path}/table")


def two_stage(hits: DataFrame, groups: DataFrame, k: int, id_col: str, group: str) -> DataFrame:
    """L4/C14: of ranked hits first those of the query's groups, then, if these are fewer than k, the others."""
    chosen = groups.select("query", group).distinct().withColumn("__in", F.lit(0))
    marked = hits.join(chosen, ["query", group], "left").withColumn("filled", F.col("__in").isNull())
    w = Window.partitionBy("query").orderBy("filled", "rank", id_col)
    return marked.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).withColumn("place", F.col("place") - 1).drop("__in")


def top_groups(hits: DataFrame, group: str, k: int, id_col: str) -> DataFrame:
    """The groups of the first k hits of each query."""
    return hits.where(F.col("rank") < k).select("query", group).distinct()


def index_kind(n_modules: int, hierarchical: bool, hybrid: bool, whole_context: bool) -> str:
    """Which index serves a run: hierarchical from five modules on, else hybrid, and dense where the whole source is in the context."""
    if whole_context:
        return "dense"
    return "hierarchical" if hierarchical and n_modules >= 5 else "hybrid" if hybrid else "dense"
