"""The bounded check-and-refine loop: what passes is kept, what fails is refined and tried again.

Each round is a written table in a folder that the cluster shares, complete or absent, so a run that was killed goes on after its last
whole round. A text is checked once, however many rows hold it, as checks may be dear.

Defined results: a null text fails as missing; rows of equal id and text are rows of their own; a refinement may give fewer
or more rows, also none, which ends the loop; an empty table gives no rows; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "id string, text string, error string"
ENDS = ("ALL_PASSED", "NO_REFINEMENT", "EMPTY_REFINEMENT", "MAX_ITERATIONS_REACHED")


def by_function(check: Callable[[str], str | None]) -> Callable[[Column], Column]:
    """A check from a function of a text that returns an error or None; it runs on batches of distinct texts."""
    return lambda text: F.pandas_udf(lambda s: s.map(check).astype("object"), "string")(text)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def checked(rows: DataFrame, check: Callable[[Column], Column]) -> DataFrame:
    """O2: rows (id, text) with error, null for those that pass; each distinct text is checked once."""
    texts = rows.select(F.col("text").alias("t")).where("t IS NOT NULL").distinct()
    found = texts.select("t", check(F.col("t")).alias("e"))
    joined = rows.select("id", "text").join(found, F.col("text") == F.col("t"), "left")
    return joined.select(F.col("id").cast("string").alias("id"), "text", F.when(F.col("text").isNull(), "missing").otherwise(F.col("e")).alias("error"))


def loop(rows: DataFrame, check: Callable[[Column], Column], refine: Callable[[DataFrame], DataFrame] | None, folder: str, rounds: int = 3) -> tuple[DataFrame, pd.DataFrame, str]:
    """(passed: id, text, round; a row for each round: round, total, passed, failed; how it ended).

    refine takes the failed rows (id, text, error) and gives rows (id, text) for the next round; None ends after the first.
    Calling again with the same folder goes on where the last call was stopped."""
    spark, passed, report, end = rows.sparkSession, [], [], ENDS[3]
    rows = rows.select("id", "text")
    for number in range(1, rounds + 1):
        path = f"{folder.rstrip('/')}/round-{number}"
        if not _exists(spark, f"{path}/_SUCCESS"):
            checked(rows, check).write.mode("overwrite").parquet(path)
        held = spark.read.schema(ROW).parquet(path)
        failed, total = held.agg(F.count("error"), F.count(F.lit(1))).first()
        if not total and number > 1:
            end = ENDS[2]
            break
        report.append((number, total, total - failed, failed))
        passed.append(held.where("error IS NULL").select("id", "text", F.lit(number).alias("round")))
        if not failed:
            end = ENDS[0]
            break
        if refine is None:
            end = ENDS[1]
            break
        rows = refine(held.where("error IS NOT NULL")).select("id", "text")
    out = passed[0]
    for more in passed[1:]:
        out = out.union(more)
    return out, pd.DataFrame(report, columns=["round", "total", "passed", "failed"]), end
