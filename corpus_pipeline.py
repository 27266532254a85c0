"""The corpus pipeline: documents in, packed sequences out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import credentials, jaccard, linededup, packing, quality
from brindle.llm.store import fresh, table, written


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeated runs of lines; those of which no word is left go. n_chars follows the text."""
    (deleted,) = fresh(docs, "deleted")
    made = linededup.dedup(docs, deleted_col=deleted)
    some_left = F.col(deleted).isNull() | F.col("text").rlike(linededup.WORD)
    return made.where(some_left).withColumn("n_chars", F.when(F.col(deleted).isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long"))).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates."""
    return jaccard.one_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced by a mark. n_chars follows the text."""
    (was,) = fresh(docs, "was")
    made = credentials.redact(docs.withColumn(was, F.col("text")))
    return made.withColumn("n_chars", F.when(F.col(was).eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(F.char_length("text").cast("long"))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences with their token ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", good), ("line dedup", fresh_lines), ("n-gram Jaccard join", one_of_each), ("secret scans", without_secrets), ("packing", packed)]

#: The classifier, the components and the packing have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
