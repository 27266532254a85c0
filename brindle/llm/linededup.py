"""Repeated runs of lines, found by winnowing over line hashes.

Only lines with a word count; blank lines neither match nor break a run. A window is a shortest run of such lines with at
least MIN_WORDS words that starts (or ends) at a given line. Each window selects its smallest line hash (the last of equal
ones) as its fingerprint: neighbouring windows mostly select the same line, so a document has far fewer selected positions
than lines, and two documents that share a run of MIN_WORDS words select the same lines of it, wherever the run stands.

Positions are joined on fingerprints first: one that stands at a single position of the whole table can't be shared, and all
windows that selected it are done with. From the positions of the others a match is extended both ways: the windows through such
a position start and end at each line around it, and together those that occur again, by two hashes of their lines' hashes
(128 bits), cover exactly the shared run, from its first to its last line. So no two documents are compared in pairs, and a
run is found also where the first place of its fingerprint has other lines around it.

Of windows with equal content the one in the smallest (id, text hash, line) is the first; lines of all others are deleted,
but for one that overlaps the first in its own document. A group is never gathered: the first of each content is a minimum
with map-side combining, and joins are equi-joins that skew handling can split.

All is DataFrame expressions. Defined results: null or empty texts have no lines and stay as they are; rows with equal id
and text are one document, each kept the same way; null ids are an id of their own, before all others; an empty table gives
no rows; other columns pass through. Blank lines between deleted lines go with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.rules import WORD
from brindle.llm.store import fresh

MIN_WORDS = 50
KEY = ["id", "h"]


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def worded_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, h (the text's hash), line (its number), n (its words), hash, other (a second hash): a row for each line with a word.

    White space around a line doesn't count."""
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("h"), F.posexplode(_lines(F.col(text_col))).alias("line", "said"))
    line = F.regexp_replace("said", r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    rows = rows.select(*KEY, "line", F.xxhash64(line).alias("hash"), F.xxhash64(F.lit(1), line).alias("other"), F.regexp_count("said", F.lit(WORD + "+")).alias("n"))
    return rows.where("n > 0").dropDuplicates([*KEY, "line"])


def windows(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """id, h, first, last (line numbers), content (two hashes of the lines' hashes), fingerprint (the smallest of them), at (its line)."""
    doc = Window.partitionBy(*KEY).orderBy("line")
    rows = lines.withColumn("upto", F.sum("n").over(doc)).withColumn("before", F.col("upto") - F.col("n"))
    starting = Window.partitionBy(*KEY).orderBy("before").rangeBetween(0, min_words - 1)
    ending = Window.partitionBy(*KEY).orderBy("upto").rangeBetween(1 - min_words, 0)

    def of(frame) -> Column:
        made = F.struct(F.min("line").over(frame).alias("first"), F.max("line").over(frame).alias("last"), F.struct(F.xxhash64(F.collect_list("hash").over(frame)).alias("a"), F.xxhash64(F.collect_list("other").over(frame)).alias("b")).alias("content"), F.min(F.struct("hash", (-F.col("line")).alias("back"))).over(frame).alias("least"))
        return F.when(F.sum("n").over(frame) >= min_words, made)

    both = rows.select(*KEY, of(starting).alias("a"), of(ending).alias("b"))
    return both.select(*KEY, F.explode(F.array_distinct(F.array_compact(F.array("a", "b")))).alias("w")).select(*KEY, "w.first", "w.last", "w.content", F.col("w.least.hash").alias("fingerprint"), (-F.col("w.least.back")).alias("at"))


def shared_fingerprints(found: DataFrame) -> DataFrame:
    """fingerprint: those that were selected at two positions or more."""
    positions = found.groupBy("fingerprint", *KEY, "at").agg(F.count(F.lit(1)).alias("n_windows"))
    return positions.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fingerprint")


def repeated_windows(found: DataFrame) -> DataFrame:
    """id, h, first, last, source (id, h, first, last of the first window of that content) of the windows that aren't first."""
    candidates = found.join(shared_fingerprints(found), "fingerprint", "left_semi")
    place = F.struct("id", "h", "first", "last")
    # of a content's windows two counts and the first: partial aggregates make one row for each content and task
    firsts = candidates.groupBy("content").agg(F.min(place).alias("source"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    joined = candidates.join(firsts, "content")
    own = F.col("id").eqNullSafe(F.col("source.id")) & (F.col("h") == F.col("source.h"))
    return joined.where(~own | (F.col("first") > F.col("source.last"))).select(*KEY, "first", "last", "source")


def runs(df: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, h, first, last, source: each run of lines to delete, extended as far as its windows reach."""
    hits = repeated_windows(windows(worded_lines(df, id_col, text_col), min_words))
    upto = Window.partitionBy(*KEY).orderBy("first", "last")
    reach = F.max("last").over(upto.rowsBetween(Window.unboundedPreceding, -1))
    islands = hits.withColumn("new", F.coalesce(F.col("first") > reach + 1, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(upto))
    return islands.groupBy(*KEY, "run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min_by("source", F.struct("first", "last")).alias("source")).drop("run")


def dedup(df: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", deleted_col: str | None = None) -> DataFrame:
    """df with later repeated runs of lines taken out of its text, and in deleted_col, if it is named, an array of
    struct<first, last, source> of line numbers (null where nothing is deleted)."""
    found = runs(df, min_words, id_col, text_col)
    id_, h, deleted = fresh(df, "own_id", "own_h", "own_deleted")
    listed = found.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("first", "last", "source"))).alias(deleted)).withColumnsRenamed({"id": id_, "h": h})
    joined = df.join(listed, F.col(id_col).eqNullSafe(F.col(id_)) & (F.xxhash64(F.col(text_col)) == F.col(h)), "left")
    kept = F.filter(_lines(F.col(text_col)), lambda x, i: ~F.exists(deleted, lambda r: (r["first"] <= i) & (i <= r["last"])))
    made = joined.withColumn(text_col, F.when(F.col(deleted).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")))
    return made.select(*df.columns, *([F.col(deleted).alias(deleted_col)] if deleted_col else []))
