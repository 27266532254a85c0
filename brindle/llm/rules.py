"""Rule bitmask ledger.

Every rule is evaluated once for each document. The ledger keeps what was measured and one bit for each rule that failed.
A policy is a named, versioned set of rules, so keeping, re-filtering under another policy and ablations are integer
operations on the ledger and never touch the text again.

Words are runs of other characters than space, tab, newline, vertical tab, form feed and carriage return. All is
DataFrame expressions; a document is measured within its row, so nothing is shuffled for the ledger.

Defined results: a null or empty text has no words (it fails MIN_WORDS); measurements that divide by no words are 0;
repeated rows are measured each by itself; null ids pass through; an empty table gives an empty ledger; other columns
take no part. A very long text is one row of arrays, as large as a few times the text.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words, n_upper_words, n_letters."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    rows = rows.select("id", "text", words_of(F.col("text")).alias("words"), lines.alias("lines"))
    n = F.size("words")
    windows = F.when(
        n >= 3,
        F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.struct(F.concat_ws(" ", F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("w"), i.alias("at"))),
    ).otherwise(F.array().cast("array<struct<w:string,at:int>>"))
    rows = rows.select(
        "id",
        n.cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.char_length(w)).alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w: (F.char_length(w) > 1) & (F.upper(w) == w) & (F.lower(w) != w))).cast("long").alias("n_upper_words"),
        F.regexp_count("text", F.lit(r"\p{L}")).cast("long").alias("n_letters"),
        F.sort_array(windows).alias("s"),
    )
    # a window stands at a repeated place if its neighbour in sorted order is equal
    same = lambda x, i: F.coalesce(F.get("s", i - 1)["w"] == x["w"], F.lit(False)) | F.coalesce(F.get("s", i + 1)["w"] == x["w"], F.lit(False))
    rows = rows.withColumn("at", F.sort_array(F.transform(F.filter("s", same), lambda x: x["at"]))).drop("s")
    # words in these windows: each adds as many as lie beyond the window before it
    covered = F.aggregate(F.transform("at", lambda x, i: F.coalesce(F.least(x - F.get("at", i - 1), F.lit(3)), F.lit(3))), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.withColumn("n_repeat_words", covered).drop("at").withColumnRenamed("id", id_col)


def _over(top: str, bottom: str, limit: float) -> Column:
    """top / bottom > limit, false if there is nothing to divide by."""
    return (F.col(bottom) > 0) & (F.col(top) > limit * F.col(bottom))


#: What a ledger measures.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper_words", "n_letters")
#: The rules in the order of their bits; a true value is a failure. New rules go to the end, so that stored bits keep their meaning.
RULES: Mapping[str, Column | None] = {
    name: None for name in ("MIN_WORDS", "REPEATED_WORDS", "SHORT_WORDS", "LONG_WORDS", "SYMBOLS", "DUPLICATE_LINES", "UPPER_WORDS", "FEW_LETTERS")
}


def failures() -> dict[str, Column]:
    found = {
        "MIN_WORDS": F.col("n_words") < 50,
        "REPEATED_WORDS": 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
        "SHORT_WORDS": (F.col("n_words") > 0) & (F.col("word_chars") < 2 * F.col("n_words")),
        "LONG_WORDS": _over("word_chars", "n_words", 15),
        "SYMBOLS": _over("n_symbols", "n_words", 0.1),
        "DUPLICATE_LINES": (F.col("n_dup_lines") >= 3) & _over("n_dup_lines", "n_lines", 0.3),
        "UPPER_WORDS": _over("n_upper_words", "n_words", 0.5),
        "FEW_LETTERS": (F.col("word_chars") > 0) & (F.col("n_letters") < 0.5 * F.col("word_chars")),
    }
    assert list(found) == list(RULES)
    return found


#: Policies by version: the rules that reject. BASE holds the two rules that every policy has.
BASE = ("MIN_WORDS", "REPEATED_WORDS")
POLICIES: dict[str, Sequence[str]] = {
    "base-1": BASE,
    "web-1": (*BASE, "SYMBOLS", "DUPLICATE_LINES"),
    "web-2": tuple(RULES),
}
CURRENT = "web-2"


def mask(names: Sequence[str]) -> int:
    order = list(RULES)
    return sum(1 << order.index(n) for n in set(names))


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """measured() with failed: bit i is set if rule i failed. Store it; policies and ablations need nothing else."""
    bits = None
    for i, fails in enumerate(failures().values()):
        bit = F.when(fails, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return measured(df, id_col, text_col).withColumn("failed", bits)


def decide(ledger: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The ledger with base_failed, kept and the policy's version."""
    hit = lambda names: F.col("failed").bitwiseAND(F.lit(mask(names))) != 0
    return ledger.withColumns({"base_failed": hit(BASE), "kept": ~hit((*BASE, *POLICIES[policy])), "policy": F.lit(policy)})


def ablation(ledger: DataFrame, policy: str = CURRENT) -> DataFrame:
    """policy, rule, n_docs, n_failed, n_only (documents that this rule alone rejects: kept without it), n_kept, n_kept_without."""
    names = list(POLICIES[policy])
    own = F.col("failed").bitwiseAND(F.lit(mask(names)))
    sums = [F.count(F.lit(1)).alias("n_docs"), F.count_if(own == 0).alias("n_kept")]
    for n in names:
        sums += [F.count_if(own.bitwiseAND(F.lit(mask([n]))) != 0).alias(f"failed_{n}"), F.count_if(own == mask([n])).alias(f"only_{n}")]
    one = ledger.agg(*sums)
    rules = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"failed_{n}").alias("n_failed"), F.col(f"only_{n}").alias("n_only")) for n in names]))
    flat = one.select("n_docs", "n_kept", rules.alias("r"))
    return flat.select(F.lit(policy).alias("policy"), "r.rule", "n_docs", "r.n_failed", "r.n_only", "n_kept", (F.col("n_kept") + F.col("r.n_only")).alias("n_kept_without"))
