"""The queries of this subpackage: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import bpe, credentials, jaccard, lexical, linededup, packing, pfor, quality, rules, sharding, simhash, topk, turns
from brindle.llm.store import table, written


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), with_ids=False)


def rules_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored ledger, with the verdict of every policy."""
    found = rules.decide(written(rules.ledger(table(spark, sf_dir, "documents")), "ledger"))
    verdicts = [(F.col("failed").bitwiseAND(F.lit(rules.mask((*rules.BASE, *names)))) == 0).alias("kept_" + policy.replace("-", "_")) for policy, names in rules.POLICIES.items()]
    return found.select("doc_id", *rules.MEASURES, "base_failed", "kept", "failed", "policy", *verdicts)


def ablation_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every policy's ablation from one stored ledger."""
    held = written(rules.ledger(table(spark, sf_dir, "documents")), "ledger")
    made = [rules.ablation(held, policy) for policy in rules.POLICIES]
    return reduce(DataFrame.unionByName, made)


def jaccard_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def bpe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def sharding_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sharding.shard(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def pfor_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfor.digests(pfor.write_table(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json")))


def topk_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def secrets_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.report(table(spark, sf_dir, "documents"))


def lines_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text (what is left of it), n_lines and n_deleted lines, deleted: from-to of each run."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines"))
    made = linededup.dedup(docs, deleted_col="runs")
    runs = F.coalesce("runs", F.array().cast(made.schema["runs"].dataType))
    n = F.aggregate(runs, F.lit(0).cast("long"), lambda a, r: a + r["last"] - r["first"] + 1)
    said = F.array_join(F.transform(runs, lambda r: F.concat_ws("-", r["first"].cast("string"), r["last"].cast("string"))), ",")
    return made.select("doc_id", "text", "n_lines", n.alias("n_deleted"), said.alias("deleted"))


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality.classify(documents, quality.fit(documents, table(spark, sf_dir, "labels")))


def turns_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of the events of all conversations, fed in twelve batches."""
    n_batches = 12
    dealt = turns.by_batch(turns.arrivals(table(spark, sf_dir, "conversations"), n_batches), n_batches)
    made = turns.Reassembly(spark, n_batches)
    for batch in range(n_batches):
        made.feed(dealt.where(F.col("batch") == batch))
    made.finish()
    said = F.when(F.col("event") == "close", F.array_join(F.col("unreleased").cast("array<string>"), ",")).otherwise(F.col("payload"))
    conv = F.when(F.col("conv") != "", F.col("conv")).cast("long")
    return made.events().select("event", conv.alias("conv_id"), "turn", F.col("batch").cast("long").alias("batch"), F.sha2(said.cast("binary"), 256).alias("sha256"), "n_missing", "n_breaks")


def simhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def lexical_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_retrieval_packing": packing_query,
    "op2_rule_ledger": rules_query,
    "rule_ablation": ablation_query,
    "op3_ngram_jaccard": jaccard_query,
    "op4_byte_bpe": bpe_query,
    "op5_rendezvous_sharding": sharding_query,
    "op6_pfor_token_ids": pfor_query,
    "op7_threshold_topk": topk_query,
    "op8_credential_linking": secrets_query,
    "op9_line_winnowing": lines_query,
    "op10_attention_quality": quality_query,
    "op11_boundary_fragments": turns_query,
    "op12_ball_hashing": simhash_query,
    "op13_blocked_product": lexical_query,
}

#: Every row of a ledger with all rules; the words, lines and windows are list functions.
_RULES = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         len(l)::BIGINT AS n_lines,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         len(list_filter(w, lambda x: length(x) > 1 AND upper(x) = x AND lower(x) <> x))::BIGINT AS n_upper_words,
         len(regexp_extract_all(text, '\p{L}'))::BIGINT AS n_letters, w
  FROM base
), windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM m)
), hit AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT p)::BIGINT AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM hit) GROUP BY doc_id
), r AS (
  SELECT m.* EXCLUDE (w), coalesce(covered.n, 0)::BIGINT AS n_repeat_words FROM m LEFT JOIN covered USING (doc_id)
), f AS (
  SELECT *, ((n_words < 50)::BIGINT
    + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT
    + 4 * (n_words > 0 AND word_chars < 2 * n_words)::BIGINT
    + 8 * (n_words > 0 AND word_chars > 15 * n_words)::BIGINT
    + 16 * (n_words > 0 AND n_symbols > 0.1::DOUBLE * n_words)::BIGINT
    + 32 * (n_dup_lines >= 3 AND n_dup_lines > 0.3::DOUBLE * n_lines)::BIGINT
    + 64 * (n_words > 0 AND n_upper_words > 0.5::DOUBLE * n_words)::BIGINT
    + 128 * (word_chars > 0 AND n_letters < 0.5::DOUBLE * word_chars)::BIGINT)::BIGINT AS failed
  FROM r
)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper_words, n_letters, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed, 'web-2' AS policy,
  (failed & 3) = 0 AS kept_base_1, (failed & 51) = 0 AS kept_web_1, failed = 0 AS kept_web_2 FROM f
"""

_ABLATION = f"""
WITH l AS ({_RULES}), r AS (SELECT unnest(['MIN_WORDS', 'REPEATED_WORDS', 'SHORT_WORDS', 'LONG_WORDS', 'SYMBOLS', 'DUPLICATE_LINES', 'UPPER_WORDS', 'FEW_LETTERS']) AS rule, unnest([1, 2, 4, 8, 16, 32, 64, 128]) AS bit),
p AS (SELECT unnest(['base-1', 'web-1', 'web-2']) AS policy, unnest([3, 51, 255]) AS own)
SELECT p.policy, rule, count(*) AS n_docs, count(*) FILTER (failed & bit <> 0) AS n_failed, count(*) FILTER (failed & own = bit) AS n_only, count(*) FILTER (failed & own = 0) AS n_kept, count(*) FILTER (failed & own & ~bit = 0) AS n_kept_without
FROM l, r JOIN p ON own & bit <> 0 GROUP BY ALL
"""

_TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""

_JACCARD = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM t WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS MATERIALIZED (SELECT x, y FROM both_ JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM t UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y)
SELECT t.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM t LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS c FROM reach GROUP BY x) m USING (doc_id)
"""

#: The events by windows over kept turns and batches of arrivals.
_TURNS = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, min(turn) OVER (PARTITION BY conv_id) AS first,
         ('0x' || sha256(coalesce(conv_id::VARCHAR, '') || ':' || turn::VARCHAR)[1:8])::BIGINT AS h
  FROM conversations WHERE turn IS NOT NULL
), r AS (
  SELECT conv_id, turn, first, role, text, h % 12 AS batch FROM t UNION ALL SELECT conv_id, turn, first, 'user', text, (h + 3) % 12 FROM t WHERE h % 7 < 2
), a AS (
  SELECT conv_id, turn, first, batch, min(role || '|' || text) AS payload, arg_min(role, role || '|' || text) AS role FROM r GROUP BY ALL
), b AS (
  SELECT conv_id, batch, lead(batch) OVER (PARTITION BY conv_id ORDER BY batch) AS next FROM (SELECT DISTINCT conv_id, batch FROM a)
), c AS (
  SELECT conv_id, least(min(batch) + 3, 12) AS closed FROM b WHERE next IS NULL OR next - batch > 3 GROUP BY conv_id
), x AS (
  SELECT a.*, batch > closed AS late, closed FROM a JOIN c ON a.conv_id IS NOT DISTINCT FROM c.conv_id
), k AS (
  SELECT conv_id, turn, first, closed, payload, role, batch FROM x WHERE NOT late QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY batch) = 1
), m AS (
  SELECT *, row_number() OVER w - 1 = turn - first AS released, max(batch) OVER w AS due, lag(turn) OVER w = turn - 1 AND lag(role) OVER w = role AS broken
  FROM k WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
)
SELECT 'release' AS event, conv_id, turn, due AS batch, sha256(payload) AS sha256, NULL::BIGINT AS n_missing, NULL::BIGINT AS n_breaks FROM m WHERE released
UNION ALL SELECT 'reject', conv_id, turn, batch, sha256(payload), NULL, NULL FROM x WHERE late
UNION ALL SELECT 'close', conv_id, -1, any_value(closed), sha256(coalesce(string_agg(turn::VARCHAR, ',' ORDER BY turn) FILTER (NOT released), '')), max(turn) - any_value(first) + 1 - count(*), count(*) FILTER (broken) FROM m GROUP BY conv_id
"""

_LEXICAL = r"""
WITH t AS (
  SELECT doc_id, r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT doc_id, text, row_number() OVER () AS r FROM documents)
), d AS (SELECT r, count(*) AS n FROM t GROUP BY r), a AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS l FROM d),
p AS (SELECT doc_id, r, term, count(*) AS tf FROM t GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
i AS (
  SELECT DISTINCT item_id, r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT item_id, text, row_number() OVER () AS r FROM benchmark)
), s AS (
  SELECT i.item_id, i.r AS item, p.doc_id, p.r, sum(floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // l))))::BIGINT AS score
  FROM i JOIN p USING (term) JOIN f USING (term) JOIN d ON d.r = p.r CROSS JOIN a GROUP BY ALL
)
SELECT item_id, (row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST))::INT AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST) <= 50
"""

ORACLE_SQL: dict[str, str] = {"op2_rule_ledger": _RULES, "rule_ablation": _ABLATION, "op3_ngram_jaccard": _JACCARD, "op7_threshold_topk": _TOPK, "op11_boundary_fragments": _TURNS, "op13_blocked_product": _LEXICAL}
