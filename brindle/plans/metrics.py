"""Queries of run metrics, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import text as X
from brindle.operators import compare, stats
from brindle.plans.tables import ASSERTIONS, assertions, t


def _runs(spark, d):
    """Orders as runs: nation, priority, status, price."""
    return t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("nation"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))


def _rounded(df, *cols, places=4):
    return df.withColumns({c: F.round(c, places) for c in cols})


_FOLD = ["price_mean", "price_median", "price_std", "price_min", "price_max", "rate"]


def cell_stats(spark, d):
    return _rounded(stats.cell_stats(_runs(spark, d), ["nation", "priority"], ["price"], "status", "F"), *_FOLD)


def macro_average(spark, d):
    cells = stats.cell_stats(_runs(spark, d), ["nation", "priority"], ["price"], "status", "F")
    return _rounded(stats.macro(cells, ["priority"], ["price_mean", "price_median", "rate"]), "price_mean", "price_median", "rate", places=3)


def micro_vs_macro(spark, d):
    li = t(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_quantity").cast("decimal(18,2)").alias("q"), (F.col("l_discount") * 100).cast("decimal(18,2)").alias("x"))
    made = stats.totals(li, ["l_returnflag", "l_linestatus"], "q", "x")
    return made.select("l_returnflag", "l_linestatus", "level", F.col("top").cast("double").alias("top"), F.col("bottom").cast("double").alias("bottom"), F.round(F.col("top").cast("double") / F.col("bottom").cast("double"), 5).alias("ratio"))


def token_means(spark, d):
    v = F.col("l_discount")
    made = t(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(stats.positive_mean(v).alias("positive_mean"), F.avg(v).alias("all_mean"), F.count_if(v > 0).alias("n_positive"))
    return _rounded(made, "positive_mean", "all_mean", places=6)


def safe_ratios(spark, d):
    made = t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q"), F.sum(F.when(F.col("l_discount") > 0.09, F.col("l_quantity"))).alias("x"))
    return made.select("l_suppkey", F.round(X.safe_ratio(F.col("q"), F.coalesce("x", F.lit(0.0))), 4).alias("ratio"))


def _mutants(spark, d):
    li = t(spark, d, "lineitem")
    status = F.when(F.col("l_returnflag") == "R", "killed").when(F.col("l_linestatus") == "F", "survived").when(F.col("l_linenumber") == 1, "stillborn").when(F.col("l_linenumber") == 2, "timeout").when(F.col("l_linenumber") == 3, "error").otherwise("killed")
    return li.select((F.col("l_partkey") % 7).cast("int").alias("operator"), status.alias("status"))


def status_score(spark, d):
    return stats.status_counts(_mutants(spark, d), [], "status")


def status_by_operator(spark, d):
    return stats.status_counts(_mutants(spark, d), ["operator"], "status")


_M = "SELECT (l_partkey % 7)::INT AS operator, CASE WHEN l_returnflag = 'R' THEN 'killed' WHEN l_linestatus = 'F' THEN 'survived' WHEN l_linenumber = 1 THEN 'stillborn' WHEN l_linenumber = 2 THEN 'timeout' WHEN l_linenumber = 3 THEN 'error' ELSE 'killed' END AS status FROM lineitem"
_S = """count(*) AS total, count(*) FILTER (status = 'killed') AS killed, count(*) FILTER (status = 'survived') AS survived,
count(*) FILTER (status = 'stillborn') AS stillborn, count(*) FILTER (status = 'timeout') AS timeout, count(*) FILTER (status = 'error') AS error"""
_SCORE = "round(CASE WHEN total - stillborn - error > 0 THEN killed / (total - stillborn - error) ELSE 0 END, 4) AS score, round(CASE WHEN total - stillborn > 0 THEN killed / (total - stillborn) END, 4) AS rate"


def status_join(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    r = t(spark, d, "lineitem").where("l_linenumber = 7").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_linestatus").alias("status"))
    return compare.status_join(o, r, "o_orderkey", "status").groupBy("o_orderpriority", "status").agg(F.count(F.lit(1)).alias("n"))


def _year(spark, d, y):
    o = t(spark, d, "orders").where((F.col("o_orderdate") >= f"{y}-01-01") & (F.col("o_orderdate") < f"{y + 1}-01-01"))
    return o.groupBy(F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def ab_delta(spark, d):
    return compare.ab_delta(_year(spark, d, 1994), _year(spark, d, 1995), "label", "n")


def pivot_reduction(spark, d):
    o = t(spark, d, "orders").select("o_orderpriority", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    made = compare.pivot_reduction(o, "o_orderpriority", "o_orderstatus", "v", "F", "O")
    return made.select("o_orderpriority", F.col("ours").cast("double").alias("ours"), F.col("naive").cast("double").alias("naive"), "reduction")


def quality_product(spark, d):
    files = t(spark, d, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.count_if(F.col("l_quantity") > 25).alias("useful"), F.countDistinct("l_returnflag").alias("domains"))
    return _rounded(stats.quality_product(files, ["l_suppkey"], "useful", "domains"), "quality", places=6)


def weighted_cost(spark, d):
    made = t(spark, d, "lineitem").groupBy("l_partkey").agg(F.count_if(F.col("l_returnflag") == "N").alias("a"), F.count_if(F.col("l_returnflag") == "R").alias("b"), F.count_if(F.col("l_returnflag") == "A").alias("c"), F.sum("l_quantity").alias("q"))
    score = stats.weighted_score(F.col("a"), F.col("b"), F.col("c"))
    return made.select("l_partkey", score.cast("long").alias("score"), F.round(X.safe_ratio(F.col("q"), score), 5).alias("cost"))


def file_fold(spark, d):
    a = F.col("assertion")
    return stats.file_fold(assertions(spark, d), "id", "pos", "assertion", X.normal_line(a), X.category(a), X.trivial_cost(a), X.complex_cost(a))


def tier_one(spark, d):
    a = F.col("assertion")
    return stats.tier_one(assertions(spark, d), "id", "pos", X.normal_text(a), ~X.trivial_quality(a), a.startswith("assert"))


def assertion_flags(spark, d):
    a = F.col("assertion")
    return assertions(spark, d).select("pos", X.category(a).alias("category"), X.trivial_cost(a).alias("trivial_cost"), X.trivial_quality(a).alias("trivial_quality"), X.complex_cost(a).alias("complex_cost"), X.complex_quality(a).alias("complex_quality"))


_T = "regexp_matches(assertion, '\\$bits\\s*\\(\\s*\\w+(\\.\\w+|\\[[^\\]]+\\])*\\s*\\)\\s*==\\s*\\d')"
_CAT = """CASE WHEN assertion NOT LIKE 'assert%' THEN 'non-assert' WHEN contains(assertion, '$stable') THEN 'stable-backpressure'
WHEN contains(assertion, '$onehot') THEN 'onehot' WHEN contains(assertion, 'inside') THEN 'inside-set'
WHEN contains(assertion, '$past') AND contains(assertion, '|=>') THEN 'seq-update' WHEN contains(assertion, '$past') THEN 'past-other'
WHEN contains(assertion, '$rose') OR contains(assertion, '$fell') THEN 'edge-detect'
WHEN regexp_matches(assertion, '\\bvalid\\b') AND regexp_matches(assertion, '\\bready\\b') THEN 'handshake'
WHEN regexp_matches(assertion, '!\\s*[a-zA-Z_]\\w*\\s*\\|->') THEN 'reset-imp' WHEN contains(assertion, '|->') THEN 'implication-other' ELSE 'other' END"""
_NORM = "lower(trim(regexp_replace(regexp_replace(regexp_replace(assertion, '//.*', '', 'g'), '\\$error\\s*\\([^)]*\\)', '$error(...)', 'g'), '\\s+', ' ', 'g')))"
# two signals before the implication: only the handshake rows have them
_CPLX = "(regexp_matches(assertion, '\\$(past|stable|rose|fell|onehot)\\b') OR contains(assertion, '|=>') OR contains(assertion, 'valid && ready'))"


def kind_counts(spark, d):
    return stats.kind_counts(t(spark, d, "events"), "user_id", "event_type", F.col("value") > 50, ["view", "signup", "error", "click", "purchase"])


def sampled_counts(spark, d):
    return stats.sampled_counts(t(spark, d, "events"), "event_type", "user_id", "event_id")


def membership(spark, d):
    return stats.membership(t(spark, d, "lineitem"), "l_partkey", F.col("l_quantity") < 5, F.col("l_discount") > 0.08)


def upsert_counts(spark, d):
    e = t(spark, d, "events")
    part = lambda odd: e.where(F.col("event_id") % 2 == odd).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return stats.upsert_counts(part(0), part(1), "user_id", "n")


def denylist(spark, d):
    counts = t(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    known = t(spark, d, "customer").where("c_nationkey < 12").select(F.col("c_custkey").alias("o_custkey"))
    return stats.denylist(counts, "o_custkey", "n", known, 25)


def lookup_fallback(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("method"), F.col("o_orderstatus").alias("design"))
    rules = spark.sql("SELECT * FROM VALUES ('1-URGENT', 'F', 1.0D), ('', 'F', 2.0D), ('', 'O', 3.0D), ('2-HIGH', 'P', 4.0D) AS t(method, design, cost)")
    return compare.lookup(o, rules, ["method", "design"], ["design"], "cost").groupBy("method", "design", "cost").agg(F.count(F.lit(1)).alias("n"))


def lookup_fan_out(spark, d):
    rows = t(spark, d, "customer").select(F.lpad((F.col("c_custkey") % 50).cast("string"), 3, "0").alias("run_id"), F.col("c_mktsegment").alias("m"), F.col("c_acctbal").alias("v"), F.col("c_custkey").alias("pos"))
    return compare.fan_out(rows, "run_id", "m", "v", "pos")


QUERIES = {f.__name__: f for f in (cell_stats, macro_average, micro_vs_macro, token_means, safe_ratios, status_score, status_by_operator, status_join, ab_delta, pivot_reduction, quality_product, weighted_cost, file_fold, tier_one, assertion_flags, kind_counts, sampled_counts, membership, upsert_counts, denylist, lookup_fallback, lookup_fan_out)}

_CELLS = """SELECT c_nationkey AS nation, o_orderpriority AS priority, count(*) AS runs, count(*) FILTER (o_orderstatus = 'F') AS succeeded,
 count(*) FILTER (o_orderstatus = 'F') / count(*) AS rate, count(o_totalprice) AS price_n, avg(o_totalprice) AS price_mean, median(o_totalprice) AS price_median,
 coalesce(stddev_samp(o_totalprice), 0) AS price_std, min(o_totalprice) AS price_min, max(o_totalprice) AS price_max
 FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"""
ORACLES = {
    "cell_stats": f"SELECT nation, priority, runs, succeeded, price_n, {', '.join(f'round({c}, 4) AS {c}' for c in _FOLD)} FROM ({_CELLS})",
    "macro_average": f"SELECT priority, count(*) AS n_cells, round(avg(price_mean), 3) AS price_mean, round(avg(price_median), 3) AS price_median, round(avg(rate), 3) AS rate FROM ({_CELLS}) GROUP BY priority",
    "micro_vs_macro": "SELECT l_returnflag, l_linestatus, grouping(l_returnflag, l_linestatus)::INT AS level, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS top, sum((l_discount * 100)::DECIMAL(18,2))::DOUBLE AS bottom, round(sum(l_quantity::DECIMAL(18,2))::DOUBLE / sum((l_discount * 100)::DECIMAL(18,2))::DOUBLE, 5) AS ratio FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "token_means": "SELECT l_returnflag, l_linestatus, round(coalesce(avg(l_discount) FILTER (l_discount > 0), 0), 6) AS positive_mean, round(avg(l_discount), 6) AS all_mean, count(*) FILTER (l_discount > 0) AS n_positive FROM lineitem GROUP BY 1, 2",
    "safe_ratios": "SELECT l_suppkey, round(CASE WHEN coalesce(sum(l_quantity) FILTER (l_discount > 0.09::DOUBLE), 0) > 0 THEN sum(l_quantity) / sum(l_quantity) FILTER (l_discount > 0.09::DOUBLE) END, 4) AS ratio FROM lineitem GROUP BY 1",
    "status_score": f"SELECT *, {_SCORE} FROM (SELECT {_S} FROM ({_M}))",
    "status_by_operator": f"SELECT *, {_SCORE} FROM (SELECT operator, {_S} FROM ({_M}) GROUP BY 1)",
    "status_join": "SELECT o_orderpriority, coalesce(s, 'error') AS status, count(*) AS n FROM orders LEFT JOIN (SELECT l_orderkey, min(l_linestatus) AS s FROM lineitem WHERE l_linenumber = 7 GROUP BY 1) ON o_orderkey = l_orderkey GROUP BY 1, 2",
    "ab_delta": "WITH y AS (SELECT o_orderpriority || '/' || o_orderstatus AS label, count(*) FILTER (year(o_orderdate) = 1994) AS a, count(*) FILTER (year(o_orderdate) = 1995) AS b FROM orders WHERE year(o_orderdate) IN (1994, 1995) GROUP BY 1) SELECT label, a, b, a - b AS delta, CASE WHEN a > b THEN 'worse' WHEN a < b THEN 'better' ELSE '' END AS mark FROM y",
    "pivot_reduction": "WITH w AS (SELECT o_orderpriority, sum(o_totalprice::DECIMAL(18,2)) FILTER (o_orderstatus = 'F') AS a, sum(o_totalprice::DECIMAL(18,2)) FILTER (o_orderstatus = 'O') AS b FROM orders GROUP BY 1) SELECT o_orderpriority, a::DOUBLE AS ours, b::DOUBLE AS naive, CASE WHEN b <> 0 THEN format('{:+.1f}%', (1 - a::DOUBLE / b::DOUBLE) * 100) ELSE 'n/a' END AS reduction FROM w",
    "quality_product": "SELECT l_suppkey, round(avg(u * d), 6) AS quality FROM (SELECT l_suppkey, l_orderkey, count(*) FILTER (l_quantity > 25) AS u, count(DISTINCT l_returnflag) AS d FROM lineitem GROUP BY 1, 2) GROUP BY 1",
    "weighted_cost": "WITH c AS (SELECT l_partkey, (count(*) FILTER (l_returnflag = 'N') + 2 * count(*) FILTER (l_returnflag = 'R') + count(*) FILTER (l_returnflag = 'A'))::BIGINT AS score, sum(l_quantity) AS q FROM lineitem GROUP BY 1) SELECT l_partkey, score, round(CASE WHEN score > 0 THEN q / score END, 5) AS cost FROM c",
    "file_fold": f"""WITH a AS ({ASSERTIONS}), r AS (SELECT id, {_CAT} AS cat, {_T} AND NOT contains(assertion, '|->') AS triv, {_CPLX} AS cplx, row_number() OVER (PARTITION BY id, {_NORM} ORDER BY pos) = 1 AS f FROM a)
      SELECT id, count(*) AS total, count(*) FILTER (f) AS n_unique, count(*) FILTER (f AND triv) AS n_trivial, count(*) FILTER (f AND cplx) AS n_complex, count(*) FILTER (f AND NOT triv) AS n_usable, count(DISTINCT cat) AS n_domains FROM r GROUP BY id""",
    "tier_one": f"""WITH a AS ({ASSERTIONS}), r AS (SELECT id, NOT {_T} AND assertion LIKE 'assert%' AS good, row_number() OVER (PARTITION BY id, {_NORM} ORDER BY pos) = 1 AS f FROM a)
      SELECT id, count(*) AS total, count(*) FILTER (f) AS n_unique, count(*) FILTER (f AND good) AS tier_one FROM r GROUP BY id""",
    "assertion_flags": f"WITH a AS ({ASSERTIONS}) SELECT pos, {_CAT} AS category, {_T} AS trivial_cost, {_T} AS trivial_quality, {_CPLX} AS complex_cost, {_CPLX} AS complex_quality FROM a",
    "kind_counts": "SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS {k}_total, count(*) FILTER (event_type = '{k}' AND value > 50) AS {k}_hit" for k in ("view", "signup", "error", "click", "purchase")) + ", count(*) AS total, count(*) FILTER (value > 50) AS hit FROM events GROUP BY 1",
    "sampled_counts": "SELECT event_type, count(*) AS n, string_agg(user_id::VARCHAR, '|' ORDER BY event_id) FILTER (rn <= 3) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events) GROUP BY 1",
    "membership": "WITH m AS (SELECT l_partkey, bool_or(l_quantity < 5) AS a, bool_or(l_discount > 0.08::DOUBLE) AS b FROM lineitem GROUP BY 1) SELECT l_partkey, CASE WHEN a AND b THEN 'mixed' WHEN a THEN 'comb' WHEN b THEN 'seq' END AS kind FROM m",
    "upsert_counts": "SELECT user_id, count(*) AS n FROM events GROUP BY 1",
    "denylist": "SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12) GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 25",
    "lookup_fallback": "WITH r(method, design, cost) AS (VALUES ('1-URGENT', 'F', 1.0::DOUBLE), ('', 'F', 2.0), ('', 'O', 3.0), ('2-HIGH', 'P', 4.0)) SELECT o_orderpriority AS method, o_orderstatus AS design, coalesce(e.cost, l.cost)::DOUBLE AS cost, count(*) AS n FROM orders LEFT JOIN r e ON e.method = o_orderpriority AND e.design = o_orderstatus LEFT JOIN r l ON l.method = '' AND l.design = o_orderstatus GROUP BY 1, 2, 3",
    "lookup_fan_out": "WITH r AS (SELECT lpad((c_custkey % 50)::VARCHAR, 3, '0') AS run_id, c_mktsegment AS m, c_acctbal AS v, c_custkey AS pos FROM customer), k AS (SELECT unnest(list_distinct([run_id, regexp_replace(run_id, '^0{1,2}', '')])) AS run, m, v, pos FROM r), g AS (SELECT run, unnest([m, '']) AS method, v, pos FROM k) SELECT run, method, max_by(v, pos) AS v FROM g GROUP BY 1, 2",
}


def flagship(spark, d):
    """Cells and their macro averages in one table."""
    cells = cell_stats(spark, d).select(F.lit("cell").alias("level"), F.col("nation").cast("string").alias("nation"), "priority", "price_mean", "price_median", "rate")
    grand = macro_average(spark, d).select(F.lit("grand").alias("level"), F.lit("all").alias("nation"), "priority", "price_mean", "price_median", "rate")
    return cells.unionByName(grand)
