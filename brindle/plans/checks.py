"""Queries of single checks and clusters that no other query reaches, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators import clean, cluster, facts
from brindle.plans.graphs import _E, _P, _asked, _edges
from brindle.plans.tables import ASSERTIONS, assertions, t


def past_depths(spark, d):
    """A claim of one, two or three cycles between suppliers of a nation."""
    rows = _asked(spark, d).withColumns({"depth": (F.col("a") % 3).cast("long"), "row": F.col("a")})
    return facts.past_depth(rows, "row", "b", "a", "depth", _edges(spark, d), 3)


def flow_votes(spark, d):
    rows = _asked(spark, d).select(F.col("a").alias("row"), F.array("a").alias("condition"), F.array("b").alias("claim"))
    return facts.against_flow(rows, "row", "condition", "claim", _edges(spark, d).where("delay = 0"), 2)


def immediate_only(spark, d):
    return clean.remove_wrong_style("immediate")(assertions(spark, d).withColumn("comment", F.lit(""))).select("pos", "assertion")


def selector_derivation(spark, d):
    p = t(spark, d, "part")
    rows = p.select(F.col("p_partkey").alias("row"), F.array(F.concat(F.lit("a_"), F.col("p_partkey") % 4)).alias("condition"), F.array(F.concat(F.lit("s_"), F.col("p_partkey") % 3)).alias("selector"))
    defined = p.select(F.concat(F.lit("s_"), F.col("p_size") % 3).alias("name"), F.concat(F.lit("a_"), F.col("p_size") % 4, F.when(F.col("p_size") % 5 == 0, "").otherwise(" & go")).alias("expr")).distinct()
    return facts.derived_selectors(rows, "row", "condition", "selector", defined)


def condition_clusters(spark, d):
    k = (F.col("p_size") % 5).cast("string")
    form = F.col("p_partkey") % 4
    said = F.when(form == 0, F.concat(F.lit("en_"), k)).when(form == 1, F.concat(F.lit("( en_"), k, F.lit(" )"))).when(form == 2, F.concat(F.lit("(en_"), k, F.lit(") == 1'b1")))
    return cluster.by_condition(t(spark, d, "part").select("p_brand", said.alias("condition"), F.col("p_partkey").alias("pos")), ["p_brand"], "condition", "pos")


def module_summaries(spark, d):
    """Nations as modules under their regions, suppliers as cells and customers' segments as ports."""
    n, r, s = t(spark, d, "nation"), t(spark, d, "region"), t(spark, d, "supplier")
    modules = n.select(F.col("n_name").alias("module")).union(r.select(F.concat(F.lit("R_"), "r_name")))
    ports = n.select(F.col("n_name").alias("module"), F.concat(F.lit("p"), F.col("n_nationkey") % 4).alias("name"), F.when(F.col("n_nationkey") % 2 == 0, "input").otherwise("output").alias("direction"), (F.col("n_nationkey") % 9).alias("width"))
    children = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("R_"), "r_name").alias("parent"), F.col("n_name").alias("child"), F.col("n_nationkey").alias("pos"))
    cells = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("module"), F.concat(F.lit("u"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("cell"), F.concat(F.lit("t"), F.col("s_suppkey") % 3).alias("type"))
    return facts.module_summaries(modules, ports, children, cells)


QUERIES = {f.__name__: f for f in (past_depths, flow_votes, immediate_only, selector_derivation, condition_clusters, module_summaries)}
ORACLES = {
    "past_depths": f"""WITH RECURSIVE e AS MATERIALIZED ({_E}), p AS (SELECT s_suppkey AS source, s_suppkey AS node, 0::BIGINT AS delay, 0 AS k FROM supplier UNION SELECT p.source, e.b, p.delay + e.delay, k + 1 FROM p JOIN e ON e.a = p.node WHERE k < 3),
      l AS (SELECT source, node, min(delay)::BIGINT AS least FROM p GROUP BY 1, 2) SELECT a AS row, least, coalesce(least <> a % 3, FALSE) AS flagged FROM ({_P}) LEFT JOIN l ON source = a AND node = b""",
    "flow_votes": f"""WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM ({_E}) WHERE delay = 0), p AS (SELECT s_suppkey AS source, s_suppkey AS node, 0 AS k FROM supplier UNION SELECT p.source, e.b, k + 1 FROM p JOIN e ON e.a = p.node WHERE k < 2), r AS (SELECT DISTINCT source, node FROM p),
      x AS (SELECT a, f.node IS NOT NULL AS ahead, g.node IS NOT NULL AS behind FROM ({_P}) LEFT JOIN r f ON f.source = a AND f.node = b LEFT JOIN r g ON g.source = b AND g.node = a)
      SELECT a AS row, (behind AND NOT ahead)::BIGINT AS wrong, (ahead AND NOT behind)::BIGINT AS "right", behind AND NOT ahead AS flagged FROM x""",
    "immediate_only": f"SELECT pos, assertion FROM ({ASSERTIONS}) WHERE NOT regexp_matches(assertion, '^assert\\s+property')",
    "selector_derivation": "WITH d AS (SELECT DISTINCT p_size % 3 AS s, p_size % 4 AS a FROM part WHERE p_size % 5 <> 0) SELECT p_partkey AS row FROM part JOIN d ON p_partkey % 3 = s AND p_partkey % 4 = a",
    "condition_clusters": "SELECT p_brand, 'en_' || (p_size % 5) AS form, count(*) AS n, min(p_partkey) AS first_pos FROM part WHERE p_partkey % 4 < 3 GROUP BY 1, 2",
    "module_summaries": """WITH c AS (SELECT n_nationkey, n_name, 'R_' || r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey), u AS (SELECT s_nationkey, 'u' || lpad(s_suppkey::VARCHAR, 9, '0') AS cell, 't' || (s_suppkey % 3) AS type, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS rn FROM supplier),
      i AS (SELECT s_nationkey, string_agg(cell || '->' || type, ', ' ORDER BY cell) AS x FROM u WHERE rn <= 20 GROUP BY 1), k AS (SELECT r, string_agg(n_name, ', ' ORDER BY n_nationkey) AS x FROM c GROUP BY 1)
      SELECT n_name AS module, '[Module: ' || n_name || ' | Parent: ' || r || ' | Ports: p' || (n_nationkey % 4) || CASE WHEN n_nationkey % 2 = 0 THEN '(inp,' ELSE '(out,' END || (n_nationkey % 9) || ')]' || chr(10) AS prefix,
        'Module: ' || n_name || chr(10) || 'Parent: ' || r || chr(10) || 'Ports: p' || (n_nationkey % 4) || CASE WHEN n_nationkey % 2 = 0 THEN '(input,' ELSE '(output,' END || (n_nationkey % 9) || ')' || chr(10) || 'Submodules: none (leaf module)' || coalesce(chr(10) || 'Instances: ' || i.x, '') AS summary
      FROM c LEFT JOIN i ON s_nationkey = n_nationkey
      UNION ALL SELECT 'R_' || r_name, '[Module: R_' || r_name || coalesce(' | Children: ' || x, '') || ']' || chr(10), 'Module: R_' || r_name || chr(10) || 'Submodules: ' || coalesce(x, 'none (leaf module)') FROM region LEFT JOIN k ON r = 'R_' || r_name""",
}
