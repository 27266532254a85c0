"""Queries of signal facts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators import facts
from brindle.plans.tables import ASSERTIONS, assertions, t


def signal_types(spark, d):
    n = F.col("p_partkey")
    end = F.when(n % 6 == 0, "_en").when(n % 6 == 1, "_addr").when(n % 6 == 2, "_clk").when(n % 6 == 3, "_data_x").when(n % 6 == 4, "_rst").otherwise("_misc")
    p = t(spark, d, "part").select(F.concat(F.lit("u"), n.cast("string"), end).alias("name"), F.when(F.col("p_size") % 2 == 0, "output").otherwise("input").alias("direction"), (F.col("p_size") % 3).cast("int").alias("width"))
    return p.select("name", facts.signal_type(F.col("name"), F.col("direction"), F.col("width")).alias("type"))


def cross_module(spark, d):
    rows = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("r")).agg(F.collect_set("l_suppkey").alias("names"))
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("name"), (F.col("s_nationkey") % 3).alias("module"), (F.col("s_suppkey") % 4).alias("instance"))
    return facts.cross_module(rows, "r", "names", s.select("name", "module"), s.select("name", "instance"))


def frequent_names(spark, d):
    freq = t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("name")).agg(F.count(F.lit(1)).alias("freq"))
    names = t(spark, d, "part").select(F.col("p_partkey").alias("name"), "p_brand")
    return facts.by_frequency(names, freq, 12, "p_brand")


def equalities(spark, d):
    e = facts.equality(F.col("assertion"))
    return assertions(spark, d).select("pos", e.alias("e")).where("e IS NOT NULL").select("pos", "e.lhs", "e.rhs", F.array_join("e.names", ",").alias("names"))


def state_flags(spark, d):
    rows = t(spark, d, "part").select("p_partkey", F.concat(F.lit("assert (st == 4'd"), (F.col("p_size") % 6).cast("string"), F.lit(");")).alias("a"))
    states = spark.sql("SELECT * FROM VALUES ('st', '4''d1'), ('st', '4''d2'), ('st', '4''d0') AS t(signal, literal)")
    return facts.unknown_states(rows, "p_partkey", "a", states)


QUERIES = {f.__name__: f for f in (signal_types, cross_module, frequent_names, equalities, state_flags)}
ORACLES = {
    "signal_types": "SELECT 'u' || p_partkey || CASE p_partkey % 6 WHEN 0 THEN '_en' WHEN 1 THEN '_addr' WHEN 2 THEN '_clk' WHEN 3 THEN '_data_x' WHEN 4 THEN '_rst' ELSE '_misc' END AS name, CASE p_partkey % 6 WHEN 0 THEN 'control' WHEN 1 THEN 'address' WHEN 2 THEN 'clock' WHEN 3 THEN 'data' WHEN 4 THEN 'reset' ELSE CASE WHEN p_size % 3 = 1 THEN CASE WHEN p_size % 2 = 0 THEN 'status' ELSE 'control' END ELSE 'data' END END AS type FROM part",
    "cross_module": """WITH n AS (SELECT DISTINCT l_orderkey AS r, l_suppkey AS name FROM lineitem), s AS (SELECT s_suppkey AS name, s_nationkey % 3 AS m, s_suppkey % 4 AS i FROM supplier),
      g AS (SELECT r, count(*) AS n, count(s.name) AS k, count(DISTINCT m) AS ms, count(DISTINCT i) AS is_ FROM n LEFT JOIN s USING (name) GROUP BY 1) SELECT r, n = k AND n >= 2 AND ms > 1 AND is_ > 1 AS "cross" FROM g""",
    "frequent_names": """WITH f AS (SELECT l_partkey AS name, count(*) AS freq FROM lineitem GROUP BY 1), r AS (SELECT p_partkey AS name, p_brand, coalesce(freq, 0) AS freq, row_number() OVER (PARTITION BY p_brand ORDER BY coalesce(freq, 0) DESC, p_partkey)::INT AS rn FROM part LEFT JOIN f ON p_partkey = f.name) SELECT * FROM r WHERE rn <= 12""",
    "equalities": f"""WITH a AS ({ASSERTIONS}) SELECT pos, CASE pos % 12 WHEN 0 THEN 'size_' || (id % 7) WHEN 1 THEN 'data_' || (id % 5) WHEN 2 THEN 'a_' || (id % 4) WHEN 3 THEN 'a_' || (id % 4) WHEN 4 THEN 'cnt' WHEN 6 THEN '$bits(bus_' || (id % 6) || ')' WHEN 9 THEN '$past(q_' || (id % 3) || ')' ELSE 'x' END AS lhs,
      CASE pos % 12 WHEN 0 THEN 'q_' || (id % 3) WHEN 1 THEN 'hold' WHEN 2 THEN 'b' WHEN 3 THEN 'b' WHEN 4 THEN (id % 3)::VARCHAR WHEN 6 THEN '8' WHEN 9 THEN 'd' ELSE 'x' END AS rhs, CASE pos % 12 WHEN 1 THEN 'ready,valid' WHEN 4 THEN 'rst' WHEN 9 THEN 'en' ELSE '' END AS names FROM a WHERE pos % 12 IN (0, 1, 2, 3, 4, 6, 9, 10)""",
    "state_flags": "SELECT p_partkey, p_size % 6 > 2 AS flagged FROM part",
}
