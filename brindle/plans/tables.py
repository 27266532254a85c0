"""What the queries read: driver tables, and rows in the shape of assertions that are derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Assertion rows of parts, in expressions that both Spark and DuckDB read.
ASSERTIONS = """
SELECT p_partkey AS pos, p_size AS id,
  CASE p_partkey % 12
    WHEN 0 THEN 'assert property (@(posedge clk) disable iff (!rst_n) size_' || (p_size % 7) || ' == q_' || (p_size % 3) || ');'
    WHEN 1 THEN 'assert property (@(posedge clk) valid && ready |-> data_' || (p_size % 5) || ' == hold);  // ' || p_brand
    WHEN 2 THEN 'assert (a_' || (p_size % 4) || ' == b);'
    WHEN 3 THEN 'assert   ( a_' || (p_size % 4) || '  ==  b ) ;'
    WHEN 4 THEN 'assert property (@(posedge clk) !rst |-> cnt == ' || (p_size % 3) || ') else $error("bad ' || p_partkey || '");'
    WHEN 5 THEN 'assert property (@(posedge clk) $rose(req) |=> ack);'
    WHEN 6 THEN 'assert property (@(posedge clk) $bits(bus_' || (p_size % 6) || ') == 8);'
    WHEN 7 THEN 'assert property (@(posedge clk) b || a_' || (p_size % 2) || ');'
    WHEN 8 THEN 'assert property (@(posedge clk) a_' || (p_size % 2) || ' || b);'
    WHEN 9 THEN 'assert property (@(posedge clk) en |=> $past(q_' || (p_size % 3) || ') == d);'
    WHEN 10 THEN 'assert property (@(posedge clk) x == x);'
    ELSE '// size ' || p_size
  END AS assertion
FROM part
"""


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of part that texts are made of, dealt to all cores: the file is small, and what is made of a row takes far longer
    than its reading."""
    return t(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand").repartition(3 * spark.sparkContext.defaultParallelism, "p_partkey")


def assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ASSERTIONS.replace("FROM part", "FROM {part}"), part=parts(spark, sf_dir))
