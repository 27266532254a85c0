"""Each query against its SQL on the same files."""

import glob
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from brindle.plans.catalogue import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def rows(df):
    clean = lambda x: None if x is None or x is pd.NA or (isinstance(x, float) and x != x) else x
    return sorted((tuple(map(clean, r)) for r in df[sorted(df.columns)].astype(object).values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name not in ORACLES:
        assert len(got.columns) > 0
        return
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


def test_rows_of_a_small_file_are_dealt_to_all_cores(spark, sf):
    # What is made of a row of part takes far longer than its reading
    from brindle.plans import lookups, tables

    for made in (tables.assertions(spark, sf), lookups._shapes(spark, sf, ["a {n}", "b"])):
        used = {r.p for r in made.select(F.spark_partition_id().alias("p")).distinct().collect()}
        assert len(used) >= spark.sparkContext.defaultParallelism
