"""The pipeline's stages on planted documents, and the queries against SQL."""

import glob
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brindle.llm import queries
from brindle.llm.store import written
from tests.test_catalogue import rows as sorted_rows

#: Planted ids lie above those of the labelled documents.
MORE = 10**6
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n):
    r = random.Random(seed)
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en"]
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(n)).capitalize() + "."


def planted(spark):
    clean = [words(i, 80) + "\n" + words(100 + i, 60) for i in range(12)]
    passage = words(999, 70)
    rows = list(enumerate(clean))
    rows.append((100, clean[3]))  # an exact copy
    rows.append((101, clean[4].replace("\n", " ").replace("er", "er", 1) + " end"))  # a near copy on one line
    rows.append((102, words(501, 90) + "\n" + passage))
    rows.append((103, passage + "\n" + words(502, 90)))
    rows.append((104, words(503, 70) + ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ' + words(504, 20)))
    rows.append((105, " | ".join(words(600 + i, 1).lower().rstrip(".") for i in range(90))))
    rows += [(106, None), (107, "")]
    return spark.createDataFrame([(i + MORE, t, "en", "s", len(t or "")) for i, t in rows], DOCS).withColumn("id", F.lit("extra"))


def test_stages(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet").withColumn("id", F.lit("extra")).unionByName(planted(spark)), {}
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = written(stage(spark, docs, sf), "stage")
        if i < 4:
            assert docs.columns == columns
        kept[name] = {r.doc_id - MORE: r for r in docs.where(F.col("doc_id") >= MORE).collect()}
    good = kept["quality classifier"]
    assert 105 not in good and {*range(12), 100, 101, 102, 103, 104} <= set(good)
    lines = kept["line dedup"]
    assert 100 not in lines and lines[103].text == words(502, 90) and lines[102].text.endswith(words(999, 70)) and lines[103].n_chars == len(lines[103].text)
    assert set(range(12)) <= set(lines) and all(lines[i].text == good[i].text for i in range(12))
    near = kept["n-gram Jaccard join"]
    assert 101 not in near and set(range(12)) <= set(near)
    safe = kept["secret scans"]
    assert set(safe) == set(near) and "[SECRET]" in safe[104].text and "04dbebab" not in safe[104].text and safe[1].text == near[1].text
    assert set(kept["packing"]) == set(safe)


def test_run(spark, sf):
    made = corpus_pipeline.run(spark, sf)
    assert made.count() > 0 and len(corpus_pipeline.STAGES) == 5


def test_empty(spark, sf):
    docs = planted(spark).where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got, want = queries.QUERIES[name](spark, sf).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and sorted_rows(got) == sorted_rows(want)


def test_registered():
    import __spark_entry__ as entry

    assert {f"op{n}_" for n in range(1, 11)} <= {q.split("_")[0] + "_" for q in entry.queries()} and "pipeline" in entry.queries()
