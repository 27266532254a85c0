"""Findings of round 4 on the operators."""

import random

from brindle.llm import simhash


def test_probes_of_fingerprints_are_no_broadcast(spark, tmp_path):
    """A small file of prints has 66 probes for each, which Spark takes for as many as the prints."""
    rng = random.Random(3)
    held = [rng.getrandbits(63) for _ in range(300)]
    spark.createDataFrame([(x,) for x in {*held, *(x ^ 1 << 40 for x in held[:9])}], "print long").write.parquet(str(tmp_path / "prints"))
    kept = simhash.with_partner(spark.read.parquet(str(tmp_path / "prints")))
    assert "BroadcastHashJoin" not in kept._jdf.queryExecution().executedPlan().toString()
    assert {x[0] for x in kept.collect()} == {*held[:9], *(x ^ 1 << 40 for x in held[:9])}
