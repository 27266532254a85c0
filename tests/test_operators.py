import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from brindle.operators import clean, cluster, coverage, dedup, graph, mutate, retrieval, stats, trace
from brindle.sources import reports
from brindle.sources import text as S


def test_fold(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", None), ("a", 4.0), ("b", 5.0), ("c", None)], "k string, v double")
    got = {r.k: r for r in df.groupBy("k").agg(*stats.fold(F.col("v"))).collect()}
    assert (got["a"].n, got["a"].mean, got["a"].median, round(got["a"]["std"], 4)) == (2, 3, 3, 1.4142)
    assert got["b"]["std"] == 0.0
    assert (got["c"].n, got["c"].mean, got["c"]["max"]) == (0, 0.0, 0.0)


def test_status_score(spark):
    rows = [("o", s) for s in ["killed"] * 4 + ["survived"] * 3 + ["stillborn", "timeout", "error"]]
    got = stats.status_counts(spark.createDataFrame(rows, "operator string, status string"), ["operator"], "status").first()
    assert (got.score, got.rate) == (0.5, 0.4444)


def test_need(spark):
    df = spark.createDataFrame([(n,) for n in (1, 2, 3, 4, 5)], "n int")
    assert [r.x for r in df.select(coverage.need(F.col("n")).alias("x")).collect()] == [1, 1, 2, 2, 3]


def test_subsumption(spark):
    rows = [(0, "a", "1", []), (1, "a", "1", ["c"]), (2, "a", "2", ["c"]), (3, "a", "3", []), (4, "z", "1", ["p"]), (5, "z", "1", ["p", "q"])]
    df = spark.createDataFrame(rows, "pos int, l string, r string, n array<string>")
    assert sorted(r.pos for r in dedup.subsumed(df, "pos", "l", "r", "n").collect()) == [0, 5]


def test_running_counter(spark):
    rows = [(0, "keep", 5), (1, "remove", 2), (2, "transform", 9), (3, "add", 1), (4, "remove", -1)]
    df = spark.createDataFrame([("k", *r) for r in rows], "k string, i int, action string, delta long")
    got = trace.running_counter(df, ["k"], ["i"], "action", "delta").orderBy("i").collect()
    assert [r.remaining for r in got] == [5, 3, 3, 4, 3]


def test_roles(spark):
    df = spark.createDataFrame([("c", 0, "u", "a"), ("c", 1, "u", "b"), ("c", 2, "s", "c"), ("c", 3, "u", "d")], "c string, turn int, role string, text string")
    assert [r.text for r in trace.merge_roles(df, ["c"], "turn", F.col("role"), "text").orderBy("turn").collect()] == ["a\nb", "c", "d"]


def test_fusion(spark):
    dense = spark.createDataFrame([(0, 1, 0), (0, 2, 1)], "query int, id int, rank int")
    sparse = spark.createDataFrame([(0, 2, 0)], "query int, id int, rank int")
    got = retrieval.fuse(dense, sparse, 5, "id").collect()
    assert [(r.id, round(r.score, 9)) for r in got] == [(2, round(1 / 61 + 1 / 60, 9)), (1, round(1 / 60, 9))]


def test_paths_and_closure(spark):
    edges = spark.createDataFrame([("a", "b", 0), ("b", "c", 1), ("a", "c", 1)], "a string, b string, delay long")
    got = {(r.source, r.node): r.delay for r in graph.least_delays(edges, spark.createDataFrame([("a",), ("c",)], "node string")).collect()}
    assert got == {("a", "a"): 0, ("a", "b"): 0, ("a", "c"): 1, ("c", "c"): 0}
    refs = spark.createDataFrame([("x", "s"), ("y", "s"), ("y", "z"), ("w", "x")], "name string, ref string")
    assert {r.name for r in graph.closure(spark.createDataFrame([("s",)], "name string"), refs).collect()} == {"s", "x", "w"}
    assert {(r.source, r.node) for r in graph.one_way(edges, spark.createDataFrame([("b",)], "node string")).collect()} == {("b", "c")}


def test_slot_fit(spark):
    rows = [("a", 0, 5), ("a", 1, 6), ("b", 0, 0), ("b", 1, 8), ("c", 0, 1), ("c", 8, 2), ("c", 16, 3), ("d", 1, 7), ("d", 9, 7)]
    got = {r.k: (r.shift, r.mul, r["add"]) for r in cluster.slot_fit(spark.createDataFrame(rows, "k string, x long, y long"), ["k"], "x", "y").collect()}
    assert got == {"a": (0, 1, 5), "b": (0, 8, 0), "c": (3, 1, 1), "d": (0, 0, 7)}


def test_partition(spark):
    rows = [("k", i, i, [3 * i, 5]) for i in range(8)] + [("k", 10 + i, i, [i + 100, 7 - i]) for i in range(6)] + [("k", 99, 1, [7777, 1])]
    got = cluster.partition(spark.createDataFrame(rows, "k string, p long, x long, ys array<long>"), "k", "p", "x", "ys").toPandas()
    assert sorted(got.groupby("part").size().to_dict().items()) == [(-1, 1), (0, 8), (1, 6)]
    assert {tuple(f) for f in got[got.part >= 0].formulas} == {("0 3 0", "0 0 5"), ("0 1 100", "0 -1 7")}
    # a multiplier that isn't tried fits no pair; four rows are too few
    odd = [("k", i, i, [5 * i * i]) for i in range(8)] + [("m", i, i, [i]) for i in range(4)]
    assert set(cluster.partition(spark.createDataFrame(odd, "k string, p long, x long, ys array<long>"), "k", "p", "x", "ys").toPandas().part) == {-1}


def made(f, line):
    return [new for new, _ in f(line)]


def test_mutations():
    assert made(mutate.op_replace, "a ^ b") == ["a & b", "a | b"]
    assert made(mutate.op_replace, "a >= b") == ["a > b", "a == b"] and made(mutate.op_replace, "a < b") == ["a <= b", "a > b"]
    assert made(mutate.op_replace, "a === b !== c = d") == [] and made(mutate.op_replace, "x <<= 1") == ["x <=<= 1", "x ><= 1", "x << 1", "x <== 1"]
    const = lambda x: made(mutate.const_replace, x)
    assert const("8'h15") == ["8'h14"] and const("4'd5") == ["4'd4"] and const("8'h0") == [] and const("1'b0") == ["1'b1"]
    assert const("1") == ["0"] and const("0") == ["1"] and const("7") == ["6", "8"] and const("4'b101") == ["4'b100"] and const("8'hF") == ["8'he"] and const("q_5") == []
    assert made(mutate.slice_move, "x[7:1] = y[3:0]") == ["x[6:0] = y[3:0]", "x[8:2] = y[3:0]", "x[7:1] = y[4:1]"]
    assert made(mutate.cond_negate, "if (!a) x") == ["if (a) x"] and made(mutate.cond_negate, "if ( a ) x") == ["if (!a) x"] and made(mutate.cond_negate, "if (a && b) x") == []
    assert made(mutate.assign_delete, "  assign x = y;") == ["// MUTANT_DELETED: assign x = y;"] and made(mutate.assign_delete, " q[1:0] <= d;") == ["// MUTANT_DELETED: q[1:0] <= d;"] and made(mutate.assign_delete, "x = y;") == []
    assert made(mutate.edge_swap, "posedge a or negedge b") == ["negedge a or negedge b", "posedge a or posedge b"]
    assert made(mutate.signal_swap({"a": 1, "b": 1, "c": 2}), "a = a && b;") == ["b = b && a;"]
    assert mutate.instances(["wire x;", "sub #(.W(8)) u1 (", "  .a(b)", ");", "assign x = y;", "sub u2 (a);", "if (a) b", "always @(c) d"]) == [False, True, True, True, False, True, False, False]


def test_mutants(spark):
    lines = ["assign q = (a == 1'b0) && b;", "// a && b", None, "  begin", "sub u1 (", "  x && y", ");", "if (x) y <= z[7:1];", "wire w = a && b;"]
    df = spark.createDataFrame([("f", i + 1, x) for i, x in enumerate(lines)], "f string, n long, l string")
    got = mutate.mutants(df, "f", "n", "l", widths={"a": 1, "b": 1}).toPandas().sort_values("id")
    assert list(got.id) == list(range(len(got))) and set(got.line_no) == {1, 8}
    assert list(got[got.line_no == 1].mutated) == ["assign q = (a != 1'b0) && b;", "assign q = (a == 1'b0) || b;", "assign q = (a == 1'b1) && b;", "// MUTANT_DELETED: assign q = (a == 1'b0) && b;", "bssign q = (b == 1'a0) && a;"]
    assert mutate.mutants(df, "f", "n", "l", most=3).count() == 3

    def fake(text):
        if "||" in text:
            raise TimeoutError
        return "killed"

    assert set(mutate.evaluate(mutate.mutants(df, "f", "n", "l"), fake).toPandas().status) == {"killed", "timeout"}


def test_repairs(spark):
    P = "assert property (@(posedge clk) "
    rows = [
        (P + "disable iff (!rst) (a && !rst && (b || c && d)) |-> e);", P + "disable iff (!rst) (a && (b || c && d))|-> e);"),
        (P + "disable iff ( (!rst) ) !rst |=> e);", None),
        (P + "disable iff (!rst) a |-> e);", P + "disable iff (!rst) a |-> e);"),
        ("assert (v && !r && !p);", None),
        ("assert (v && r);", "assert (v && r);"),
        ("assert (!(a && b));", "assert (!(a && b));"),
        ("assert (a == 1 && !b);", "assert (a == 1 && !b);"),
        (P + "v && !r);", P + "v && !r);"),
        ("assert (mode == 4'd3);", None),
        (P + "disable iff (!rst) x.y[3:0] == 8'hff);", None),
        ("assert (a == b);", "assert (a == b);"),
        ("assert (MAX_N == 4);", "assert (MAX_N == 4);"),
        (P + "en |-> mode == 4'd3);", P + "en |-> mode == 4'd3);"),
    ]
    df = spark.createDataFrame([(1, i, t) for i, (t, _) in enumerate(rows)], "id int, pos int, assertion string")
    passes = [("a", clean.remove_dead_under_disable), ("b", clean.remove_missing_implication), ("c", clean.remove_unconditional_equality)]
    got = {r.pos: r.assertion for r in clean.clean(df, passes).collect()}
    assert got == {i: t for i, (_, t) in enumerate(rows) if t is not None}
    assert [r.n_left for r in clean.counted(df, passes).orderBy("step").collect()] == [13, 12, 11, 9]


def test_closure(spark):
    # backwards: p is defined and only q, which is in, refers to it; o isn't defined
    refs = spark.createDataFrame([("q", "s"), ("q", "p"), ("p", None), ("s", "o"), ("z", "p2"), ("q2", "p2"), ("q2", "s")], "name string, ref string")
    assert {r.name for r in graph.closure(spark.createDataFrame([("s",), ("q",)], "name string"), refs).collect()} == {"s", "q", "p"}


def test_chunks():
    text = "a" * 900 + "\n\n" + "b" * 900
    got = list(S.snapped(text, 1000, 200))
    assert [(i, s) for i, s, _ in got] == [(0, 0), (1, 700)] or got[0][2] == "a" * 900
    assert list(S.snapped("", 1000, 200)) == [] and list(S.snapped(" \n ", 1000, 200)) == []
    assert [len(c) for _, _, c in S.snapped("x" * 2500, 1000, 200)] == [1000, 1000, 900]


def test_sentences():
    assert list(S.sentences("One two. Three\nfour.\n\n```\nFive")) == [(1, "One two."), (1, "Three four."), (2, "Five")]
    assert list(S.sentences("- a\n- b\n\n~~~\nc! d?\n\ne")) == [(1, "- a - b"), (4, "c!"), (5, "d?"), (5, "e")] and list(S.sentences("")) == []


def test_html():
    page = "<html><head><title>t</title></head><body><nav>menu</nav><h2>Head</h2><p>One &amp; two<br>three</p><div class='ads'>buy</div><ul><li>x</li></ul><script>no()</script></body></html>"
    assert S.markdown(page) == "## Head\n\nOne & two\nthree\n\n- x" and S.markdown(None) == ""


def test_sections_and_assertions(spark):
    md = "# T\n### CWE-12 (Bad thing)\nbody one\n## Other\nx\n### CWE-7 (More)\nlast"
    got = S.sections(spark.createDataFrame([("d", md)], "d string, t string"), "d", "t").collect()
    assert [(r.cwe_id, r.title, r.body) for r in got] == [(12, "Bad thing", "body one"), (7, "More", "last")]
    src = "// why\nassert (a);\nx\nassert (b);"
    rows = S.split_assertions(spark.createDataFrame([("d", src)], "d string, t string"), "d", "t")
    assert [(r.pos, r.comment, r.assertion) for r in rows.orderBy("pos").collect()] == [(1, "// why", "assert (a);"), (3, None, "assert (b);")]
    assert S.join_assertions(rows, "d").first().text == "// why\nassert (a);\nassert (b);"


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.v").write_text("module m; endmodule")
    (tmp_path / "y.sv").write_text("module n; endmodule")
    (tmp_path / "z.txt").write_text("no")
    files = S.files(spark, str(tmp_path), [".v", ".sv"])
    assert files.count() == 2
    assert S.context(files, 10).first().context is None and "module n" in S.context(files, 1000).first().context
    assert len(S.staleness(files).first().checksum) == 16
    assert {r.module for r in S.module_chunks(files, "path", "text").collect()} == {"m", "n"}


def test_run_paths(spark):
    df = spark.createDataFrame([("r/full/cmac/run_03/s.sv",), ("r/cmac/full/run_04/s.sv",), ("r/x/y/other/s.sv",)], "p string")
    got = S.run_paths(df, "p", ["full"]).collect()
    assert [(r.method, r.design, r.run) for r in got] == [("full", "cmac", "03"), ("full", "cmac", "04")]


def test_reports(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"design": "d", "total_tokens": 7, "llm_calls": null}')
    (tmp_path / "b.json").write_text("{oops")
    got = reports.token_summaries(spark, str(tmp_path)).collect()
    assert sorted((r.design or "", r.total_tokens, r.llm_calls) for r in got) == [("", 0, 0), ("d", 7, 0)]
    texts = ['{"iterations": []}', '{"steps": []}', '{"summary_by_operator": {"A": {"total": 4, "killed": 1, "survived": 1, "stillborn": 2}}}', "[1, 2]", "no"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "s int, t string")
    assert [r.x for r in df.select(reports.kind_of(F.col("t")).alias("x")).collect()] == ["lint", "trace", "mutation", "unknown", "unknown"]
    assert [(r.operator, r.kill_rate) for r in reports.mutation_operators(df.where("s = 2"), "s", "t").collect()] == [("A", "50.0%")]
    assert [r.x for r in df.where("s = 3").select(reports.failures_in(F.col("t")).alias("x")).collect()] == [2]
    lint = '{"iterations": [{"iteration": 1, "total_assertions": 2, "passed": 1, "failed": 1, "failures": [{"index": 1, "assertion": "a\\nb", "error": "e"}]}]}'
    summary, failed = reports.lint_tables(spark.createDataFrame([("f", lint)], "s string, t string"), "s", "t")
    assert summary.first().passed == 1 and failed.first().assertion == "a b"
    reports.write_csv(spark.createDataFrame([("a", None, ["y", "x"])], "k string, v int, s array<string>"), str(tmp_path / "out"))
    assert reports.csv_strings(spark, str(tmp_path / "out")).first().asDict() == {"k": "a", "v": "—", "s": "x;y"}


def test_netlist(spark):
    text = '{"modules": {"top": {"ports": {"a": {"direction": "input", "bits": [1, 2]}}, "cells": {"u": {"type": "sub"}}}, "sub": {"ports": {}, "cells": {}}}}'
    made = reports.netlist_tables(spark, spark.createDataFrame([(text,)], "t string"), "t")
    assert made["ports"].first().width == 2 and [(r.parent, r.child) for r in made["edges"].collect()] == [("top", "sub")]


def test_streams(spark, sf, tmp_path):
    from brindle.streaming import counters

    events = counters.table_stream(spark, sf, "events")
    q = counters.windowed(events).writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    assert spark.sql("select sum(n) as n from w").first().n == spark.read.parquet(f"{sf}/events.parquet").count()
    q.stop()
    src = tmp_path / "in"
    pd.DataFrame({"key": ["k"] * 5, "action": ["keep", "remove", "transform", "add", "remove"], "delta": [5, 2, 9, 1, -1]}).to_json(tmp_path / "x.json", orient="records", lines=True)
    src.mkdir()
    (tmp_path / "x.json").rename(src / "x.json")
    steps = spark.readStream.schema("key string, action string, delta long").json(str(src))
    q = counters.running(steps).writeStream.outputMode("update").format("memory").queryName("r").start()
    q.processAllAvailable()
    assert [r.remaining for r in spark.sql("select remaining from r").collect()] == [3]
    q.stop()
    out = counters.append_csv(steps, str(tmp_path / "out"), str(tmp_path / "cp"))
    out.awaitTermination()
    assert spark.read.csv(str(tmp_path / "out")).count() == 5


def test_built_or_loaded(spark, tmp_path):
    made = []

    def build():
        made.append(1)
        return spark.range(3 + len(made))

    load = lambda stamp: retrieval.built_or_loaded(spark, f"file://{tmp_path}/index", stamp, build).count()
    assert [load("a"), load("a"), load("b"), load("b")] == [4, 4, 5, 5] and len(made) == 2


def test_fusion_by_text(spark):
    dense = spark.createDataFrame([(1, "x", 0), (1, "y", 1)], "query int, text string, rank int")
    sparse = spark.createDataFrame([(1, "y", 0), (1, "z", 1)], "query int, text string, rank int")
    assert [r.text for r in retrieval.fuse(dense, sparse, 3, "text").orderBy("rank").collect()] == ["y", "x", "z"]


def test_parted_in_families_across_batches(spark):
    """Rows without a family, families longer than a batch, and many of one row, with the least row and size of each part."""
    rows = [(None, i, [i]) for i in range(500)] + [("a", i, [i, 2 * i + 1]) for i in range(700)] + [("a", 700 + i, [i, 7]) for i in range(3)] + [(f"s{i:03}", i, [i]) for i in range(300)] + [("z", i, None if i else [4]) for i in range(6)]
    df = spark.createDataFrame(rows, "f string, r long, i array<long>").coalesce(1)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = cluster.parted(df, "f", "r", "i").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert len(got) == len(rows)
    by = {(x.f, x.r): x for x in got}
    assert {(x.part, x.size, x.first == x.r) for x in got if x.f is None or x.f[0] == "s"} == {(-1, 1, True)}
    assert {(by["a", i].part, by["a", i].size, by["a", i].first, tuple(by["a", i].formulas)) for i in range(700)} == {(0, 700, 0, ("0 2 1",))}
    assert [(by["a", i].part, by["a", i].size, by["a", i].first) for i in range(700, 703)] == [(-1, 3, 700)] * 3
    assert {(x.part, x.size, x.first) for x in got if x.f == "z"} == {(-1, 6, 0)}


def test_formulas_of_a_large_cluster():
    """A hypothesis for each row, each held against every row, took the square of the cluster."""
    import time

    import numpy as np

    x = np.arange(40000)
    began = time.process_time()
    parts, made = cluster.formulas(x, np.stack([x * 3 + 1, np.where(x % 2 == 0, x, 0)], 1))
    assert time.process_time() - began < 20
    assert made == [["0 3 1", "0 0 0"], ["0 3 1", "0 1 0"]] and parts[0] == 0 and (parts[1::2] == 0).all() and (parts[2::2] == 1).all()


def _shuffled(spark, run):
    """Rows that the stages of a run wrote to shuffles."""
    store, sc = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext
    every = lambda: {s.stageId(): s.shuffleWriteRecords() for s in (lambda q: [q.apply(i) for i in range(q.size())])(store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None))}
    known = set(every())
    got = run()
    return got, sum(n for i, n in every().items() if i not in known)


def test_linked_by_either_way(spark):
    """Neighbours of few ends give their pairs; one that touches all ends is looked up by the pairs that are asked for."""
    import random

    r = random.Random(7)
    edges = {(a, 1000 + r.randrange(4000)) for a in range(300) for _ in range(60)} | {(a, 9999) for a in range(0, 300, 40)} | {(500, 9999), (3, 4), (4, 3), (600, 6001), (601, 6001), (600, 600)}
    edges |= {(a, 7777) for a in range(2000, 2300)} | {(300, 5), (301, 5)}
    pairs = {(r.randrange(300), r.randrange(300)) for _ in range(20000)} | {(500, 0), (2000, 2001), (2299, 2000), (600, 601), (601, 600), (8, 8), (700, 700), (None, 3), (3, None), (800, 801)}
    modules = {(800, "m"), (801, "m"), (None, "m")}
    df = lambda rows, form: spark.createDataFrame(sorted(rows, key=repr), form)
    got, n = _shuffled(spark, lambda: graph.linked(df(pairs, "a long, b long"), df(edges, "a long, b long"), df(modules, "name long, module string")).collect())
    both = {}
    for a, b in edges | {(b, a) for a, b in edges}:
        both.setdefault(a, set()).add(b)
    module = dict(modules)
    wanted = {(a, b) for a, b in pairs if a is not None and b is not None and (b in both.get(a, ()) or both.get(a, set()) & both.get(b, set()) or (a in module and module[a] == module.get(b)))}
    assert len(got) == len(wanted) and {tuple(x) for x in got} == wanted
    assert n < 700_000  # each pair with each neighbour of its rarer end were 1.2 million rows


def test_paths_go_out_from_all_suppliers(spark, sf):
    from brindle.plans.graphs import reach_three, zero_one_path

    suppliers = spark.read.parquet(f"{sf}/supplier.parquet").count()
    for df in (zero_one_path(spark, sf), reach_three(spark, sf)):
        assert df.columns[:2] == ["source", "node"]
        assert df.select("source").distinct().count() == suppliers and df.count() > 100 * suppliers


def test_mutants_hold_a_batch_only(spark):
    """A source was a pandas group with all its lines and mutants."""
    lines = spark.range(3000).select((F.col("id") % 2).alias("f"), F.col("id").alias("n"), F.when(F.col("id") % 10 == 4, "sub u1 (").when(F.col("id") % 10 == 6, ");").otherwise("assign x = a && b;").alias("l"))
    lines = lines.unionByName(spark.createDataFrame([(None, 1, "assign y = a || b;"), (None, None, "assign z = a == b;")], "f long, n long, l string"))
    made = mutate.mutants(lines.repartition(3), "f", "n", "l")
    assert "FlatMapGroupsInPandas" not in made._jdf.queryExecution().executedPlan().toString()
    got = made.collect()
    for f in ("0", "1", None):
        mine = sorted((x for x in got if x.source == f), key=lambda x: x.id)
        assert [x.id for x in mine] == list(range(len(mine)))
        assert [x.line_no for x in mine if x.line_no is not None] == sorted(x.line_no for x in mine if x.line_no is not None)
    assert {x.line_no % 10 for x in got if x.source == "0"} == {0, 2, 8} and {x.line_no % 10 for x in got if x.source == "1"} == {1, 3, 5, 7, 9}
    assert [x.line_no for x in got if x.source is None][-1] is None


def test_sentences_leave_python_by_batches(spark):
    """All sentences of a batch of texts were one pandas table."""
    df = spark.createDataFrame([(2, None), (1, "The reset must fall. " * 9000 + "It shall rise."), (3, "")], "id long, text string")
    made = S.documented(df, "id", "text", ("must", "shall"))
    assert "MapInPandas" not in made._jdf.queryExecution().executedPlan().toString()
    assert [tuple(x) for x in made.collect()] == [(1, 1, "must", "The reset must fall."), (1, 1, "shall", "It shall rise.")]


def test_sentences_are_all_kept(spark):
    """Only the first 60 were."""
    df = spark.createDataFrame([(i, f"Signal {i} must fall. It may rise.\nSignal {i % 50} must fall.") for i in range(100)], "id long, text string")
    made = [tuple(x) for x in S.documented(df, "id", "text", ("must",)).collect()]
    assert sorted(made) == [(i, 1, "must", f"Signal {i} must fall.") for i in range(100)]
    assert sorted(tuple(x) for x in S.documented(df, "id", "text", ("must",), 7, 8).collect()) == [(i, 1, "must", "Signal " + str(i)) for i in range(7)]


def test_bm25_counts_terms_in_the_row(spark):
    # rows' terms are counted in the row, so that only scores are shuffled; rows of one id are one row
    texts = [(1, ["a", "b", "a", None]), (2, ["b"]), (3, []), (4, None), (5, ["c", "a"]), (6, ["c"]), (7, ["d", "d"]), (8, ["e"])]
    rows = spark.createDataFrame(texts, "id long, w array<string>")
    queries = spark.createDataFrame([(1, "a"), (1, "b"), (2, "d"), (2, "none")], "query long, term string")
    n_docs = rows.agg(F.count(F.lit(1)).alias("n"), F.lit(1.5).alias("mean_length"))
    assert [tuple(r) for r in rows.select("id", F.inline(retrieval.counted(F.col("w")))).where("id = 1").collect()] == [(1, "a", 2), (1, "b", 1)]
    scored = retrieval.bm25(rows, "id", "w", queries, n_docs)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in plan
    df = {"a": 2, "b": 2, "d": 1}
    idf = {t: math.log(8 - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
    part = lambda t, tf, length: idf[t] * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / 1.5))
    want = {(1, 1): part("a", 2, 4) + part("b", 1, 4), (1, 2): part("b", 1, 1), (1, 5): part("a", 1, 2), (2, 7): part("d", 2, 2)}
    got = {(r.query, r.id): r.score for r in scored.collect()}
    assert got == pytest.approx(want)
    same = retrieval.bm25(spark.createDataFrame([(1, ["a", "b"]), (1, ["b", "a"]), (2, ["z"])], "id long, w array<string>"), "id", "w", queries, n_docs.select(F.lit(8).alias("n"), "mean_length"))
    assert {(r.query, r.id): r.score for r in same.collect()} == pytest.approx({(1, 1): part("a", 2, 2) + part("b", 2, 2)})
