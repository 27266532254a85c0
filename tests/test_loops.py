"""Graphs against plain searches, the refine loop, and texts that are long."""

import random

import pytest
from pyspark.sql import functions as F

from brindle.operators import clean, compact, facts, graph, refine, repairs


def plain_delays(edges, most):
    """(a, b): least delay over at most most edges, by rounds."""
    nodes = {x for a, b, _ in edges for x in (a, b)}
    out = {}
    for s in nodes:
        best = {s: 0}
        for _ in range(most):
            new = dict(best)
            for a, b, w in edges:
                if a in best:
                    new[b] = min(new.get(b, 99), best[a] + w)
            best = new
        out |= {(s, x): v for x, v in best.items()}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_pair_delays(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(14), r.randrange(14), r.randrange(2)) for _ in range(26)]
    wanted = plain_delays(edges, 4)
    pairs = [(a, b) for a in range(0, 14, 2) for b in range(14)]
    e = spark.createDataFrame([(a, b, w) for a, b, w in edges], "a long, b long, delay long").groupBy("a", "b").agg(F.min("delay").alias("delay"))
    got = graph.pair_delays(e, spark.createDataFrame([*pairs, pairs[0]], "a long, b long"), 4).collect()
    assert {(x.a, x.b): x.delay for x in got} == {p: wanted.get(p, 0 if p[0] == p[1] else None) for p in pairs} and len(got) == len(pairs)
    flat = plain_delays([(a, b, 0) for a, b, _ in edges], 3)
    both = graph.pairs_reached(e, spark.createDataFrame(pairs, "a long, b long"), 3).collect()
    assert {(x.a, x.b): (x.ahead, x.behind) for x in both} == {p: (p in flat or p[0] == p[1], p[::-1] in flat or p[0] == p[1]) for p in pairs}


def test_detected_has_rules_and_rounds(spark):
    refs = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "x"), ("d", "b"), ("p", "q"), ("p", "p"), ("q", None), ("s", "q")], "name string, ref string")
    seeds = spark.createDataFrame([("a",), ("a",), ("x",), ("p",), ("s",)], "name string")
    assert {(x.name, x.rule, x.round) for x in graph.detected(seeds, refs).collect()} == {("a", "seed", 0), ("x", "seed", 0), ("p", "seed", 0), ("s", "seed", 0), ("b", "forward", 1), ("q", "backward", 1), ("c", "forward", 2), ("d", "forward", 2)}
    assert graph.detected(seeds.limit(0), refs).count() == 0


def test_refine_goes_on_where_it_was_stopped(spark, tmp_path):
    rows = spark.createDataFrame([("1", "ok"), ("2", "bad bad"), ("3", None), ("4", "bad"), ("4", "bad")], "id string, text string")
    better = lambda failed: failed.select("id", F.regexp_replace("text", "bad ?", "").alias("text")).where("text IS NOT NULL")
    passed, report, end = refine.loop(rows, refine.by_function(lambda x: "found bad" if "bad" in x else None), better, f"file://{tmp_path}/a")
    assert sorted((x.id, x.text, x.round) for x in passed.collect()) == [("1", "ok", 1), ("2", "", 2), ("4", "", 2), ("4", "", 2)]
    assert report.values.tolist() == [[1, 5, 1, 4], [2, 3, 3, 0]] and end == "ALL_PASSED"

    def dies(failed):
        raise KeyboardInterrupt

    check = lambda c: F.when(c.contains("bad"), "found bad")
    with pytest.raises(KeyboardInterrupt):
        refine.loop(rows, check, dies, f"file://{tmp_path}/b")
    (tmp_path / "b" / "round-2").mkdir()  # a round that was killed has no mark of success
    again, report_, end = refine.loop(rows, check, better, f"file://{tmp_path}/b")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, passed.collect())) and report_.equals(report) and end == "ALL_PASSED"
    same = lambda failed: failed
    assert refine.loop(rows, check, same, f"file://{tmp_path}/c", 2)[2] == "MAX_ITERATIONS_REACHED"
    assert refine.loop(rows, check, None, f"file://{tmp_path}/d")[2] == "NO_REFINEMENT"
    assert refine.loop(rows, check, lambda failed: failed.limit(0), f"file://{tmp_path}/e")[2] == "EMPTY_REFINEMENT"
    assert refine.loop(rows.limit(0), check, same, f"file://{tmp_path}/f")[2] == "ALL_PASSED"


def test_long_clauses_do_not_end_the_jvm(spark):
    n = 100_000
    long_ = "a" * n
    df = spark.createDataFrame([(1, f"assert property (@(posedge clk) disable iff ({long_} || (b & {long_})) x |-> y);", "{" + "{a}, " * (n // 5) + "}", "wire" + " " * n + "abc;")], "id long, a string, b string, c string")
    row = df.select(clean.body(F.col("a")).alias("body"), F.char_length(repairs.value_read(F.col("b"))).alias("braces")).first()
    assert row.body == "x |-> y" and row.braces == n + 2
    assert facts.declarations(df, "id", "id", "c").first().name == "abc"


def test_compaction_places_every_row_once(spark):
    facts_ = (None, None, None, None)
    at_clock = ("clk", "rst_n", True, "low")
    rows = [("s", i, i, "seq_reset", None, "!rst_n", f"q_{i}", "8'h0", *at_clock) for i in range(3)]
    rows += [("s", 3, 3, "seq_reset", None, "!rst_n", "odd", "other", *at_clock), ("s", 4, 4, "seq_func", None, None, "r", "r + 1", *at_clock)]
    rows += [("s", 5 + i, 5 + i, "seq_func", None, c, f"u_{i}", "{a, b}", *at_clock) for i, c in enumerate(["en", "(en)", "(en) == 1'b1"])]
    rows += [("s", 10 + i, 10 + i, "ternary_mux", None, None, f"m_{i}", f"sel[{i + 32}] ? a_{i * 2} : b_{i}", *facts_) for i in range(6)]
    rows += [("s", 20 + i, 20 + i, "wire_passthrough", None, None, f"w_{i}", f"a_{i * i}", *facts_) for i in range(3)] + [("t", 0, 0, "wire_passthrough", None, None, "w_9", "a_9", *facts_), ("t", 0, 0, "wire_passthrough", None, None, "w_9", "a_9", *facts_)]
    rows += [(None, 0, 0, "if_branch", "c", b, n, "f(a, b)", *facts_) for b in ("then", "else") for n in ("x", "y")]
    df = spark.createDataFrame(rows, "source string, no long, line long, pattern_type string, selector string, condition string, lhs string, rhs string, clock string, reset string, reset_is_async boolean, reset_polarity string").withColumn("module", F.lit("m"))
    routed = compact.route(df).cache()
    assert routed.count() == len(rows) and routed.select("source", "row").distinct().count() == len(rows)
    roles = {(x.source, x.lhs, x.condition): (x.role, x.route) for x in routed.collect()}
    assert roles["s", "q_1", "!rst_n"] == ("packed", "review") and roles["s", "odd", "!rst_n"] == ("single", "review") and roles["s", "r", None] == ("single", "review")
    assert roles["s", "m_3", None] == ("family", "review") and roles["s", "w_0", None] == ("representative", "direct") and roles["s", "w_2", None] == ("sibling", "direct")
    units = compact.emitted(routed)
    texts = sorted(x.text for x in units.collect())
    assert "assert property (@(posedge clk) disable iff (!rst_n) (en) |=> {u_0, u_1, u_2} == $past({{a, b}, {a, b}, {a, b}})) else $error(\"Packed seq_func mismatch across 3 signals\");" in texts
    assert any(x.startswith("assert ({m_5, m_4, m_3, m_2, m_1, m_0} == ((~{sel[37], sel[36]") for x in texts)
    members = routed.where("role IN ('packed', 'family')")
    wanted = sorted((x.source or "", x.lhs, "'0" if x.pattern_type == "seq_reset" else x.rhs) for x in members.collect())
    assert sorted((x.source or "", x.lhs, x.rhs) for x in compact.expanded(units).collect()) == wanted
    report = compact.report(routed).first()
    assert (report.n_patterns, report.n_packed, report.largest) == (len(rows), len(wanted), 6)
    assert compact.route(df.limit(0)).count() == 0


def test_overlap_is_that_of_all_pairs(spark):
    from brindle.operators import coverage

    r = random.Random(7)
    words = [f"w{i}" for i in range(30)]
    draw = lambda n: [words[min(int(r.expovariate(0.15)), 29)] for _ in range(n)]
    events = [(i, draw(r.randrange(9))) for i in range(60)] + [(90, ["none", "never"]), (91, []), (92, None)]
    texts = [(i, draw(r.randrange(12))) for i in range(80)] + [(99, None)]
    e, t = spark.createDataFrame(events, "e long, w array<string>"), spark.createDataFrame(texts, "t long, g array<string>")
    got = {x.e: (x.best, x.covered) for x in coverage.overlap(e, "e", "w", t, "t", "g").collect()}
    wanted = {}
    for i, w in events:
        best, n = max(len(set(w or []) & set(g or [])) for _, g in texts), len(set(w or []))
        wanted[i] = (best, n > 0 and best >= max(-(-n // 2), 1))
    assert {k: v for k, v in got.items() if k != 92} == {k: v for k, v in wanted.items() if k != 92} and got[92][0] == 0


def test_trace_in_two_forms(spark, tmp_path):
    from brindle.operators import retrieval
    from brindle.sources import reports

    steps = spark.createDataFrame([(2, "draft", "b", "t2", "x\ny" * 100, ["lint", "read"], 3, 10, None, "n"), (1, "plan", "a", "t1", None, None, None, None, None, None)], "no long, phase string, step string, timestamp string, output string, tools array<string>, assertions long, prompt_tokens long, completion_tokens long, notes string")
    reports.write_trace(steps, str(tmp_path))
    rows = spark.read.csv(f"{tmp_path}/trace.csv", header=True).orderBy("no").collect()
    assert [(x.output_length, x.n_tools, x.tools, x.total_tokens) for x in rows] == [("0", "0", "-", "0"), ("300", "2", "lint, read", "10")] and rows[1].preview == ("x y" * 100)[:150]
    assert spark.read.json(f"{tmp_path}/trace.json").count() == 2
    assert [retrieval.index_kind(*x) for x in ((5, True, True, False), (4, True, True, False), (9, True, False, True), (4, True, False, False))] == ["hierarchical", "hybrid", "dense", "dense"]


def test_rows_are_dealt_by_size(spark, monkeypatch, sf):
    # tasks hold about TASK_ROWS rows of a table that has grown, with the same results
    from brindle.plans import designs

    plain = sorted(map(tuple, designs.source_blocks(spark, sf).collect()))
    monkeypatch.setattr(graph, "TASK_ROWS", 250)
    made = designs.source_blocks(spark, sf)
    assert made.rdd.getNumPartitions() > 4
    assert sorted(map(tuple, made.collect())) == plain
    assert designs.texts(spark, sf).rdd.getNumPartitions() > 4


def test_out_of_scope_seed_meets_names_once(spark):
    rows = [("a", "i1", "gate", "output"), ("b", "i1", "gate", "input"), ("c", "i1", "gate", "input"), ("c", "i2", "logic", "input"), ("d", "i2", "logic", "output"), (None, "i1", "gate", "input"), (None, "i2", None, "input"), ("e", "i1", "gate", None), ("f", "i1", "gate", "input"), ("f", "i3", "logic", "output")]
    c = spark.createDataFrame(rows, "name string, instance string, type string, direction string")
    found = graph.out_of_scope_seed(c, spark.createDataFrame([("gate",), ("gate",)], "type string"))
    assert sorted(map(str, (x.name for x in found.collect()))) == ["None", "a", "b", "f"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("LogicalRDD") == 2

def test_least_delays_write_inner_nodes_only(spark, monkeypatch):
    # nodes without edges of their own are found in the last step and written by no round
    r = random.Random(5)
    rows = list({(a, b): (a, b, r.randint(0, 1)) for a, b in ((r.randint(0, 9), r.randint(0, 400)) for _ in range(300)) if a != b}.values())
    edges, plain, sizes = spark.createDataFrame(rows, "a long, b long, delay long"), graph.cut, []

    def cut(df):
        made = plain(df)
        sizes.append(made.count())
        return made

    monkeypatch.setattr(graph, "cut", cut)
    sources = spark.createDataFrame([(x,) for x in [*range(12), 3]], "node long")
    for most in (0, 1, 2, 4):
        want = {(s, n): d for (s, n), d in plain_delays(rows + [(x, -1, 0) for x in range(12)], most).items() if n >= 0 and s < 12}
        got = [(x.source, x.node, x.delay) for x in graph.least_delays(edges, sources, most).collect()]
        assert len(got) == len(set(got)) and {(s, n): d for s, n, d in got} == want
    assert max(sizes) <= 12 * 12


def test_least_delays_meet_in_blocks(spark, monkeypatch):
    """Steps joined each path of each source; sources and nodes meet in blocks, of which only the answer leaves the task."""
    monkeypatch.setattr(graph, "SOURCE_BITS", 2)
    monkeypatch.setattr(graph, "NODE_BITS", 3)
    r = random.Random(8)
    rows = list({(a, b): (a, b, r.randint(0, 1)) for a, b in ((r.randint(0, 40), r.randint(0, 90)) for _ in range(160)) if a != b}.values())
    edges = spark.createDataFrame([*rows, (None, 3, 0), (4, None, 0)], "a int, b long, delay int")
    sources = spark.createDataFrame([(x,) for x in [*range(50), 7, None]], "node int")
    for most in (1, 3):
        want = {(s, n): d for (s, n), d in plain_delays(rows + [(x, -1, 0) for x in range(50)], most).items() if n >= 0 and s < 50} | {(None, None): 0}
        found = graph.least_delays(edges, sources, most)
        got = [(x.source, x.node, x.delay) for x in found.collect()]
        assert len(got) == len(set(got)) and {(s, n): d for s, n, d in got} == want
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()
    letters = spark.createDataFrame([("a", "b", 1), ("b", "c", 0), ("a", "c", 1)], "a string, b string, delay long")
    assert {tuple(x) for x in graph.reachable(letters, spark.createDataFrame([("a",), ("a",), ("z",)], "node string"), 2).collect()} == {("a", "a"), ("a", "b"), ("a", "c"), ("z", "z")}


def test_reach_three_goes_three_edges(spark, tmp_path):
    """It went two, over edges without delay only."""
    from brindle.plans.graphs import reach_three

    spark.createDataFrame([(1, 2, 1), (2, 3, 1), (3, 4, 2), (4, 5, 1), (9, 9, 1)], "l_suppkey long, l_partkey long, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(1,), (9,)], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    assert sorted(tuple(x) for x in reach_three(spark, str(tmp_path)).collect()) == [(1, 1), (1, 2), (1, 3), (1, 4), (9, 9)]
