from pyspark.sql import functions as F

from brindle.operators import facts as X

SOURCE = """module m;
input clk, rst_n;
input [7:0] data_in; // wide
output reg [3:0] q;
wire a;
assign a = data_in & en;
if (!rst_n)
  q <= 4'h0;
else
  q <= a + q;
endmodule"""


def lines(spark):
    return spark.createDataFrame([("f", i, s) for i, s in enumerate(SOURCE.split("\n"))], "source string, no int, line string")


def test_declarations(spark):
    got = {r.name: (r.direction, r.width, r.line) for r in X.declarations(lines(spark), "source", "no", "line").collect()}
    assert got["clk"] == ("input", 1, 1) and got["rst_n"] == ("input", 1, 1) and got["data_in"] == ("input", 8, 2)
    assert got["q"] == ("output", 4, 3) and got["a"] == (None, 1, 4)
    assert [(r.register, r.value) for r in X.reset_values(lines(spark), "source", "no", "line").collect()] == [("q", "4'h0")]
    made = {(r.lhs, r.delay): r.refs for r in X.assignments(lines(spark), "source", "no", "line").collect()}
    assert made["a", 0] == ["data_in", "en"] and made["q", 1] in (["a"], [])


def test_types_and_roles(spark):
    df = spark.createDataFrame([("core_clk", "input", 1), ("wr_en", "input", 1), ("busy", "output", 1), ("x", "input", 1), ("sum", "output", 9)], "name string, direction string, width int")
    got = [r.t for r in df.select(X.signal_type(F.col("name"), F.col("direction"), F.col("width")).alias("t")).collect()]
    assert got == ["clock", "control", "status", "control", "data"]
    marks = spark.createDataFrame([("x", "state"), ("x", "reset"), ("sum", "handshake_init")], "name string, mark string")
    assert {r.name: r.role for r in X.roles(df, marks).collect()} == {"core_clk": "control", "wr_en": "control", "busy": "control", "x": "reset", "sum": "handshake_init"}
    ports = df.withColumn("module", F.lit("top"))
    assert {r.key for r in X.signal_map(ports, "other").collect()} >= {"top.busy"}


def test_blocks(spark):
    df = spark.createDataFrame([(0, ["clk"], ["rst"]), (1, ["clk"], []), (2, ["rs", "clk"], []), (3, [], [])], "block int, posedge array<string>, negedge array<string>")
    got = {r.block: (r.clock, r.reset, r.polarity) for r in X.block_clocks(df).collect()}
    assert got == {0: ("clk", "rst", "low"), 1: ("clk", None, None), 2: ("clk", "rs", "high"), 3: (None, None, None)}


def test_equality_and_eligible(spark):
    df = spark.createDataFrame([("assert (!(c) || (a == 1));",), ("assert (a == 1);",), ("assert property (@(posedge clk) p && q |-> r[0] == s);",), ("assert (a);",)], "t string")
    got = [r.e for r in df.select(X.equality(F.col("t")).alias("e")).collect()]
    assert [(e.names, e.lhs, e.rhs) if e else None for e in got] == [(["c"], "a", "1"), ([], "a", "1"), (["p", "q"], "r[0]", "s"), None]
    one = spark.createDataFrame([(["clk", "WIDTH", "ij", "data", "other"], ["clk"], ["data"])], "i array<string>, s array<string>, k array<string>")
    assert one.select(X.eligible(F.col("i"), F.col("s"), F.col("k")).alias("x")).first().x == ["data"]


def test_flags(spark):
    rows = spark.createDataFrame([(0, ["a", "b"]), (1, ["a", "c"]), (2, ["a", "zz"]), (3, ["a"])], "r int, n array<string>")
    members = spark.createDataFrame([("a", "m"), ("b", "m"), ("c", "k")], "name string, module string")
    inst = spark.createDataFrame([("a", "u1"), ("c", "u2")], "name string, instance string")
    assert {r.r: r.cross for r in X.cross_module(rows, "r", "n", members, inst).collect()} == {0: False, 1: True, 2: False, 3: False}
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 0)], "a string, b string, delay long")
    sides = spark.createDataFrame([(0, ["a"], ["c"]), (1, ["c"], ["a"]), (2, ["x"], ["a"])], "r int, p array<string>, q array<string>")
    assert {r.r: (r.wrong, r.right, r.flagged) for r in X.against_flow(sides, "r", "p", "q", edges).collect()} == {0: (0, 1, False), 1: (1, 0, True), 2: (0, 0, False)}
    claims = spark.createDataFrame([(0, "c", "a", 1), (1, "c", "a", 2), (2, "a", "c", 1)], "r int, to string, of string, d long")
    assert {r.r: (r.least, r.flagged) for r in X.past_depth(claims, "r", "to", "of", "d", edges).collect()} == {0: (1, False), 1: (1, True), 2: (None, False)}
    states = spark.createDataFrame([("st", "2'b00"), ("st", "2'b01")], "signal string, literal string")
    texts = spark.createDataFrame([(0, "assert (st == 2'b01);"), (1, "assert (st == 2'b10);"), (2, "assert (q == 2'b10);")], "r int, t string")
    assert {r.r: r.flagged for r in X.unknown_states(texts, "r", "t", states).collect()} == {0: False, 1: True, 2: False}
    defs = spark.createDataFrame([("sel", "p & w"), ("plain", "p")], "name string, expr string")
    cases = spark.createDataFrame([(0, ["p"], ["sel"]), (1, ["p"], ["plain"]), (2, ["v"], ["sel"])], "r int, c array<string>, s array<string>")
    assert [r.r for r in X.derived_selectors(cases, "r", "c", "s", defs).collect()] == [0]


def test_sections(spark):
    names = spark.createDataFrame([("a", "in"), ("b", "in"), ("c", "out")], "name string, dir string")
    freq = spark.createDataFrame([("b", 9), ("c", 1)], "name string, freq long")
    assert [r.name for r in X.by_frequency(names, freq, 2).collect()] == ["b", "c"]
    assert {(r.dir, r.name) for r in X.by_frequency(names, freq, 1, "dir").collect()} == {("in", "b"), ("out", "c")}
    assert {r.name for r in X.priority_names(names, freq).collect()} == {"a", "b", "c"}
    assert X.preferred(names, "name", freq).count() == 2 and X.preferred(names, "name", freq.where("false")).count() == 3
    texts = [("core", "x" * 400), ("big", "x" * 4000), ("small", "x" * 40)]
    assert X.fill(texts, ["core"], 150) == ["core", "small"] and X.fill(texts, ["core"], 150, {"small": "x" * 80}) == ["core", "small (full)"]
    assert X.choice(names, "name", F.col("dir") == "none", F.col("dir") == "in").first().name == "a"
    assert X.best(names, F.lit(0), F.col("name") != "b", "name").first().name == "b"
    flags = spark.createDataFrame([("s", f"f{i}", i) for i in range(4)] + [("t", "g", 0), ("t", "k", 2)], "source string, flag string, value long")
    assert {r.source: r.assertion for r in X.decoder_checks(flags).collect()} == {"s": "assert ($onehot({f0, f1, f2, f3}));", "t": "assert ($onehot0({g, k}));"}
    kind = spark.createDataFrame([("hold", "q", None, "en", "clk", "rst"), ("nothing", "q", "d", "en", "clk", None)], "k string, l string, r string, c string, clk string, rst string")
    got = [r.t for r in kind.select(X.pattern_text(*[F.col(c) for c in ("k", "l", "r", "c", "clk", "rst")]).alias("t")).collect()]
    assert got == ["assert property (@(posedge clk) disable iff (!rst) !(en) |=> $stable(q));", None]


def test_module_facts_scan_each_text_once(spark):
    """Each extractor scanned the texts anew."""
    from brindle.operators import modules

    df = spark.createDataFrame([("a", "module m;\ninput [3:0] x;\nalways @(posedge clk or negedge rst_n) if (!rst_n) q <= 4'h0; else q <= x;\nendmodule\n")], "id string, text string")
    made = modules.extracted(df, "id", "text")
    assert "MapInArrow" not in made._jdf.queryExecution().executedPlan().toString()
    assert sorted((x.kind, x.name, x.value) for x in made.collect()) == [("clock", "clk", "2"), ("refers", "q", "rst_n"), ("reset", "rst_n", "low"), ("reset_value", "q", "4'h0")]


def test_only_telling_lines_are_put_in_order(spark):
    """All lines of a source went through the windows that find their module."""
    from brindle.operators import modules

    text = "input a;\nx = y;\nmodule m;\nz = 1;\nwire b; // endmodule\nq = 2;\nendmodule\n\nr = 3;\nreg c; /* module n */\n  module o; logic d;\nendmodule module p;\nreg e;\n"
    rows = modules._lines(spark.createDataFrame([("s", text)], "source string, text string")).orderBy("no").collect()
    assert [(x.no, x.module) for x in rows] == [(0, None), (2, "m"), (4, "m"), (6, "m"), (9, None), (10, "o"), (11, "o"), (12, None)]
