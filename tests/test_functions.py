"""Small cases with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from brindle.functions import text as X
from brindle.operators import clean


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    ("f", "text", "want"),
    [
        (X.search_tokens, "AES_Encrypt keyOut2", ["aes", "encrypt", "key", "out2"]),
        (X.template, "x_3 == y[66]", "x_* == y[*]"),
        (X.template, "a == 8'h0", "a == 8'h0"),
        (X.template_indices, "x_3 == y[66]", [3, 66]),
        (X.canonical_constant, "1'b0", "'0"),
        (X.canonical_constant, "{16{1'b0}}", "'0"),
        (X.canonical_constant, "8'hff", "'1"),
        (X.canonical_constant, "3'd7", "'1"),
        (X.canonical_constant, "2'o3", "'1"),
        (X.canonical_constant, "7'h7f", "'1"),
        (X.canonical_constant, "8'h0f", "8'h0f"),
        (X.canonical_constant, "4'bxx01", "4'bxx01"),
        (X.canonical_constant, "128'hffffffffffffffffffffffffffffffff", "'1"),
        (X.canonical_constant, "reg_q", None),
        (X.category, "assert property (!rst |-> q == 0);", "reset-imp"),
        (X.category, "assert property (en |=> $past(a) == b);", "seq-update"),
        (X.category, "// note", "non-assert"),
        (X.idents, 'assert property (@(posedge clk) a |-> q == 8\'hff) else $error("bad x");', ["clk", "a", "q"]),
        (X.antecedent_count, "assert property (@(posedge clk) a && q |-> c);", 2),
        (X.design_name, "nvdla_cmac", "cmac"),
        (X.design_name, "coral_rvv_backend", "rvv_backend"),
        (X.design_name, "rvv_backend", "rvv"),
        (X.literal_width, "8'hff", 8),
        (X.select_width, "a[7:0]", 8),
        (X.select_width, "a[3]", 1),
        (X.select_width, "a", None),
        (X.strip_outer, "((a) && (b))", "(a) && (b)"),
        (X.strip_outer, "(a) && (b)", "(a) && (b)"),
        (X.balanced, "(a))(", False),
        (X.modal, "It must not fall.", "must"),
        (X.modal, "It is Required  to hold, always so.", "required"),
        (X.modal, "It will never be; we must", "never"),
        (X.modal, "It will be as we must", None),
        (X.data_uri, "data:text/plain;base64,aGk=", "hi"),
        (X.token_estimate, "abcdefghi", 2),
        (X.fenced_code, "x\n```sv\nassert a;\n```\ny", "assert a;"),
        (X.property_block, "so\nproperty p; a; endproperty\nassert property (p);\nok", "property p; a; endproperty\nassert property (p);"),
        (X.canonical, "assert property (@(posedge clk) b || !  a);", "!a || b"),
        (X.canonical, None, None),
    ],
)
def test_text(spark, f, text, want):
    assert one(spark, text, f) == want


def test_tags_and_ratios(spark):
    df = spark.createDataFrame([("a_b_naive", 25.0, 100.0), ("solo", 1.0, 0.0)], "t string, a double, b double")
    got = df.select(X.split_tag(F.col("t")).alias("s"), X.reduction(F.col("a"), F.col("b")).alias("r"), X.safe_ratio(F.col("a"), F.col("b")).alias("q")).collect()
    assert [(r.s.name, r.s.variant, r.r, r.q) for r in got] == [("a_b", "naive", "+75.0%", 0.25), ("solo", "", "n/a", None)]


def test_inflate(spark):
    df = spark.createDataFrame([("x_* == y[*]", [3, 66])], "t string, i array<long>")
    assert df.select(X.inflate(F.col("t"), F.col("i")).alias("x")).first().x == "x_3 == y[66]"


def test_tool_calls_and_plans(spark):
    text = 'a <tool_call>{"name": "f"}</tool_call> <tool_call>{bad</tool_call> [1, 2]'
    assert one(spark, text, lambda t: F.size(X.tool_calls(t))) == 1
    assert one(spark, text, lambda t: X.plan_json(t).cast("string")) == "[1,2]"


def chain(spark, *texts):
    df = spark.createDataFrame([("f", i, None, t) for i, t in enumerate(texts)], "id string, pos int, comment string, assertion string")
    return [r.assertion for r in clean.clean(df).orderBy("pos").collect()]


def test_chain(spark):
    p = "assert property (@(posedge clk) "
    kept = [p + "a |-> b == c);", p + "req |=> ack);", p + "p == q);"]
    gone = [p + "x == x);", p + "a && !a |-> b);", p + "a && b |-> a);", "assert (1'b1);", p + "m == 4'd3);", "assert (v && !r);", p + "a  |->  b == c);", p + "a || !a);"]
    assert chain(spark, *kept, *gone) == kept
    assert chain(spark, p + "a |-> !(!(b)));") == [p + "a |-> b);"]
    assert chain(spark) == []


def test_counted(spark):
    p = "assert property (@(posedge clk) "
    df = spark.createDataFrame([("f", 0, None, p + "x == x);"), ("f", 1, None, p + "a |-> b);"), ("f", 2, None, p + "a |->  b);")], "id string, pos int, comment string, assertion string")
    left = {r["pass"]: r.n_left for r in clean.counted(df).collect()}
    assert left["input"] == 3 and left["remove_self_comparison"] == 2 and left["semantic_deduplicate"] == 1


def test_fact_passes(spark):
    p = "assert property (@(posedge clk) "
    df = spark.createDataFrame([("f", 0, None, p + "!rst |-> q == 8'h01);"), ("f", 1, None, p + "en |=> w == 4'h3);"), ("f", 2, None, p + "en |-> q == 9'h1);")], "id string, pos int, comment string, assertion string")
    resets = spark.createDataFrame([("q", "8'h00")], "register string, value string")
    widths = spark.createDataFrame([("q", 8), ("w", 4)], "name string, width int")
    names = spark.createDataFrame([("w",)], "name string")
    owners = spark.createDataFrame([("4'h3", "z")], "literal string, name string")
    pos = lambda d: sorted(r.pos for r in d.collect())
    assert pos(clean.reset_values(resets)(df)) == [1, 2]
    assert pos(clean.known_widths(widths)(df)) == [0, 1]
    assert pos(clean.constant_owners(owners)(df)) == [0, 2]
    assert [r.assertion for r in clean.next_cycle_on(names, True)(df).where("pos = 1").collect()] == [p + "en |-> w == 4'h3);"]
