"""Queries of lookups, ranked sections, property bodies and single passes, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import text as X
from brindle.operators import clean, cluster, facts, lookup, repairs
from brindle.plans.tables import ASSERTIONS, assertions, parts, t


def _shapes(spark, d, shapes):
    """Rows id, pos, assertion of all parts; the shapes take turns, and {n} is the part's size."""
    each = [F.replace(F.lit(s), F.lit("{n}"), F.col("p_size").cast("string")) for s in shapes]
    return parts(spark, d).select(F.col("p_brand").alias("id"), F.col("p_partkey").alias("pos"), F.get(F.array(*each), (F.col("p_partkey") % len(shapes)).cast("int")).alias("assertion"))


def _sql(shapes, columns):
    """The parts of the shapes whose expected columns are given; a null in the first column leaves the shape out."""
    said = lambda x: "NULL" if x is None else str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, int) else "replace('" + x.replace("'", "''") + "', '{n}', p_size::VARCHAR)"
    names = list(columns)
    cases = {n: "CASE p_partkey % " + str(len(shapes)) + " " + " ".join(f"WHEN {i} THEN {said(v)}" for i, v in enumerate(columns[n]) if v is not None) + " END" for n in names}
    kept = [str(i) for i, v in enumerate(columns[names[0]]) if v is not None]
    return f"SELECT p_partkey AS pos, {', '.join(f'{c} AS {n}' for n, c in cases.items())} FROM part WHERE p_partkey % {len(shapes)} IN ({', '.join(kept)})"


_P = "assert property (@(posedge clk) "
#: An assertion, and what single passes leave of it.
_REPAIRS = (
    (_P + "disable iff (!rst) (a && !rst && (b || c{n})) |-> e);", _P + "disable iff (!rst) (a && (b || c{n}))|-> e);"),
    (_P + "disable iff (!rst) !rst |=> e{n});", None),
    ("assert (v{n} && !r && !p);", None),
    ("assert (v{n} && r);", "assert (v{n} && r);"),
    ("assert (mode{n} == 4'd3);", None),
    ("assert (MAX{n} == 4);", "assert (MAX{n} == 4);"),
    (_P + "a{n} && b |-> b);", None),
    (_P + "a{n} && b |-> c || b);", None),
    (_P + "a{n} |-> c || d);", _P + "a{n} |-> c || d);"),
    (_P + "en |-> (x{n}) <= x{n});", None),
    (_P + "en |-> x{n} < y);", _P + "en |-> x{n} < y);"),
    ("assert (q[7:0] == d{n}[8:1]);", None),
    ("assert (q == d{n}[8:1]) else $error(\"x\");", None),
    ("assert (q[7:0] == d{n}[3:0]);", "assert (q[7:0] == d{n}[3:0]);"),
)
_LOOPS = (("assert (x{n}[i] == sig) else $error(\"on it; be\");", True), ("assert (ab == 4'hf);", False), ("assert (sig{n} == ok);", False), (_P + "k |-> sig{n});", True))
_MESSAGES = (("out{n} mismatch", "out{n}"), ("the data incorrect, expected sum{n}", "sum{n}"), ("crc{n} output wrong", "crc{n}"), ("result must be even", None), ("flag{n} should be low", "flag{n}"), ("nothing", None))
_SHORT = (("assert property (@(posedge clk) a |-> b{n}) else $error(\"no\");", "@(posedge clk) a |-> b{n}"), ("  assert ((a) && (b{n}));", "(a) && (b{n})"), ("// assert x", None), ("assert (" + "x" * 120 + ");", "x" * 97 + "..."))
_BODY = "property p_{n};\n  @(posedge clk)\n  a |-> b{n} ;\nendproperty\nother text\nPROPERTY q;  c ; endproperty"
_NAMED = (
    ("assert property (p_{n});", "assert property (@(posedge clk) a |-> b{n});", "assert property (p_{n})  @(posedge clk) a |-> b{n};"),
    ("Assert  property ( q );", "assert property (c);", "Assert  property ( q )  c;"),
    ("assert property (none);", "assert property (none);", "assert property (none)  c;"),
    ("assert property (a |-> b);", "assert property (a |-> b);", "assert property (a |-> b);"),
)
_ANDS = (
    ('assert (en && (a || b) && sum{n} == c) else $error("sum{n} mismatch");', 'assert (en && (a || b) && sum{n} == c) else $error("sum{n} mismatch");'),
    ('assert (en && mode && SUM{n} == c) else $error("sum{n} mismatch");', 'assert (!(en && mode) || (SUM{n} == c)) else $error("sum{n} mismatch");'),
    ('assert (en && sum{n} == c) else $error("sum{n} mismatch");', 'assert (en && sum{n} == c) else $error("sum{n} mismatch");'),
    ('assert (a && f(x && y) && q{n} == 1 && q{n} != z) else $error("expected q{n}");', 'assert (!(a && f(x && y)) || (q{n} == 1 && q{n} != z)) else $error("expected q{n}");'),
    ('assert (a && b && c{n}) else $error("the data wrong");', 'assert (a && b && c{n}) else $error("the data wrong");'),
)
_ONLY = (
    ('assert (en{n}) else $error("out must be 4\'hf");', 'assert (!(en{n}) || (out == 4\'hf)) else $error("out must be 4\'hf");'),
    ('assert (en{n}) else $error("out must be 8\'hf0");', None),
    ('assert (en{n}) else $error("ghost must be 1");', None),
    ('assert (en{n} && top) else $error("top should be 1 and u.low shall be 0 here, must be so");', 'assert (!(en{n} && top) || (u.low == 0)) else $error("top should be 1 and u.low shall be 0 here, must be so");'),
    ('assert (en{n}) else $error("all wrong");', 'assert (en{n}) else $error("all wrong");'),
    ('assert (en{n} || x) else $error("out must be 1");', 'assert (en{n} || x) else $error("out must be 1");'),
    ("assert property (en{n});", "assert property (en{n});"),
)
_VALUES = ((" 32'h55{n} rest", "32'h55{n}"), ("{4{1'b0}} x", "{4{1'b0}}"), ("name_{n}, y", "name_{n}"), ("; none", None), ("{open {n", None))
_CHOICES = (("(a{n} == b) ? c : (d ? e : f)", ("a{n} == b", "c", "(d ? e : f)")), ("((x) ? y{n} : z)", ("x", "y{n}", "z")), ("f(a ? b : c{n})", None), ("p ? q{n} ? r : s : t", ("p", "q{n} ? r", "s : t")), ("a{n} + b", None))
#: The parenthesis before the message counts as the missing wrapper's.
_FRAGMENTS = (
    ("// why\n((a{n}) |-> (b))\n  else $error(\"x\");\nassert (c);", "// why\nassert property (@(posedge clk) disable iff (!rst) ((a{n}) |-> (b)) else $error(\"x\");\nassert (c);"),
    ("(a{n} && b) else $error(\"x\")\n\nwire q;", "assert ((a{n} && b) else $error(\"x\");\n\nwire q;"),
    ("property p{n};\n a |-> b;\nendproperty", "property p{n};\n a |-> b;\nendproperty"),
)


def glob_filter(spark, d):
    return lookup.by_globs(t(spark, d, "part"), F.col("p_type"), ("*BRASS", "STANDARD*", "[!A-S]?????"), ("*TIN*",)).select("p_partkey")


def name_lookup(spark, d):
    return lookup.containing(t(spark, d, "part").select("p_partkey", "p_type"), "p_type", "Steel")


def missing_lookup(spark, d):
    return lookup.containing(t(spark, d, "part").select("p_partkey", "p_type"), "p_type", "no such type")


def exact_lookup(spark, d):
    return lookup.exactly(t(spark, d, "customer").select(F.col("c_custkey").alias("k")), t(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey"), "k")


def allowed_targets(spark, d):
    kinds = F.get(F.array(*map(F.lit, ("direct_assign", "wire_passthrough", "comb_comparison", "case_branch"))), (F.col("p_partkey") % 4).cast("int"))
    target = F.concat(F.lit("s"), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, "[3:0], other").otherwise(" "))
    rows = t(spark, d, "part").select("p_partkey", kinds.alias("kind"), target.alias("target"))
    return lookup.of_allowed(rows, "kind", "target", t(spark, d, "nation").select(F.concat(F.lit("s"), F.col("n_nationkey").cast("string")).alias("name")), "name").select("p_partkey")


def module_participation(spark, d):
    li = t(spark, d, "lineitem").withColumn("name", F.col("l_partkey"))
    return lookup.participation(li.select("name", F.col("l_returnflag").alias("module")), li.select("name", F.col("l_linestatus").alias("module")), li.select("name", F.col("l_returnflag").alias("parent"), F.concat("l_returnflag", "l_linestatus").alias("child")))


def name_counts(spark, d):
    return lookup.name_counts(assertions(spark, d), "assertion")


def listed_names(spark, d):
    return lookup.listed(t(spark, d, "nation"), ["n_regionkey"], "n_name").select("n_regionkey", F.array_join("names", ",").alias("names"), "n")


def run_matrix(spark, d):
    return lookup.run_matrix(t(spark, d, "orders"), ["o_orderpriority"], F.col("o_orderstatus") == "F")


def denylist_totals(spark, d):
    return lookup.denylist_totals(t(spark, d, "part").select("p_brand", F.when(F.col("p_size") % 5 == 0, "n/a").otherwise(F.concat(F.col("p_size").cast("string"), F.lit(".7"))).alias("c")), "p_brand", "c")


def ranked_properties(spark, d):
    words = F.array(*[F.concat(F.lit("w"), (F.col("p_size") % k).cast("string")) for k in (7, 5, 3)])
    signals = F.when(F.col("p_partkey") % 2 == 0, F.array_append(words, F.lit("z"))).otherwise(words)
    props = t(spark, d, "part").select("p_partkey", signals.alias("signals"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("sentence"))
    return lookup.ranked_properties(props, "signals", "sentence", t(spark, d, "region").select(F.concat(F.lit("w"), F.col("r_regionkey").cast("string")).alias("name")), "name").select("p_partkey", "n_priority", "n_signals", "place")


def ranked_pairs(spark, d):
    pairs = t(spark, d, "customer").select(F.concat(F.lit("a"), F.col("c_custkey").cast("string")).alias("initiator"), F.concat(F.lit("b"), F.col("c_nationkey").cast("string")).alias("responder"), F.when(F.col("c_custkey") % 2 == 0, "high").otherwise("low").alias("confidence"))
    freq = t(spark, d, "orders").groupBy(F.concat(F.lit("a"), F.col("o_custkey").cast("string")).alias("name")).agg(F.count(F.lit(1)).alias("freq"))
    return lookup.ranked_pairs(pairs, freq, t(spark, d, "region").select(F.concat(F.lit("b"), (F.col("r_regionkey") * 5).cast("string")).alias("name"))).select("initiator", "responder", "score")


def first_and_last(spark, d):
    return lookup.ends(t(spark, d, "orders").select("o_orderkey"), "o_orderkey", 10)


def coverage_events(spark, d):
    part = t(spark, d, "part")
    cases = part.select(F.col("p_brand").alias("selector"), F.col("p_type").alias("lhs"), F.when(F.col("p_size") % 3 > 0, F.col("p_size").cast("string")).otherwise("").alias("condition"), F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("key"))
    return lookup.coverage_events(part.select(F.col("p_brand").alias("key")), part.select(F.col("p_type").alias("key")), cases, "key")


def appended_rows(spark, d):
    one = t(spark, d, "nation").select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("name"))
    return lookup.appended(one, t(spark, d, "region").select(F.col("r_regionkey").alias("pos"), F.col("r_name").alias("name")), "pos")


def property_inlining(spark, d):
    files = t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.replace(F.lit(_BODY), F.lit("{n}"), F.col("p_size").cast("string")).alias("text"))
    rows = _shapes(spark, d, [x[0] for x in _NAMED]).select(F.col("pos").alias("id"), F.lit(100).alias("pos"), "assertion")
    bodies = clean.property_bodies(files, "id", "text")
    near = clean.inlined(rows, bodies, rebuilt=False, nearest=True).select("id", F.col("assertion").alias("behind"))
    return clean.inlined(rows, bodies).join(near, "id").select(F.col("id").alias("pos"), F.col("assertion").alias("rebuilt"), "behind")


def repaired_assertions(spark, d):
    passes = [("", f) for f in (clean.remove_dead_under_disable, clean.remove_missing_implication, clean.remove_unconditional_equality, clean.remove_tautologies, clean.remove_self_comparison, clean.remove_slice_restatements)]
    return clean.clean(_shapes(spark, d, [x[0] for x in _REPAIRS]), passes).select("pos", "assertion")


def loop_scope(spark, d):
    widths = t(spark, d, "region").select(F.get(F.array(*map(F.lit, ("ab", "ok", "clk", "sig", "x"))), F.col("r_regionkey").cast("int")).alias("name"))
    return clean.loop_scope(widths)(_shapes(spark, d, [x[0] for x in _LOOPS])).select("pos", "assertion")


def low_affinity(spark, d):
    rows = t(spark, d, "part").select(F.col("p_brand").alias("id"), F.col("p_partkey").alias("pos"), F.concat(F.lit("assert (n"), (F.col("p_size") % 25).cast("string"), F.lit(" == n"), (F.col("p_partkey") % 25).cast("string"), F.lit(");")).alias("assertion"))
    n = t(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("name"), "n_regionkey")
    edges = n.alias("x").join(n.alias("y"), "n_regionkey").where("x.name <> y.name").select(F.col("x.name").alias("a"), F.col("y.name").alias("b"))
    return clean.affinity(edges)(rows).select("pos", F.array_join("flags", ",").alias("flags"))


def checked_signals(spark, d):
    return _shapes(spark, d, [x[0] for x in _MESSAGES]).select("pos", X.checked_signal(F.col("assertion")).alias("signal")).where("signal IS NOT NULL")


def covered_signatures(spark, d):
    return _shapes(spark, d, [x[0] for x in _SHORT]).select("pos", X.covered_signature(F.col("assertion")).alias("signature")).where("signature IS NOT NULL")


def and_forms(spark, d):
    return repairs.fix_immediate_and_form(_shapes(spark, d, [x[0] for x in _ANDS])).select("pos", "assertion")


def condition_only(spark, d):
    names = F.get(F.array(*map(F.lit, ("out", "top", "low", "en", "x"))), F.col("r_regionkey").cast("int"))
    signals = t(spark, d, "region").select(names.alias("name"), F.when(F.col("r_regionkey") == 0, 4).alias("width"))
    return repairs.fix_condition_only(signals)(_shapes(spark, d, [x[0] for x in _ONLY])).select("pos", "assertion")


def values_read(spark, d):
    return _shapes(spark, d, [x[0] for x in _VALUES]).select("pos", repairs.value_read(F.col("assertion")).alias("value")).where("value IS NOT NULL")


def ternaries(spark, d):
    return repairs.ternaries(_shapes(spark, d, [x[0] for x in _CHOICES]), "pos", "assertion")


def wrapped_fragments(spark, d):
    return repairs.with_wrapped_fragments(_shapes(spark, d, [x[0] for x in _FRAGMENTS]), "pos", "assertion", "clk", "rst")


def doc_coverage(spark, d):
    props = t(spark, d, "part").select(F.col("p_partkey").alias("pos"), F.lit("must").alias("modal"), F.array(F.concat(F.lit("s"), F.col("p_size").cast("string")), F.lit("s1")).alias("signals"))
    used = t(spark, d, "nation").select(F.concat(F.lit("s"), F.col("n_nationkey").cast("string")).alias("name"))
    return repairs.doc_coverage(props, "signals", used, "name")


_said = lambda c: F.array_join(c, ",")
#: A text function, a text and what it gives.
_FUNCTIONS = (
    (lambda c: _said(X.idents_before_message(c)), "assert (a{n} == 8'h0f && $past(sig)) else $error(\"bad x\");", "a{n},sig"),
    (lambda c: _said(X.idents_of_pair(c, F.lit("zed"))), "assert (a{n});", "a{n},zed"),
    (X.literal_width, "16'hab{n}", "16"),
    (X.select_width, "x{n}[7:0]", "8"),
    (X.normal_literal, " 8'HF_{n} ", "8'hf{n}"),
    (X.design_name, "nvdla_c{n}", "c{n}"),
    (X.design_name, "rvv_backend", "rvv"),
    (X.data_uri, "data:text/plain;base64,aGk=", "hi"),
    (X.bare_source, "a{n}; // c\n`define X\nb", "a{n}; \nb"),
    (lambda c: X.line_of(c, F.lit(5)), "ab\ncd\nef{n}", "2"),
    (X.fenced_code, "x\n```sv\nassert a{n};\n```\ny", "assert a{n};"),
    (X.property_block, "so\nproperty p; a{n}; endproperty\nassert property (p);\nok", "property p; a{n}; endproperty\nassert property (p);"),
    (X.zero_reset, "8'h00", "true"),
    (X.zero_reset, "4'd{n}", "false"),
    (lambda c: F.size(X.tool_calls(c)), '<tool_call>{"name": "f{n}"}</tool_call> <tool_call>{bad</tool_call>', "1"),
    (lambda c: X.plan_json(c), "so [1, {n}] it is", "[1,{n}]"),
    (lambda c: X.inflate(X.template(c), X.template_indices(c)), "x_{n} == y[66]", "x_{n} == y[66]"),
    (lambda c: X.unresolved(c, F.array(F.lit("a"), F.lit("b"))), "assert (a == c{n});", "true"),
    (lambda c: _said(facts.eligible(X.idents(c), F.array(F.lit("clk")), F.array(F.lit("sig"), F.lit("AB"), F.lit("clk")))), "assert (sig && AB && clk && i && other{n});", "sig"),
)
_PATTERNS = (
    ("comb_assign", "assert (q{n} == d);"),
    ("comb_if", "assert (!(en) || (q{n} == d));"),
    ("reset_value", "assert property (@(posedge clk) !rst |-> q{n} == d);"),
    ("seq_update", "assert property (@(posedge clk) disable iff (!rst) (en) |=> q{n} == $past(d));"),
    ("hold", "assert property (@(posedge clk) disable iff (!rst) !(en) |=> $stable(q{n}));"),
    ("other", None),
)


def text_functions(spark, d):
    rows = _shapes(spark, d, [x[1] for x in _FUNCTIONS])
    value = F.coalesce(*[F.when(F.col("pos") % len(_FUNCTIONS) == i, f(F.col("assertion")).cast("string")) for i, (f, _, _) in enumerate(_FUNCTIONS)])
    return rows.select("pos", value.alias("value"))


def signal_roles(spark, d):
    n = F.col("p_partkey")
    end = F.get(F.array(*map(F.lit, ("_baseaddr", "_pd", "_idle", "_x", "_DATA_q", "_din"))), (n % 6).cast("int"))
    signals = t(spark, d, "part").select(F.concat(F.lit("u"), n.cast("string"), end).alias("name"), (F.col("p_size") % 3).cast("int").alias("width"))
    marks = t(spark, d, "part").where("p_size < 10").select(F.concat(F.lit("u"), n.cast("string"), end).alias("name"), F.when(F.col("p_size") < 5, "reset").otherwise("state").alias("mark"))
    return facts.roles(signals, marks.union(marks.select("name", F.lit("handshake_resp"))))


def cluster_parts(spark, d):
    n, k = F.col("p_partkey"), F.col("p_partkey") % 10
    ys = F.array(F.when(k < 6, n * 4 + 1).when(k < 8, F.lit(7) - n).otherwise(n * n), F.when(k < 6, F.lit(3).cast("long")).otherwise(n))
    return cluster.partition(t(spark, d, "part").select(F.floor(n / 40).cast("string").alias("key"), n.alias("pos"), n.alias("x"), ys.alias("ys")), "key", "pos", "x", "ys").select("pos", "part", F.array_join("formulas", ",").alias("formulas"))


def compaction_stats(spark, d):
    return cluster.compaction_stats(t(spark, d, "part").groupBy("p_type", "p_size").agg(F.count(F.lit(1)).alias("n")), least=2)


def declared_names(spark, d):
    said = F.get(F.array(*map(F.lit, ("input wire [7:0] aa, bb;", "output reg cc; // input zz", "wire [0:3] aa;", "assign x = y;"))), (F.col("p_partkey") % 4).cast("int"))
    return facts.declarations(t(spark, d, "part").select("p_brand", "p_partkey", said.alias("line")), "p_brand", "p_partkey", "line")


def assigned_names(spark, d):
    said = F.get(F.array(*map(F.lit, ("  assign x[3:0] = yy & zz;", "q <= q + 4'd1;", "if (a) b = c;", "r = 1'b0;"))), (F.col("p_partkey") % 4).cast("int"))
    return facts.assignments(t(spark, d, "part").select("p_brand", "p_partkey", said.alias("line")), "p_brand", "p_partkey", "line").select("p_partkey", "lhs", F.array_join("refs", ",").alias("refs"), "delay")


def pattern_texts(spark, d):
    kind = F.get(F.array(*[F.lit(k) for k, _ in _PATTERNS]), (F.col("p_partkey") % len(_PATTERNS)).cast("int"))
    made = facts.pattern_text(kind, F.concat(F.lit("q"), F.col("p_size").cast("string")), F.lit("d"), F.lit("en"), F.lit("clk"), F.lit("rst"))
    return t(spark, d, "part").select(F.col("p_partkey").alias("pos"), made.alias("assertion")).where("assertion IS NOT NULL")


def fact_passes(spark, d):
    shapes = (_P + "!rst |-> q == 8'h01);", _P + "en |=> w == 4'h3);", _P + "en |-> q == 9'h1);", _P + "en |-> w == 4'h2);")
    widths = t(spark, d, "region").where("r_regionkey < 2").select(F.when(F.col("r_regionkey") == 0, "q").otherwise("w").alias("name"), F.when(F.col("r_regionkey") == 0, 8).otherwise(4).alias("width"))
    rows = _shapes(spark, d, shapes)
    passes = {"reset": clean.reset_values(widths.select(F.col("name").alias("register"), F.lit("8'h00").alias("value"))), "width": clean.known_widths(widths), "owner": clean.constant_owners(widths.where("name = 'q'").select(F.lit("4'h3").alias("literal"), "name")), "next": clean.next_cycle_on(widths.where("name = 'w'").select("name"), True)}
    made = [f(rows).select(F.lit(k).alias("pass"), "pos", "assertion") for k, f in passes.items()]
    return made[0].union(made[1]).union(made[2]).union(made[3])


def preferred_names(spark, d):
    wanted = facts.priority_names(t(spark, d, "nation").select(F.col("n_nationkey").alias("name")), t(spark, d, "region").select((F.col("r_regionkey") + 30).alias("name")))
    return facts.preferred(t(spark, d, "part").select("p_partkey", "p_size"), "p_size", wanted).select("p_partkey", "p_size")


QUERIES = {f.__name__: f for f in (glob_filter, name_lookup, missing_lookup, exact_lookup, allowed_targets, module_participation, name_counts, listed_names, run_matrix, denylist_totals, ranked_properties, ranked_pairs, first_and_last, coverage_events, appended_rows, property_inlining, repaired_assertions, loop_scope, low_affinity, checked_signals, covered_signatures, and_forms, condition_only, values_read, ternaries, wrapped_fragments, doc_coverage, text_functions, signal_roles, cluster_parts, compaction_stats, declared_names, assigned_names, pattern_texts, fact_passes, preferred_names)}
ORACLES = {
    "glob_filter": "SELECT p_partkey FROM part WHERE (p_type LIKE '%BRASS' OR p_type LIKE 'STANDARD%' OR regexp_full_match(p_type, '[^A-S].....')) AND p_type NOT LIKE '%TIN%'",
    "name_lookup": "SELECT p_partkey, p_type, (SELECT count(*) > 0 FROM part WHERE contains(lower(p_type), 'steel')) AS found FROM part WHERE contains(lower(p_type), 'steel') OR NOT EXISTS (SELECT 1 FROM part WHERE contains(lower(p_type), 'steel'))",
    "missing_lookup": "SELECT p_partkey, p_type, FALSE AS found FROM part",
    "exact_lookup": "SELECT c_custkey AS k, o_orderkey, o_orderkey IS NOT NULL AS found FROM customer LEFT JOIN orders ON o_custkey = c_custkey",
    "allowed_targets": "SELECT p_partkey FROM part WHERE p_partkey % 4 = 3 OR p_size IN (SELECT n_nationkey FROM nation)",
    "module_participation": "SELECT l_partkey AS name, l_returnflag AS module FROM lineitem UNION SELECT l_partkey, l_linestatus FROM lineitem UNION SELECT l_partkey, l_returnflag || l_linestatus FROM lineitem",
    "name_counts": f"SELECT name, count(*) AS n FROM (SELECT unnest(regexp_extract_all(assertion, '\\b[A-Za-z_][A-Za-z0-9_]*\\b')) AS name FROM ({ASSERTIONS})) GROUP BY 1",
    "listed_names": "SELECT n_regionkey, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS names, count(DISTINCT n_name) AS n FROM nation GROUP BY 1",
    "run_matrix": "SELECT o_orderpriority, count(*) AS runs, count(*) FILTER (o_orderstatus = 'F') AS succeeded, count(*) FILTER (o_orderstatus <> 'F') AS failed FROM orders GROUP BY 1",
    "denylist_totals": "SELECT count(DISTINCT p_brand) AS n_names, sum(p_size) FILTER (p_size % 5 <> 0)::BIGINT AS total FROM part",
    "ranked_properties": """WITH p AS (SELECT p_partkey, p_name || ' ' || p_partkey AS s, ['w' || p_size % 7, 'w' || p_size % 5, 'w' || p_size % 3] AS w FROM part), r AS (SELECT list('w' || r_regionkey) AS l FROM region), h AS (SELECT p_partkey, s, len(list_intersect(w, l)) AS n, 3 + (p_partkey % 2 = 0)::INT AS k FROM p, r)
      SELECT p_partkey, n::BIGINT AS n_priority, k::INT AS n_signals, row_number() OVER (ORDER BY n DESC, k DESC, s)::INT AS place FROM h ORDER BY place LIMIT 12""",
    "ranked_pairs": "WITH f AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT 'a' || c_custkey AS initiator, 'b' || c_nationkey AS responder, coalesce(n, 0) + CASE WHEN c_nationkey % 5 = 0 AND c_nationkey // 5 IN (SELECT r_regionkey FROM region) THEN 100 ELSE 0 END AS score FROM customer LEFT JOIN f ON o_custkey = c_custkey WHERE c_custkey % 2 = 0 ORDER BY score DESC, initiator, responder LIMIT 12",
    "first_and_last": "SELECT * FROM (SELECT o_orderkey, 'head' AS \"end\" FROM orders ORDER BY o_orderkey LIMIT 10) UNION ALL SELECT * FROM (SELECT o_orderkey, 'tail' FROM orders ORDER BY o_orderkey DESC LIMIT 10)",
    "coverage_events": "SELECT DISTINCT 'reset' AS kind, p_brand AS key FROM part UNION SELECT 'documented', p_type FROM part UNION SELECT 'case', p_brand || '/' || p_size FROM part WHERE p_size % 3 > 0",
    "appended_rows": "SELECT n_nationkey AS pos, n_name AS name, 0 AS part FROM nation UNION ALL SELECT r_regionkey, r_name, 1 FROM region",
    "property_inlining": _sql(_NAMED, {"rebuilt": [x[1] for x in _NAMED], "behind": [x[2] for x in _NAMED]}),
    "repaired_assertions": _sql(_REPAIRS, {"assertion": [x[1] for x in _REPAIRS]}),
    "loop_scope": _sql(_LOOPS, {"assertion": [None if gone else s for s, gone in _LOOPS]}),
    "low_affinity": "WITH r AS (SELECT p_partkey AS pos, (p_size % 25)::INT AS a, (p_partkey % 25)::INT AS b FROM part) SELECT pos, CASE WHEN a <> b AND (SELECT n_regionkey FROM nation WHERE n_nationkey = a) <> (SELECT n_regionkey FROM nation WHERE n_nationkey = b) THEN 'low_affinity' ELSE '' END AS flags FROM r",
    "checked_signals": _sql(_MESSAGES, {"signal": [x[1] for x in _MESSAGES]}),
    "covered_signatures": _sql(_SHORT, {"signature": [x[1] for x in _SHORT]}),
    "and_forms": _sql(_ANDS, {"assertion": [x[1] for x in _ANDS]}),
    "condition_only": _sql(_ONLY, {"assertion": [x[1] for x in _ONLY]}),
    "values_read": _sql(_VALUES, {"value": [x[1] for x in _VALUES]}),
    "ternaries": _sql(_CHOICES, {n: [x[1] and x[1][i] for x in _CHOICES] for i, n in enumerate(("condition", "then", "otherwise"))}).replace(" AS then", ' AS "then"'),
    "wrapped_fragments": _sql(_FRAGMENTS, {"assertion": [x[1] for x in _FRAGMENTS]}),
    "doc_coverage": """WITH p AS (SELECT p_partkey AS pos, p_size AS n, p_size IN (SELECT n_nationkey FROM nation) AND 1 IN (SELECT n_nationkey FROM nation) AS ok FROM part), m AS (SELECT pos, 'must:' || CASE WHEN n = 1 THEN 's1' ELSE 's1,s' || n END AS l FROM p WHERE NOT ok ORDER BY pos LIMIT 6)
      SELECT count(*) FILTER (ok) AS covered, count(*) AS total, (SELECT coalesce(string_agg(l, '; ' ORDER BY pos), '') FROM m) AS missing FROM p""",
    "text_functions": _sql(_FUNCTIONS, {"value": [x[2] for x in _FUNCTIONS]}),
    "signal_roles": """SELECT 'u' || p_partkey || ['_baseaddr', '_pd', '_idle', '_x', '_DATA_q', '_din'][p_partkey % 6 + 1] AS name,
      CASE WHEN p_size < 5 THEN 'reset' WHEN p_size < 10 THEN 'handshake_resp' ELSE CASE p_partkey % 6 WHEN 0 THEN 'address' WHEN 1 THEN 'data' WHEN 2 THEN 'status' WHEN 5 THEN 'data' ELSE CASE p_size % 3 WHEN 1 THEN 'control' WHEN 2 THEN 'data' ELSE 'unknown' END END END AS role FROM part""",
    "cluster_parts": """WITH p AS (SELECT p_partkey AS pos, p_partkey // 40 AS key, CASE WHEN p_partkey % 10 < 6 THEN 0 WHEN p_partkey % 10 < 8 THEN 1 ELSE 2 END AS g FROM part), n AS (SELECT *, count(*) OVER (PARTITION BY key, g) AS n FROM p), b AS (SELECT key, max(n) FILTER (g = 0) AS a, max(n) FILTER (g = 1) AS b FROM n GROUP BY 1)
      SELECT pos, CASE WHEN g = 0 AND n >= 5 THEN 0 WHEN g = 1 AND n >= 5 THEN 1 ELSE -1 END::BIGINT AS part, CASE WHEN g = 0 AND n >= 5 THEN '0 4 1,0 0 3' WHEN g = 1 AND n >= 5 THEN '0 -1 7,0 1 0' END AS formulas FROM n""",
    "compaction_stats": "WITH c AS (SELECT count(*) AS n FROM part GROUP BY p_type, p_size) SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_clusters, coalesce(sum(n) FILTER (n >= 2), 0)::BIGINT AS n_compacted, max(n) AS largest FROM c",
    "declared_names": """WITH l AS (SELECT p_brand, p_partkey AS no, p_partkey % 4 AS k FROM part), e AS (SELECT p_brand, no, unnest(CASE k WHEN 0 THEN ['aa', 'bb'] WHEN 1 THEN ['cc'] WHEN 2 THEN ['aa'] ELSE [] END) AS name, CASE k WHEN 0 THEN 'input' WHEN 1 THEN 'output' END AS direction, CASE k WHEN 0 THEN 8 WHEN 1 THEN 1 ELSE 4 END AS width FROM l)
      SELECT p_brand, name, max(direction) AS direction, arg_min(width, no)::INT AS width, min(no) AS line FROM e GROUP BY 1, 2""",
    "assigned_names": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'x' WHEN 1 THEN 'q' ELSE 'r' END AS lhs, CASE p_partkey % 4 WHEN 0 THEN 'yy,zz' ELSE '' END AS refs, (p_partkey % 4 = 1)::BIGINT AS delay FROM part WHERE p_partkey % 4 <> 2",
    "pattern_texts": _sql(_PATTERNS, {"assertion": [x[1] for x in _PATTERNS]}),
    "fact_passes": """WITH a AS (SELECT p_partkey AS pos, p_partkey % 4 AS k, 'assert property (@(posedge clk) ' || ['!rst |-> q == 8''h01);', 'en |=> w == 4''h3);', 'en |-> q == 9''h1);', 'en |-> w == 4''h2);'][p_partkey % 4 + 1] AS s FROM part)
      SELECT 'reset' AS pass, pos, s AS assertion FROM a WHERE k <> 0 UNION ALL SELECT 'width', pos, s FROM a WHERE k <> 2 UNION ALL SELECT 'owner', pos, s FROM a WHERE k <> 1 UNION ALL SELECT 'next', pos, CASE k WHEN 1 THEN replace(s, '|=>', '|->') ELSE s END FROM a""",
    "preferred_names": "WITH w AS (SELECT n_nationkey AS n FROM nation UNION SELECT r_regionkey + 30 FROM region) SELECT p_partkey, p_size FROM part WHERE p_size IN (SELECT n FROM w) OR NOT EXISTS (SELECT 1 FROM part WHERE p_size IN (SELECT n FROM w))",
}
