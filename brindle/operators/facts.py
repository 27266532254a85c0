"""Facts about signals: declarations read from source lines, roles, ranked sections, and annotations by facts.

Tables: signals(name, module, width, freq), edges(a, b, delay), modules(name, module), connections(name, instance, module).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.text import KEYWORDS, canonical_constant, idents, lit_array
from brindle.operators.clean import sides, squeezed
from brindle.operators.graph import pair_delays, pairs_reached

# Types by name, the first that matches.
NAME_TYPES = (
    (r"(?:^|_)clk(?:$|_)|^clock$|^pclk$|^aclk$|^sclk$", "clock"),
    (r"(?:^|_)rst(?:$|_)|^reset|^prstn$|^rst_n$|^arst", "reset"),
    (r"(?:^|_)(?:valid|vld|pvld)(?:$|_)", "control"),
    (r"(?:^|_)(?:ready|rdy|prdy)(?:$|_)", "control"),
    (r"(?:^|_)(?:en|enable)(?:$|_)", "control"),
    (r"(?:^|_)(?:sel|cs|psel)(?:$|_)", "control"),
    (r"(?:^|_)(?:wr|write|pwrite|we)(?:$|_)", "control"),
    (r"(?:^|_)(?:rd|read)(?:$|_)", "control"),
    (r"(?:^|_)(?:addr|adr|paddr)(?:$|_)", "address"),
    (r"(?:^|_)(?:data|dat|wdat|rdat|pwdata|prdata)(?:$|_)", "data"),
    (r"(?:^|_)(?:nposted|posted)(?:$|_)", "control"),
)
# Name hints of roles, in their order.
ROLE_NAMES = (
    (r"(?i)_addr\b|_address\b|_baseaddr\b", "address"),
    (r"(?i)_data\b|_pd\b|_payload\b|_dout\b|_din\b", "data"),
    (r"(?i)_status\b|_done\b|_busy\b|_idle\b|_err(or)?\b", "status"),
)


def signal_type(name: Column, direction: Column, width: Column) -> Column:
    """By name, else one-bit outputs are status, one-bit inputs control, wider ones data."""
    low, rules = F.lower(name), iter(NAME_TYPES)
    out = F.when(low.rlike((first := next(rules))[0]), first[1])
    for p, t in rules:
        out = out.when(low.rlike(p), t)
    return out.when(width == 1, F.when(direction == "output", "status").otherwise("control")).otherwise("data")


def roles(signals: DataFrame, marks: DataFrame) -> DataFrame:
    """Name, role. marks (name, mark) holds what is known: clock, reset, out_of_scope, handshake_init, handshake_resp, state."""
    order = ("clock", "reset", "out_of_scope", "handshake_init", "handshake_resp", "state")
    known = marks.groupBy("name").agg(F.min(F.array_position(lit_array(order), F.col("mark"))).alias("p"))
    out = F.when(F.col("p") > 0, F.get(lit_array(order), (F.col("p") - 1).cast("int")))
    for p, r in ROLE_NAMES:
        out = out.when(F.col("name").rlike(p), r)
    out = out.when(F.col("width") == 1, "control").when(F.col("width") > 1, "data").otherwise("unknown")
    return signals.join(known, "name", "left").select("name", out.alias("role"))


def block_clocks(blocks: DataFrame) -> DataFrame:
    """Block, clock, reset, polarity. blocks: block, posedge, negedge (arrays in textual order). With two rising edges
    the one that drives more blocks is the clock, the smaller name on ties."""
    freq = blocks.select(F.explode(F.array_distinct("posedge")).alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    each = blocks.select("block", F.explode("posedge").alias("s")).join(freq, "s")
    ranked = each.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "s"))), lambda x: x["s"]).alias("by_n"))
    rows = blocks.join(ranked, "block", "left")
    one, low = F.size("posedge") == 1, F.size("negedge") > 0
    none = F.size("posedge") == 0
    first = lambda c, i=0: F.get(F.col(c), F.lit(i))
    return rows.select(
        "block",
        F.when(none, None).when(low | one, first("posedge")).otherwise(first("by_n")).alias("clock"),
        F.when(none, None).when(low, first("negedge")).when(~one, first("by_n", 1)).alias("reset"),
        F.when(none, None).when(low, "low").when(~one, "high").alias("polarity"),
    )


def best(df: DataFrame, demoted: Column, missed: Column, name: str) -> DataFrame:
    """the name of the least (demotions, suffix miss, name)."""
    return df.agg(F.min(F.struct(demoted.alias("d"), missed.cast("int").alias("m"), name)).alias("b")).select(F.col("b")[name].alias(name))


def choice(df: DataFrame, name: str, *tiers: Column) -> DataFrame:
    """the smallest name of the first tier that has one."""
    return df.agg(F.coalesce(*[F.min(F.when(t, F.col(name))) for t in tiers]).alias(name))


def declarations(lines: DataFrame, source: str, no: str, line: str) -> DataFrame:
    """Source, name, direction, width, line of declared names, the first of each; a direction holds for the names
    that follow it in the line."""
    head = r"\b(input|output|inout|wire|reg|logic)\b\s*(?:wire|reg|logic|signed|\s++)*+\s*(\[[^\]]*\])?\s*([A-Za-z_]\w*+(?:\s*+,\s*+[A-Za-z_]\w*+)*+)"
    found = lines.withColumn("s", F.explode(F.regexp_extract_all(F.regexp_replace(line, "//.*", ""), F.lit(f"({head})"), F.lit(1))))
    part = lambda i: F.regexp_extract("s", head, i)
    hi, lo = (F.regexp_extract(part(2), r"\[\s*(\d+)\s*:\s*(\d+)", g).try_cast("int") for g in (1, 2))
    width = F.when(part(2) == "", 1).otherwise(F.abs(hi - lo) + 1)
    rows = found.select(source, no, F.when(part(1).isin("input", "output", "inout"), part(1)).alias("direction"), width.alias("width"), F.explode(F.split(part(3), r"\s*,\s*")).alias("name"))
    rows = rows.where(~F.col("name").isin(*KEYWORDS))
    return rows.groupBy(source, "name").agg(F.max("direction").alias("direction"), F.min_by("width", no).alias("width"), F.min(no).alias("line"))


def assignments(lines: DataFrame, source: str, no: str, line: str) -> DataFrame:
    """Source, line, lhs, refs (other identifiers), delay: 0 of continuous, 1 of clocked assignments."""
    form = r"^\s*(?:assign\s+)?([A-Za-z_]\w*)(?:\[[^\]]*\])?\s*(<=|=)\s*([^;]*);"
    lhs, op, rhs = (F.regexp_extract(line, form, i) for i in (1, 2, 3))
    rows = lines.where(F.col(line).rlike(form)).select(source, no, lhs.alias("lhs"), op.alias("op"), idents(rhs).alias("refs"))
    return rows.select(source, no, "lhs", F.filter("refs", lambda x: x != F.col("lhs")).alias("refs"), (F.col("op") == "<=").cast("long").alias("delay"))


def reset_values(lines: DataFrame, source: str, no: str, line: str, back: int = 3) -> DataFrame:
    """Register, value: clocked constants in the lines just after a reset condition; the first of each register."""
    w = Window.partitionBy(source).orderBy(no)
    test = F.col(line).rlike(r"(?i)\bif\s*\(\s*[!~]?\s*\w*(rst|reset)\w*\s*\)")
    rows = lines.withColumn("__near", F.max(test.cast("int")).over(w.rowsBetween(-back, 0))).withColumn("__else", F.max(F.col(line).rlike(r"\belse\b").cast("int")).over(w.rowsBetween(-back, 0)))
    form = r"\b([A-Za-z_]\w*)\s*<=\s*(\d*'[bdhoBDHO]?\w+|\d+)\s*;"
    hits = rows.where("__near = 1 AND __else = 0").select(source, no, F.regexp_extract(line, form, 1).alias("register"), F.regexp_extract(line, form, 2).alias("value")).where("register <> ''")
    return hits.groupBy(source, "register").agg(F.min_by("value", no).alias("value"))


def eligible(ids: Column, skipped: Column, known: Column) -> Column:
    """H5: no clocks or resets, no capitals of two letters or more, no lower-case names of one or two letters, known ones only (if any are)."""
    caps = lambda x: (F.char_length(x) >= 2) & (x == F.upper(x)) & x.rlike("[A-Za-z]")
    kept = F.filter(F.array_except(ids, skipped), lambda x: ~caps(x) & ~x.rlike("^[a-z]{1,2}$"))
    return F.when(F.size(known) > 0, F.array_intersect(kept, known)).otherwise(kept)


def equality(text: Column) -> Column:
    """struct(names of the condition, lhs, rhs); null where the claim isn't one equality. `!(c) || (a == b)` has condition c."""
    s = sides(text)
    clause = r"^!\s*\(?(.*?)\)?\s*\|\|\s*\(?\s*([^|]*?)\s*\)?$"
    or_ = s["claim"].rlike(clause)
    claim = F.when(or_, F.regexp_extract(s["claim"], clause, 2)).otherwise(s["claim"])
    condition = F.when(s["condition"].isNotNull(), s["condition"]).when(or_, F.regexp_extract(s["claim"], clause, 1)).otherwise("")
    form = r"^([^=!<>&|]+?)\s*==\s*([^=!<>&|]+)$"
    return F.when(claim.rlike(form), F.struct(F.sort_array(idents(condition)).alias("names"), squeezed(F.regexp_extract(claim, form, 1)).alias("lhs"), squeezed(F.regexp_extract(claim, form, 2)).alias("rhs")))


def cross_module(rows: DataFrame, row: str, names: str, members: DataFrame, instances: DataFrame) -> DataFrame:
    """Row, cross: at least two known names, no unknown one, and neither a module nor an instance that holds them all."""
    each = rows.select(F.col(row).alias("r"), F.size(F.array_distinct(names)).alias("n"), F.explode(F.array_distinct(names)).alias("name"))
    shared = lambda table, col: each.join(table.select("name", col).distinct(), "name").groupBy("r", "n", col).agg(F.count(F.lit(1)).alias("c")).where("c = n").select("r").distinct()
    known = each.join(members.select("name").distinct(), "name", "left_semi").groupBy("r", "n").agg(F.count(F.lit(1)).alias("c")).where("c = n AND n >= 2").select("r")
    bad = known.join(shared(members, "module"), "r", "left_anti").join(shared(instances, "instance"), "r", "left_anti").withColumn("cross", F.lit(True))
    return rows.select(F.col(row).alias("r")).join(bad, "r", "left").select(F.col("r").alias(row), F.coalesce("cross", F.lit(False)).alias("cross"))


def against_flow(rows: DataFrame, row: str, condition: str, claim: str, edges: DataFrame, hops: int = 3) -> DataFrame:
    """Row, wrong, right, flagged: pairs of names on one side only whose flow runs strictly from claim to condition
    (wrong) or the other way; flagged if wrong outnumber right."""
    a, b = F.array_except(condition, claim), F.array_except(claim, condition)
    pairs = rows.select(F.col(row).alias("r"), F.explode(a).alias("a"), b.alias("b")).select("r", "a", F.explode("b").alias("b"))
    flow = pairs_reached(edges.select("a", "b").distinct(), pairs.select("a", "b").distinct(), hops)
    one = flow.select("a", "b", F.when(F.col("ahead") & ~F.col("behind"), 1).alias("right"), F.when(F.col("behind") & ~F.col("ahead"), 1).alias("wrong"))
    votes = pairs.join(one, ["a", "b"]).groupBy("r").agg(F.count("wrong").alias("wrong"), F.count("right").alias("right"))
    out = rows.select(F.col(row).alias("r")).join(votes, "r", "left").fillna(0, ["wrong", "right"])
    return out.select(F.col("r").alias(row), "wrong", "right", ((F.col("wrong") > 0) & (F.col("wrong") > F.col("right"))).alias("flagged"))


def past_depth(rows: DataFrame, row: str, driven: str, driver: str, depth: str, edges: DataFrame, most: int = 8) -> DataFrame:
    """Row, least, flagged: a claim that driven follows driver after `depth` cycles, where the least delay between them differs."""
    paths = pair_delays(edges, rows.select(F.col(driver).alias("a"), F.col(driven).alias("b")), most)
    joined = rows.join(paths.select(F.col("a").alias(driver), F.col("b").alias(driven), F.col("delay").alias("least")), [driver, driven], "left")
    return joined.select(row, "least", F.coalesce(F.col("least") != F.col(depth), F.lit(False)).alias("flagged"))


def unknown_states(rows: DataFrame, row: str, text: str, states: DataFrame) -> DataFrame:
    """Row, flagged: a comparison of a state signal (states: signal, literal) with a literal that isn't one of its states."""
    pairs = F.regexp_extract_all(text, F.lit(r"([A-Za-z_]\w*\s*==\s*\d+'[bdhoBDHO]\w+)"), F.lit(1))
    each = rows.select(row, F.explode(pairs).alias("p")).select(row, F.regexp_extract("p", r"^(\w+)", 1).alias("signal"), canonical_constant(F.regexp_extract("p", r"==\s*(.*)$", 1)).alias("c"))
    known = states.select("signal", canonical_constant(F.col("literal")).alias("c")).distinct()
    bad = each.join(states.select("signal").distinct(), "signal", "left_semi").join(known, ["signal", "c"], "left_anti").select(row).distinct().withColumn("flagged", F.lit(True))
    return rows.select(row).join(bad, row, "left").select(row, F.coalesce("flagged", F.lit(False)).alias("flagged"))


def derived_selectors(rows: DataFrame, row: str, condition: str, selector: str, definitions: DataFrame) -> DataFrame:
    """K4/I32: rows where a name of the condition stands, with an operator, in the definition of a name of the selector (one step)."""
    names = rows.select(row, F.explode(selector).alias("name"), F.col(condition).alias("c")).join(definitions, "name")
    hit = F.col("expr").rlike(r"[&|+\-<>=?^~]") & F.arrays_overlap("c", idents(F.col("expr")))
    return names.where(hit).select(row).distinct()


def by_frequency(names: DataFrame, freq: DataFrame, most: int, group: str | None = None) -> DataFrame:
    """names by (-frequency, name), the first of each group."""
    joined = names.join(freq.select("name", "freq"), "name", "left").fillna(0, ["freq"])
    w = (Window.partitionBy(group) if group else Window.partitionBy(F.lit(0))).orderBy(F.desc("freq"), "name")
    if group is None:
        return joined.orderBy(F.desc("freq"), "name").limit(most)
    return joined.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)


def priority_names(*sources: DataFrame) -> DataFrame:
    """Union of name sources."""
    out = sources[0].select("name")
    for s in sources[1:]:
        out = out.union(s.select("name"))
    return out.distinct()


def preferred(rows: DataFrame, name: str, wanted: DataFrame) -> DataFrame:
    """F16: rows of wanted names, or all rows if there are none."""
    marked = rows.join(wanted.select(F.col("name").alias(name)).distinct().withColumn("__w", F.lit(1)), name, "left")
    any_ = marked.agg(F.max("__w").alias("__any"))
    return marked.crossJoin(F.broadcast(any_)).where("__any IS NULL OR __w = 1").drop("__w", "__any")


def fill(sections: Sequence[tuple[str, str]], core: Sequence[str], budget: int, longer: dict[str, str] | None = None) -> list[str]:
    """Names of the sections (in the order of priority) that fit the budget of tokens (a quarter of the characters).

    Core sections always count; a section that would pass the budget is left out and the next one tried; at the end a longer
    form takes a section's place if it still fits. A dozen texts, so this is no distributed operation."""
    cost = lambda s: len(s) // 4
    texts, chosen, spent = dict(sections), [], 0
    for name, text in sections:
        if name in core or spent + cost(text) <= budget:
            chosen.append(name)
            spent += cost(text)
    for name, text in (longer or {}).items():
        if name in chosen and spent - cost(texts[name]) + cost(text) <= budget:
            spent += cost(text) - cost(texts[name])
            chosen[chosen.index(name)] = f"{name} (full)"
    return chosen


def decoder_checks(flags: DataFrame) -> DataFrame:
    """Text for each source with two decoded flags or more (flags: source, flag, value): one-hot if the values are 0 to
    2^n - 1, at most one otherwise."""
    made = flags.groupBy("source").agg(F.sort_array(F.collect_set("flag")).alias("f"), F.sort_array(F.collect_set("value")).alias("v")).where(F.size("f") >= 2)
    n = F.size("v")
    full = (F.col("v") == F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)) & (n.bitwiseAND(n - 1) == 0)
    body = F.concat(F.lit("{"), F.array_join("f", ", "), F.lit("}"))
    return made.select("source", n.alias("n"), F.concat(F.when(full, "assert ($onehot(").otherwise("assert ($onehot0("), body, F.lit("));")).alias("assertion"))


def pattern_text(kind: Column, lhs: Column, rhs: Column, condition: Column, clock: Column, reset: Column) -> Column:
    """The assertion of an extracted pattern; null for a kind that has none."""
    at, off = F.concat(F.lit("assert property (@(posedge "), clock, F.lit(") ")), F.when(reset.isNotNull(), F.concat(F.lit("disable iff (!"), reset, F.lit(") "))).otherwise("")
    eq = F.concat(lhs, F.lit(" == "), rhs)
    when = F.concat(F.lit("("), condition, F.lit(")"))
    return (
        F.when(kind == "comb_assign", F.concat(F.lit("assert ("), eq, F.lit(");")))
        .when(kind == "comb_if", F.concat(F.lit("assert (!"), when, F.lit(" || ("), eq, F.lit("));")))
        .when(kind == "case_branch", F.concat(F.lit("assert (!"), when, F.lit(" || ("), eq, F.lit("));")))
        .when(kind == "reset_value", F.concat(at, F.lit("!"), reset, F.lit(" |-> "), eq, F.lit(");")))
        .when(kind == "seq_update", F.concat(at, off, when, F.lit(" |=> "), lhs, F.lit(" == $past("), rhs, F.lit("));")))
        .when(kind == "hold", F.concat(at, off, F.lit("!"), when, F.lit(" |=> $stable("), lhs, F.lit("));")))
    )


def signal_map(ports: DataFrame, top: str) -> DataFrame:
    """Key, name, module, direction, width, type, description; the top module's ports under their plain names."""
    key = F.when(F.col("module") == top, F.col("name")).otherwise(F.concat_ws(".", "module", "name"))
    kind = signal_type(F.col("name"), F.col("direction"), F.col("width"))
    said = F.concat(F.initcap("direction"), F.lit(" "), kind, F.lit(" of "), F.col("module"), F.when(F.col("width") > 1, F.concat(F.lit(" ["), (F.col("width") - 1).cast("string"), F.lit(":0]"))).otherwise(""))
    return ports.select(key.alias("key"), "name", "module", "direction", "width", kind.alias("type"), said.alias("description"))


def module_summaries(modules: DataFrame, ports: DataFrame, children: DataFrame, cells: DataFrame, most_cells: int = 20) -> DataFrame:
    """Module, prefix, summary: texts with the parent (of several the smallest), ports and submodules of each module.

    modules: module; ports: module, name, direction, width; children: parent, child, pos (their order); cells: module, cell, type. A module
    without any of these has a text without that part."""
    port = lambda cut: F.concat("name", F.lit("("), F.substring("direction", 1, cut), F.lit(","), F.col("width").cast("string"), F.lit(")"))
    listed = ports.groupBy("module").agg(*[F.sort_array(F.collect_list(F.struct("name", port(n).alias("said")))).alias(c) for n, c in ((3, "short"), (99, "long"))])
    below = children.groupBy(F.col("parent").alias("module")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "child"))), lambda x: x["child"]), ", ").alias("below"))
    above = children.groupBy(F.col("child").alias("module")).agg(F.min("parent").alias("parent"))
    inside = cells.groupBy("module").agg(F.array_join(F.transform(F.slice(F.sort_array(F.collect_list(F.struct("cell", "type"))), 1, most_cells), lambda x: F.concat(x["cell"], F.lit("->"), x["type"])), ", ").alias("inside"))
    rows = modules.select("module").distinct().join(listed, "module", "left").join(below, "module", "left").join(above, "module", "left").join(inside, "module", "left")
    said = lambda c: F.array_join(F.transform(c, lambda x: x["said"]), ", ")
    part = lambda label, c: F.concat(F.lit(label), c)
    first, parent = part("Module: ", F.col("module")), part("Parent: ", F.col("parent"))
    prefix = F.concat(F.lit("["), F.concat_ws(" | ", first, parent, part("Ports: ", said(F.slice("short", 1, 10))), part("Children: ", F.col("below"))), F.lit("]\n"))
    summary = F.concat_ws("\n", first, parent, part("Ports: ", said("long")), part("Submodules: ", F.coalesce("below", F.lit("none (leaf module)"))), part("Instances: ", F.col("inside")))
    return rows.select("module", prefix.alias("prefix"), summary.alias("summary"))
