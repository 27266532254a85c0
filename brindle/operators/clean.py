"""The cleaning chain: an ordered list of maps, filters and annotations over assertion rows (id, pos, comment, assertion)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.text import VACUOUS_TRUE, balanced, canonical, exact_signature, idents, strip_outer
from brindle.operators.coverage import pair_links

A = "assertion"
Pass = tuple[str, Callable[[DataFrame], DataFrame]]


def body(text: Column) -> Column:
    """What is asserted: no assert, clock, disable clause, error tail or semicolon."""
    t = F.regexp_replace(F.trim(F.regexp_replace(text, r"//[^\n]*", "")), r"(?s)\s*else\s+\$\w+\s*\(.*$|;\s*$", "")
    t = F.regexp_extract(t, r"(?s)^assert\s*(?:property\s*)?(.*)$", 1)
    t = strip_outer(t, 2)
    return strip_outer(F.regexp_replace(t, r"@\s*\([^)]*\)\s*|disable\s+iff\s*\((?:[^()]++|\([^()]*+\))*+\)\s*", ""), 3)


def sides(text: Column) -> Column:
    """struct(condition, claim) at the first implication; a null condition without one."""
    b = body(text)
    has = b.rlike(r"\|->|\|=>")
    cond, claim = (F.regexp_extract(b, r"(?s)^(.*?)\s*\|[-=]>\s*(.*)$", g) for g in (1, 2))
    return F.struct(F.when(has, strip_outer(cond, 3)).alias("condition"), strip_outer(F.when(has, claim).otherwise(b), 3).alias("claim"))


def squeezed(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value evaluated (and written into the plan) once."""
    return F.get(F.transform(F.array(value), lambda x: f(x)), F.lit(0))


def split_top(text: Column, sign: str) -> Column:
    """The parts of text between the signs that stand in no parenthesis."""

    def step(out: Column, part: Column) -> Column:
        last = F.element_at(out, -1)
        return F.when((F.size(out) > 0) & ~balanced(F.coalesce(F.try_element_at(out, F.lit(-1)), F.lit(""))), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.concat(last, F.lit(sign), part)))).otherwise(F.concat(out, F.array(part)))

    def joined(parts: Column) -> Column:
        # a fold only where a part isn't balanced on its own
        return F.when(F.forall(parts, lambda c: balanced(c)), parts).otherwise(F.aggregate(parts, F.array().cast("array<string>"), step))

    return bound(F.split(text, sign.replace("|", r"\|")), joined)


def conjuncts(text: Column) -> Column:
    return F.transform(split_top(text, "&&"), lambda c: squeezed(strip_outer(c, 2)))


def constant_false(text: Column) -> Column:
    """A literal zero, or a conjunct with its own negation."""
    parts = conjuncts(text)
    opposed = F.exists(parts, lambda p: F.array_contains(parts, F.concat(F.lit("!"), p)))
    return squeezed(text).rlike("^(1'b0|0|'0)$") | opposed


def constant_true(text: Column) -> Column:
    parts = F.transform(F.split(text, r"\|\|"), lambda c: squeezed(strip_outer(c, 2)))
    return squeezed(text).rlike("^(1'b1|1|'1)$") | F.exists(parts, lambda p: F.array_contains(parts, F.concat(F.lit("!"), p)))


def keep(test: Callable[[Column], Column]) -> Callable[[DataFrame], DataFrame]:
    """A filter: rows of which the test is true stay; an undecided test keeps the row."""

    def run(df: DataFrame) -> DataFrame:
        return df.where(F.coalesce(test(F.col(A)), F.lit(True)))

    run.test = test
    return run


def repair(test: Callable[[Column], Column], f: Callable[[Column], Column]) -> Callable[[DataFrame], DataFrame]:
    """A filter that also rewrites what stays."""
    made = keep(test)

    def run(df: DataFrame) -> DataFrame:
        return change(f)(made(df))

    run.test, run.change = test, change(f)
    return run


def change(f: Callable[[Column], Column]) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumn(A, f(F.col(A)))


def flag(name: str, test: Callable[[Column], Column]) -> Callable[[DataFrame], DataFrame]:
    """An annotation: rows of which the test is true carry the name."""
    return lambda df: df.withColumn("flags", F.when(F.coalesce(test(F.col(A)), F.lit(False)), F.array_append(_flags(df), F.lit(name))).otherwise(_flags(df)))


def _flags(df: DataFrame) -> Column:
    return F.col("flags") if "flags" in df.columns else F.array().cast("array<string>")


# An immediate assertion with an implication becomes a disjunction.
fix_immediate_implication = change(lambda t: F.when(t.rlike(r"^assert\s*\("), F.regexp_replace(t, r"^assert\s*\((.*?)\s*\|->\s*(.*)\)(\s*(?:else.*)?;)\s*$", "assert (!($1) || ($2))$3")).otherwise(t))
# A double negation of the same goes.
fix_double_negation = change(lambda t: F.regexp_replace(t, r"!\s*\(\s*!\s*\(?([A-Za-z_]\w*)\)?\s*\)", "$1"))
_DISABLED = r"(?s)^(assert\b.*?(?i:disable\s+iff)\s*\(((?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+)\)\s*)(.*?)(\|[-=]>.*)$"


def _dead(t: Column) -> tuple[Column, Column]:
    """(the conjuncts of the condition, what the disable clause holds)."""
    dead = F.nullif(squeezed(strip_outer(F.regexp_extract(t, _DISABLED, 2), 2)), F.lit(""))
    return split_top(strip_outer(F.regexp_extract(t, _DISABLED, 3), 3), "&&"), dead


def _strip_dead(t: Column) -> Column:
    parts, dead = _dead(t)

    def without(p: Column) -> Column:
        # the first equal conjunct goes
        at = F.array_position(F.transform(p, lambda c: squeezed(strip_outer(c, 2))), dead)
        new = lambda k: F.concat(F.regexp_extract(t, _DISABLED, 1), F.lit("("), F.array_join(F.transform(F.filter(p, lambda c, i: i + 1 != k), lambda c: F.trim(c)), " && "), F.lit(")"), F.regexp_extract(t, _DISABLED, 4))
        return bound(at, lambda k: F.when(k > 0, new(k)).otherwise(t))

    return F.when(t.rlike(_DISABLED), bound(parts, without)).otherwise(t)


def _only_dead(t: Column) -> Column:
    parts, dead = _dead(t)
    return t.rlike(_DISABLED) & bound(parts, lambda p: (F.size(p) == 1) & (squeezed(strip_outer(F.get(p, F.lit(0)), 2)) == dead))


# A conjunct that equals the disable clause can't hold: it goes, and the row only if nothing else is left.
remove_dead_under_disable = repair(lambda t: ~_only_dead(t), _strip_dead)
_ATOM = r"^\s*[!~]?\s*\(?\s*[A-Za-z_]\w*(?:\.\w+)*(?:\[[^\]]+\])?\s*\)?\s*$"


def _violation(t: Column) -> Column:
    """An immediate conjunction of two plain signals or more, one of them negated, without any implication."""
    immediate = t.rlike(r"^assert\s*\(") & ~t.rlike(r"\|->|\|=>|##")

    def violates(b: Column) -> Column:
        atoms = lambda p: (F.size(p) > 1) & F.forall(p, lambda c: c.rlike(_ATOM)) & F.exists(p, lambda c: c.rlike(r"^\s*[!~]"))
        return ~b.rlike(r"\|\||==|!=|<=|>=|\s<\s|\s>\s|[+*/%]|(?<![!~\-])\s-\s") & bound(split_top(b, "&&"), atoms)

    return immediate & bound(body(t), violates)


# I11.
remove_missing_implication = keep(lambda t: ~_violation(t))
_LITERAL = r"(?:\d+'?[bdhoBDHOxXzZ?]?[\w?]*|\{[^}]+\})"


def _always_equal(t: Column) -> Column:
    """A name that equals a literal without any condition; names in capitals are parameters."""
    whole = rf"^\s*\(?\s*([A-Za-z_]\w*(?:\.\w+)*)(?:\[[^\]]+\])?\s*==\s*{_LITERAL}\s*\)?\s*$"
    inner = rf"\(\s*([A-Za-z_]\w*(?:\[[^\]]+\])?)\s*==\s*{_LITERAL}\s*\)"
    lower = lambda name: (name != "") & ~(name.rlike("[A-Z]") & ~name.rlike("[a-z]") & (F.char_length(name) > 1))

    def equal(b: Column) -> Column:
        name = F.when(b.rlike(whole), F.regexp_extract(b, whole, 1)).otherwise(F.regexp_extract(b, inner, 1))
        return ~b.rlike(r"\|[->=]+|##|\$(past|stable|rose|fell|onehot|isunknown)|&&|\|\|") & bound(name, lower)

    return t.rlike("^assert") & bound(body(t), equal)


# I12.
remove_unconditional_equality = keep(lambda t: ~_always_equal(t))
def implied(condition: Column, claim: Column) -> Column:
    """The claim, or one of its alternatives, is among the conjuncts of the condition; an alternative may be all of it."""
    held = F.filter(conjuncts(F.coalesce(condition, F.lit(""))), lambda c: c != "")
    others = F.filter(F.transform(split_top(claim, "||"), lambda c: squeezed(strip_outer(c, 3))), lambda c: c != "")
    whole = F.array(squeezed(strip_outer(condition, 3)))
    among = lambda h, o: F.array_contains(h, squeezed(strip_outer(claim, 3))) | ((F.size(o) > 1) & F.arrays_overlap(o, F.array_union(h, whole)))
    return bound(held, lambda h: bound(others, lambda o: among(h, o)))


# I13.
remove_tautologies = keep(lambda t: ~bound(sides(t), lambda s: implied(s["condition"], s["claim"])))


def same_sides(claim: Column) -> Column:
    """The first comparison outside parentheses has the same on both sides; logical combinations are left alone."""

    def decided(said: Column) -> Column:
        out = F.lit(False)
        for op in reversed(("==", "!=", "<=", ">=", "<", ">")):
            rest = lambda p, op=op: F.array_join(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), op)
            pair = bound(split_top(said, op), lambda p, rest=rest: F.when(F.size(p) > 1, F.array(squeezed(strip_outer(F.get(p, F.lit(0)), 3)), squeezed(strip_outer(rest(p), 3)))))
            out = bound(pair, lambda x, out=out: F.when((F.get(x, F.lit(0)) != "") & (F.get(x, F.lit(1)) != ""), F.get(x, F.lit(0)) == F.get(x, F.lit(1))).otherwise(out))
        return out

    return ~claim.rlike(r"&&|\|\|") & bound(strip_outer(claim, 3), decided)


# Conditions that never hold, claims that always do.
remove_vacuous_condition = keep(lambda t: ~constant_false(sides(t)["condition"]))
remove_vacuous_claim = keep(lambda t: ~constant_true(sides(t)["claim"]))
# The same on both sides of a comparison.
remove_self_comparison = keep(lambda t: ~bound(sides(t)["claim"], same_sides))
# Constant truths.
remove_trivial = keep(lambda t: ~t.rlike(VACUOUS_TRUE))
# Constant ternaries.
fold_ternary = change(lambda t: F.regexp_replace(F.regexp_replace(t, r"\b([A-Za-z_]\w*)\s*\?\s*1'b1\s*:\s*1'b0", "$1"), r"\b([A-Za-z_]\w*)\s*\?\s*1'b0\s*:\s*1'b1", "!$1"))


def remove_wrong_style(wanted: str) -> Callable[[DataFrame], DataFrame]:
    """Concurrent or immediate assertions only."""
    concurrent = lambda t: t.rlike(r"^assert\s+property\b")
    return keep(concurrent if wanted == "concurrent" else lambda t: ~concurrent(t))


def next_cycle_on(names: DataFrame, combinational: bool) -> Callable[[DataFrame], DataFrame]:
    r"""|=> becomes |-> where the claim holds a combinational signal; |-> with $past becomes |=> where it holds a sequential one.
    names: name. The first textual operator is rewritten."""

    def run(df: DataFrame) -> DataFrame:
        rows = df.withColumn("__k", F.monotonically_increasing_id()) if "pos" not in df.columns else df
        hit = rows.select("id", "pos", F.explode(idents(sides(F.col(A))["claim"])).alias("name")).join(names.select("name").distinct(), "name", "left_semi").select("id", "pos").distinct().withColumn("__hit", F.lit(True))
        t = F.col(A)
        old, new = (r"\|=>", "|->") if combinational else (r"\|->", "|=>")
        which = F.coalesce("__hit", F.lit(False)) & (F.lit(True) if combinational else t.contains("$past"))
        once = F.regexp_replace(t, rf"(?s)^(.*?){old}", F.lit("$1" + new.replace("$", r"\$")))
        return df.join(hit, ["id", "pos"], "left").withColumn(A, F.when(which, once).otherwise(t)).drop("__hit")

    return run


_SLICE = r"(\w+(?:\[[^\]]+\])?)"
_RESTATED = rf"^\s*assert\s*\(?\s*{_SLICE}\s*==\s*\(?\s*{_SLICE}\s*\)?\s*\)?\s*(?:else\s+\$\w+\([^)]*\))?\s*;\s*$"


def _slice_width(part: Column) -> Column:
    """Bits of a select, null for a bare name or a select that isn't numbers."""
    hi, lo = (F.regexp_extract(part, r"\[(\d+)\s*:\s*(\d+)\]$", i).try_cast("int") for i in (1, 2))
    return F.coalesce(F.abs(hi - lo) + 1, F.when(part.rlike(r"\w\[\d+\]$"), F.lit(1)))


def _restates(t: Column) -> Column:
    left, right = (_slice_width(F.regexp_extract(t, _RESTATED, i)) for i in (1, 2))
    return t.rlike(_RESTATED) & F.coalesce(left == right, left.isNotNull() | right.isNotNull())


# An immediate equality of two selects of equal width, or of a select and a bare name.
remove_slice_restatements = keep(lambda t: ~_restates(t))


def loop_names(text: Column) -> Column:
    """Names of one or two small letters in what is asserted, without strings, messages and literals."""
    bare = F.regexp_replace(F.regexp_replace(body(text), r"(?s)\)\s*else\s+\$\w+\s*\(.*$", ""), r'"[^"]*"', " ")
    bare = F.regexp_replace(bare, r"\b\d+'\s*[bdhoBDHO][0-9a-fA-FxXzZ_?]*", " ")
    return F.array_distinct(F.regexp_extract_all(bare, F.lit(r"\b([a-z]{1,2})\b"), F.lit(1)))


def loop_scope(widths: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Rows with a name like a loop's that no declared width knows go; without any width all stay. widths: name."""

    def run(df: DataFrame) -> DataFrame:
        any_ = widths.agg((F.count(F.lit(1)) > 0).alias("__any"))  # one row
        each = df.crossJoin(F.broadcast(any_)).where("__any").select("id", "pos", F.explode(loop_names(F.col(A))).alias("name"))
        return df.join(each.join(widths.select("name").distinct(), "name", "left_anti").select("id", "pos").distinct(), ["id", "pos"], "left_anti")

    return run


def affinity(edges: DataFrame, most: float = 0.0) -> Callable[[DataFrame], DataFrame]:
    """An annotation for rows of two names or more of whose pairs no more than the share most is linked (edges: a, b)."""

    def run(df: DataFrame) -> DataFrame:
        rows = df.select(F.struct("id", "pos").alias("k"), idents(body(F.col(A))).alias("names"))
        low = pair_links(rows, "k", "names", edges).where(F.col("n_linked") <= most * F.col("n_pairs")).select("k.id", "k.pos").withColumn("__low", F.lit(True))
        marked = df.join(low, ["id", "pos"], "left").withColumn("__flags", _flags(df))
        return marked.withColumn("flags", F.when(F.col("__low"), F.array_append("__flags", F.lit("low_affinity"))).otherwise(F.col("__flags"))).drop("__low", "__flags")

    return run


_REFERENCE = r"(?i)\bassert\s+property\s*\(\s*([A-Za-z_]\w*)\s*\)"


def property_bodies(files: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, name, body (in one line, without a semicolon at its end), line of the block's start: of blocks of equal name the last."""
    block = r"(?is)\bproperty\s+([A-Za-z_]\w*)\s*;\s*(.*?)\s*\bendproperty\b"
    t = F.col(text)
    names, bodies, gaps = F.regexp_extract_all(t, F.lit(block), F.lit(1)), F.regexp_extract_all(t, F.lit(block), F.lit(2)), F.split(t, block, -1)
    each = files.select(F.col(id_col).alias("id"), F.posexplode(F.arrays_zip(names.alias("name"), bodies.alias("body"))).alias("k", "p"), gaps.alias("gaps"), F.regexp_extract_all(t, F.lit(block), F.lit(0)).alias("blocks"))
    newlines = lambda parts, upto: F.aggregate(F.slice(parts, 1, upto), F.lit(0), lambda a, x: a + F.regexp_count(x, F.lit("\n")))
    flat = F.regexp_replace(F.trim(F.regexp_replace(F.col("p.body"), r"\s+", " ")), r"[;\s]+$", "")
    each = each.select("id", F.col("p.name").alias("name"), flat.alias("body"), (newlines(F.col("gaps"), F.col("k") + 1) + newlines(F.col("blocks"), F.col("k"))).alias("line"), "k")
    return each.groupBy("id", "name").agg(F.max_by("body", "k").alias("body"), F.max_by("line", "k").alias("line"))


def inlined(rows: DataFrame, bodies: DataFrame, rebuilt: bool = True, nearest: bool = False) -> DataFrame:
    """H6-H8: rows (id, pos, assertion) that assert a property by its name get its body: as assert property (body); or, if not
    rebuilt, behind the assertion. nearest: a name without a block takes the block before it (pos and the blocks' lines count alike)."""
    name = F.regexp_extract(A, _REFERENCE, 1)
    out = rows.withColumn("__name", F.nullif(name, F.lit(""))).join(bodies.select("id", F.col("name").alias("__name"), F.col("body").alias("__body")), ["id", "__name"], "left")
    found = F.nullif(F.col("__body"), F.lit(""))
    if nearest:
        marks = bodies.select("id", F.col("line").alias("pos"), F.col("body").alias("__mark"))
        both = out.withColumn("__mark", F.lit(None).cast("string")).withColumn("__row", F.lit(1)).unionByName(marks.withColumn("__row", F.lit(0)), allowMissingColumns=True)
        before = Window.partitionBy("id").orderBy("pos", "__row").rowsBetween(Window.unboundedPreceding, -1)
        out = both.withColumn("__near", F.last("__mark", ignorenulls=True).over(before)).where("__row = 1")
        found = F.coalesce(found, F.nullif(F.col("__near"), F.lit("")))
    t = F.col(A)
    new = F.concat(F.lit("assert property ("), found, F.lit(");")) if rebuilt else F.concat(F.rtrim(F.regexp_replace(F.rtrim(t), ";+$", "")), F.lit("  "), found, F.lit(";"))
    return out.withColumn(A, F.when(F.col("__name").isNotNull() & found.isNotNull(), new).otherwise(t)).select(*rows.columns)


def known_widths(widths: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Rows with a literal wider than the signal it is compared with go. widths: name, width."""

    def run(df: DataFrame) -> DataFrame:
        pairs = F.regexp_extract_all(A, F.lit(r"([A-Za-z_]\w*\s*(?:==|!=)\s*\d+\s*'[bdhoBDHO])"), F.lit(1))
        each = df.select("id", "pos", F.explode(pairs).alias("p")).select("id", "pos", F.regexp_extract("p", r"^(\w+)", 1).alias("name"), F.regexp_extract("p", r"(\d+)\s*'", 1).cast("int").alias("n"))
        bad = each.join(widths, "name").where("n > width").select("id", "pos").distinct()
        return df.join(bad, ["id", "pos"], "left_anti")

    return run


def constant_owners(owners: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Rows that compare a literal that belongs to one signal only with another signal go. owners: literal, name."""

    def run(df: DataFrame) -> DataFrame:
        single = owners.groupBy(F.lower("literal").alias("literal")).agg(F.min("name").alias("owner"), F.countDistinct("name").alias("n")).where("n = 1").drop("n")
        pairs = F.regexp_extract_all(A, F.lit(r"([A-Za-z_]\w*\s*==\s*\d+'[bdhoBDHO]\w+)"), F.lit(1))
        each = df.select("id", "pos", F.explode(pairs).alias("p")).select("id", "pos", F.regexp_extract("p", r"^(\w+)", 1).alias("name"), F.lower(F.regexp_extract("p", r"(\d+'\w+)$", 1)).alias("literal"))
        return df.join(each.join(single, "literal").where("owner <> name").select("id", "pos").distinct(), ["id", "pos"], "left_anti")

    return run


def reset_values(resets: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Under a reset, rows that claim another value than the register's reset value go. resets: register, value."""
    from brindle.functions.text import canonical_constant

    def run(df: DataFrame) -> DataFrame:
        rows = df.select("id", "pos", sides(F.col(A)).alias("s")).where(F.col("s.condition").rlike(r"(?i)!\s*\w*(rst|reset)\w*|\brst\b"))
        claim = r"^(\w+)\s*==\s*(\d+'[bdhoBDHO]\w+)$"
        each = rows.select("id", "pos", F.regexp_extract("s.claim", claim, 1).alias("register"), canonical_constant(F.regexp_extract("s.claim", claim, 2)).alias("said"))
        bad = each.join(resets.select("register", canonical_constant(F.col("value")).alias("real")), "register").where("said <> real").select("id", "pos")
        return df.join(bad.distinct(), ["id", "pos"], "left_anti")

    return run


def deduplicate(key: Callable[[Column], Column] = exact_signature) -> Callable[[DataFrame], DataFrame]:
    """Of rows of one id (a block never meets another) and equal key the first stays."""

    def run(df: DataFrame) -> DataFrame:
        w = Window.partitionBy("id", key(F.col(A))).orderBy("pos")
        return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")

    run.key = key
    return run


#: The passes that need no facts, in their order.
PASSES: Sequence[Pass] = (
    ("fix_immediate_implication", fix_immediate_implication),
    ("fix_double_negation", fix_double_negation),
    ("fold_ternary", fold_ternary),
    ("remove_dead_under_disable", remove_dead_under_disable),
    ("remove_missing_implication", remove_missing_implication),
    ("remove_unconditional_equality", remove_unconditional_equality),
    ("remove_tautologies", remove_tautologies),
    ("remove_vacuous_condition", remove_vacuous_condition),
    ("remove_self_comparison", remove_self_comparison),
    ("remove_vacuous_claim", remove_vacuous_claim),
    ("remove_trivial", remove_trivial),
    ("deduplicate", deduplicate()),
    ("semantic_deduplicate", deduplicate(canonical)),
)


def clean(df: DataFrame, passes: Sequence[Pass] = PASSES) -> DataFrame:
    """The chain as one plan: Catalyst merges neighbouring maps and filters."""
    for _, f in passes:
        df = f(df)
    return df


def counted(df: DataFrame, passes: Sequence[Pass] = PASSES) -> DataFrame:
    """Rows that are left after each pass, from one scan: each row notes the pass that drops it instead of going."""
    df, gone = df.withColumn("__gone", F.lit(None).cast("int")), F.col("__gone")
    for step, (_, f) in enumerate(passes, 1):
        if hasattr(f, "test"):
            df = df.withColumn("__gone", F.coalesce(gone, F.when(~F.coalesce(f.test(F.col(A)), F.lit(True)), step)))
            df = f.change(df) if hasattr(f, "change") else df
        elif hasattr(f, "key"):
            w = Window.partitionBy("id", gone.isNull(), f.key(F.col(A))).orderBy("pos")
            df = df.withColumn("__rn", F.row_number().over(w)).withColumn("__gone", F.coalesce(gone, F.when(F.col("__rn") > 1, step))).drop("__rn")
        else:
            df = f(df)
    names = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(n).alias("pass")) for i, n in enumerate(["input", *[n for n, _ in passes]])])
    each = [F.count_if(gone.isNull() | (gone > i)).alias(f"n{i}") for i in range(len(passes) + 1)]
    one = df.agg(*each).select(F.posexplode(F.array(*[f"n{i}" for i in range(len(passes) + 1)])).alias("i", "n_left"), names.alias("names"))
    return one.select("i", "n_left", F.get("names", F.col("i")).alias("p")).select("p.step", "p.pass", "n_left")
