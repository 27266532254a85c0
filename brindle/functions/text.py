r"""Text functions: Column to Column, all inside the JVM.

Identifiers are ASCII ([A-Za-z_][A-Za-z0-9_]*), so that Java's, Python's and RE2's expressions agree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

IDENT = r"[A-Za-z_][A-Za-z0-9_]*"

# Words that are no signal names.
KEYWORDS = (
    "assert property endproperty disable iff posedge negedge else and or not if logic wire reg input output always_ff "
    "always_comb module endmodule begin end b h d x z inside throughout until first_match signed unsigned null void true false"
).split()
# The shorter list of the cost metric.
COST_KEYWORDS = (
    "assert property disable iff posedge negedge else error and or not if logic wire reg input output always_ff always_comb "
    "module endmodule begin end b h d x z inside throughout until first_match"
).split()
# Patterns of trivial and complex checks.
BITS_CHECK = r"\$bits\s*\(\s*\w+(?:\.\w+|\[[^\]]+\])*\s*\)\s*==\s*\d"
VACUOUS_TRUE = r"(?i)^\s*assert\s*(?:property\s*)?\(?\s*1'b1\s*\)?\s*\)?\s*;"
COST_BUILTINS = r"\$(past|stable|rose|fell|onehot|onehot0|isunknown)\b"
QUALITY_BUILTINS = r"\$(past|stable|rose|fell|onehot|onehot0|countones|isunknown|changed)\b"
SET_WORDS = r"\b(inside|throughout|until|first_match)\b"
# English phrases of documented properties.
MODALS = ("must", "shall", "should", "required to", "expected to", "cannot", "never", "always")


def strip(text: Column, *patterns: str) -> Column:
    """text without what the patterns match, in their order."""
    return reduce(lambda t, p: F.regexp_replace(t, p, ""), patterns, text)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def lit_array(words) -> Column:
    return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


def idents(text: Column, keywords=KEYWORDS) -> Column:
    """Distinct identifiers in order of first use: no strings, comments, $-functions, typed literals, numbers or keywords (H2)."""
    bare = strip(text, r'"[^"]*"', r"//.*", r"(?s)/\*.*?\*/", r"\$\w+", r"\d+'[bdhoBDHO][\w?]+", r"\b\d+\b")
    found = F.array_distinct(F.regexp_extract_all(bare, F.lit(rf"\b({IDENT})\b"), F.lit(1)))
    words = lit_array(keywords)
    return F.filter(found, lambda x: ~F.array_contains(words, F.lower(x)))


def idents_before_message(text: Column) -> Column:
    """Identifiers before a failure message (H1): case-sensitive keywords, and no left-overs of literals such as h0f."""
    bare = strip(text, r"(?s)else\s*\$\w+\s*\(.*", r'"[^"]*"', r"\$\w+")
    found = F.array_distinct(F.regexp_extract_all(bare, F.lit(rf"\b({IDENT})\b"), F.lit(1)))
    return F.filter(F.array_except(found, lit_array(KEYWORDS)), lambda x: ~x.rlike("^[bdho][0-9a-fA-F_]+$"))


def idents_of_pair(first: Column, second: Column) -> Column:
    """Identifiers of two texts together (H3)."""
    return F.array_union(idents_before_message(first), idents_before_message(second))


def antecedent_count(text: Column) -> Column:
    r"""Distinct identifiers before the first implication (H4); 0 without one."""
    body = F.regexp_extract(text, r"(.+?)\s*\|[->=]+\s*", 1)
    bare = strip(body, r'"[^"]*"', r"\$\w+", r"(?i)\d+'[bdho][\w?]+", r"@\s*\([^)]*\)", r"\bdisable\s+iff\s*\([^)]*\)")
    words = lit_array(KEYWORDS)
    found = F.array_distinct(F.regexp_extract_all(bare, F.lit(rf"\b({IDENT})\b"), F.lit(1)))
    return F.size(F.filter(found, lambda x: ~F.array_contains(words, F.lower(x))))


def antecedent_count_cost(text: Column) -> Column:
    r"""The cost metric's count: only what stands between a closing parenthesis and the implication (H4)."""
    body = F.regexp_extract(text, r"\)\s*([^|]+?)\s*\|[->=]+\s*", 1)
    bare = strip(body, r'"[^"]*"', r"\$\w+", r"\d+'[bdho][\w?]+")
    return F.size(F.array_except(F.regexp_extract_all(bare, F.lit(rf"\b({IDENT})\b"), F.lit(1)), lit_array(COST_KEYWORDS)))


def category(text: Column) -> Column:
    """What an assertion is about: the first rule that holds (B1)."""
    t = F.trim(text)
    has = t.contains
    rules = [
        (~t.startswith("assert"), "non-assert"),
        (has("$stable"), "stable-backpressure"),
        (has("$onehot"), "onehot"),
        (has("inside"), "inside-set"),
        (has("$past") & has("|=>"), "seq-update"),
        (has("$past"), "past-other"),
        (has("$rose") | has("$fell"), "edge-detect"),
        ((has("pvld") & has("prdy")) | (t.rlike(r"\bvalid\b") & t.rlike(r"\bready\b")), "handshake"),
        (t.rlike(r"!\s*[a-zA-Z_]\w*\s*\|->"), "reset-imp"),
        (has("|->"), "implication-other"),
    ]
    first = reduce(lambda c, r: c.when(*r), rules[1:], F.when(*rules[0]))
    return first.otherwise("other")


def trivial_cost(text: Column) -> Column:
    """A width check alone (B2): the overlapped implication excuses it, the next-cycle one doesn't."""
    return text.rlike(BITS_CHECK) & ~text.contains("&&") & ~text.contains("||") & ~text.contains("|->")


def trivial_quality(text: Column) -> Column:
    """A width check alone or a constant truth."""
    return (trivial_cost(text) & ~text.contains("|=>")) | text.rlike(VACUOUS_TRUE)


def complex_cost(text: Column) -> Column:
    """Time, sets, next cycle, or two signals in the condition."""
    return text.rlike(COST_BUILTINS) | text.contains("inside") | text.contains("|=>") | (antecedent_count_cost(text) >= 2)


def complex_quality(text: Column) -> Column:
    """The quality metric's test (B5): two signals count before an overlapped implication only."""
    return text.rlike(QUALITY_BUILTINS) | text.rlike(SET_WORDS) | text.contains("|=>") | (text.contains("|->") & (antecedent_count(text) >= 2))


def unresolved(text: Column, known: Column) -> Column:
    """Any identifier outside the known ones (B6); nothing is unresolved where nothing is known."""
    return (F.size(known) > 0) & (F.size(F.array_except(idents(text), known)) > 0)


def normal_line(text: Column) -> Column:
    """H9: line comments off, error texts alike, white space collapsed, lower case."""
    return F.lower(collapse(F.regexp_replace(strip(text, r"//.*"), r"\$error\s*\([^)]*\)", r"\$error(...)")))


def normal_text(text: Column) -> Column:
    """H9 with block comments off and display texts alike."""
    bare = F.regexp_replace(strip(text, r"//.*", r"(?s)/\*.*?\*/"), r"\$error\s*\([^)]*\)", r"\$error(...)")
    return F.lower(collapse(F.regexp_replace(bare, r"\$display\s*\([^)]*\)", r"\$display(...)")))


def exact_signature(text: Column) -> Column:
    """White space collapsed, the error tail off."""
    return F.trim(strip(collapse(text), r"else \$error\(.*$"))


def canonical(text: Column) -> Column:
    """H12. All parentheses are deleted, so `a && (b || c)` and `a && b || c` are equal here; clauses of || are sorted."""
    bare = strip(F.trim(text), r"(?m)//.*$", r"else\s+\$error\(.*$")
    bare = F.regexp_replace(F.trim(bare), r"[;\s]+$", "")
    bare = F.regexp_replace(bare, r"^assert\s+property\s*\(|^assert\s*\(", "(")
    bare = strip(bare, r"disable\s+iff\s*\([^)]*\)", r"@\s*\(\s*(?:pos|neg)edge\s+\w+\s*\)")
    bare = F.regexp_replace(bare, r"\s*(==|!=|<=|>=|\|\||&&|\|->|\|=>|->)\s*", " $1 ")
    bare = F.regexp_replace(collapse(strip(bare, r"[()]")), r"!\s+", "!")
    return F.lower(F.array_join(F.array_sort(F.transform(F.split(bare, r"\|\|"), lambda c: F.trim(c))), " || "))


def slug(text: Column, most: int = 60, head: str = "") -> Column:
    """H39."""
    return F.left(F.concat(F.lit(head), F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_")), F.lit(most))


def search_tokens(text: Column) -> Column:
    """camelCase parted, split at everything but letters and digits, lower case."""
    parted = F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(parted), "[^a-z0-9]+"), lambda x: x != "")


def safe_ratio(top: Column, bottom: Column) -> Column:
    """Null unless the denominator is positive."""
    return F.when(bottom > 0, top / bottom)


def reduction(top: Column, bottom: Column) -> Column:
    """(1 - top / bottom) * 100 with sign and one decimal, n/a without a denominator."""
    return F.when(bottom != 0, F.format_string("%+.1f%%", ((1 - top / bottom) * 100).cast("double"))).otherwise("n/a")


def split_tag(tag: Column) -> Column:
    """struct(name, variant), parted at the last underscore."""
    has = tag.contains("_")
    return F.struct(F.when(has, F.regexp_extract(tag, "^(.*)_([^_]*)$", 1)).otherwise(tag).alias("name"), F.when(has, F.regexp_extract(tag, "^(.*)_([^_]*)$", 2)).otherwise("").alias("variant"))


def design_name(name: Column) -> Column:
    """H38."""
    return F.when(name.startswith("nvdla_"), F.substring(name, 7, 1 << 20)).when(name.startswith("coral_"), F.substring(name, 7, 1 << 20)).when(name == "rvv_backend", "rvv").otherwise(name)


def literal_width(text: Column) -> Column:
    """N of N'b..., null otherwise."""
    return F.regexp_extract(text, r"^\s*(\d+)\s*'[bdhoBDHO]", 1).try_cast("int")


def select_width(text: Column) -> Column:
    """Bits of [hi:lo] or [i], null otherwise."""
    hi, lo = (F.regexp_extract(text, r"\[\s*(\d+)\s*:\s*(\d+)\s*\]", g).try_cast("long") for g in (1, 2))
    return F.when(hi.isNotNull(), F.abs(hi - lo) + 1).when(text.rlike(r"\[\s*\d+\s*\]"), F.lit(1).cast("long"))


def normal_literal(text: Column) -> Column:
    """H19."""
    return F.lower(F.regexp_replace(text, r"[\s_]+", ""))


def canonical_constant(text: Column) -> Column:
    """H20: '0, '1, or width, base and value; null for anything else. Decimal all-ones up to 62 bits."""
    t = F.trim(text)
    sized = r"^(\d+)\s*'([bdhoBDHO])\s*([0-9a-fA-F_xXzZ]+)$"
    width, base, value = F.regexp_extract(t, sized, 1).try_cast("int"), F.lower(F.regexp_extract(t, sized, 2)), F.regexp_replace(F.regexp_extract(t, sized, 3), "_", "")
    digits = F.regexp_replace(F.lower(value), "^0+", "")
    per = F.when(base == "b", 1).when(base == "o", 3).when(base == "h", 4)
    # all ones: full digits behind a first digit that holds what is left of the width
    full = F.when(base == "b", F.lit("1")).when(base == "o", F.lit("7")).otherwise(F.lit("f"))
    top_bits = F.when(width % per == 0, per).otherwise(width % per)
    top = F.substring(F.lit("137f"), top_bits, 1)
    ones = F.when(base == "d", (width <= 62) & (digits == (F.expr("shiftleft(1L, 0)") * F.pow(F.lit(2.0), width).cast("long") - 1).cast("string"))).otherwise(
        (width > 0) & (digits == F.concat(top, F.repeat(full, (F.ceil(width / per) - 1).cast("int"))))
    )
    return (
        F.when(t.rlike(r"^'0$|^\d+\s*'[bdhoBDHO]\s*[0_]+$|^\{\s*\d+\s*\{\s*1'b0\s*\}\s*\}$"), "'0")
        .when(t.rlike(r"^'1$|^\{\s*\d+\s*\{\s*1'b1\s*\}\s*\}$"), "'1")
        .when(~t.rlike(sized), None)
        .when(~value.rlike("[xXzZ]") & F.coalesce(ones, F.lit(False)), "'1")
        .otherwise(F.concat(width.cast("string"), F.lit("'"), base, value))
    )


def template(text: Column) -> Column:
    r"""name_3 to name_*, [66] to [*]; typed literals keep their digits."""
    # a literal's digits follow a quote sign and a base letter, so neither pattern reaches them
    return F.regexp_replace(F.regexp_replace(text, r"\b([A-Za-z_]\w*?)_(\d+)\b(?<!'[bdhoBDHO]\w{0,40})", "$1_*"), r"\[\d+\]", "[*]")


def template_indices(text: Column) -> Column:
    """The numbers that template() replaced, from left to right."""
    hits = F.regexp_extract_all(text, F.lit(r"(\b[A-Za-z_]\w*?_\d+\b|\[\d+\])"), F.lit(1))
    return F.transform(hits, lambda h: F.regexp_extract(h, r"(\d+)\]?$", 1).cast("long"))


def inflate(form: Column, indices: Column) -> Column:
    """A template with its numbers back in place, from left to right."""
    parts = F.split(form, r"\*")
    return F.array_join(F.zip_with(parts, indices, lambda p, i: F.concat(p, F.coalesce(i.cast("string"), F.lit("")))), "")


def token_estimate(text: Column) -> Column:
    """H46."""
    return F.floor(F.char_length(text) / 4)


def line_of(text: Column, offset: Column) -> Column:
    """The 1-based line of a 0-based offset."""
    return F.regexp_count(F.substring(text, F.lit(1), offset), F.lit("\n")) + 1


def bare_source(text: Column) -> Column:
    """Lines without comments and without compiler directives."""
    lines = F.filter(F.split(text, "\n"), lambda x: ~x.rlike(r"^\s*`"))
    return F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, "//.*", "")), "\n")


def mutant_key(line: Column, mutated: Column) -> Column:
    """H40."""
    return F.md5(F.concat_ws(":", line.cast("string"), mutated))


def data_uri(text: Column) -> Column:
    """The bytes of data:...;base64,... as text, null if there are none."""
    said = F.regexp_extract(text, r"^data:[^,]*;base64,(.*)$", 1)
    return F.when(said != "", F.decode(F.try_to_binary(said, F.lit("base64")), "UTF-8"))


def tool_calls(text: Column) -> Column:
    """The JSON objects in <tool_call> tags, as variants; what isn't JSON is left out."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>\s*(\{.*?\})\s*</tool_call>"), F.lit(1))
    return F.filter(F.transform(found, F.try_parse_json), lambda v: v.isNotNull())


def plan_json(text: Column) -> Column:
    """A fenced JSON block, else from the first [ to the last ]."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\[.*?\])\s*```", 1)
    return F.coalesce(F.try_parse_json(F.nullif(fenced, F.lit(""))), F.try_parse_json(F.nullif(F.regexp_extract(text, r"(?s)(\[.*\])", 1), F.lit(""))))


def fenced_code(text: Column) -> Column:
    """A closed fence's content, else an open one's, else the whole text."""
    closed, open_ = F.regexp_extract(text, r"(?s)```\w*\n(.*?)```", 1), F.regexp_extract(text, r"(?s)```\w*\n(.*)$", 1)
    return F.regexp_replace(F.coalesce(F.nullif(closed, F.lit("")), F.nullif(open_, F.lit("")), text), r"^\s+|\s+$", "")


def property_block(text: Column) -> Column:
    """From the first property to the last semicolon; null without an assert property."""
    bare = strip(text, r"(?s)<think>.*?</think>", r"```\w*")
    return F.when(bare.rlike(r"assert\s+property"), F.nullif(F.regexp_extract(bare, r"(?s)((?:assert\s+)?property\b.*;)", 1), F.lit("")))


def modal(text: Column, phrases=MODALS) -> Column:
    """The first word of the first modal phrase that something follows, null without one. Phrases may come from the caller."""
    found = F.regexp_extract(text, r"(?i)\b(" + "|".join(p.replace(" ", r"\s+") for p in phrases) + r")\s", 1)
    return F.nullif(F.lower(F.regexp_extract(found, r"^(\S+)", 1)), F.lit(""))


# Patterns of the signal that a message says is checked, in their order, and words that are none.
CHECKED = (
    r"(?i)(\w+)\s+(?:incorrect|mismatch|wrong|error|failure)",
    r"(?i)([a-zA-Z_]\w*)\s+output\s+(?:incorrect|mismatch|wrong)",
    r"(?i)(?:expected|check(?:ing)?|verify(?:ing)?)\s+(\w+)",
    r"(?i)(\w+)\s+(?:should|must)\s+be",
    r"(?i)(\w+)\s+pattern\s+(?:incorrect|mismatch|wrong)",
)
NOISE = (
    "the", "a", "an", "output", "input", "signal", "value", "result", "data", "when", "if", "not", "is", "are",
    "code", "mode", "pattern", "format", "sign", "flag", "zero", "one", "bit", "byte", "word", "width", "size",
)


def checked_signal(message: Column) -> Column:
    """What the first pattern names that isn't noise, null without one."""
    found = [F.regexp_extract(message, p, 1) for p in CHECKED]
    return F.coalesce(*[F.when((f != "") & ~F.lower(f).isin(*NOISE), f) for f in found])


def covered_signature(text: Column) -> Column:
    """An assertion in short: no message, keywords, semicolon or outer parentheses, 100 characters at most; null for other lines."""
    bare = F.regexp_extract(F.trim(text), r"(?s)^(.*?)(?:\belse\s+\$\w+\s*\(.*)?$", 1)
    bare = F.regexp_replace(F.trim(F.regexp_replace(bare, r"^assert\s+(property\s+)?", "")), r";\s*$", "")
    bare = strip_outer(F.trim(bare), 1)
    short = F.when(F.char_length(bare) > 100, F.concat(F.left(bare, F.lit(97)), F.lit("..."))).otherwise(bare)
    return F.when(F.trim(text).startswith("assert"), F.nullif(short, F.lit("")))


def balanced(text: Column) -> Column:
    """Every parenthesis closes, none before it opens."""
    signs = F.transform(F.regexp_extract_all(text, F.lit(r"([()])"), F.lit(1)), lambda c: F.when(c == "(", 1).otherwise(-1))
    start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("low"))
    end = F.aggregate(signs, start, lambda a, x: F.struct((a["d"] + x).alias("d"), F.least(a["low"], a["d"] + x).alias("low")))
    return (end["d"] == 0) & (end["low"] >= 0)


def strip_outer(text: Column, times: int = 8) -> Column:
    """Outer parentheses off, as often as they wrap the whole (up to times)."""

    def once(out: Column, _: Column) -> Column:
        inner = F.regexp_extract(out, r"(?s)^\((.*)\)$", 1)
        return F.when(out.rlike(r"(?s)^\(.*\)$") & balanced(inner), F.trim(inner)).otherwise(out)

    # a fold, so that the expression doesn't grow with each round
    return F.aggregate(F.sequence(F.lit(1), F.lit(times)), F.trim(text), once)


def zero_reset(text: Column) -> Column:
    """A constant zero of any width."""
    return F.coalesce(canonical_constant(text) == "'0", F.lit(False)) | F.trim(text).rlike("^0+$")


def percent_known(ids: Column, known: Column) -> Column:
    return safe_ratio(F.size(F.array_intersect(ids, known)).cast("double"), F.size(ids))
