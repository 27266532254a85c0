"""Scanner state over the lines of long texts: depth of parentheses, floored at zero, and whether a string is open.

What a line does to the state is an element of a monoid: to the flag one of four maps (it may set, clear, keep or turn it), to
the depth a map d -> max(d + a, b). Elements of consecutive lines compose, so a text is cut into chunks of lines, each chunk
composed by itself, the chunks' elements composed over the text, and each line gets its chunk's start state. No task reads more than
a chunk's lines or a text's chunks.

Defined results: a null line is an empty one; line numbers need not be dense; of repeated numbers the smaller text comes first; a
backslash skips the next character within a string only and never the line's end; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.graph import dealt

#: Lines of a chunk.
CHUNK = 1024
# What a string holds up to its end or the line's.
INSIDE = r'(?:[^"\\]++|\\.|\\$)*+'


def _line_maps(line: Column) -> tuple[Column, Column]:
    """For a start outside and inside a string: struct(out: the flag after the line, net, floor: of the depth)."""
    text = F.coalesce(line, F.lit(""))

    def outside(t: Column, open_before: Column) -> Column:
        bare = F.regexp_replace(t, rf'(?s)"{INSIDE}"', "")
        still = bare.contains('"')
        signs = F.regexp_replace(F.regexp_replace(bare, r'(?s)".*$', ""), r"[^()]", "")
        net = F.length(F.regexp_replace(signs, r"\)", "")) - F.length(F.regexp_replace(signs, r"\(", ""))
        # the depth after the line from a start at zero
        least = F.when(signs == "", 0).otherwise(F.aggregate(F.split(signs, ""), F.lit(0), lambda d, c: F.when(c == "(", d + 1).when(c == ")", F.greatest(d - 1, F.lit(0))).otherwise(d)))
        return F.struct((still | open_before).cast("int").alias("out"), net.cast("long").alias("net"), least.cast("long").alias("floor"))

    rest = F.regexp_extract(text, rf'(?s)^{INSIDE}"(.*)$', 1)
    closed = text.rlike(rf'(?s)^{INSIDE}"')
    return outside(text, F.lit(False)), outside(F.when(closed, rest).otherwise(""), ~closed)


def _flag_before(order: Window, zero: Column, one: Column, start: Column) -> Column:
    """The flag before each row, of rows that map 0 to zero and 1 to one, from start: the last row that sets it, turned as often as rows since turn it."""
    sets, turns = F.when(zero == one, zero), ((zero == 1) & (one == 0)).cast("int")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    so_far = F.coalesce(F.sum(turns).over(before), F.lit(0))
    last, at = F.last(sets, ignorenulls=True).over(before), F.last("turned", ignorenulls=True).over(before)
    return F.when(last.isNull(), (start + so_far) % 2).otherwise((last + so_far - at) % 2)


def _turned(df: DataFrame, order: Window, zero: str, one: str) -> DataFrame:
    """df with turned: of rows that set the flag, how many rows have turned it up to there."""
    turns = ((F.col(zero) == 1) & (F.col(one) == 0)).cast("int")
    so_far = F.sum(turns).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("turned", F.when(F.col(zero) == F.col(one), so_far))


def states(lines: DataFrame, source: str, no: str, line: str, chunk: int = CHUNK, n_rows: int = 0) -> DataFrame:
    """Source, no, line, depth and in_string after the line, complete: the line ends a statement (a semicolon at depth 0 outside
    strings). n_rows: how many lines there are, if a task is to hold a bounded number of them."""
    outside, inside = _line_maps(F.col(line))
    rows = lines.select(F.col(source).alias("source"), F.col(no).alias("no"), F.col(line).alias("line"), outside.alias("o"), inside.alias("i"))
    rows = rows.withColumns({"chunk": F.floor(F.col("no") / chunk), "zero": F.col("o.out"), "one": F.col("i.out")})
    # windows over a chunk and the join of its start find its lines in place; a struct's nulls are equal
    rows = dealt(rows.withColumn("of", F.struct("source", "chunk")), n_rows, "of")
    own = Window.partitionBy("of").orderBy("no", "line")
    rows = _turned(rows, own, "zero", "one")
    rows = rows.withColumns({"from_zero": _flag_before(own, F.col("zero"), F.col("one"), F.lit(0)), "from_one": _flag_before(own, F.col("zero"), F.col("one"), F.lit(1))})

    def under(flag: str) -> dict[str, Column]:
        """The depth's map up to each line of the chunk, if the chunk starts in state flag: net, and the most of floor - net so far."""
        at = F.when(F.col(flag) == 1, F.col("i")).otherwise(F.col("o"))
        return {f"net_{flag}": F.sum(at["net"]).over(own), f"floor_{flag}": at["floor"], f"after_{flag}": at["out"]}

    rows = rows.withColumns(under("from_zero") | under("from_one"))
    rows = rows.withColumns({f"lift_{f}": F.max(F.col(f"floor_{f}") - F.col(f"net_{f}")).over(own) for f in ("from_zero", "from_one")})
    last = F.struct("no", "line")
    facts = [F.max_by(F.struct(F.col(f"after_{f}").alias("after"), F.col(f"net_{f}").alias("net"), F.col(f"lift_{f}").alias("lift")), last).alias(f) for f in ("from_zero", "from_one")]
    chunks = rows.groupBy("of").agg(*facts).withColumns({"zero": F.col("from_zero.after"), "one": F.col("from_one.after")})
    text = Window.partitionBy("of.source").orderBy("of.chunk")
    chunks = _turned(chunks, text, "zero", "one")
    chunks = chunks.withColumn("start", _flag_before(text, F.col("zero"), F.col("one"), F.lit(0)))
    chunks = chunks.withColumn("at", F.when(F.col("start") == 1, F.col("from_one")).otherwise(F.col("from_zero"))).withColumn("net", F.sum("at.net").over(text))
    before = text.rowsBetween(Window.unboundedPreceding, -1)
    # floor - net of a chunk's whole map, relative to the text's start
    lift = F.col("at.lift") - F.col("net") + F.col("at.net")
    chunks = chunks.withColumn("lift", lift)
    net, most = F.coalesce(F.sum("at.net").over(before), F.lit(0)), F.coalesce(F.max("lift").over(before), F.lit(0))
    chunks = chunks.select("of", "start", (net + F.greatest(most, F.lit(0))).alias("depth_at"))
    joined = rows.join(chunks, "of")
    pick = lambda name: F.when(F.col("start") == 1, F.col(f"{name}_from_one")).otherwise(F.col(f"{name}_from_zero"))
    depth = pick("net") + F.greatest("depth_at", pick("lift"))
    out = joined.select("source", "no", "line", depth.alias("depth"), (pick("after") == 1).alias("in_string"))
    return out.withColumn("complete", F.coalesce(F.col("line").rlike(r";\s*$"), F.lit(False)) & (F.col("depth") == 0) & ~F.col("in_string"))


def statements(lines: DataFrame, source: str, no: str, line: str, n_rows: int = 0) -> DataFrame:
    """Source, statement (from 0), first, last (line numbers), text: lines joined up to each that completes a statement."""
    order = Window.partitionBy("source").orderBy("no", "line")
    held = dealt(states(lines, source, no, line, n_rows=n_rows), n_rows, "source").withColumn("statement", F.coalesce(F.sum(F.col("complete").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    listed = F.sort_array(F.collect_list(F.struct("no", F.coalesce("line", F.lit("")).alias("line"))))
    return held.groupBy("source", "statement").agg(F.min("no").alias("first"), F.max("no").alias("last"), F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("text"))
