"""Repairs that rebuild an assertion: from fragments, from what its message says, and the readers of values they need."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import checked_signal
from brindle.operators.clean import A, bound, change, split_top

_IMMEDIATE = r"^\s*assert\s*\((.+)\)\s*else\s*\$error\s*\(\"(.+?)\"\)\s*;\s*$"
_VALUE = r"\d+'[bdhoBDHO][0-9a-fA-FxXzZ_]+|0x[0-9a-fA-F]+|\d+|\{[^}]+\}"
_EXPECTED = r"(?i)\b(?:must\s+be|should\s+be|must\s+equal|must\s+produce|shall\s+be|expected\s+to\s+be)\b"
_CLAIM = rf"(?i)([A-Za-z_]\w*(?:\.\w+)*)\s*(?:=|==|must\s+be|should\s+be|must\s+equal|shall\s+be)\s+({_VALUE})\b"


def _implication(condition: Column, claim: Column, message: Column) -> Column:
    return F.concat(F.lit("assert (!("), condition, F.lit(") || ("), claim, F.lit(')) else $error("'), message, F.lit('");'))


def _and_form(t: Column) -> Column:
    body, message = F.trim(F.regexp_extract(t, _IMMEDIATE, 1)), F.regexp_extract(t, _IMMEDIATE, 2)
    clauses = F.filter(F.transform(split_top(body, "&&"), lambda c: F.trim(c)), lambda c: c != "")

    def rewritten(parts: Column, name: Column) -> Column:
        says = lambda c: F.rlike(c, F.concat(F.lit(r"(?i)\b"), name, F.lit(r"\b")))
        given, claimed = F.filter(parts, lambda c: ~says(c)), F.filter(parts, says)
        new = bound(F.struct(given.alias("g"), claimed.alias("c")), lambda x: F.when((F.size(x["g"]) > 0) & (F.size(x["c"]) > 0), _implication(F.array_join(x["g"], " && "), F.array_join(x["c"], " && "), message)))
        return F.when((F.size(parts) >= 3) & name.isNotNull(), new)

    fits = t.rlike(_IMMEDIATE) & ~body.rlike(r"\|\||\|->|\|=>") & ~F.lower(t).contains("property")
    return F.coalesce(F.when(fits, bound(clauses, lambda p: bound(checked_signal(message), lambda n: rewritten(p, n)))), t)


#: I4: an immediate conjunction of three or more becomes an implication: what names the signal that the message checks is its claim.
fix_immediate_and_form = change(_and_form)


def fix_condition_only(signals: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """An immediate condition whose message says what must be gets that as its claim, if a signal of the design (name, width;
    null widths are unknown) and a value that fits it are named; else it goes. Without signals all stay."""

    def run(df: DataFrame) -> DataFrame:
        if signals.isEmpty():
            return df
        t = F.col(A)
        condition, message = F.trim(F.regexp_extract(t, _IMMEDIATE, 1)), F.trim(F.regexp_extract(t, _IMMEDIATE, 2))
        shaped = t.rlike(_IMMEDIATE) & ~condition.rlike(r"\|\||\|->|\|=>|##") & message.rlike(_EXPECTED)
        rows = df.withColumn("__shaped", shaped).withColumn("__if", condition).withColumn("__says", message)
        pairs = F.arrays_zip(F.regexp_extract_all("__says", F.lit(_CLAIM), F.lit(1)).alias("name"), F.regexp_extract_all("__says", F.lit(_CLAIM), F.lit(2)).alias("value"))
        each = rows.where("__shaped").select("id", "pos", "__if", F.posexplode(pairs).alias("k", "p")).select("id", "pos", "__if", "k", "p.name", "p.value")
        each = each.where(~F.rlike("__if", F.concat(F.lit(r"\b\Q"), F.col("name"), F.lit(r"\E\b")))).withColumn("__leaf", F.regexp_extract("name", r"(\w+)$", 1))
        known = signals.groupBy("name").agg(F.max("width").alias("width"))
        own, leaf = known.toDF("name", "__own").withColumn("__a", F.lit(True)), known.toDF("__leaf", "__of_leaf").withColumn("__b", F.lit(True))
        each = each.join(own, "name", "left").join(leaf, "__leaf", "left").where("__a OR __b")
        bits = F.regexp_extract("value", r"^(\d+)'", 1).try_cast("int")
        each = each.where(F.coalesce(bits <= F.coalesce("__own", "__of_leaf"), F.lit(True)))
        claims = each.groupBy("id", "pos").agg(F.array_sort(F.collect_list(F.struct("k", F.concat_ws(" == ", "name", "value").alias("c")))).alias("__claims"))
        out = rows.join(claims, ["id", "pos"], "left").where(~F.col("__shaped") | F.col("__claims").isNotNull())
        claim = F.array_join(F.transform("__claims", lambda x: x["c"]), " && ")
        return out.withColumn(A, F.when(F.col("__shaped"), _implication(F.col("__if"), claim, F.col("__says"))).otherwise(t)).select(*df.columns)

    return run


def value_read(text: Column) -> Column:
    """The value that text starts with: a brace expression (braces in it up to three deep), a sized literal or a word; null without one."""
    braces = r"\{(?:[^{}]++|\{(?:[^{}]++|\{[^{}]*+\})*+\})*+\}"
    return F.nullif(F.regexp_extract(text, rf"^\s*({braces}|\d+'[bdhoBDHO][0-9a-fA-F_xXzZ?]+|\w+)", 1), F.lit(""))


def parsed_ternary(text: str | None) -> tuple[str, str, str] | None:
    """H24 for one expression: condition, then and else of a choice that stands in no parenthesis but one around the whole."""

    def outside(said: str, sign: str, start: int = 0) -> int:
        depth = 0
        for i in range(start, len(said)):
            if said[i] == sign and depth == 0:
                return i
            depth += (said[i] == "(") - (said[i] == ")")
        return -1

    said = (text or "").strip()
    if said[:1] == "(" and said[-1:] == ")" and outside(said[1:], ")") == len(said) - 2:
        said = said[1:-1].strip()
    at = outside(said, "?")
    to = outside(said, ":", at + 1) if at >= 0 else -1
    if to < 0:
        return None
    condition = said[:at].strip()
    if condition[:1] == "(" and condition[-1:] == ")":
        condition = condition[1:-1].strip()
    return condition, said[at + 1 : to].strip(), said[to + 1 :].strip()


def ternaries(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """Id, condition, then, otherwise of the rows that are a choice."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(i, *x) for i, t in zip(b.id.array, b.text) if (x := parsed_ternary(t))]
            yield pd.DataFrame(found, columns=["id", "condition", "then", "otherwise"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return rows.mapInPandas(run, f"id {dict(rows.dtypes)['id']}, condition string, then string, otherwise string").withColumnRenamed("id", id_col)


_WRAPPED = re.compile(r"\bproperty\s+\w+\s*;|\bendproperty\b|\bassert\s+property\b", re.IGNORECASE)
_MESSAGE = re.compile(r"else\s+\$error\s*\(")
_TAIL = re.compile(r'\)\s*(else\s+\$error\s*\(".*?"\)\s*;?)\s*$')


def _unwrapped(body: str) -> str:
    """Without the parentheses around the whole."""
    while body[:1] == "(" and body[-1:] == ")":
        depth = low = 0
        for c in body[1:-1]:
            depth += (c == "(") - (c == ")")
            low = min(low, depth)
        if depth or low < 0:
            break
        body = body[1:-1].strip()
    return body


def wrapped_fragments(text: str, clock: str | None = None, reset: str | None = None) -> str:
    """I1 for one file: expressions with a failure message but without an assert get one: clocked if they hold an implication
    (without a clock these go, with a comment right before them), else immediate. Other lines stay."""
    stays = lambda line: not line or line.startswith("//") or line.lower().startswith("assert") or bool(_WRAPPED.search(line))
    lines, out, i = text.splitlines(), [], 0
    while i < len(lines):
        if stays(lines[i].strip()):
            out.append(lines[i])
            i += 1
            continue
        held, j = [lines[i].strip()], i + 1
        while j < len(lines) and not stays(lines[j].strip()):
            held.append(lines[j].strip())
            j += 1
            if _MESSAGE.search(held[-1]):
                break
        fragment = " ".join(held)
        tail = _TAIL.search(fragment)
        if not tail:
            out.append(lines[i])
            i += 1
            continue
        body, said = _unwrapped(fragment[: tail.start()].strip()), tail[1].rstrip(";") + ";"
        if not re.search(r"\|[-=]>", fragment):
            out.append(f"assert ({body}) {said}")
        elif clock:
            out.append(f"assert property (@(posedge {clock}){f' disable iff (!{reset})' if reset else ''} {body}) {said}")
        elif out and out[-1].strip().startswith("//"):
            out.pop()
        i = j
    return "\n".join(out)


def with_wrapped_fragments(files: DataFrame, id_col: str, text: str, clock: str | None = None, reset: str | None = None) -> DataFrame:
    """Id, text of each file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(text=[None if t is None else wrapped_fragments(t, clock, reset) for t in b.text])

    rows = files.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return rows.mapInPandas(run, rows.schema).withColumnsRenamed({"id": id_col, "text": text})


def doc_coverage(props: DataFrame, signals: str, used: DataFrame, name: str, most: int = 6) -> DataFrame:
    """One row: covered (all signals of a property are used, and it has some), total, missing (labels modal:signals of the
    first others, three signals each). props: pos, modal, signals (array); used: names."""
    each = props.select("pos", "modal", F.array_sort(F.array_distinct(signals)).alias("s"))
    lost = each.select("pos", F.explode("s").alias("n")).join(used.select(F.col(name).alias("n")).distinct(), "n", "left_anti").select("pos").distinct().withColumn("__lost", F.lit(True))
    marked = each.join(lost, "pos", "left").withColumn("ok", F.col("__lost").isNull() & (F.size("s") > 0))
    label = F.concat(F.coalesce("modal", F.lit("?")), F.lit(":"), F.array_join(F.slice("s", 1, 3), ","))
    first = marked.where("NOT ok").orderBy("pos").limit(most).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", label.alias("l")))), lambda x: x["l"]), "; ").alias("missing"))
    return marked.agg(F.count_if("ok").alias("covered"), F.count(F.lit(1)).alias("total")).crossJoin(F.broadcast(first))  # two single rows
