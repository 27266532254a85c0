"""Mutation rows of source lines: one row for each operator, match and replacement."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import groupby, islice, tee

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Replaced operators, and what replaces them.
REPLACED = {
    "&&": ("||",),
    "||": ("&&",),
    "&": ("|",),
    "|": ("&",),
    "^": ("&", "|"),
    "==": ("!=",),
    "!=": ("==",),
    ">=": (">", "=="),
    "<=": ("<", "=="),
    ">": (">=", "<"),
    "<": ("<=", ">"),
    "+": ("-",),
    "-": ("+",),
}
#: An operator, two signs before one, that no = or ! stands before and no = behind.
OPERATOR = re.compile(r"(?<![=!])(?:" + "|".join(re.escape(x) for n in (2, 1) for x in REPLACED if len(x) == n) + r")(?!=)")
# Lines that are never mutated.
SKIPPED = (
    r"^\s*//",
    r"^\s*$",
    r"^\s*(module|endmodule)\b",
    r"^\s*(input|output|inout)\b",
    r"^\s*(wire|reg|logic|integer)\b",
    r"^\s*(parameter|localparam)\b",
    r"^\s*(begin|end)\s*$",
    r"^\s*\);?\s*$",
    r"^\s*\.\w+\s*\(",
)
# Words that are no module's or instance's name.
NO_NAMES = (
    "module", "endmodule", "input", "output", "inout", "wire", "reg", "logic", "assign", "always", "initial", "if", "else", "begin", "end",
    "case", "default", "for", "generate", "parameter", "localparam", "function", "endfunction", "task", "endtask", "always_comb", "always_ff",
    "always_latch", "integer",
)
SKIP, INSTANCE = re.compile("|".join(SKIPPED)), re.compile(r"^\s*(\w+)\s+(?:#\s*\(.*?\)\s+)?(\w+)\s*\(")
Made = Iterator[tuple[str, str]]


def _put(line: str, m: re.Match, new: str) -> str:
    return line[: m.start()] + new + line[m.end() :]


def op_replace(line: str) -> Made:
    """M1: mutated line and description, operator by operator."""
    for m in OPERATOR.finditer(line):
        for new in REPLACED[m[0]]:
            yield _put(line, m, new), f"Replace '{m[0]}' with '{new}'"


def _other_constant(said: str) -> tuple[str, ...]:
    if "'" not in said:
        n = int(said)
        return (str(1 - n),) if n < 2 else (str(n - 1), str(n + 1))
    if said in ("1'b0", "1'b1"):
        return ("1'b1" if said == "1'b0" else "1'b0",)
    size, base, digits = re.fullmatch(r"(\d+)'(.)(.+)", said).groups()
    if digits == "0":
        return ()
    if base == "b":
        last = "0" if digits[-1] == "1" else "1"
    elif base == "h":
        last = f"{int(digits[-1], 16) ^ 1:x}" if digits[-1] != "_" else ""
    else:
        last = str(int(digits[-1]) ^ 1) if digits[-1].isdigit() else ""
    return (f"{size}'{base}{digits[:-1]}{last}",) if last else ()


def const_replace(line: str) -> Made:
    """M2: one-bit constants flip, the lowest bit of other literals' last digit flips (of a plain zero not), integers move by one."""
    for m in re.finditer(r"\d+'[bhd][0-9a-fA-F_]+|\b\d+\b", line, re.ASCII):
        for new in _other_constant(m[0]):
            yield _put(line, m, new), f"Replace constant '{m[0]}' with '{new}'"


def slice_move(line: str) -> Made:
    """M4: both ends of a slice move by one: down, only from above 0, then up."""
    for m in re.finditer(r"\[(\d+):(\d+)\]", line):
        hi, lo = int(m[1]), int(m[2])
        for step, said in ((-1, "down"), (1, "up")):
            if step > 0 or lo > 0:
                new = f"[{hi + step}:{lo + step}]"
                yield _put(line, m, new), f"Shift {m[0]} {said} to {new}"


def cond_negate(line: str) -> Made:
    """M5: negations of a name go, then conditions that are one name are negated."""
    for m in re.finditer(r"!(\w+)", line):
        yield _put(line, m, m[1]), f"Remove negation: !{m[1]} → {m[1]}"
    for m in re.finditer(r"if\s*\(\s*(\w+)\s*\)", line):
        yield _put(line, m, f"if (!{m[1]})"), f"Negate condition: if ({m[1]}) → if (!{m[1]})"


def assign_delete(line: str) -> Made:
    """M6."""
    if re.match(r"\s*(assign\s+\w+\s*=|[\w\[\]:]+\s*<=)", line):
        yield f"// MUTANT_DELETED: {line.lstrip()}", "Delete assignment"


def edge_swap(line: str) -> Made:
    """M7: the first edge of each kind turns."""
    for old, new in (("posedge", "negedge"), ("negedge", "posedge")):
        if old in line:
            yield line.replace(old, new, 1), f"Swap {old} → {new}"


def signal_swap(widths: dict[str, int]) -> Callable[[str], Made]:
    """M3: each two signals of equal width that the line holds trade places throughout; widths in their order of declaration.

    Names count wherever their letters stand. Hierarchical names (with a point) take no part; leave clocks and resets out."""
    groups: dict[int, list[str]] = {}
    for name, width in widths.items():
        if "." not in name:
            groups.setdefault(width, []).append(name)

    def swap(line: str) -> Made:
        for names in groups.values():
            there = [n for n in names if n in line]
            for i, a in enumerate(there):
                for b in there[i + 1 :]:
                    new = b.join(part.replace(b, a) for part in line.split(a))
                    if new != line:
                        yield new, f"Swap '{a}' with '{b}'"

    return swap


def _inside(lines: Iterable[str]) -> Iterator[bool]:
    depth = 0
    for line in lines:
        if depth <= 0:
            m = INSTANCE.match(line)
            if not m or m[1] in NO_NAMES or m[2] in NO_NAMES:
                yield False
                continue
            depth = 0
        depth += line.count("(") - line.count(")")
        yield True


def instances(lines: Sequence[str]) -> list[bool]:
    """Which lines of a file belong to an instance of another module, up to the parenthesis that closes it."""
    return list(_inside(lines))


#: The registry.
OPERATORS: dict[str, Callable[[str], Iterator[tuple[str, str]]]] = {
    "OP_REPLACE": op_replace,
    "CONST_REPLACE": const_replace,
    "BITSLICE_MUT": slice_move,
    "COND_NEGATE": cond_negate,
    "ASSIGN_DELETE": assign_delete,
    "SENSITIVITY_MUT": edge_swap,
}


def mutants(lines: DataFrame, source: str, line_no: str, line: str, names: Sequence[str] | None = None, widths: dict[str, int] | None = None, most: int | None = None) -> DataFrame:
    """Source, id (0, 1 ... within the source), operator, line_no, original, mutated, description; equal mutants of a line once;
    with most the first of a source in the order they are made.

    A source's lines are read in their order by one task, as an instance's are known only so; no more than a batch of lines and of
    mutants is held."""
    chosen = [(n, OPERATORS[n]) for n in names or OPERATORS] + ([("SIGNAL_SWAP", signal_swap(widths))] if widths else [])
    schema = pa.schema([("source", pa.string()), ("line_no", pa.int64()), ("operator", pa.string()), ("original", pa.string()), ("mutated", pa.string()), ("description", pa.string()), ("id", pa.int64())])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        lines_ = ((s, no, x or "") for b in batches for s, no, x in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for s, file in groupby(lines_, lambda x: x[0]):
            n, (here, ahead) = 0, tee(file)
            for (_, no, text), instance in zip(here, _inside(x[2] for x in ahead)):
                if instance or SKIP.match(text):
                    continue
                seen: set[str] = set()
                for name, make in chosen:
                    for new, why in make(text):
                        if new not in seen and (most is None or n < most):
                            seen.add(new)
                            yield s, no, name, text, new, why, n
                            n += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = made(batches)
        while rows := list(islice(found, 8192)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    rows = lines.select(F.col(source).cast("string").alias("source"), F.col(line_no).cast("long").alias("line_no"), F.col(line).alias("line"))
    ordered = rows.repartition("source").sortWithinPartitions("source", F.asc_nulls_last("line_no"))
    return ordered.mapInArrow(run, "source string, line_no long, operator string, original string, mutated string, description string, id long")


def evaluate(mutants_: DataFrame, run_one: Callable[[str], str]) -> DataFrame:
    """Status of each mutant by a caller's function of the mutated text; an exception is an error, a TimeoutError a timeout."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def status(text: str) -> str:
            try:
                return run_one(text)
            except TimeoutError:
                return "timeout"
            except Exception:
                return "error"

        for b in batches:
            yield b.assign(status=[status(t) for t in b.mutated])

    schema = ", ".join(f"`{n}` {t}" for n, t in mutants_.dtypes) + ", status string"
    return mutants_.mapInPandas(run, schema)
