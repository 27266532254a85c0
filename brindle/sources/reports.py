"""Report scans and sinks: JSON and CSV in, flat tables out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENS = "config STRING, design STRING, rtl_dir STRING, model STRING, backend STRING, naive_baseline BOOLEAN, llm_calls BIGINT, prompt_tokens BIGINT, completion_tokens BIGINT, total_tokens BIGINT, final_assertions BIGINT, tokens_per_assertion DOUBLE, elapsed_sec DOUBLE"


def token_summaries(spark: SparkSession, path: str) -> DataFrame:
    """One row for each JSON file; a bad file or a missing number counts 0."""
    rows = spark.read.schema(TOKENS + ", _corrupt_record STRING").json(path, multiLine=True, mode="PERMISSIVE", recursiveFileLookup=True)
    numbers = ["llm_calls", "prompt_tokens", "completion_tokens", "total_tokens", "final_assertions"]
    return rows.withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in numbers})


def csv_strings(spark: SparkSession, path: str) -> DataFrame:
    """Every column a string."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')


def kind_of(report: Column) -> Column:
    """Which report a JSON text is, by its keys."""
    v = F.try_parse_json(report)
    has = lambda p: F.try_variant_get(v, p, "variant").isNotNull()
    return F.when(has("$.summary_by_operator") | has("$.metadata.mutation_score"), "mutation").when(has("$.iterations"), "lint").when(has("$.steps"), "trace").otherwise("unknown")


def failures_in(report: Column) -> Column:
    """How many failures a JSON text lists: a list, a named list, or an object's members; 0 otherwise."""
    v = F.try_parse_json(report)
    size = lambda c, kind: F.size(F.from_json(c, kind))
    kind = F.schema_of_variant(v)
    named = F.get_json_object(report, "$.failures")
    return F.when(kind.startswith("ARRAY"), size(report, "array<string>")).when(named.isNotNull(), size(named, "array<string>")).when(kind.startswith("OBJECT"), size(report, "map<string,string>")).otherwise(0)


LINT = "struct<iterations:array<struct<iteration:int,timestamp:string,total_assertions:int,passed:int,failed:int,failures:array<struct<`index`:int,assertion:string,comment:string,error:string>>>>,final_status:string,total_refinement_iterations:int>"


def lint_tables(reports: DataFrame, source: str, report: str) -> tuple[DataFrame, DataFrame]:
    """Summary rows and failure rows of lint reports; line breaks become spaces, long texts are cut."""
    rows = reports.select(source, F.explode_outer(F.from_json(report, LINT)["iterations"]).alias("i")).where("i IS NOT NULL")
    summary = rows.select(source, "i.iteration", "i.timestamp", "i.total_assertions", "i.passed", "i.failed")
    cut = lambda c, n: F.left(F.regexp_replace(c, "\n", " "), F.lit(n))
    each = rows.select(source, "i.iteration", F.explode("i.failures").alias("f"))
    return summary, each.select(source, "iteration", "f.index", cut("f.assertion", 200).alias("assertion"), cut("f.error", 200).alias("error"))


MUTATION = "struct<metadata:map<string,string>,summary_by_operator:map<string,struct<total:int,killed:int,survived:int,stillborn:int>>>"


def mutation_operators(reports: DataFrame, source: str, report: str) -> DataFrame:
    """One row for each operator of a mutation report, with its kill rate."""
    rows = reports.select(source, F.explode(F.from_json(report, MUTATION)["summary_by_operator"]).alias("operator", "c"))
    base = F.col("c.total") - F.col("c.stillborn")
    return rows.select(source, "operator", "c.*", F.when(base > 0, F.format_string("%.1f%%", 100 * F.col("c.killed") / base)).otherwise("N/A").alias("kill_rate"))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; nulls become dashes, arrays sorted texts."""
    flat = [F.coalesce((F.array_join(F.sort_array(c), ";") if t.startswith("array") else F.col(c).cast("string")), F.lit("—")).alias(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; arrays are sets, so they are sorted."""
    df.select(*[F.sort_array(c).alias(c) if t.startswith("array<") and "struct" not in t else F.col(c) for c, t in df.dtypes]).write.mode("overwrite").json(path)


def write_trace(steps: DataFrame, path: str) -> None:
    """The steps of a run twice, from one table: whole as JSON lines, and as a CSV with a header, one line for each step in their order.

    steps: no, phase, step, timestamp, output, tools (array), assertions, prompt_tokens, completion_tokens, notes; null counts are 0."""
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    steps.write.mode("overwrite").json(f"{path}/trace.json")
    row = steps.select("no", "phase", "step", "timestamp", F.char_length(F.coalesce("output", F.lit(""))).alias("output_length"), F.size(F.coalesce("tools", F.array().cast("array<string>"))).alias("n_tools"), F.coalesce(F.nullif(F.array_join("tools", ", "), F.lit("")), F.lit("-")).alias("tools"), count("assertions").alias("assertions"), count("prompt_tokens").alias("prompt_tokens"), count("completion_tokens").alias("completion_tokens"), (count("prompt_tokens") + count("completion_tokens")).alias("total_tokens"), "notes", F.translate(F.substring(F.coalesce("output", F.lit("")), 1, 150), "\n", " ").alias("preview"))
    row.orderBy("no").write.mode("overwrite").csv(f"{path}/trace.csv", header=True)


def write_index(vectors: DataFrame, postings: DataFrame, path: str) -> None:
    """Vectors and postings; postings lie by term, so a query reads the row groups of its terms."""
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    postings.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")


def attributed(names: DataFrame, ids: str, owners: DataFrame, pos: str) -> DataFrame:
    """Rows of each module, by the first identifier in the text that has one (smallest module on ties)."""
    each = names.select(pos, F.posexplode(ids).alias("k", "name")).join(owners.select("name", "module"), "name")
    first = each.groupBy(pos).agg(F.min(F.struct("k", "module")).alias("m"))
    return first.groupBy(F.col("m.module").alias("module")).agg(F.count(F.lit(1)).alias("n"))


def netlist_tables(spark: SparkSession, netlists: DataFrame, text: str) -> dict[str, DataFrame]:
    """Ports, cells and module edges of netlist JSON."""
    kind = "struct<modules:map<string,struct<ports:map<string,struct<direction:string,bits:array<string>>>,cells:map<string,struct<type:string>>>>>"
    modules = netlists.select(F.explode(F.from_json(text, kind)["modules"]).alias("module", "m"))
    ports = modules.select("module", F.explode("m.ports").alias("name", "p")).select("module", "name", "p.direction", F.size("p.bits").alias("width"))
    cells = modules.select("module", F.explode("m.cells").alias("cell", "c")).select("module", "cell", "c.type")
    edges = cells.join(modules.select(F.col("module").alias("type")), "type", "left_semi").select(F.col("module").alias("parent"), F.col("type").alias("child")).distinct()
    return {"ports": ports, "cells": cells, "edges": edges}


def peaks(samples: DataFrame, key: str, value: str, at: str) -> DataFrame:
    """The largest value of each key and when it was first reached."""
    return samples.groupBy(key).agg(F.max(value).alias("peak"), F.min_by(at, F.struct(-F.col(value), F.col(at))).alias("at"))


def columns_of(df: DataFrame, caps: dict[str, int]) -> DataFrame:
    """Text columns cut to their caps."""
    return df.withColumns({c: F.left(c, F.lit(n)) for c, n in caps.items()})


def discovered(logs: DataFrame, file: str, no: str, line: str, summaries: DataFrame, name: str) -> DataFrame:
    """The first line of each log that names an existing summary."""
    said = logs.where(~F.col(file).contains("batch")).withColumn(name, F.regexp_extract(line, r"([\w.-]+_summary\.json)", 1)).where(f"`{name}` <> ''")
    known = said.join(summaries.select(name).distinct(), name, "left_semi")
    return known.groupBy(file).agg(F.min_by(name, no).alias(name))


def collected(base: DataFrame, key: str, parts: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Numbers of several tables side by side, -1 where one is missing."""
    for name, part in parts:
        base = base.join(part.select(key, F.col("value").alias(name)), key, "left").fillna(-1, [name])
    return base
