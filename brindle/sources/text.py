"""Scans of text, documents, logs, markdown and HTML, and chunkers."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions.text import MODALS, strip


def files(spark: SparkSession, path: str, suffixes: Sequence[str]) -> DataFrame:
    """A1/A3/A4: path, text, modified of all files below path with these suffixes. A file that isn't UTF-8 gets replacement characters."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    keep = found.where(F.lower("path").rlike("(" + "|".join(re.escape(s) for s in suffixes) + ")$"))
    return keep.select("path", F.decode("content", "UTF-8").alias("text"), F.col("modificationTime").alias("modified"))


def context(files_: DataFrame, threshold: int) -> DataFrame:
    """All texts in the order of paths under banners, or null if they are longer together than threshold.

    The total is taken first; only a total within the bound is ever put into one row."""
    total = files_.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("chars"))
    fits = files_.join(F.broadcast(total.where(F.col("chars") <= threshold)), F.lit(True), "inner")
    one = fits.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", "text"))), lambda s: F.concat(F.lit("// file: "), s["path"], F.lit("\n"), s["text"])), "\n").alias("context"), F.count(F.lit(1)).alias("n"))
    return total.crossJoin(one).select("chars", F.when(F.col("n") > 0, F.col("context")).alias("context"))


def staleness(files_: DataFrame) -> DataFrame:
    """The first 16 hex digits of the sha256 of the sorted path:modified lines."""
    lines = F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "path", F.col("modified").cast("string")))), "\n")
    return files_.agg(F.left(F.sha2(lines, 256), F.lit(16)).alias("checksum"))


def stale(sources: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """Sources without an output, or with one that is older."""
    fresh = outputs.select(F.col(key), F.col("modified").alias("__m"))
    return sources.join(fresh, (sources[key] == fresh[key]) & (F.col("__m") >= sources["modified"]), "left_anti")


def windows(df: DataFrame, id_col: str, text: str, size: int, overlap: int) -> DataFrame:
    """Fixed windows of long texts; the last one is that which reaches the end."""
    n = F.char_length(text)
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size - overlap)), lambda s: (s == 0) | (s + overlap < n)))
    rows = df.where(n > 0).select(id_col, text, F.posexplode(starts).alias("chunk_index", "char_start"))
    return rows.select(id_col, "chunk_index", "char_start", F.substring(text, F.col("char_start") + 1, F.lit(size)).alias("chunk"))


def module_chunks(df: DataFrame, id_col: str, text: str, size: int = 8000, overlap: int = 200) -> DataFrame:
    """One chunk for each module, the whole text without any; long ones as windows."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)(\bmodule\b.*?\bendmodule\b)"), F.lit(1))
    parts = df.select(id_col, F.posexplode(F.when(F.size(found) > 0, found).otherwise(F.array(text))).alias("part", "said"))
    parts = parts.withColumn("module", F.nullif(F.regexp_extract("said", r"^module\s+(\w+)", 1), F.lit(""))).withColumn("__k", F.struct(id_col, "part", "module"))
    return windows(parts, "__k", "said", size, overlap).select(f"__k.{id_col}", "__k.part", "__k.module", "chunk_index", "char_start", "chunk")


def snapped(text: str, size: int, overlap: int) -> Iterator[tuple[int, int, str]]:
    """H30 for one text: (index, start, chunk); windows end at a paragraph, else at a line, that leaves room to go on."""
    start = index = 0
    while start < len(text):
        end = min(len(text), start + size)
        if end < len(text):
            for mark in ("\n\n", "\n"):
                at = text.rfind(mark, start, end)
                if at > start + overlap + 1:
                    end = at
                    break
        if text[start:end].strip():
            yield index, start, text[start:end].strip()
            index += 1
        if end >= len(text):
            return
        start = max(end - overlap, start + 1)


def doc_chunks(df: DataFrame, id_col: str, text: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """The start of each window depends on where the last one ended, so each text is walked by itself."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, t in zip(b.id, b.text):
                rows = [(i, *c) for c in snapped(t or "", size, overlap)]
                if rows:
                    yield pd.DataFrame(rows, columns=["id", "chunk_index", "char_start", "chunk"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return rows.mapInPandas(run, f"id {dict(rows.dtypes)['id']}, chunk_index int, char_start int, chunk string").withColumnRenamed("id", id_col)


def sentences(text: str) -> Iterator[tuple[int, str]]:
    """H27 for one text: (line, sentence). Fence lines go; a sentence ends with a terminator or before a blank line. The line is
    that on which the sentence before it ended (the first for the first), or the one behind the blank line."""
    held, line = [], 1
    for no, said in enumerate(map(str.strip, text.splitlines()), 1):
        if said.startswith(("```", "~~~")):
            continue
        for part in filter(None, re.split(r"(?<=[.!?])\s+", said)):
            held.append(part)
            if part[-1] in ".!?":
                yield line, " ".join(held)
                held, line = [], no
        if held and not said:
            yield line, " ".join(held)
            held, line = [], no + 1
    if held:
        yield line, " ".join(held)


def documented(df: DataFrame, id_col: str, text: str, phrases: Sequence[str] = MODALS, most: int | None = None, size: int = 240) -> DataFrame:
    """Sentences with a modal phrase, once for each phrase and first 80 characters, the first of all in the order of (id, line).
    All of them; with most, only so many in that order."""
    from brindle.functions.text import modal

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a text and some sentences at a time, however many a batch holds
        for b in batches:
            found = ((i.as_py(), k, *s) for i, t in zip(*b.columns, strict=True) for k, s in enumerate(sentences(t.as_py() or "")))
            while rows := list(islice(found, 4096)):
                kinds = (b.schema.field(0).type, pa.int32(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["id", "k", "source_line", "sentence"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    found = rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, k int, source_line int, sentence string")
    found = found.withColumn("modal", modal(F.col("sentence"), phrases)).where("modal IS NOT NULL").withColumn("short", F.left("sentence", F.lit(80)))
    first = found.groupBy("modal", "short").agg(F.min(F.struct("id", "k", "source_line", F.left("sentence", F.lit(size)).alias("sentence"))).alias("s"))
    first = first if most is None else first.orderBy("s.id", "s.k").limit(most)
    return first.select(F.col("s.id").alias(id_col), "s.source_line", "modal", "s.sentence")


def log_counts(lines: DataFrame, line: str, rules: Sequence[tuple[str, str]], by: Sequence[str] = ()) -> DataFrame:
    """For each rule (label, pattern with one group) the sum of the captured numbers; rules without a hit count 0. One scan for all rules."""
    sums = [F.coalesce(F.sum(F.aggregate(F.regexp_extract_all(line, F.lit(p), F.lit(1)), F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x.try_cast("long"), F.lit(0).cast("long")))), F.lit(0)).alias(f"r{i}") for i, (_, p) in enumerate(rules)]
    one = lines.groupBy(*by).agg(*sums) if by else lines.agg(*sums)
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("label"), F.col(f"r{i}").alias("total")) for i, (n, _) in enumerate(rules)]))
    return one.select(*by, rows.alias("r")).select(*by, "r.label", "r.total")


def last_number(lines: DataFrame, line: str, order: str, pattern: str, by: Sequence[str] = ()) -> DataFrame:
    """The number in the last matching line, -1 without one."""
    n = F.regexp_extract(line, pattern, 1).try_cast("long")
    value = F.coalesce(F.max_by(n, F.when(n.isNotNull(), F.col(order))), F.lit(-1)).alias("value")
    return lines.groupBy(*by).agg(value) if by else lines.agg(value)


def matching_lines(text: Column, pattern: str = r"(?m)^\s*assert\b") -> Column:
    """A13."""
    return F.regexp_count(text, F.lit(pattern))


def run_paths(df: DataFrame, path: str, methods: Sequence[str] = ()) -> DataFrame:
    """Method, design, run of .../<X>/<Y>/run_NN/file; where Y is a known method, X is the design. With one level less
    the method is the root's name."""
    parts = F.split(path, "/")
    run = F.element_at(parts, -2)
    x, y = F.try_element_at(parts, F.lit(-4)), F.try_element_at(parts, F.lit(-3))
    swapped = y.isin(*methods) if methods else F.lit(False)
    return df.where(run.rlike("^run_?[0-9]+$")).withColumns({"method": F.when(swapped, y).otherwise(x), "design": F.when(swapped, x).otherwise(y), "run": F.regexp_extract(run, "([0-9]+)$", 1)})


def sections(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """Number, title and body of `### CWE-N (Title)` sections; a body ends at the next heading of two or three marks."""
    found = F.regexp_extract_all(text, F.lit(r"(?ms)(^###\s+CWE-\d+[^\n]*\n.*?)(?=^##|\z)"), F.lit(1))
    rows = df.select(id_col, F.posexplode(found).alias("pos", "s"))
    head = r"^###\s+CWE-(\d+)\s*:?\s*\(?([^)\n]*)\)?"
    return rows.select(id_col, "pos", F.regexp_extract("s", head, 1).cast("int").alias("cwe_id"), F.trim(F.regexp_extract("s", head, 2)).alias("title"), strip(F.col("s"), r"^[^\n]*\n", r"^\s+|\s+$").alias("body"))


class _Markdown(HTMLParser):
    """Text of a page as markdown: headings, list items and links; skipped elements leave nothing."""

    VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

    def __init__(self, skip_tags: frozenset, skip_names: re.Pattern):
        super().__init__(convert_charrefs=True)
        self.skip_tags, self.skip_names, self.out, self.stack = skip_tags, skip_names, [], []

    def handle_starttag(self, tag, attrs):
        names = " ".join(v for k, v in attrs if k in ("class", "id") and v)
        skip = bool(self.stack and self.stack[-1][1]) or tag in self.skip_tags or bool(names and self.skip_names.search(names))
        if not skip:
            if re.fullmatch("h[1-6]", tag):
                self.out.append(f"\n\n{'#' * int(tag[1])} ")
            elif tag == "li":
                self.out.append("\n- ")
            elif tag in ("p", "div", "section", "article", "table", "ul", "ol", "tr", "br", "body", "pre"):
                self.out.append("\n" if tag in ("br", "tr") else "\n\n")
        if tag not in self.VOID:
            self.stack.append((tag, skip))

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.stack):
            while self.stack.pop()[0] != tag:
                pass
            if re.fullmatch("h[1-6]", tag) or tag in ("p", "div"):
                self.out.append("\n\n")

    def handle_data(self, data):
        if not (self.stack and self.stack[-1][1]):
            self.out.append(re.sub(r"[ \t\r\n]+", " ", data))


# What a page's text leaves out.
SKIP_TAGS = ("script", "style", "nav", "footer", "header", "noscript", "iframe", "svg", "form", "head")
SKIP_NAMES = ("nav", "sidebar", "footer", "header", "menu", "breadcrumb", "advert", "ads", "cookie", "toc")


def markdown(html: str | None, skip_tags: Sequence[str] = SKIP_TAGS, skip_names: Sequence[str] = SKIP_NAMES) -> str:
    """A5/H42 for one page. Names are found anywhere in class and id, so `ads` also leaves out `loads`."""
    parser = _Markdown(frozenset(skip_tags), re.compile("|".join(skip_names), re.I) if skip_names else re.compile(r"(?!)"))
    parser.feed(html or "")
    parser.close()
    lines = [line.strip() for line in "".join(parser.out).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def html_text(df: DataFrame, id_col: str, html: str, skip_tags: Sequence[str] = SKIP_TAGS, skip_names: Sequence[str] = SKIP_NAMES) -> DataFrame:
    """A5: id, text of each page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b.id, "text": [markdown(h, skip_tags, skip_names) for h in b.html]})

    rows = df.select(F.col(id_col).alias("id"), F.col(html).alias("html"))
    return rows.mapInPandas(run, f"id {dict(rows.dtypes)['id']}, text string").withColumnRenamed("id", id_col)


def html_strip(html: Column) -> Column:
    """H42 without a parser: scripts, styles, comments and tags off, white space collapsed. Stays in the JVM."""
    bare = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def split_assertions(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """Text to rows: pos, comment, assertion. A comment belongs to the assertion in the line below it."""
    rows = df.select(id_col, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    w = Window.partitionBy(id_col).orderBy("pos")
    before = F.lag("line").over(w)
    rows = rows.withColumn("comment", F.when(F.trim(before).startswith("//"), F.trim(before)))
    return rows.where(F.trim("line").rlike(r"^assert\b")).select(id_col, "pos", "comment", F.trim("line").alias("assertion"))


def join_assertions(rows: DataFrame, id_col: str) -> DataFrame:
    """Rows back to one text, in their order."""
    said = F.when(F.col("comment").isNull(), F.col("assertion")).otherwise(F.concat_ws("\n", "comment", "assertion"))
    listed = F.array_sort(F.collect_list(F.struct(F.col("pos").alias("p"), said.alias("s"))))
    return rows.groupBy(id_col).agg(F.array_join(F.transform(listed, lambda x: x["s"]), "\n").alias("text"))
