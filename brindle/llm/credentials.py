"""Secret scan with multipart credential linking.

Strong patterns (an assignment to a secret's name, an access key id, a long hexadecimal run) are reported wherever they
stand. Weak candidates prove nothing alone: an account name, an opaque mixed token, an endpoint with a host. They are
reported only where complementary parts co-occur: an identifier or an endpoint in the scope of a secret, or a secret in that
of an identifier or an endpoint. Scopes are the intervals between blank lines, however long.

The link is an interval join of the parts of a document with its scopes: a part's scope is the number of blank lines before
it, and what roles a scope holds is a window over its parts. So no pairs are made. Texts are scanned once and stay in their stage; only their parts are
shuffled, after equal (id, text) rows have been counted together.

All is DataFrame expressions. Spans are code points, end exclusive. The place of a match is found from the pieces between
the matches, as split() and regexp_extract_all() step through a text alike.

Defined results: a null or empty text has no spans; repeated rows are reported each; null ids are an id of their own; an
empty table gives no rows; other columns take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.store import fresh

#: kind, pattern, role, strong. Kinds in the order of reports. Each pattern's matches are leftmost and don't overlap.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
ACCOUNT = r"""(?i:access_?key_?id|client_?id|account|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
OPAQUE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]*[0-9])(?=[A-Za-z0-9+/_=-]*[A-Z])(?=[A-Za-z0-9+/_=-]*[a-z])[A-Za-z0-9+/_=-]{20,}"
ENDPOINT = r"(?:https?|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?|s3)://[A-Za-z0-9._~:@%-]+"
KINDS = ("assign", "access", "hex", "account", "opaque", "endpoint")
STRONG, SECRETS = KINDS[:3], ("assign", "hex", "opaque")


def _spans(text: Column, rank: int, pattern: str, keep) -> Column:
    """array<struct<start, rank, end>> of the pattern's matches that keep(match) accepts."""
    empty = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    lengths = F.zip_with(gaps, hits, lambda g, h: F.struct(F.char_length(g).alias("gap"), F.char_length(h).alias("len"), keep(h).alias("ok")))
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(a: Column, x: Column) -> Column:
        from_ = a["at"] + x["gap"]
        to = from_ + x["len"]
        span = F.array(F.struct(from_.alias("start"), F.lit(rank).alias("rank"), to.alias("end")))
        # the last gap has no match behind it: len is null
        return F.struct(F.coalesce(to, from_).alias("at"), F.when(x["ok"], F.concat(a["out"], span)).otherwise(a["out"]).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(lengths, start, step)["out"]).otherwise(empty)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, h (the text's hash), spans: array<struct<start, rank, end>> in order of start and kind; one row for each row of df."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), text.alias("text"))
    t, yes = F.col("text"), lambda h: h.isNotNull()
    found = F.concat(
        _spans(t, 0, ASSIGN, lambda h: F.char_length(F.regexp_extract(h, ASSIGN, 1)) >= 6),
        _spans(t, 1, ACCESS, lambda h: F.char_length(h) >= 20),
        *[_spans(t, i, p, yes) for i, p in ((2, HEX), (3, ACCOUNT), (4, OPAQUE), (5, ENDPOINT))],
    )
    rows = rows.select("id", F.xxhash64("text").alias("h"), F.octet_length("text").alias("size"), found.alias("parts"), F.when(F.size(found) > 0, _blank_lines(t)).otherwise(F.array().cast("array<int>")).alias("blanks"))
    key = ["id", "h", "size"]
    rows = rows.groupBy(*key).agg(F.first("parts").alias("parts"), F.first("blanks").alias("blanks"), F.count(F.lit(1)).alias("copies"))
    parts = rows.select(*key, "copies", "blanks", F.explode_outer("parts").alias("p")).select(*key, "copies", F.col("p.start").alias("start"), F.col("p.rank").alias("rank"), F.col("p.end").alias("end"), F.size(F.filter("blanks", lambda b: b < F.col("p.start"))).alias("scope"))
    linked = _linked(parts, key)
    span = F.when(linked["reported"], F.struct("start", "rank", "end"))
    whole = linked.groupBy(*key, "copies").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    return whole.select(F.col("id").alias(id_col), "h", "spans", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).drop("copy")


def _blank_lines(text: Column) -> Column:
    """The places of blank lines, which part the scopes."""
    gaps = F.split(text, "\n(?=[\x20\t\r]*\n)", -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda a, g: F.struct((a["at"] + F.char_length(g) + 1).alias("at"), F.concat(a["out"], F.array(a["at"] + F.char_length(g))).alias("out"))
    return F.aggregate(F.slice(gaps, 1, F.size(gaps) - 1), start, step)["out"]


def _linked(parts: DataFrame, key: list[str]) -> DataFrame:
    """parts with reported: strong, or weak with a complementary part in the same scope."""
    secret = F.col("rank").isin(*[KINDS.index(k) for k in SECRETS])
    scope = Window.partitionBy(*key, "scope")
    has = lambda role: F.coalesce(F.max(role).over(scope), F.lit(False))
    complement = F.when(secret, has(~secret)).otherwise(has(secret))
    return parts.withColumn("reported", F.col("rank").isNotNull() & (F.col("rank").isin(*range(len(STRONG))) | complement))


def said(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_assign, n_access, n_hex, n_weak, base_sha256, spans."""
    found = scan(df, id_col, text_col)
    count = lambda test: F.size(F.filter("spans", lambda s: test(s["rank"]))).cast("long")
    base = F.filter("spans", lambda s: s["rank"] < len(STRONG))
    return found.select(id_col, *[count(lambda r, i=i: r == i).alias(f"n_{k}") for i, k in enumerate(STRONG)], count(lambda r: r >= len(STRONG)).alias("n_weak"), F.sha2(F.encode(said(base), "UTF-8"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def redact(df: DataFrame, mark: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with each reported span of its text replaced by mark. Overlapping spans are one; null texts stay null."""
    id_, h, spans = fresh(df, "own_id", "own_h", "own_spans")
    found = scan(df, id_col, text_col).where(F.size("spans") > 0).select(F.col(id_col).alias(id_), F.col("h").alias(h), F.col("spans").alias(spans)).dropDuplicates([id_, h])
    joined = df.join(found, F.col(id_col).eqNullSafe(F.col(id_)) & (F.xxhash64(F.col(text_col)) == F.col(h)), "left")
    text = F.col(text_col)
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        new = s["start"] >= a["at"]
        gap = F.substring(text, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0)))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(new, F.concat(a["out"], gap, F.lit(mark))).otherwise(a["out"]).alias("out"))

    done = F.aggregate(spans, begin, step)
    cleaned = F.when(F.col(spans).isNull(), text).otherwise(F.concat(done["out"], F.substring(text, done["at"] + 1, F.char_length(text))))
    return joined.withColumn(text_col, cleaned).select(*df.columns)
