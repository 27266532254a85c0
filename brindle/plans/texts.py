"""Queries of text rows: dedup, subsumption, coverage, retrieval, clusters, scans, mutations, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import text as X
from brindle.operators import clean, cluster, compare, coverage, dedup, mutate, retrieval
from brindle.plans.tables import ASSERTIONS, assertions, t
from brindle.sources import reports, text as S

WORD = "[a-z0-9]+"


def _tokens(df, id_col, text="text"):
    return df.select(id_col, F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1)).alias("tokens"))


def keep_first_exact(spark, d):
    return dedup.keep_first_ids(t(spark, d, "documents"), X.exact_signature(F.col("text")), "doc_id")


def keep_first_normalised(spark, d):
    return dedup.keep_first_ids(t(spark, d, "documents"), X.normal_line(F.col("text")), "doc_id")


def canonical_dedup(spark, d):
    rows = assertions(spark, d)
    return dedup.keep_first(rows.withColumn("form", X.canonical(F.col("assertion"))), F.col("form"), ["pos"]).select("pos", "form")


def keep_first_capped(spark, d):
    return dedup.keep_first_capped(t(spark, d, "part"), [F.col("p_type"), F.left("p_name", F.lit(5))], ["p_partkey"], 60).select("p_partkey", "p_type")


def subsumption(spark, d):
    names = F.when(F.col("l_linenumber") == 1, F.array().cast("array<string>")).otherwise(F.sort_array(F.array_distinct(F.array_compact(F.array(F.when(F.col("l_discount") > 0.03, "disc"), F.when(F.col("l_tax") > 0.03, "tax"), F.when(F.col("l_quantity") > 20, "qty"))))))
    rows = t(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), (F.col("l_partkey") % 400).cast("string").alias("lhs"), F.col("l_returnflag").alias("rhs"), names.alias("names"))
    return dedup.subsumed(rows.where("l_orderkey is not null") if "l_orderkey" in rows.columns else rows, "pos", "lhs", "rhs", "names").select("pos", "lhs", "rhs", F.array_join("names", ",").alias("names"))


def cap_per_group(spark, d):
    return dedup.capped(t(spark, d, "part"), "p_brand", [F.desc("p_retailprice"), "p_partkey"], 3).select("p_brand", "p_partkey", "rn", "group_size", "n_more")


def small_groups(spark, d):
    return dedup.small_groups(t(spark, d, "orders"), "o_custkey", 8).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


def merged_sources(spark, d):
    c = t(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("pos"))
    s = t(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("pos"))
    return dedup.merged(s, c, key=F.col("k"), order="pos")


def set_sizes(spark, d):
    return dedup.set_sizes(t(spark, d, "orders").select(F.col("o_custkey").alias("k")), t(spark, d, "customer").select(F.col("c_custkey").alias("k")), "k")


def coverage_overlap(spark, d):
    return coverage.overlap(_tokens(t(spark, d, "benchmark"), "item_id"), "item_id", "tokens", _tokens(t(spark, d, "documents"), "doc_id"), "doc_id", "tokens")


def coverage_subset(spark, d):
    return coverage.subset(_tokens(t(spark, d, "benchmark"), "item_id"), "item_id", "tokens", _tokens(t(spark, d, "documents"), "doc_id"), "tokens")


def majority_unknown(spark, d):
    known = _tokens(t(spark, d, "benchmark"), "item_id").select(F.explode("tokens").alias("w"))
    return coverage.majority_known(_tokens(t(spark, d, "documents"), "doc_id"), "doc_id", "tokens", known, "w")


def unknown_names(spark, d):
    known = _tokens(t(spark, d, "documents").where("lang = 'en'"), "doc_id").select(F.explode("tokens").alias("w"))
    return coverage.unknown_names(_tokens(t(spark, d, "documents").where("lang <> 'en'"), "doc_id"), "tokens", known, "w")


def _bm25(spark, d):
    docs = _tokens(t(spark, d, "documents"), "doc_id")
    n = docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("tokens")).alias("mean_length"))
    queries = _tokens(t(spark, d, "benchmark"), "item_id").select(F.col("item_id").alias("query"), F.explode(F.array_distinct("tokens")).alias("term"))
    return retrieval.bm25(docs, "doc_id", "tokens", queries, n)


def out_of_scope(spark, d):
    names = _tokens(t(spark, d, "benchmark"), "item_id").select(F.explode("tokens").alias("w"))
    return coverage.out_of_scope(_tokens(t(spark, d, "documents"), "doc_id"), "doc_id", "tokens", names, "w", ("^[0-9]+$",)).select("doc_id")


def _hundredths(e):
    """Every vector whose id is divisible by 100, as a query."""
    return e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))


def dense_topk(spark, d):
    e = t(spark, d, "embeddings")
    return retrieval.dense_topk(_hundredths(e), e, 10).withColumn("score", F.round("score", 6))


def bm25_topk(spark, d):
    return retrieval.ranked(_bm25(spark, d).withColumn("score", F.round("score", 6)), 10, "doc_id")


def rrf_fusion(spark, d):
    """Queries: every benchmark item, and every vector whose id is divisible by 100; a query of one side alone has that side's ranks."""
    sparse = retrieval.ranked(_bm25(spark, d).withColumn("score", F.round("score", 6)), 20, "doc_id")
    e = t(spark, d, "embeddings")
    items = e.join(t(spark, d, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    dense = retrieval.dense_topk(items.unionByName(_hundredths(e)).dropDuplicates(["query"]), e.withColumnRenamed("vec_id", "doc_id"), 20, "doc_id")
    return retrieval.fuse(dense, sparse, 10, "doc_id").withColumn("score", F.round("score", 9))


def two_stage_retrieval(spark, d):
    e = t(spark, d, "embeddings")
    hits = retrieval.dense_topk(_hundredths(e), e, 40).join(e.select("vec_id", "label"), "vec_id")
    return retrieval.two_stage(hits, retrieval.top_groups(hits, "label", 3, "vec_id"), 10, "vec_id", "label").select("query", "vec_id", "label", "place", "filled")


def suffix_pairs(spark, d):
    n = F.col("p_partkey")
    end = F.when(n % 3 == 0, "_valid").when(n % 3 == 1, "_ready").otherwise("_vld")
    names = t(spark, d, "part").select(F.concat(F.lit("sig"), (F.floor(n / 4)).cast("string"), end).alias("name"))
    return compare.suffix_partners(names, "name", [("_valid", "_ready"), ("_vld", "_rdy"), ("d", "y")])


def glob_hints(spark, d):
    globs = spark.sql("SELECT * FROM VALUES ('a', 0, '*small*'), ('a', 1, '*1?'), ('b', 0, 'BRAND#3*') AS t(`group`, pos, pattern)")
    keys = t(spark, d, "part").select(F.explode(F.array("p_brand", "p_type")).alias("key")).distinct()
    return compare.glob_matches(globs, "pattern", keys, "key").select(F.col("group").alias("grp"), "key", "pos", "rn")


def template_cluster(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_mktsegment", F.concat(F.lit("acct_"), F.col("c_custkey").cast("string"), F.lit(" == seg["), F.col("c_nationkey").cast("string"), F.lit("]")).alias("s"))
    return cluster.by_template(c, "c_custkey", F.col("c_mktsegment"), "s")


def slot_fit(spark, d):
    c = t(spark, d, "customer").select("c_nationkey", F.col("c_custkey").alias("x"))
    x = F.col("x")
    shapes = [x + 5, x * 8 - 3, F.shiftright(x, 3) + 1, x * x, 7 - x, x * 128 + 1, x * 5, F.lit(9).cast("long"), F.shiftright(x, 7) * -8 + 2]
    y = F.get(F.array(*shapes), (F.col("c_nationkey") % len(shapes)).cast("int"))
    return cluster.slot_fit(c.withColumn("y", y), ["c_nationkey"], "x", "y")


def value_cluster(spark, d):
    n = F.col("p_size")
    v = F.when(n % 5 == 0, "8'h00").when(n % 5 == 1, "4'b1111").when(n % 5 == 2, "8'hff").when(n % 5 == 3, F.concat(F.lit("8'h"), (n % 10).cast("string"))).otherwise("reg_q")
    return cluster.by_constant(t(spark, d, "part").withColumn("v", v), ["p_brand"], "v", "p_partkey")


def clean_counts(spark, d):
    rows = assertions(spark, d).where("assertion LIKE 'assert%'").withColumn("comment", F.lit(None).cast("string"))
    return clean.counted(rows)


def mutation_rows(spark, d):
    n, size = F.col("p_partkey") % 5, F.col("p_size")
    line = (
        F.when(n == 0, F.concat(F.lit("assign q_"), size.cast("string"), F.lit(" = (a[7:0] == 8'h1"), (size % 10).cast("string"), F.lit(") && b;")))
        .when(n == 1, F.concat(F.lit("  if (!busy) y <= x ^ 4'd"), (size % 8).cast("string"), F.lit(";")))
        .when(n == 2, "always @(posedge clk) if (en) z <= 1'b0;")
        .when(n == 3, "wire w = a && b;")
        .otherwise("sub u1 (a && b);")
    )
    return mutate.mutants(t(spark, d, "part").select((F.col("p_partkey") % 50).alias("f"), F.col("p_partkey").alias("n"), line.alias("l")), "f", "n", "l")


def fixed_windows(spark, d):
    made = S.windows(t(spark, d, "documents"), "doc_id", "text", 1000, 200)
    return made.select("doc_id", "chunk_index", "char_start", F.char_length("chunk").alias("n"), F.md5(F.encode("chunk", "UTF-8")).alias("digest"))


def doc_chunks(spark, d):
    return S.doc_chunks(t(spark, d, "documents"), "doc_id", "text")


def sentence_props(spark, d):
    return S.documented(t(spark, d, "documents"), "doc_id", "text", ("the", "mit", "les", "para"))


def html_text(spark, d):
    return S.html_text(t(spark, d, "pages"), "page_id", "html")


def html_strip(spark, d):
    return t(spark, d, "pages").select("page_id", F.md5(F.encode(S.html_strip(F.col("html")), "UTF-8")).alias("digest"))


def log_counts(spark, d):
    lines = t(spark, d, "documents").select("text")
    return S.log_counts(lines, "text", [("versions", r"version (\d+)"), ("numbers", r"\b(\d{1,6})\b"), ("none", r"zzz(\d+)zzz")])


def last_numbers(spark, d):
    return S.last_number(t(spark, d, "events"), "props", "event_id", r"(\d+)", ["user_id"])


def url_parts(spark, d):
    p = t(spark, d, "pages")
    parts = F.split("url", "/")
    return p.select("page_id", F.element_at(parts, 3).alias("host"), F.element_at(parts, -1).alias("leaf"), F.size(parts).alias("n_parts"))


def tag_split(spark, d):
    tag = F.concat_ws("_", F.col("p_brand"), F.col("p_type"))
    return t(spark, d, "part").select("p_partkey", X.split_tag(tag)["name"].alias("name"), X.split_tag(tag)["variant"].alias("variant"))


def slugs(spark, d):
    return t(spark, d, "part").select("p_partkey", X.slug(F.concat_ws(" ", "p_name", "p_type"), 20).alias("slug"), X.token_estimate(F.col("p_name")).alias("tokens"))


def identifier_counts(spark, d):
    ids = assertions(spark, d).select("pos", F.explode(X.idents(F.col("assertion"))).alias("name"))
    return ids.groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name")


def implication_parts(spark, d):
    return assertions(spark, d).select("pos", clean.sides(F.col("assertion"))["condition"].alias("condition"), clean.sides(F.col("assertion"))["claim"].alias("claim"))


def module_attribution(spark, d):
    rows = _tokens(t(spark, d, "documents"), "doc_id")
    owners = _tokens(t(spark, d, "benchmark"), "item_id").select(F.explode(F.array_distinct("tokens")).alias("name"), F.col("item_id").alias("module")).groupBy("name").agg(F.min("module").alias("module"))
    return reports.attributed(rows, "tokens", owners, "doc_id")


def peak_values(spark, d):
    return reports.peaks(t(spark, d, "events"), "user_id", "value", "event_id")


def flag_labels(spark, d):
    lab = t(spark, d, "labels").join(t(spark, d, "documents"), "doc_id")
    return lab.groupBy("lang", "quality", "toxic").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("text").contains(" | ")).alias("n_piped"), F.sum("n_chars").alias("chars"))


QUERIES = {f.__name__: f for f in (keep_first_exact, keep_first_normalised, canonical_dedup, keep_first_capped, subsumption, cap_per_group, small_groups, merged_sources, set_sizes, coverage_overlap, coverage_subset, majority_unknown, unknown_names, out_of_scope, dense_topk, bm25_topk, rrf_fusion, two_stage_retrieval, suffix_pairs, glob_hints, template_cluster, slot_fit, value_cluster, clean_counts, mutation_rows, fixed_windows, doc_chunks, sentence_props, html_text, html_strip, log_counts, last_numbers, url_parts, tag_split, slugs, identifier_counts, implication_parts, module_attribution, peak_values, flag_labels)}

_TOK = "regexp_extract_all(lower(text), '[a-z0-9]+')"
_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_BM = f"""docs AS (SELECT doc_id, {_TOK} AS w FROM documents), st AS (SELECT count(*) AS n, avg(len(w)) AS al FROM docs),
 p AS (SELECT doc_id, term, count(*) AS tf, any_value(l) AS l FROM (SELECT doc_id, len(w) AS l, unnest(w) AS term FROM docs) GROUP BY 1, 2),
 df AS (SELECT term, count(*) AS df FROM p GROUP BY 1), raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM df, st),
 idf AS (SELECT term, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
 qt AS (SELECT DISTINCT item_id AS query, unnest({_TOK}) AS term FROM benchmark),
 bm AS (SELECT query, doc_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / al))), 6) AS score FROM qt JOIN p USING (term) JOIN idf USING (term), st GROUP BY 1, 2),
 bmr AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) - 1 AS rank FROM bm)"""
#: Queries: every hundredth vector; for fusion those of benchmark items too.
_HUNDREDTHS, _ITEMS = "q.vec_id % 100 = 0", "q.vec_id % 100 = 0 OR q.vec_id IN (SELECT item_id FROM benchmark)"
_DENSE = f"dn AS (SELECT q.vec_id AS query, e.vec_id, {_COS} AS score FROM embeddings e, embeddings q WHERE {{where}}), dr AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) - 1 AS rank FROM dn)"
_NORMDOC = "lower(trim(regexp_replace(regexp_replace(regexp_replace(text, '//.*', '', 'g'), '\\$error\\s*\\([^)]*\\)', '$error(...)', 'g'), '\\s+', ' ', 'g')))"
ORACLES = {
    "keep_first_exact": "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY trim(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), 'else \\$error\\(.*$', '', 'g'))",
    "keep_first_normalised": f"SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY {_NORMDOC}",
    "keep_first_capped": "SELECT p_partkey, p_type FROM (SELECT *, row_number() OVER (PARTITION BY p_type, left(p_name, 5) ORDER BY p_partkey) AS rn FROM part) WHERE rn = 1 ORDER BY p_partkey LIMIT 60",
    "subsumption": """WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS pos, (l_partkey % 400)::VARCHAR AS lhs, l_returnflag AS rhs,
      CASE WHEN l_linenumber = 1 THEN [] ELSE list_sort(list_filter([CASE WHEN l_discount > 0.03::DOUBLE THEN 'disc' END, CASE WHEN l_tax > 0.03::DOUBLE THEN 'tax' END, CASE WHEN l_quantity > 20 THEN 'qty' END], lambda x: x IS NOT NULL)) END::VARCHAR[] AS names FROM lineitem),
      u AS (SELECT lhs, min_by(rhs, pos) AS f FROM r WHERE len(names) = 0 GROUP BY 1),
      k AS (SELECT r.* FROM r LEFT JOIN u USING (lhs) WHERE CASE WHEN len(names) > 0 THEN f IS NULL ELSE f = rhs END),
      s AS (SELECT DISTINCT lhs, rhs, names FROM k WHERE len(names) > 0),
      bad AS (SELECT DISTINCT a.lhs, a.rhs, a.names FROM s a JOIN s b ON a.lhs = b.lhs AND a.rhs = b.rhs AND len(a.names) < len(b.names) AND list_has_all(b.names, a.names))
      SELECT pos, lhs, rhs, array_to_string(names, ',') AS names FROM k WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.lhs = k.lhs AND bad.rhs = k.rhs AND bad.names = k.names)""",
    "canonical_dedup": f"""WITH a AS ({ASSERTIONS}), x1 AS (SELECT pos, trim(regexp_replace(regexp_replace(trim(assertion), '//[^\\n]*', '', 'g'), 'else\\s+\\$error\\(.*$', '', 'g')) AS s FROM a),
      x2 AS (SELECT pos, regexp_replace(regexp_replace(s, '[;\\s]+$', ''), '^assert\\s+property\\s*\\(|^assert\\s*\\(', '(') AS s FROM x1),
      x3 AS (SELECT pos, regexp_replace(regexp_replace(s, 'disable\\s+iff\\s*\\([^)]*\\)', '', 'g'), '@\\s*\\(\\s*(?:pos|neg)edge\\s+\\w+\\s*\\)', '', 'g') AS s FROM x2),
      x4 AS (SELECT pos, trim(regexp_replace(regexp_replace(regexp_replace(s, '\\s*(==|!=|<=|>=|\\|\\||&&|\\|->|\\|=>|->)\\s*', ' \\1 ', 'g'), '[()]', '', 'g'), '\\s+', ' ', 'g')) AS s FROM x3),
      x5 AS (SELECT pos, lower(array_to_string(list_sort(list_transform(string_split(regexp_replace(s, '!\\s+', '!', 'g'), '||'), lambda c: trim(c))), ' || ')) AS form FROM x4)
      SELECT min(pos) AS pos, form FROM x5 GROUP BY form""",
    "cap_per_group": "SELECT p_brand, p_partkey, rn::INT AS rn, n AS group_size, greatest(n - 3, 0) AS n_more FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn, count(*) OVER (PARTITION BY p_brand) AS n FROM part) WHERE rn <= 3",
    "small_groups": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) <= 8",
    "merged_sources": "SELECT k, arg_min(pos, r * 1000000000 + pos) AS pos, min(r)::INT AS source_rank FROM (SELECT s_nationkey AS k, s_suppkey AS pos, 0 AS r FROM supplier UNION ALL SELECT c_nationkey, c_custkey, 1 FROM customer) GROUP BY 1",
    "set_sizes": "WITH b AS (SELECT x.k IS NOT NULL AS a, y.k IS NOT NULL AS b FROM (SELECT DISTINCT o_custkey AS k FROM orders) x FULL JOIN (SELECT DISTINCT c_custkey AS k FROM customer) y ON x.k = y.k) SELECT count(*) AS n_union, count(*) FILTER (a AND b) AS n_both, count(*) FILTER (a AND NOT b) AS n_only_a, count(*) FILTER (b AND NOT a) AS n_only_b, count(*) FILTER (a AND NOT b) = 0 AND count(*) FILTER (b AND NOT a) > 0 AS strict_subset FROM b",
    "coverage_overlap": f"""WITH e AS (SELECT item_id, list_distinct({_TOK}) AS w FROM benchmark), x AS (SELECT doc_id, unnest(list_distinct({_TOK})) AS t FROM documents),
      c AS (SELECT item_id, doc_id, count(*) AS c FROM (SELECT item_id, unnest(w) AS t FROM e) JOIN x USING (t) GROUP BY 1, 2), b AS (SELECT item_id, max(c) AS c FROM c GROUP BY 1)
      SELECT item_id, len(w)::INT AS n, coalesce(c, 0) AS best, len(w) > 0 AND coalesce(c, 0) >= greatest(ceil(len(w) / 2), 1) AS covered FROM e LEFT JOIN b USING (item_id)""",
    "coverage_subset": f"""WITH e AS (SELECT item_id, list_distinct({_TOK}) AS w FROM benchmark), x AS (SELECT DISTINCT unnest({_TOK}) AS t FROM documents),
      m AS (SELECT item_id, count(*) AS c FROM (SELECT item_id, unnest(w) AS t FROM e) ANTI JOIN x USING (t) GROUP BY 1) SELECT item_id, len(w)::INT AS n, coalesce(c, 0) AS n_missing, len(w) > 0 AND c IS NULL AS covered FROM e LEFT JOIN m USING (item_id)""",
    "majority_unknown": f"""WITH x AS (SELECT doc_id, unnest(list_distinct({_TOK})) AS t FROM documents), k AS (SELECT DISTINCT unnest({_TOK}) AS t FROM benchmark),
      c AS (SELECT doc_id, count(*) AS n, count(k.t) AS n_known FROM x LEFT JOIN k ON x.t = k.t GROUP BY 1) SELECT doc_id, coalesce(n, 0) AS n, coalesce(n_known, 0) AS n_known, coalesce(n, 0) = 0 OR n_known >= 0.5 * n AS kept FROM documents LEFT JOIN c USING (doc_id)""",
    "unknown_names": f"WITH x AS (SELECT doc_id, unnest(list_distinct({_TOK})) AS w FROM documents WHERE lang <> 'en'), k AS (SELECT DISTINCT unnest({_TOK}) AS w FROM documents WHERE lang = 'en') SELECT w, count(*) AS n FROM x ANTI JOIN k USING (w) GROUP BY 1",
    "out_of_scope": f"WITH x AS (SELECT doc_id, unnest({_TOK}) AS w FROM documents), k AS (SELECT DISTINCT unnest({_TOK}) AS w FROM benchmark) SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM x WHERE w IN (SELECT w FROM k) OR regexp_matches(w, '^[0-9]+$'))",
    "dense_topk": f"WITH {_DENSE.format(where=_HUNDREDTHS)} SELECT query, vec_id, round(score, 6) AS score, rank::INT AS rank FROM dr WHERE rank < 10",
    "bm25_topk": f"WITH {_BM} SELECT query, doc_id, score, rank::INT AS rank FROM bmr WHERE rank < 10",
    "rrf_fusion": f"""WITH {_BM}, {_DENSE.format(where=_ITEMS)}, f AS (SELECT coalesce(a.query, b.query) AS query, coalesce(a.vec_id, b.doc_id) AS doc_id, coalesce(1 / (60 + a.rank), 0) + coalesce(1 / (60 + b.rank), 0) AS score
      FROM (SELECT * FROM dr WHERE rank < 20) a FULL JOIN (SELECT * FROM bmr WHERE rank < 20) b ON a.query = b.query AND a.vec_id = b.doc_id), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) - 1 AS rank FROM f)
      SELECT query, doc_id, round(score, 9) AS score, rank::INT AS rank FROM r WHERE rank < 10""",
    "two_stage_retrieval": f"""WITH {_DENSE.format(where=_HUNDREDTHS)}, h AS (SELECT query, vec_id, rank, label FROM dr JOIN embeddings USING (vec_id) WHERE rank < 40), g AS (SELECT DISTINCT query, label FROM h WHERE rank < 3),
      m AS (SELECT h.*, g.label IS NULL AS filled FROM h LEFT JOIN g ON h.query = g.query AND h.label = g.label), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY filled, rank, vec_id) - 1 AS place FROM m)
      SELECT query, vec_id, label, place::INT AS place, filled FROM r WHERE place < 10""",
    "suffix_pairs": """WITH n AS (SELECT DISTINCT 'sig' || (p_partkey // 4) || CASE p_partkey % 3 WHEN 0 THEN '_valid' WHEN 1 THEN '_ready' ELSE '_vld' END AS n FROM part)
      SELECT a.n AS initiator, b.n AS responder FROM n a JOIN n b ON a.n LIKE '%\\_valid' ESCAPE '\\' AND b.n = left(a.n, length(a.n) - 6) || '_ready'""",
    "glob_hints": """WITH k AS (SELECT DISTINCT unnest([p_brand, p_type]) AS key FROM part), g(grp, pos, re) AS (VALUES ('a', 0, '(?i)^.*small.*$'), ('a', 1, '(?i)^.*1.$'), ('b', 0, '(?i)^brand#3.*$')),
      h AS (SELECT grp, key, min(pos)::INT AS pos FROM k JOIN g ON regexp_matches(key, re) GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY pos, key)::INT AS rn FROM h) WHERE rn <= 30""",
    "identifier_counts": f"""WITH a AS ({ASSERTIONS}), c AS (SELECT pos, regexp_replace(regexp_replace(regexp_replace(assertion, '"[^"]*"|//.*', '', 'g'), '\\$\\w+', '', 'g'), '\\b\\d+\\b', '', 'g') AS s FROM a),
      i AS (SELECT pos, unnest(list_distinct(regexp_extract_all(s, '\\b[A-Za-z_][A-Za-z0-9_]*\\b'))) AS name FROM c) SELECT name, count(*) AS n FROM i WHERE lower(name) NOT IN ({', '.join(f"'{k}'" for k in X.KEYWORDS)}) GROUP BY 1""",
    "implication_parts": """SELECT p_partkey AS pos, CASE p_partkey % 12 WHEN 1 THEN 'valid && ready' WHEN 4 THEN '!rst' WHEN 5 THEN '$rose(req)' WHEN 9 THEN 'en' END AS condition,
      CASE p_partkey % 12 WHEN 0 THEN 'size_' || (p_size % 7) || ' == q_' || (p_size % 3) WHEN 1 THEN 'data_' || (p_size % 5) || ' == hold' WHEN 2 THEN 'a_' || (p_size % 4) || ' == b' WHEN 3 THEN 'a_' || (p_size % 4) || '  ==  b' WHEN 4 THEN 'cnt == ' || (p_size % 3) WHEN 5 THEN 'ack' WHEN 6 THEN '$bits(bus_' || (p_size % 6) || ') == 8'
      WHEN 7 THEN 'b || a_' || (p_size % 2) WHEN 8 THEN 'a_' || (p_size % 2) || ' || b' WHEN 9 THEN '$past(q_' || (p_size % 3) || ') == d' WHEN 10 THEN 'x == x' ELSE '' END AS claim FROM part""",
    "template_cluster": "SELECT c_mktsegment AS kind, 'acct_* == seg[*]' AS template, count(*) AS n, min(c_custkey) AS first_pos, max(c_custkey) AS last_pos FROM customer GROUP BY 1",
    "slot_fit": """WITH m AS (SELECT unnest([1, -1, 2, -2, 3, 4, -4, 8, -8, 16, 32, 64, 128]) AS mul, unnest(range(1, 14)) AS i), g AS (SELECT 0 AS shift, 0 AS mul, 0 AS o UNION ALL SELECT s, mul, 100 * s + i FROM m, (SELECT unnest(range(0, 8)) AS s)),
      c AS (SELECT c_nationkey, c_custkey AS x, [c_custkey + 5, c_custkey * 8 - 3, (c_custkey >> 3) + 1, c_custkey * c_custkey, 7 - c_custkey, c_custkey * 128 + 1, c_custkey * 5, 9, (c_custkey >> 7) * -8 + 2][c_nationkey % 9 + 1] AS y FROM customer),
      f AS (SELECT c_nationkey, o, shift, mul, min(y - mul * (x >> shift)) AS add, max(y - mul * (x >> shift)) AS top FROM c, g GROUP BY ALL), b AS (SELECT c_nationkey, arg_min(shift, o) AS shift, arg_min(mul, o) AS mul, arg_min(add, o) AS add FROM f WHERE add = top GROUP BY 1)
      SELECT c_nationkey, count(*) AS n, any_value(shift)::INT AS shift, any_value(mul)::INT AS mul, any_value(add)::BIGINT AS add FROM customer LEFT JOIN b USING (c_nationkey) GROUP BY 1""",
    "mutation_rows": r"""WITH l AS (SELECT p_partkey % 50 AS f, p_partkey AS n, p_size AS s, p_partkey % 5 AS k, CASE p_partkey % 5 WHEN 0 THEN 'assign q_' || p_size || ' = (a[7:0] == 8''h1' || (p_size % 10) || ') && b;' WHEN 1 THEN '  if (!busy) y <= x ^ 4''d' || (p_size % 8) || ';' ELSE 'always @(posedge clk) if (en) z <= 1''b0;' END AS o,
        '8''h1' || (p_size % 10) AS h, '8''h1' || xor(p_size % 10, 1) AS h2, '4''d' || (p_size % 8) AS dd, '4''d' || xor(p_size % 8, 1) AS d2 FROM part WHERE p_partkey % 5 < 3),
      x AS (SELECT *, CASE k
        WHEN 0 THEN [['OP_REPLACE', replace(o, '==', '!='), 'Replace ''=='' with ''!='' '], ['OP_REPLACE', replace(o, '&&', '||'), 'Replace ''&&'' with ''||'' '],
          ['CONST_REPLACE', replace(o, '[7:0]', '[6:0]'), 'Replace constant ''7'' with ''6'' '], ['CONST_REPLACE', replace(o, '[7:0]', '[8:0]'), 'Replace constant ''7'' with ''8'' '], ['CONST_REPLACE', replace(o, '[7:0]', '[7:1]'), 'Replace constant ''0'' with ''1'' '],
          ['CONST_REPLACE', replace(o, h, h2), 'Replace constant ''' || h || ''' with ''' || h2 || ''' '], ['BITSLICE_MUT', replace(o, '[7:0]', '[8:1]'), 'Shift [7:0] up to [8:1]'], ['ASSIGN_DELETE', '// MUTANT_DELETED: ' || o, 'Delete assignment']]
        WHEN 1 THEN [['OP_REPLACE', replace(o, '<=', '<'), 'Replace ''<='' with ''<'' '], ['OP_REPLACE', replace(o, '<=', '=='), 'Replace ''<='' with ''=='' '], ['OP_REPLACE', replace(o, '^', '&'), 'Replace ''^'' with ''&'' '], ['OP_REPLACE', replace(o, '^', '|'), 'Replace ''^'' with ''|'' '],
          ['CONST_REPLACE', replace(o, dd, d2), 'Replace constant ''' || dd || ''' with ''' || d2 || ''' '], ['COND_NEGATE', replace(o, '!busy', 'busy'), 'Remove negation: !busy → busy']]
        ELSE [['OP_REPLACE', replace(o, '<=', '<'), 'Replace ''<='' with ''<'' '], ['OP_REPLACE', replace(o, '<=', '=='), 'Replace ''<='' with ''=='' '], ['CONST_REPLACE', replace(o, '1''b0', '1''b1'), 'Replace constant ''1''b0'' with ''1''b1'' '],
          ['COND_NEGATE', replace(o, '(en)', '(!en)'), 'Negate condition: if (en) → if (!en)'], ['SENSITIVITY_MUT', replace(o, 'posedge', 'negedge'), 'Swap posedge → negedge']] END AS xs FROM l),
      m AS (SELECT *, unnest(xs) AS x, generate_subscripts(xs, 1) AS i FROM x)
      SELECT f::VARCHAR AS source, n AS line_no, x[1] AS operator, o AS original, x[2] AS mutated, trim(x[3]) AS description, (row_number() OVER (PARTITION BY f ORDER BY n, i) - 1)::BIGINT AS id FROM m WHERE NOT (k = 1 AND x[1] = 'CONST_REPLACE' AND s % 8 = 0)""",
    "clean_counts": """WITH a AS (SELECT p_size AS id, p_partkey % 12 AS k, p_brand AS b FROM part WHERE p_partkey % 12 < 11),
      e AS (SELECT count(*) AS n, count(*) FILTER (k <> 10) AS alive, count(DISTINCT (id, k, CASE WHEN k = 1 THEN b END)) FILTER (k <> 10) AS exact, count(DISTINCT (id, CASE k WHEN 3 THEN 2 WHEN 8 THEN 7 ELSE k END)) FILTER (k <> 10) AS form FROM a),
      s AS (SELECT unnest(['input', 'fix_immediate_implication', 'fix_double_negation', 'fold_ternary', 'remove_dead_under_disable', 'remove_missing_implication', 'remove_unconditional_equality', 'remove_tautologies', 'remove_vacuous_condition', 'remove_self_comparison', 'remove_vacuous_claim', 'remove_trivial', 'deduplicate', 'semantic_deduplicate']) AS pass, unnest(range(0, 14))::INT AS step)
      SELECT step, pass, CASE WHEN step < 9 THEN n WHEN step < 12 THEN alive WHEN step = 12 THEN exact ELSE form END AS n_left FROM s, e""",
    "value_cluster": "SELECT p_brand, constant, count(*) AS n, min(p_partkey) AS first_pos FROM (SELECT p_brand, p_partkey, CASE p_size % 5 WHEN 0 THEN '''0' WHEN 1 THEN '''1' WHEN 2 THEN '''1' WHEN 3 THEN '8''h' || (p_size % 10) END AS constant FROM part) WHERE constant IS NOT NULL GROUP BY 1, 2",
    "fixed_windows": "WITH s AS (SELECT doc_id, text, CASE WHEN length(text) <= 1000 THEN [0] ELSE list_filter(range(0, length(text), 800), lambda s: s = 0 OR s + 200 < length(text)) END AS st FROM documents WHERE length(text) > 0), u AS (SELECT doc_id, text, unnest(st) AS char_start, unnest(range(0, len(st))) AS i FROM s) SELECT doc_id, i::INT AS chunk_index, char_start::INT AS char_start, length(substr(text, char_start + 1, 1000))::INT AS n, md5(substr(text, char_start + 1, 1000)) AS digest FROM u",
    "html_strip": "SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->|<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS digest FROM pages",
    "log_counts": "SELECT label, coalesce(sum(n), 0)::BIGINT AS total FROM (SELECT 'versions' AS label, unnest(regexp_extract_all(text, 'version (\\d+)', 1))::BIGINT AS n FROM documents UNION ALL SELECT 'numbers', unnest(regexp_extract_all(text, '\\b(\\d{1,6})\\b', 1))::BIGINT FROM documents UNION ALL SELECT unnest(['versions', 'numbers', 'none']), NULL) GROUP BY 1",
    "last_numbers": "SELECT user_id, coalesce(arg_max(nullif(regexp_extract(props, '(\\d+)', 1), '')::BIGINT, event_id), -1) AS value FROM events GROUP BY 1",
    "url_parts": "SELECT page_id, string_split(url, '/')[3] AS host, string_split(url, '/')[-1] AS leaf, len(string_split(url, '/'))::INT AS n_parts FROM pages",
    "tag_split": "SELECT p_partkey, p_brand AS name, p_type AS variant FROM part",
    "slugs": "SELECT p_partkey, left(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', '_', 'g'), 20) AS slug, length(p_name) // 4 AS tokens FROM part",
    "module_attribution": f"""WITH o AS (SELECT name, min(item_id) AS module FROM (SELECT item_id, unnest({_TOK}) AS name FROM benchmark) GROUP BY 1),
      w AS (SELECT doc_id, unnest({_TOK}) AS name, unnest(range(0, len({_TOK}))) AS k FROM documents), f AS (SELECT doc_id, arg_min(module, k) AS module FROM w JOIN o USING (name) GROUP BY 1) SELECT module, count(*) AS n FROM f GROUP BY 1""",
    "peak_values": "SELECT user_id, max(value) AS peak, arg_min(event_id, (-value, event_id)) AS at FROM events GROUP BY 1",
    "flag_labels": "SELECT lang, quality, toxic, count(*) AS n, count(*) FILTER (contains(text, ' | ')) AS n_piped, sum(n_chars)::BIGINT AS chars FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2, 3",
}
