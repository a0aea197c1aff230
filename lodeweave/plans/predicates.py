"""Filters, predicates, projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import predicates as P
from .registry import query, table
from .relations import actions, chunks, edges, facts, files, over, symbols, usage


@query("p1_point_lookup", over("symbols", """, w AS (SELECT unnest(['Brand#17.red widget', 'Brand#17.no such thing', 'brand#17.red widget']) AS wanted), f AS (SELECT wanted, min(s.id) AS id FROM w LEFT JOIN symbols s ON qualified_name = wanted GROUP BY wanted)
SELECT wanted, f.id, kind, CASE WHEN f.id IS NULL THEN 'not found: ' || wanted END AS error FROM f LEFT JOIN symbols s ON s.id = f.id""").replace("\n, w AS", ", w AS"))  # fmt: skip
def p1(spark, d):
    """Symbols by their qualified names, of equal ones the lowest id; a name that nothing has gives an error."""
    return P.point_lookup(symbols(spark, d), ["Brand#17.red widget", "Brand#17.no such thing", "brand#17.red widget"], "qualified_name").select("wanted", "id", "kind", "error")


@query("p2_keyword", over("chunks", "SELECT id, token_count FROM chunks WHERE content ILIKE '%LICENSE%'"))
def p2(spark, d):
    return P.keyword(chunks(spark, d), "content", "LICENSE").select("id", "token_count")


@query("p3_snippet_keyword", over("chunks", "SELECT id FROM chunks WHERE content ILIKE '%the and attion to thanedble the, anea. Er%'"))
def p3(spark, d):
    return P.snippet(chunks(spark, d), "content", "  the and attion to thanedble the, anea. Eriner thanea").select("id")


FRAGMENTS = [("src1/",), ("7.EN",), ("none",)]


@query("p4_path_fragment", over("files", "SELECT f.id, g.fragment FROM files f JOIN (VALUES ('src1/'), ('7.EN'), ('none')) g(fragment) ON f.path ILIKE '%' || g.fragment || '%'"))
def p4(spark, d):
    wanted = spark.createDataFrame(FRAGMENTS, "fragment string")
    return P.path_fragments(files(spark, d), wanted).select("id", "fragment")


@query("p5_edge_kind", over("edges", "SELECT src, dst FROM edges WHERE kind = 'imports'"))
def p5(spark, d):
    return edges(spark, d).where("kind = 'imports'").select("src", "dst")


@query("p6_embedding_not_null", "SELECT vec_id AS id FROM embeddings WHERE CASE WHEN vec_id % 3 > 0 THEN embedding END IS NOT NULL")
def p6(spark, d):
    return facts(spark, d).withColumn("embedding", F.when(F.col("id") % 3 > 0, F.col("embedding"))).where("embedding IS NOT NULL").select("id")


DAY = 1_704_844_800_000  # 2024-01-10 in UTC


@query("p7_time_filters", over("usage", f"SELECT id, ts >= {DAY} AS since_day, ts BETWEEN {DAY} AND {DAY + 86_400_000} AS in_range, ts > {DAY} AS after_mark FROM usage WHERE ts >= {DAY}"))
def p7(spark, d):
    """Since a day's midnight, in a closed range, strictly after a mark; the day is a parameter."""
    u = usage(spark, d).where(F.col("ts") >= DAY)
    return u.select("id", (F.col("ts") >= DAY).alias("since_day"), F.col("ts").between(DAY, DAY + 86_400_000).alias("in_range"), (F.col("ts") > DAY).alias("after_mark"))


@query("p8_delete_ids", over("chunks", "SELECT id, token_count FROM chunks WHERE id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"))
def p8(spark, d):
    gone = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return chunks(spark, d).join(gone, "id", "left_anti").select("id", "token_count")


@query("p9_free_filter", over("chunks", "SELECT id, token_count FROM chunks WHERE token_count > 500 AND id % 2 = 0 ORDER BY token_count, id LIMIT 25"))
def p9(spark, d):
    """A filter given as text, output columns and a limit."""
    return chunks(spark, d).where("token_count > 500 AND id % 2 = 0").orderBy("token_count", "id").limit(25).select("id", "token_count")


COMMAND = "concat_ws(' ', event_type, '--user', user_id)"


@query(
    "p10_command_policy",
    """SELECT event_id AS id,
       CASE WHEN regexp_matches(event_type, '(?i)^err.*$') THEN false WHEN NOT regexp_matches(event_type, '(?i)^(cl.ck|view|purchase)$') THEN false ELSE true END AS allowed,
       CASE WHEN event_type = 'error' THEN 'Command ''error'' matches deny list' WHEN event_type IN ('click', 'view', 'purchase') THEN 'Command permitted by policy'
            ELSE 'Command ''' || event_type || ''' not in allow list' END AS reason FROM events""",
)
def p10(spark, d):
    verdict = P.command_verdict(F.expr(COMMAND), allow=["CL?CK", "view", "purchase", "error"], deny=["err*"])
    return table(spark, d, "events").select(F.col("event_id").alias("id"), verdict.alias("v")).select("id", "v.*")


@query("p11_path_policy", over("files", "SELECT id, NOT path LIKE 'src1/%' AS can_read, NOT path LIKE 'src1/%' AND (path LIKE '%.en' OR path LIKE 'src2_/%') AS can_write FROM files"))
def p11(spark, d):
    path = F.col("path")
    return files(spark, d).select("id", P.path_allowed(path, "read", ["SRC1/*"]).alias("can_read"), P.path_allowed(path, "write", ["src1/*"], ["*.en", "src2?/*"]).alias("can_write"))


@query("p12_name_policy", "SELECT DISTINCT source AS name, source NOT LIKE 'src1%' AS env_allowed, source LIKE 'src_' AS domain_allowed, true AS open_allowed FROM documents")
def p12(spark, d):
    names = table(spark, d, "documents").select(F.col("source").alias("name")).distinct()
    name = F.col("name")
    return names.select("name", P.name_allowed(name, deny=["src1*"]).alias("env_allowed"), P.name_allowed(name, allow=["SRC?"]).alias("domain_allowed"), P.name_allowed(name).alias("open_allowed"))


@query(
    "p13_egress",
    """WITH p AS (SELECT page_id AS id, lower(split_part(split_part(regexp_replace(url, '(?i)^https?://', ''), '/', 1), ':', 1)) AS domain FROM pages)
    SELECT id, domain, NOT (domain LIKE 'm.%.example.net' OR domain = 'none.org') AND (domain LIKE '%.example.com' OR domain LIKE '%.example.net') AS allowed FROM p""",
)
def p13(spark, d):
    url = F.col("url")
    blocked = P.normal_domain(url).rlike(r"^m\..*\.example\.net$")
    allowed = P.egress_allowed(url, allow=["*.example.com", "*.Example.net"], deny=["none.org"]) & ~blocked
    return table(spark, d, "pages").select(F.col("page_id").alias("id"), P.normal_domain(url).alias("domain"), allowed.alias("allowed"))


@query(
    "p15_ignore_patterns",
    """WITH f AS (SELECT doc_id AS id, concat(source, '/', CASE WHEN doc_id % 11 = 0 THEN '.git/' ELSE '' END, 'build', doc_id % 4, '/', doc_id, '.', lang) AS path FROM documents)
    SELECT id, path, (regexp_matches(path, '/[.]git/') OR regexp_matches(path, '(^|/)build1/') OR regexp_matches(path, '[.]de$') OR path LIKE 'src3/%'
      OR regexp_matches(path, '^src4/build2/[^/]*$') OR regexp_matches(path, '^src5(/|$)')) AS ignored FROM f""",
)
def p15(spark, d):
    """Ignore rules over synthetic paths of documents."""
    docs = table(spark, d, "documents")
    path = F.concat_ws("", "source", F.lit("/"), F.when(F.col("doc_id") % 11 == 0, ".git/"), F.lit("build"), (F.col("doc_id") % 4).cast("string"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang")
    rows = docs.select(F.col("doc_id").alias("id"), path.alias("path"))
    return rows.select("id", "path", P.ignored(F.col("path"), ["build1/", "*.de", "/src3/", "src4/build2", "/src5"]).alias("ignored"))


@query("p16_previews", over("chunks", "SELECT id, replace(substr(content, 1, 400), chr(10), ' ') AS p400, replace(substr(content, 1, 300), chr(10), ' ') AS p300, replace(substr(content, 1, 200), chr(10), ' ') AS p200, replace(substr(content, 1, 120), chr(10), ' ') AS p120 FROM chunks"))
def p16(spark, d):
    return chunks(spark, d).select("id", *(P.preview(F.col("content"), n).alias(f"p{n}") for n in (400, 300, 200, 120)))


LEVELS = {"error": "error", "signup": "warn"}


@query("p17_level_filter", over("actions", "SELECT ord, CASE kind WHEN 'error' THEN 'error' ELSE 'warn' END AS level FROM actions WHERE kind IN ('error', 'signup')"))
def p17(spark, d):
    level = F.when(F.col("kind") == "error", "error").when(F.col("kind") == "signup", "warn").otherwise("info")
    return P.relevant_levels(actions(spark, d).select("ord", level.alias("level")))


@query(
    "p18_dispatch",
    """SELECT item_id AS id, CASE WHEN regexp_matches(lower(text), 'implement|write|create|add|generate|code') THEN 'coder'
       WHEN regexp_matches(lower(text), 'find|search|locate|scan|grep|list') THEN 'finder'
       WHEN regexp_matches(lower(text), 'rename|refactor|move|extract|reorganize|restructure') THEN 'first' ELSE 'first' END AS agent FROM benchmark""",
)
def p18(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("id"), P.dispatch(F.col("text"), {"code_gen": "coder", "search": "finder"}).alias("agent"))


@query(
    "p19_key_format",
    """SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' AND NOT starts_with(c_name, 'Customer#00000001') THEN 'BUILDING keys start with Customer#00000001'
       WHEN length(right(c_name, 1 + c_custkey % 12)) < 8 AND c_mktsegment <> 'BUILDING' THEN 'Key too short' END AS error FROM customer""",
)
def p19(spark, d):
    """Key prefixes per provider and the least length; segments stand for providers."""
    c = table(spark, d, "customer")
    key = F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_name")).otherwise(F.expr("right(c_name, cast(1 + c_custkey % 12 as int))"))
    return c.select(F.col("c_custkey").alias("id"), P.key_error(F.col("c_mktsegment"), key, {"BUILDING": "Customer#00000001"}).alias("error"))
