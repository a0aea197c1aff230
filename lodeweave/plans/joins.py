"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import predicates as P
from .registry import query, table
from .relations import actions, chunks, edges, files, over, plan_steps, snapshots, symbols, usage


@query("j1_chunk_file_keyword", over("chunks files", "SELECT c.id, f.path, f.lang, c.token_count FROM chunks c JOIN files f ON c.file_id = f.id WHERE c.content ILIKE '%token =%'"))
def j1(spark, d):
    hits = P.keyword(chunks(spark, d), "content", "token =").select("id", "file_id", "token_count")
    f = files(spark, d).select(F.col("id").alias("file_id"), "path", "lang")
    return hits.join(f, "file_id").select("id", "path", "lang", "token_count")


@query("j2_callers", over("symbols edges", "SELECT e.dst AS target, s.id AS caller, s.qualified_name FROM edges e JOIN symbols s ON s.id = e.src WHERE e.kind = 'calls'"))
def j2(spark, d):
    """Callers of every symbol."""
    calls = edges(spark, d).where("kind = 'calls'")
    s = symbols(spark, d).select(F.col("id").alias("src"), "qualified_name")
    return calls.join(s, "src").select(F.col("dst").alias("target"), F.col("src").alias("caller"), "qualified_name")


@query("j3_callees", over("symbols edges", "SELECT e.src AS target, s.id AS callee, s.qualified_name FROM edges e JOIN symbols s ON s.id = e.dst WHERE e.kind = 'calls'"))
def j3(spark, d):
    calls = edges(spark, d).where("kind = 'calls'")
    s = symbols(spark, d).select(F.col("id").alias("dst"), "qualified_name")
    return calls.join(s, "dst").select(F.col("src").alias("target"), F.col("dst").alias("callee"), "qualified_name")


@query("j4_file_dependencies", over("symbols edges", "SELECT DISTINCT a.file AS from_file, b.file AS to_file FROM edges e JOIN symbols a ON a.id = e.src JOIN symbols b ON b.id = e.dst WHERE e.kind = 'imports'"))
def j4(spark, d):
    s = symbols(spark, d)
    a, b = s.select(F.col("id").alias("src"), F.col("file").alias("from_file")), s.select(F.col("id").alias("dst"), F.col("file").alias("to_file"))
    return edges(spark, d).where("kind = 'imports'").join(a, "src").join(b, "dst").select("from_file", "to_file").distinct()


@query("j5_path_lookup", over("symbols files", "SELECT s.id, coalesce(f.path, '(unknown)') AS path FROM symbols s LEFT JOIN files f ON f.id = s.id"))
def j5(spark, d):
    """The file path of every symbol, '(unknown)' where there is none: one join instead of a look-up a row."""
    return symbols(spark, d).join(files(spark, d).select("id", "path"), "id", "left").select("id", F.coalesce("path", F.lit("(unknown)")).alias("path"))


@query("j6_symbols_of_file", over("symbols", "SELECT file, id, name, rk FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY \"start\", id) AS rk FROM symbols) WHERE rk <= 20"))
def j6(spark, d):
    """The first 20 symbols of every file by position."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("file").orderBy("start", "id"))
    return symbols(spark, d).withColumn("rk", rank).where("rk <= 20").select("file", "id", "name", F.col("rk").cast("long").alias("rk"))


@query(
    "j7_local_then_global",
    over("symbols edges", """, l AS (SELECT file, name, min(id) AS id FROM symbols GROUP BY ALL), g AS (SELECT name, min(id) AS id FROM symbols GROUP BY ALL)
    SELECT e.src, e.dst, coalesce(l.id, g.id) AS target FROM edges e JOIN symbols a ON a.id = e.src JOIN symbols b ON b.id = e.dst
    LEFT JOIN l ON l.file = a.file AND l.name = b.name LEFT JOIN g ON g.name = b.name""").replace("\n, l AS", ", l AS"),
)
def j7(spark, d):
    """The target of each edge by name: in the caller's file first, then anywhere."""
    s = symbols(spark, d)
    e = edges(spark, d).select("src", "dst").join(s.select(F.col("id").alias("src"), "file"), "src").join(s.select(F.col("id").alias("dst"), "name"), "dst")
    local, anywhere = s.groupBy("file", "name").agg(F.min("id").alias("l")), s.groupBy("name").agg(F.min("id").alias("g"))
    return e.join(local, ["file", "name"], "left").join(anywhere, "name", "left").select("src", "dst", F.coalesce("l", "g").alias("target"))


@query(
    "j8_innermost_interval",
    over("symbols", """, p AS (SELECT event_id AS chunk, 'Brand#' || (1 + user_id % 25) AS file, CAST(floor(value) AS BIGINT) AS line FROM events)
    SELECT chunk, line, (SELECT arg_max(s.id, s."start" * 1000000 - s.id) FROM symbols s WHERE s.file = p.file AND p.line BETWEEN s."start" AND s."end") AS span_id FROM p""").replace("\n, p AS", ", p AS"),
)
def j8(spark, d):
    """The innermost symbol around each chunk's first line; events stand for chunks."""
    points = table(spark, d, "events").select(F.col("event_id").alias("chunk"), F.concat(F.lit("Brand#"), (1 + F.col("user_id") % 25).cast("string")).alias("file"), F.floor("value").alias("line"))
    return J.innermost_interval(points, symbols(spark, d), "file", "chunk").select("chunk", "line", "span_id")


@query("j9_parent_link", over("symbols", "SELECT c.id, p.id AS parent, p.qualified_name AS parent_name FROM symbols c LEFT JOIN symbols p ON p.id = c.parent_id AND p.id <> c.id"))
def j9(spark, d):
    s = symbols(spark, d)
    parents = s.select(F.col("id").alias("parent"), F.col("qualified_name").alias("parent_name"))
    return s.join(parents, (s["parent_id"] == parents["parent"]) & (s["id"] != parents["parent"]), "left").select("id", "parent", "parent_name")


@query(
    "j10_fuzzy_names",
    """WITH n AS (SELECT p_name AS name, min(p_partkey) AS ord FROM part GROUP BY p_name),
    t AS (SELECT DISTINCT substr(p_name, 1, CAST(1 + p_partkey % 5 AS INT)) || substr(p_name, CAST(3 + p_partkey % 5 AS INT)) || CASE WHEN p_partkey % 2 = 0 THEN 'x' ELSE '' END AS target FROM part),
    c AS (SELECT target, name, CAST(levenshtein(target, name) AS INT) AS distance, ord FROM t JOIN n ON levenshtein(target, name) <= 2)
    SELECT target, name, distance FROM c QUALIFY row_number() OVER (PARTITION BY target ORDER BY distance, ord) = 1""",
)
def j10(spark, d):
    """Part names with a letter dropped, and perhaps one added, back to the nearest name within two edits."""
    parts = table(spark, d, "part")
    typo = F.expr("concat(substr(p_name, 1, cast(1 + p_partkey % 5 as int)), substr(p_name, cast(3 + p_partkey % 5 as int)), CASE WHEN p_partkey % 2 = 0 THEN 'x' ELSE '' END)")
    names = parts.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("ord"))
    return J.nearest_names(parts.select(typo.alias("target")), names)


_CASCADE = """, sy AS (SELECT p_partkey AS ord, p_name AS name, p_brand || '.' || p_name AS qn FROM part),
e AS (SELECT p_partkey AS id, p_brand || '.x.y' AS src, CASE p_partkey % 5 WHEN 0 THEN p_brand || '.' || p_name WHEN 1 THEN p_name WHEN 2 THEN upper(p_name) WHEN 3 THEN p_name || '.run' ELSE substr(p_name, 2) || 'q' END AS dst,
      CASE WHEN p_partkey % 11 = 0 THEN 'imports' ELSE 'calls' END AS kind, 0.8::DOUBLE AS confidence FROM part),
b AS (SELECT 'hot ring' AS local, 'Brand#1.hot ring' AS target UNION ALL SELECT 'red plate', 'Nowhere.red plate'),
k AS (SELECT DISTINCT qn FROM sy), n AS (SELECT lower(name) AS n, count(*) AS c, arg_min(qn, ord) AS first, min(ord) AS ord FROM sy GROUP BY 1),
r AS (SELECT e.*, x.qn AS exact, l.qn AS l1, b1.target AS b1, b2.target AS b2, n1.c AS n1, n1.first AS f1, n2.c AS n2, n2.first AS f2 FROM e LEFT JOIN k x ON x.qn = e.dst LEFT JOIN k l ON l.qn = split_part(src, '.', 1) || '.' || dst
   LEFT JOIN b b1 ON b1.local = dst LEFT JOIN b b2 ON b2.local = lower(dst) LEFT JOIN n n1 ON n1.n = lower(dst) LEFT JOIN n n2 ON contains(dst, '.') AND n2.n = lower(split_part(dst, '.', 1))),
z AS (SELECT r.id, n.first, row_number() OVER (PARTITION BY r.id ORDER BY levenshtein(lower(r.dst), n.n), n.ord) AS rk FROM r JOIN n ON levenshtein(lower(r.dst), n.n) <= 2),
q AS (SELECT r.*, z.first AS near FROM r LEFT JOIN z ON z.id = r.id AND z.rk = 1)
SELECT id, CASE WHEN kind <> 'calls' THEN dst WHEN exact IS NOT NULL THEN dst WHEN l1 IS NOT NULL THEN l1 WHEN coalesce(b1, b2) IS NOT NULL THEN coalesce(b1, b2) WHEN n1 = 1 THEN f1
    WHEN n2 = 1 THEN f2 || substr(dst, instr(dst, '.')) WHEN near IS NOT NULL THEN near ELSE dst END AS target,
  CASE WHEN kind <> 'calls' THEN confidence WHEN exact IS NOT NULL THEN 1.0 WHEN l1 IS NOT NULL THEN 0.95 WHEN coalesce(b1, b2) IS NOT NULL THEN 0.9 WHEN n1 = 1 THEN 0.85 WHEN n2 = 1 THEN 0.75 WHEN near IS NOT NULL THEN 0.5 ELSE confidence END::DOUBLE AS score,
  CASE WHEN kind <> 'calls' THEN exact IS NOT NULL WHEN exact IS NOT NULL OR l1 IS NOT NULL THEN true WHEN coalesce(b1, b2) IS NOT NULL THEN coalesce(b1, b2) IN (SELECT qn FROM k) WHEN n1 = 1 THEN true
    WHEN n2 = 1 THEN f2 || substr(dst, instr(dst, '.')) IN (SELECT qn FROM k) ELSE near IS NOT NULL END AS resolved,
  CASE WHEN kind <> 'calls' THEN CASE WHEN exact IS NOT NULL THEN 'exact' ELSE 'unresolved' END WHEN exact IS NOT NULL THEN 'exact' WHEN l1 IS NOT NULL THEN 'local_scope' WHEN coalesce(b1, b2) IS NOT NULL THEN 'file_alias' WHEN n1 = 1 THEN 'import_resolved'
    WHEN n2 = 1 THEN 'type_hint' WHEN near IS NOT NULL THEN 'fuzzy' ELSE 'unresolved' END AS strategy FROM q"""


def _cascade(spark, parts):
    sym = parts.select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"), F.concat_ws(".", "p_brand", "p_name").alias("qualified_name"))
    dst = F.expr("CASE p_partkey % 5 WHEN 0 THEN concat(p_brand, '.', p_name) WHEN 1 THEN p_name WHEN 2 THEN upper(p_name) WHEN 3 THEN concat(p_name, '.run') ELSE concat(substr(p_name, 2), 'q') END")
    e = parts.select(F.col("p_partkey").alias("id"), F.concat("p_brand", F.lit(".x.y")).alias("src_qn"), dst.alias("dst_qn"), F.when(F.col("p_partkey") % 11 == 0, "imports").otherwise("calls").alias("kind"), F.lit(0.8).alias("confidence"))
    bindings = spark.createDataFrame([("hot ring", "Brand#1.hot ring"), ("red plate", "Nowhere.red plate")], "local string, target string")
    return J.resolve_edges(e, sym, bindings).select("id", "target", "score", "resolved", "strategy")


@query("j11_resolution_cascade", "WITH z0 AS (SELECT 1)" + _CASCADE)
def j11(spark, d):
    """Calls made up from part names against the symbols of all parts."""
    return _cascade(spark, table(spark, d, "part"))


def _expected_and_changed(spark, d):
    lines = table(spark, d, "lineitem")
    step = F.col("l_orderkey").alias("step")
    expected = lines.select(step, F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("file")).distinct()
    changed = lines.where("l_linenumber > 1").select(step, F.concat(F.lit("p"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey")).otherwise(F.col("l_suppkey")).cast("string")).alias("file")).distinct()
    return expected, changed


_STEPS = """WITH x AS (SELECT DISTINCT l_orderkey AS step, 'p' || l_partkey AS file FROM lineitem),
c AS (SELECT DISTINCT l_orderkey AS step, 'p' || CASE WHEN l_linenumber % 2 = 0 THEN l_partkey ELSE l_suppkey END AS file FROM lineitem WHERE l_linenumber > 1)
"""


@query("j12_unexpected_changes", _STEPS + "SELECT step, file FROM c WHERE step IN (SELECT step FROM x) AND NOT EXISTS (SELECT 1 FROM x WHERE x.step = c.step AND (contains(x.file, c.file) OR contains(c.file, x.file)))")
def j12(spark, d):
    """Changed files of a step that no expected file accounts for."""
    expected, changed = _expected_and_changed(spark, d)
    return J.unmatched(changed, expected, "step")


@query("j13_missing_changes", _STEPS + "SELECT step, file FROM x WHERE step IN (SELECT step FROM c) AND NOT EXISTS (SELECT 1 FROM c WHERE x.step = c.step AND (contains(x.file, c.file) OR contains(c.file, x.file)))")
def j13(spark, d):
    """Expected files of a step that were not changed."""
    expected, changed = _expected_and_changed(spark, d)
    return J.unmatched(expected, changed, "step")


@query("j14_change_diff", over("old_files new_files", """SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'modified' END AS change
FROM old_files o FULL JOIN new_files n ON o.path = n.path WHERE o.hash IS DISTINCT FROM n.hash OR o.path IS NULL OR n.path IS NULL"""))  # fmt: skip
def j14(spark, d):
    return J.change_diff(*snapshots(spark, d))


@query("j15_hash_set_diff", over("old_files new_files", "SELECT 'added' AS side, hash FROM (SELECT hash FROM new_files EXCEPT SELECT hash FROM old_files) UNION ALL SELECT 'removed', hash FROM (SELECT hash FROM old_files EXCEPT SELECT hash FROM new_files)"))
def j15(spark, d):
    old, new = (x.select("hash").distinct() for x in snapshots(spark, d))
    return new.join(old, "hash", "left_anti").select(F.lit("added").alias("side"), "hash").unionByName(old.join(new, "hash", "left_anti").select(F.lit("removed").alias("side"), "hash"))


#: A price list for the test models, in dollars a token; m4 has no price.
RATES = [("m0", 3e-6, 15e-6), ("m1", 15e-6, 75e-6), ("m2", 0.25e-6, 1.25e-6), ("m3", 5e-6, 15e-6)]
RATES_SQL = "rates(model, ri, ro) AS (VALUES ('m0', 3e-6::DOUBLE, 15e-6::DOUBLE), ('m1', 15e-6, 75e-6), ('m2', 0.25e-6, 1.25e-6), ('m3', 5e-6, 15e-6))"


def rates(spark):
    return spark.createDataFrame(RATES, "model string, rate_in double, rate_out double")


@query("j16_price_lookup", over("usage", f", {RATES_SQL} SELECT u.id, round(coalesce(ri, 0) * tokens_in + coalesce(ro, 0) * tokens_out, 8) AS cost_usd FROM usage u LEFT JOIN rates r ON r.model = u.model").replace("\n, rates", ", rates"))
def j16(spark, d):
    return J.cost(usage(spark, d), rates(spark)).select("id", F.round("cost_usd", 8).alias("cost_usd"))


ROUTES = [("click", "alpha", "beta"), ("view", "beta", "alpha"), ("purchase", "gamma", "alpha")]


@query("j17_route_lookup", """SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'alpha' WHEN 'view' THEN 'beta' WHEN 'purchase' THEN 'gamma' END AS provider,
CASE event_type WHEN 'click' THEN 'beta' WHEN 'view' THEN 'alpha' WHEN 'purchase' THEN 'alpha' END AS fallback, event_type NOT IN ('click', 'view', 'purchase') AS missing FROM events""")  # fmt: skip
def j17(spark, d):
    """Route and fallback of every tag; ``missing`` marks tags without a route, an error to the caller."""
    routes = spark.createDataFrame(ROUTES, "event_type string, provider string, fallback string")
    out = table(spark, d, "events").join(F.broadcast(routes), "event_type", "left")
    return out.select(F.col("event_id").alias("id"), "provider", "fallback", F.col("provider").isNull().alias("missing"))


@query("j18_new_by_hash", """WITH h AS (SELECT doc_id AS id, sha256(text) AS content_hash FROM documents)
SELECT min(id) AS id, content_hash FROM h WHERE id % 3 > 0 AND content_hash NOT IN (SELECT content_hash FROM h WHERE id % 3 = 0) GROUP BY content_hash""")  # fmt: skip
def j18(spark, d):
    """Facts not yet shared: a third of the documents is held, the others come in."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("content_hash"))
    return J.new_by_hash(rows.where("id % 3 > 0"), rows.where("id % 3 = 0")).select("id", "content_hash")


@query("j19_first_events", over("actions", """SELECT task_id, min(ord) FILTER (kind = 'signup') AS created, min(ts) FILTER (kind = 'signup') AS created_ts, min(ord) FILTER (kind = 'purchase') AS merged
FROM actions WHERE kind IN ('signup', 'purchase') GROUP BY task_id"""))  # fmt: skip
def j19(spark, d):
    """The first create and the first merge event of every task."""
    a = actions(spark, d).where(F.col("kind").isin("signup", "purchase"))
    first = lambda kind, value: F.min_by(F.when(F.col("kind") == kind, F.col(value)), F.when(F.col("kind") == kind, F.col("ord")))
    return a.groupBy("task_id").agg(first("signup", "ord").alias("created"), first("signup", "ts").alias("created_ts"), first("purchase", "ord").alias("merged"))
