"""Aggregations; U1 to U4: set operations; K3 to K8: latest, oldest and bounded rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import joins as J
from .joins import RATES_SQL, rates
from .registry import query, table
from .relations import actions, chunks, edges, files, over, symbols, turns, usage


@query("a1_table_counts", over("files symbols edges chunks", "SELECT 'files' AS relation, count(*) AS n FROM files UNION ALL SELECT 'symbols', count(*) FROM symbols UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'chunks', count(*) FROM chunks"))
def a1(spark, d):
    return A.table_counts({"files": files(spark, d), "symbols": symbols(spark, d), "edges": edges(spark, d), "chunks": chunks(spark, d)})


@query("a2_files_per_language", over("files", "SELECT lang, count(*) AS n, false AS is_total FROM files GROUP BY lang UNION ALL SELECT NULL, count(*), true FROM files"))
def a2(spark, d):
    return A.with_total(files(spark, d).select("lang"), ["lang"], n=F.count("*")).orderBy(F.desc("n"), "lang")


@query("a3_counts_per_owner", over("turns chunks", "SELECT 'turns' AS kind, session_id AS owner, count(*) AS n FROM turns GROUP BY session_id UNION ALL SELECT 'chunks', file_id % 50, count(*) FROM chunks GROUP BY 2 UNION ALL SELECT 'cold', NULL, count(*) FROM chunks WHERE token_count > 600"))
def a3(spark, d):
    """Turns of each session, chunks of each file, and the items that are too large to stay in a cache."""
    c, count = chunks(spark, d), F.count("*").alias("n")
    cold = c.where("token_count > 600").agg(count).select(F.lit("cold").alias("kind"), F.lit(None).cast("long").alias("owner"), "n")
    own = c.groupBy((F.col("file_id") % 50).alias("owner")).agg(count).select(F.lit("chunks").alias("kind"), "owner", "n")
    return turns(spark, d).groupBy(F.col("session_id").alias("owner")).agg(count).select(F.lit("turns").alias("kind"), "owner", "n").unionByName(own).unionByName(cold)


@query("a4_sum_and_exists", """SELECT c_custkey AS task, coalesce(sum(o_shippriority), 0)::BIGINT AS tokens, count(o_shippriority) > 0 AS held FROM
(SELECT c.c_custkey, CASE WHEN o.o_orderstatus = 'F' THEN CAST(floor(o.o_totalprice) AS BIGINT) END AS o_shippriority FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey) GROUP BY c_custkey""")  # fmt: skip
def a4(spark, d):
    """Tokens of each task, 0 without entries, and whether it has any."""
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("task")).agg(F.sum(F.floor("o_totalprice")).alias("s"), F.count("*").alias("n"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("task"))
    return c.join(o, "task", "left").select("task", F.coalesce("s", F.lit(0)).cast("long").alias("tokens"), (F.coalesce("n", F.lit(0)) > 0).alias("held"))


@query("a5_usage_totals", over("usage", f", {RATES_SQL} SELECT sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, round(sum(coalesce(ri, 0) * tokens_in + coalesce(ro, 0) * tokens_out), 4) AS cost_usd FROM usage u LEFT JOIN rates r ON r.model = u.model").replace("\n, rates", ", rates"))
def a5(spark, d):
    return J.cost(usage(spark, d), rates(spark)).agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.round(F.sum("cost_usd"), 4).alias("cost_usd"))


@query("a6_cost_by_model", over("usage", f""", {RATES_SQL}, c AS (SELECT provider, u.model, tokens_in, tokens_out, coalesce(ri, 0) * tokens_in + coalesce(ro, 0) * tokens_out AS cost FROM usage u LEFT JOIN rates r ON r.model = u.model WHERE provider <> 'error')
SELECT provider, model, sum(tokens_in)::BIGINT AS tokens_in, round(sum(cost), 4) AS cost_usd, grouping(provider) = 1 AS is_total FROM c GROUP BY GROUPING SETS ((provider, model), ())""").replace("\n, rates", ", rates"))  # fmt: skip
def a6(spark, d):
    """Cost of each provider and model, with the grand total; one provider is filtered out."""
    u = J.cost(usage(spark, d).where("provider <> 'error'"), rates(spark))
    return A.with_total(u, ["provider", "model"], tokens_in=F.sum("tokens_in"), cost_usd=F.round(F.sum("cost_usd"), 4))


@query("a7_actions_per_task", over("actions", "SELECT task_id, count(*) AS n FROM (SELECT * FROM actions ORDER BY ts DESC, ord DESC LIMIT 20) GROUP BY task_id"))
def a7(spark, d):
    """Tasks of the last 20 entries with their counts."""
    return actions(spark, d).orderBy(F.desc("ts"), F.desc("ord")).limit(20).groupBy("task_id").agg(F.count("*").alias("n"))


@query("a8_levels", "SELECT count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'signup') AS warnings, count(*) AS entries FROM events")
def a8(spark, d):
    return table(spark, d, "events").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_type") == "signup").alias("warnings"), F.count("*").alias("entries"))


@query("a9_complexity", "SELECT p_brand AS file, greatest(max(p_size), 1) AS max_complexity, round(avg(p_size), 6) AS avg_complexity, max(max(p_size)) OVER () AS project_max FROM part GROUP BY p_brand")
def a9(spark, d):
    """Complexity of each file and of the project; part sizes stand for functions."""
    f = A.file_complexity(table(spark, d, "part").select(F.col("p_brand").alias("file"), F.col("p_size").alias("complexity")))
    most = f.agg(F.max("max_complexity").alias("project_max"))
    return f.join(F.broadcast(most)).select("file", "max_complexity", F.round("avg_complexity", 6).alias("avg_complexity"), "project_max")


@query("a14_index_statistics", over("files chunks", "SELECT count(*) AS files, sum(c.token_count)::BIGINT AS tokens, sum(length(c.content))::BIGINT AS characters FROM files f JOIN chunks c ON c.file_id = f.id"))
def a14(spark, d):
    return chunks(spark, d).join(files(spark, d).select(F.col("id").alias("file_id")), "file_id").agg(F.count("*").alias("files"), F.sum("token_count").alias("tokens"), F.sum(F.length("content")).alias("characters"))


@query("a15_success_rates", "SELECT user_id, count(*) FILTER (event_type <> 'error') AS ok, count(*) FILTER (event_type = 'error') AS failed, round(avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END), 6) AS rate, round(avg(value), 4) AS mean_time FROM events GROUP BY user_id")
def a15(spark, d):
    ok = F.col("event_type") != "error"
    return table(spark, d, "events").groupBy("user_id").agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"), F.round(F.avg(ok.cast("double")), 6).alias("rate"), F.round(F.avg("value"), 4).alias("mean_time"))


@query("a16_checks_passed", "SELECT o_orderkey AS step, count(*) FILTER (l_returnflag <> 'R') || '/' || count(*) AS passed, bool_and(l_returnflag <> 'R') AS all_passed FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def a16(spark, d):
    """Passed checks of each step as n/m; line items stand for checks."""
    ok = F.col("l_returnflag") != "R"
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    return lines.groupBy(F.col("l_orderkey").alias("step")).agg(F.concat_ws("/", F.count_if(ok).cast("string"), F.count("*").cast("string")).alias("passed"), F.bool_and(ok).alias("all_passed"))


@query("u1_candidate_union", over("chunks", "SELECT 0 AS rank, id FROM chunks WHERE content ILIKE '%license%' UNION ALL SELECT 1, vec_id FROM embeddings WHERE label = 1"))
def u1(spark, d):
    """Graph candidates before vector candidates."""
    graph = chunks(spark, d).where(F.col("content").ilike("%license%")).select(F.lit(0).alias("rank"), "id")
    return graph.unionByName(table(spark, d, "embeddings").where("label = 1").select(F.lit(1).alias("rank"), F.col("vec_id").alias("id")))


@query("u2_distinct_union", "SELECT l_partkey AS file FROM lineitem WHERE l_returnflag = 'R' UNION SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'A'")
def u2(spark, d):
    """Working-tree and staged files, each once."""
    lines = table(spark, d, "lineitem")
    return lines.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("file")).union(lines.where("l_returnflag = 'A'").select("l_suppkey")).distinct()


@query("u3_tasks_first_seen", over("actions", "SELECT task_id, min(ord) AS first_seen FROM actions GROUP BY task_id"))
def u3(spark, d):
    return actions(spark, d).groupBy("task_id").agg(F.min("ord").alias("first_seen")).orderBy("first_seen")


@query("u4_tool_complement", "SELECT user_id, list_aggregate(list_sort(list_filter(['click', 'error', 'purchase', 'refund', 'signup', 'view'], lambda x: NOT list_contains(list(DISTINCT event_type), x))), 'string_agg', ',') AS missing FROM events GROUP BY user_id")
def u4(spark, d):
    """Tools of the vocabulary that a task never used; null where it used all."""
    every = F.array(*map(F.lit, ["click", "error", "purchase", "refund", "signup", "view"]))
    used = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("used"))
    missing = F.array_sort(F.array_except(every, "used"))
    return used.select("user_id", F.when(F.size(missing) > 0, F.array_join(missing, ",")).alias("missing"))


@query("k3_latest", over("actions", "SELECT ord, ts, task_id FROM actions ORDER BY ts DESC, ord DESC LIMIT 100"))
def k3(spark, d):
    return actions(spark, d).orderBy(F.desc("ts"), F.desc("ord")).limit(100).select("ord", "ts", "task_id")


@query("k4_smallest_candidates", over("chunks", "SELECT id, token_count FROM chunks WHERE content ILIKE '%the%' ORDER BY token_count, id LIMIT 50"))
def k4(spark, d):
    return chunks(spark, d).where(F.col("content").ilike("%the%")).orderBy("token_count", "id").limit(50).select("id", "token_count")


@query("k5_limit_per_fragment", over("files", "SELECT fragment, id FROM (SELECT f.id, g.fragment, row_number() OVER (PARTITION BY g.fragment ORDER BY f.id) AS rk FROM files f JOIN (VALUES ('src1'), ('.fr'), ('7')) g(fragment) ON f.path ILIKE '%' || g.fragment || '%') WHERE rk <= 10"))
def k5(spark, d):
    """At most ten files for each path fragment."""
    from ..operators.predicates import path_fragments

    wanted = spark.createDataFrame([("src1",), ("7",), (".fr",)], "fragment string")
    rank = F.row_number().over(Window.partitionBy("fragment").orderBy("id"))
    return path_fragments(files(spark, d).select("id", "path"), wanted).withColumn("rk", rank).where("rk <= 10").select("fragment", "id")


@query("k6_worst_functions", over("symbols", "SELECT id, \"start\" AS complexity, (SELECT count(*) FROM symbols WHERE \"start\" > 10) - 10 AS more FROM symbols WHERE \"start\" > 10 ORDER BY \"start\" DESC, id LIMIT 10"))
def k6(spark, d):
    """The ten worst above the limit, and how many more there are."""
    s = symbols(spark, d).select("id", F.col("start").alias("complexity")).where("complexity > 10")
    more = s.agg((F.count("*") - 10).alias("more"))
    return s.orderBy(F.desc("complexity"), "id").limit(10).join(F.broadcast(more))


@query("k7_oldest_turns", over("turns", "SELECT session_id, id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id) AS rk FROM turns) WHERE rk <= 2"))
def k7(spark, d):
    """The oldest two turns of every session."""
    return turns(spark, d).withColumn("rk", F.row_number().over(Window.partitionBy("session_id").orderBy("id"))).where("rk <= 2").select("session_id", "id")


@query("k8_graph_dump", over("edges", "(SELECT 'node' AS what, id AS a, NULL::BIGINT AS b FROM (SELECT p_partkey AS id FROM part ORDER BY 1 LIMIT 500)) UNION ALL (SELECT 'edge', src, dst FROM (SELECT src, dst FROM edges ORDER BY src, dst LIMIT 2000))"))
def k8(spark, d):
    """At most 500 nodes and 2,000 edges, by key."""
    nodes = symbols(spark, d).orderBy("id").limit(500).select(F.lit("node").alias("what"), F.col("id").alias("a"), F.lit(None).cast("long").alias("b"))
    return nodes.unionByName(edges(spark, d).orderBy("src", "dst").limit(2000).select(F.lit("edge").alias("what"), F.col("src").alias("a"), F.col("dst").alias("b")))
