"""Ordered logic."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import logs as L
from ..operators import sequences as S
from ..sources.partitions import tasks_for
from .registry import query, table
from .relations import chunks, over, token_estimate, turns


@query("w1_budget_fill_ascending", over("chunks", "SELECT id, token_count, used FROM (SELECT id, token_count, sum(token_count) OVER (ORDER BY token_count, id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM (SELECT * FROM chunks WHERE content ILIKE '%the%' ORDER BY token_count, id LIMIT 50)) WHERE used <= 2000"))
def w1(spark, d):
    """Keyword retrieval under a budget of 2,000 tokens: the 50 smallest hits, as many as fit."""
    hits = chunks(spark, d).where(F.col("content").ilike("%the%")).select("id", "token_count").orderBy("token_count", "id").limit(50)
    return S.budget_prefix(hits, 2000)


def _turn_tokens(spark, d):
    return turns(spark, d).select("session_id", "id", F.col("id").alias("ord"), token_estimate(F.col("content")).alias("tokens"))


@query("w2_budget_fill_in_order", over("turns", """, t AS (SELECT session_id, id, (length(content) + 3) // 4 AS tokens, row_number() OVER (PARTITION BY session_id ORDER BY id) AS rn FROM turns),
f AS (SELECT session_id, id, rn, CASE WHEN tokens <= 200 THEN tokens ELSE 0 END AS used, tokens <= 200 AS taken FROM t WHERE rn = 1
 UNION ALL SELECT t.session_id, t.id, t.rn, f.used + CASE WHEN f.used + t.tokens <= 200 THEN t.tokens ELSE 0 END, f.used + t.tokens <= 200 FROM f JOIN t ON t.session_id = f.session_id AND t.rn = f.rn + 1)
SELECT session_id, id, used::BIGINT AS used FROM f WHERE taken""").replace("\n, t AS", ", t AS"))  # fmt: skip
def w2(spark, d):
    """Turns of each session in order within 200 tokens, skipping what does not fit."""
    return S.budget_in_order(_turn_tokens(spark, d), 200, "session_id")


@query("w3_first_occurrence", "SELECT min(doc_id) AS id FROM documents GROUP BY source, substr(text, 1, 64)")
def w3(spark, d):
    """The first document of each source and first 64 characters."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", F.substring("text", 1, 64).alias("head"))
    return S.first_of_each(docs, [F.col("source"), F.col("head")], "id").select("id")


_PLANS = "p AS (SELECT DISTINCT o_custkey AS plan, o_orderkey AS step, l_partkey % 50 AS file, o_orderstatus <> 'P' AS success FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"


def _plans(spark, d):
    """Steps (orders) of plans (customers) with their files (parts), dealt by plan to as many tasks as the lines' bytes need."""
    tasks = tasks_for(table(spark, d, "lineitem"))
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("plan"), F.col("o_orderkey").alias("step"), (F.col("o_orderstatus") != "P").alias("success"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("step"), (F.col("l_partkey") % 50).alias("file"))
    both = orders.repartition(tasks, "step").join(lines.repartition(tasks, "step"), "step")
    return both.select("plan", "step", "file", "success").repartition(tasks, "plan").distinct()


@query("w5_parallel_groups", f"""WITH {_PLANS}, f AS (SELECT *, min(step) OVER (PARTITION BY plan, file) AS first FROM p), s AS (SELECT plan, step, bool_or(first < step) AS conflict FROM f GROUP BY plan, step)
SELECT plan, step, conflict, sum(CASE WHEN conflict OR rn = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY plan ORDER BY step)::BIGINT AS "group" FROM (SELECT *, row_number() OVER (PARTITION BY plan ORDER BY step) AS rn FROM s)""")  # fmt: skip
def w5(spark, d):
    return S.parallel_groups(_plans(spark, d))


@query("w6_file_conflicts", f"WITH {_PLANS}, s AS (SELECT * FROM p WHERE success) SELECT s.plan, s.file, o.owner AS step_a, s.step AS step_b FROM s JOIN (SELECT plan, file, min(step) AS owner FROM s GROUP BY ALL) o ON o.plan = s.plan AND o.file = s.file WHERE s.step <> o.owner")
def w6(spark, d):
    return S.file_conflicts(_plans(spark, d))


@query("w7_modified_files", """WITH r AS (SELECT o_orderkey AS step, unnest(['src/a' || o_custkey || '.ts', 'lib/' || o_orderkey % 7 || '.txt', CASE WHEN o_orderkey % 2 = 0 THEN 'x/y.go' ELSE 'src/a' || o_custkey || '.ts' END]) AS file FROM orders)
SELECT DISTINCT step, file FROM r""")  # fmt: skip
def w7(spark, d):
    """Files that each step's output names; outputs are made up from orders."""
    out = F.expr("concat('Edit:  src/a', o_custkey, '.ts\nok\n+++ b/lib/', o_orderkey % 7, '.txt \nEdit: notes.md\n', CASE WHEN o_orderkey % 2 = 0 THEN 'diff --git a/x/z.go b/x/y.go' ELSE concat('Created: src/a', o_custkey, '.ts') END)")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("step"), F.explode(S.modified_files(out)).alias("file"))


@query("w8_chunk_overlap", over("turns", """, t AS (SELECT session_id, id, content, right(lag(content) OVER (PARTITION BY session_id ORDER BY id), 300) AS b FROM turns)
SELECT session_id, id, CASE WHEN b IS NULL THEN id * 10 + 1 ELSE greatest(1, id * 10 + 1 - (length(b) - length(replace(b, chr(10), '')) + 1)) END AS start_line, md5(coalesce(b || chr(10), '') || content) AS content FROM t""").replace("\n, t AS", ", t AS"))  # fmt: skip
def w8(spark, d):
    """Turns as chunks, each with the last 300 characters of the one before."""
    t = turns(spark, d).select("session_id", "id", "content", (F.col("id") * 10 + 1).alias("start_line"))
    return S.with_overlap(t, "session_id", "id").select("session_id", "id", "start_line", F.md5("content").alias("content"))


@query("w9_fifo_cache", over("turns", """, t AS (SELECT session_id, id, (length(content) + 3) // 4 AS tokens FROM turns)
SELECT session_id, id, tokens <= 300 AND sum(CASE WHEN tokens <= 300 THEN tokens ELSE 0 END) OVER (PARTITION BY session_id ORDER BY id DESC ROWS UNBOUNDED PRECEDING) <= 300 AS hot FROM t""").replace("\n, t AS", ", t AS"))  # fmt: skip
def w9(spark, d):
    return S.fifo_hot(_turn_tokens(spark, d), 300, "session_id", "ord").select("session_id", "id", "hot")


RESET_MS = 21_600_000
_CALLS = """c AS (SELECT user_id, event_id AS id, epoch_us(ts) // 1000 AS t, event_type IN ('error', 'view', 'click') AS failed FROM events),
s AS (SELECT *, row_number() OVER w AS rn, max(CASE WHEN NOT failed THEN id END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ok, max(CASE WHEN failed THEN t END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM c WINDOW w AS (PARTITION BY user_id ORDER BY t, id))"""


@query("w10_circuit_breaker", f"""WITH {_CALLS} SELECT user_id, id, failed, coalesce((SELECT count(*) FROM c WHERE c.user_id = s.user_id AND c.failed AND c.id > coalesce(s.ok, -1) AND c.id < s.id) >= 3 AND t - last <= {RESET_MS}, false) AS open FROM s""")
def w10(spark, d):
    """Whether each user's breaker is open at each call; three kinds of events stand for failures, six hours for the reset time."""
    calls = table(spark, d, "events").select("user_id", F.col("event_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("t"), F.col("event_type").isin("error", "view", "click").alias("failed"))
    return S.breaker_open(calls, "user_id", "t", "id", "failed", reset_ms=RESET_MS).select("user_id", "id", "failed", "open")


@query("w11_backoff", "SELECT user_id, attempt, 500 * CAST(2 ^ (attempt - 1) AS BIGINT) AS delay_ms FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest([1, 2]) AS attempt)")
def w11(spark, d):
    """Delays after the first two of three attempts."""
    users = table(spark, d, "events").select("user_id").distinct()
    return S.backoff(users.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(2)))))


@query("w12_budget_monitor", over("turns", """SELECT session_id, id, round(used / total, 6) AS ratio, CASE WHEN used / total >= 1 THEN 'error' WHEN used / total >= 0.9 THEN 'warning' END AS severity FROM
(SELECT session_id, id, sum((length(content) + 3) // 4) OVER (PARTITION BY session_id ORDER BY id) AS used, nullif(session_id % 4, 0) * 200 AS total FROM turns)"""))  # fmt: skip
def w12(spark, d):
    """Budgets of 0, 200, 400 and 600 tokens by session."""
    out = S.budget_events(_turn_tokens(spark, d), F.col("session_id") % 4 * 200, "session_id", "ord")
    return out.select("session_id", "id", F.round("ratio", 6).alias("ratio"), "severity")


@query("w13_renumber", "SELECT o_custkey AS plan, o_orderkey AS old_step, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS step FROM orders")
def w13(spark, d):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return table(spark, d, "orders").select(F.col("o_custkey").alias("plan"), F.col("o_orderkey").alias("old_step"), n.cast("long").alias("step"))


@query("w14_keep_last", over("turns", "SELECT session_id, id FROM turns QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY id DESC) <= 5"))
def w14(spark, d):
    return S.keep_last(turns(spark, d).select("session_id", "id"), "session_id", "id", 5)


def log_lines(spark, d):
    """A log per user: a line for every event, two frames after errors, an empty line after sign-ups."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss").alias("at"))
    head = F.concat_ws(" ", "at", F.upper("event_type"), F.lit("\x1b[31mrequest\x1b[0m"), F.col("event_id").cast("string"))
    frames = F.array(F.lit("    at handle (/srv/app.js:10:5)"), F.concat(F.lit("  at /srv/lib/"), F.col("event_id").cast("string"), F.lit(".js:7:1")))
    lines = F.when(F.col("event_type") == "error", F.concat(F.array(head), frames)).when(F.col("event_type") == "signup", F.array(head, F.lit("  "))).otherwise(F.array(head))
    return e.select("user_id", "event_id", F.posexplode(lines).alias("n", "raw")).select("user_id", (F.col("event_id") * 10 + F.col("n")).alias("line"), "raw")


_LOG = """WITH e AS (SELECT user_id, event_id * 10 AS line, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, event_type AS t, strftime(ts, '%Y-%m-%dT%H:%M:%S') || ' ' || upper(event_type) || ' request ' || event_id AS message,
CASE event_type WHEN 'error' THEN 2 ELSE 0 END AS n_frames, event_id FROM events)"""


@query("w15_stack_lines", _LOG + " SELECT user_id, line, message, n_frames FROM e")
def w15(spark, d):
    """Log entries with the number of stack lines attached to each."""
    return L.parse_lines(log_lines(spark, d), "user_id").select("user_id", "line", "message", F.size("stack").alias("n_frames"))


@query("t9_log_parsing", _LOG + """ SELECT user_id, line, CASE t WHEN 'error' THEN 'error' ELSE 'unknown' END AS level, timestamp, CASE WHEN t = 'error' THEN 'handle' END AS fn, CASE WHEN t = 'error' THEN '/srv/app.js:10:5' END AS at,
CASE WHEN t = 'error' THEN '/srv/lib/' || event_id || '.js' END AS second_file FROM e""")  # fmt: skip
def t9(spark, d):
    """Level, time and frames of every log entry."""
    p = L.parse_lines(log_lines(spark, d), "user_id")
    first, second = F.get("stack", F.lit(0)), F.get("stack", F.lit(1))
    return p.select("user_id", "line", "level", "timestamp", first["fn"].alias("fn"), F.concat_ws(":", first["file"], first["line"], first["col"]).alias("at"), second["file"].alias("second_file")).withColumn("at", F.when(F.col("fn").isNotNull(), F.col("at")))


@query("x8_level_detection", "SELECT event_id AS id, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn' WHEN 'view' THEN 'info' WHEN 'click' THEN 'debug' ELSE 'unknown' END AS level FROM events")
def x8(spark, d):
    lines = F.expr("""CASE event_type WHEN 'error' THEN 'x FATAL info' WHEN 'signup' THEN '{"level":40}' WHEN 'view' THEN 'INFO debug' WHEN 'click' THEN 'verbose' ELSE 'plain' END""")
    return table(spark, d, "events").select(F.col("event_id").alias("id"), X.log_level(lines).alias("level"))
