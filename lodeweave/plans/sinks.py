"""Sources, sinks, catalog tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.joins import change_diff
from ..operators.retrieval import retrieve
from ..operators.vectors import top_k
from ..sources import files as S
from ..sources import records as R
from ..sources import tables as T
from ..sources.worktables import new_path
from .registry import query, table
from .relations import actions, chunks, files, over
from .sequences import log_lines

TABLES = ["benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation", "orders", "pages", "part", "region", "supplier"]
_NAMES = "(VALUES " + ", ".join(f"('{t}')" for t in TABLES) + ") t(name)"
PARQUET = {"parquet": "table"}


def _scan(spark, d):
    """The data folder as a source tree; a table may be a file or a folder of files."""
    found = S.scan(spark, d, PARQUET, content=False)
    return found.withColumn("name", F.regexp_extract("path", r"^([a-z]+)\.parquet", 1))


@query("s1_source_walk", f"SELECT name, 'table' AS lang FROM {_NAMES}")
def s1(spark, d):
    return _scan(spark, d).select("name", "lang").distinct()


@query("s2_project_profile", "SELECT 'table' AS lang, 14::BIGINT AS n, 14::BIGINT AS file_count, false AS has_tests")
def s2(spark, d):
    return S.profile(S.scan(spark, d, PARQUET, content=False, mapped=False))


@query("s3_quality_walk", f"SELECT name FROM {_NAMES} WHERE name NOT LIKE 'l%'")
def s3(spark, d):
    """A walk that skips some names."""
    found = S.scan(spark, d, PARQUET, skipped=["node_modules", "dist", "lineitem.parquet", "labels.parquet"], content=False)
    return found.select(F.regexp_extract("path", r"^([a-z]+)\.parquet", 1).alias("name")).distinct()


@query("s4_hash_scan", "SELECT n_nationkey AS id, sha256(n_name || chr(10)) AS hash FROM nation WHERE n_nationkey NOT IN (2, 3, 20, 21, 22, 23, 24)")
def s4(spark, d):
    """SHA-256 of the files that ignore patterns leave; a file a nation."""
    path = new_path(spark, "tree")
    table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("value")).coalesce(1).write.partitionBy("id").text(path)
    keep = S.hashes(spark, path, ["id=3", "id=2*/"], {"txt": "text"})
    return keep.select(F.regexp_extract("path", r"^id=([0-9]+)/", 1).cast("int").alias("id"), "hash")


@query("s5_open_model", "SELECT name, CASE name WHEN 'files' THEN (SELECT count(*) FROM documents) ELSE 0 END AS n FROM (SELECT unnest(['chunks', 'cold_context', 'edges', 'facts', 'files', 'manifests', 'session_turns', 'sessions', 'shared_facts', 'symbols', 'usage']) AS name)")
def s5(spark, d):
    """The model's tables and their rows after creating them, filling one with all documents, and creating them again."""
    db = f"model_{uuid.uuid4().hex[:12]}"
    T.open_model(spark, db)
    files(spark, d).select("id", "path", "hash", "lang", "mtime", F.lit(None).cast("bigint").alias("indexed_at")).write.insertInto(f"`{db}`.files")
    rows = [(n, spark.table(f"`{db}`.`{n}`").count()) for n in T.open_model(spark, db)]
    spark.sql(f"DROP DATABASE `{db}` CASCADE")
    return spark.createDataFrame(rows, "name string, n bigint")


@query("s6_vector_collection", "SELECT vec_id::VARCHAR AS id FROM embeddings WHERE vec_id % 2 = 1 ORDER BY list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) - 2 * embedding[1]::DOUBLE, vec_id::VARCHAR LIMIT 5")
def s6(spark, d):
    """A collection created, filled, half deleted and searched with a unit vector."""
    store = T.VectorStore(spark, "vectors")
    name = f"c_{uuid.uuid4().hex[:12]}"
    store.create(name, 64)
    rows = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), F.lit("").alias("content"), F.lit("f").alias("relativePath"), F.lit(1).alias("startLine"), F.lit(2).alias("endLine"), F.lit("ts").alias("fileExtension"), F.lit("{}").alias("metadata"))
    store.insert(name, rows)
    store.delete(name, rows.where("cast(id AS bigint) % 2 = 0"))
    return top_k(store.table(name), [1.0] + [0.0] * 63, 5, vector="vector").select("id")


@query("s7_append_log", over("actions", "SELECT kind, count(*) AS n, count(DISTINCT task_id) AS tasks FROM actions GROUP BY kind"))
def s7(spark, d):
    """The action log written by two appends and read back strictly."""
    path = new_path(spark, "actions")
    a = actions(spark, d).select("ts", F.col("task_id").alias("taskId"), "kind", F.from_json("payload", "map<string,string>").alias("payload"))
    R.append_actions(a.where("ts % 2 = 0"), path)
    R.append_actions(a.where("ts % 2 <> 0"), path)
    return R.read_actions(spark, path).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("taskId").alias("tasks"))


@query("s8_lenient_log", over("actions", "SELECT ts, task_id FROM actions WHERE ord % 10 <> 0 ORDER BY ts DESC, task_id, kind LIMIT 50"))
def s8(spark, d):
    """A log in which every tenth line is broken: the newest 50 of the others."""
    path = new_path(spark, "lenient")
    good = F.to_json(F.struct("ts", F.col("task_id").alias("taskId"), "kind"))
    actions(spark, d).select(F.when(F.col("ord") % 10 == 0, F.lit('{"ts": oops')).otherwise(good).alias("value")).write.text(path)
    return R.read_actions(spark, path, strict=False, last=50).select("ts", F.col("taskId").alias("task_id"))


@query("s9_text_logs", "SELECT CASE event_type WHEN 'error' THEN 'error' ELSE 'unknown' END AS level, count(*) AS n, (count(*) FILTER (event_type = 'error') * 2)::BIGINT AS frames FROM events GROUP BY 1")
def s9(spark, d):
    """Logs written as text files, a few for all users, and parsed again."""
    path = new_path(spark, "logs")
    log_lines(spark, d).repartition(4, "user_id").sortWithinPartitions("user_id", "line").select("raw").write.text(path)
    return R.read_logs(spark, path).groupBy("level").agg(F.count("*").alias("n"), F.sum(F.size("stack")).alias("frames"))


@query("s10_snapshot", over("files", "SELECT path, 'removed' AS change FROM files WHERE id % 5 = 0"))
def s10(spark, d):
    """A snapshot built at the first load, read at the second, and compared."""
    path, f = new_path(spark, "snapshot"), files(spark, d).select("path", "hash", "id")
    S.load_snapshot(spark, path, f)
    return change_diff(S.load_snapshot(spark, path, f.where("false")), f.where("id % 5 > 0"))


@query("s11_config", "SELECT 'auto' AS default_agent, count(DISTINCT source) AS retries, false AS absent_is_error FROM documents")
def s11(spark, d):
    """A configuration, a retry for each source of documents, over defaults; an absent file gives the defaults."""
    path = new_path(spark, "config")
    retries = table(spark, d, "documents").agg(F.concat(F.lit("retries: "), F.countDistinct("source").cast("string")).alias("value"))
    retries.coalesce(1).write.text(path)
    defaults = {"default_agent": "auto", "retries": 3}
    found, none = R.read_config(spark, path, defaults), R.read_config(spark, path + "-absent", defaults)
    return spark.createDataFrame([(found["default_agent"], found["retries"], none != defaults)], "default_agent string, retries bigint, absent_is_error boolean")


@query("s12_decisions", "SELECT '## ' || source || chr(10) || chr(10) || count(*) || ' documents' || chr(10) AS text, 'decision' AS tags FROM documents GROUP BY source")
def s12(spark, d):
    """A decision for each source, appended to the facts as markdown."""
    path = new_path(spark, "decisions")
    rows = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.min("doc_id").alias("ts"))
    R.append_decisions(rows.select(F.col("source").alias("title"), F.concat_ws(" ", F.col("n").cast("string"), F.lit("documents")).alias("body"), "ts"), path)
    return spark.read.parquet(path).select("text", "tags")


@query("s13_shared_store", "SELECT min(doc_id)::VARCHAR AS id, sha256(text) AS hash FROM documents GROUP BY text")
def s13(spark, d):
    """Facts pushed twice to an encrypted store and pulled: each text once."""
    path, key = new_path(spark, "team"), X.passphrase_key("team", b"lodeweave-team")
    facts = table(spark, d, "documents").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("id"), "text", F.col("doc_id").alias("created_at"))
    T.push_facts(facts, spark.createDataFrame([], T.MODEL["shared_facts"]), key, "me").write.parquet(path)
    store = spark.read.parquet(path)
    again = T.push_facts(facts, store, key, "you")
    return T.pull_facts(store.unionByName(again), key).select(F.col("id").cast("long").cast("string").alias("id"), F.sha2("text", 256).alias("hash"))


@query("s14_report", "SELECT count(*) AS n, round(avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END), 6) AS success_rate, round(avg(value), 4) AS mean_ms FROM events")
def s14(spark, d):
    """A benchmark report over all events: result rows written as JSON lines and read back, totals from what was read."""
    path = new_path(spark, "report")
    rows = table(spark, d, "events").select(F.col("event_id").cast("string").alias("name"), F.col("value").alias("ms"), (F.col("event_type") != "error").alias("ok"))
    R.write_results(rows, path)
    return R.report_totals(R.read_results(spark, path)).select("n", F.round("success_rate", 6).alias("success_rate"), F.round("mean_ms", 4).alias("mean_ms"))


class EveryHundredth:
    """A stand-in for a vector store: each step gets the documents whose id ends in its number."""

    def __init__(self, documents):
        self.documents = documents

    def search(self, steps, k):
        from pyspark.sql import Window

        hits = self.documents.join(F.broadcast(steps), F.col("doc_id") % 100 == F.col("step"))
        rank = F.row_number().over(Window.partitionBy("step").orderBy("doc_id"))
        return hits.select("step", rank.alias("rank"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content")).where(F.col("rank") <= k)


_EXPECTED = [(1, "src1/", 0), (1, "7.en", 1), (2, "src2/", 0), (3, "none", 0)]


@query("e4_plug_ins", over("files chunks", """, x(step, fragment, n) AS (VALUES (1, 'src1/', 0), (1, '7.en', 1), (2, 'src2/', 0), (3, 'none', 0)),
g AS (SELECT x.step, 0 AS side, x.n, row_number() OVER (PARTITION BY x.step, x.fragment ORDER BY c.id) AS rk, x.fragment AS path, c.content FROM x JOIN files f ON f.path ILIKE '%' || x.fragment || '%' JOIN chunks c ON c.file_id = f.id),
v AS (SELECT doc_id % 100 AS step, 1 AS side, 0 AS n, row_number() OVER (PARTITION BY doc_id % 100 ORDER BY doc_id) AS rk, source || '/' || doc_id AS path, text AS content FROM documents WHERE doc_id % 100 IN (1, 2, 3)),
a AS (SELECT * FROM g WHERE rk <= 10 UNION ALL SELECT * FROM v WHERE rk <= 5),
u AS (SELECT *, row_number() OVER (PARTITION BY step, path, substr(content, 1, 64) ORDER BY side, n, rk) AS one FROM a),
t AS (SELECT step, row_number() OVER (PARTITION BY step ORDER BY side, n, rk) AS id, path, (length(content) + 3) // 4 AS tokens FROM u WHERE one = 1),
r AS (SELECT step, id, path, CASE WHEN tokens <= 2000 THEN tokens ELSE 0 END AS used, tokens <= 2000 AS taken FROM t WHERE id = 1
 UNION ALL SELECT t.step, t.id, t.path, r.used + CASE WHEN r.used + t.tokens <= 2000 THEN t.tokens ELSE 0 END, r.used + t.tokens <= 2000 FROM r JOIN t ON t.step = r.step AND t.id = r.id + 1)
SELECT step::INT AS step, id::INT AS id, path, used::BIGINT AS used FROM r WHERE taken""").replace("\n, x(", ", x("))  # fmt: skip
def e4(spark, d):
    """Retrieval for three steps with a vector store and a progress callback plugged in."""
    docs = table(spark, d, "documents")
    steps = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], "step int, intent string")
    expected = spark.createDataFrame(_EXPECTED, "step int, fragment string, n int")
    seen = []
    out = retrieve(steps, expected, files(spark, d), chunks(spark, d), EveryHundredth(docs), 2000, progress=seen.append)
    return out.select("step", "id", "path", "used")
