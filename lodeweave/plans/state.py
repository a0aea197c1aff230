"""ST1 to ST9, M1 to M7 and event-time windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import mutations as M
from ..operators import sequences as S
from ..sources.runs import RunTable
from ..sources.worktables import new_path
from ..streaming import sinks, stateful, timed, windows
from .registry import query, table
from .relations import edges, over, snapshots, symbols, turns
from .sequences import _CALLS, RESET_MS


def stream(spark, d, name):
    """A table as a stream of its files. A glob, as the source takes a plain path for a folder and a table may be one file."""
    return spark.readStream.schema(table(spark, d, name).schema).option("maxFilesPerTrigger", 4).parquet(f"{d}/{name}.parque[t]")


EVERY, KEEP = 4, 1
_ROLL = f"SELECT conv_id AS session_id, turn_no FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn_no FROM conversations) WHERE turn_no >= {EVERY} AND (turn_no - {EVERY}) % ({EVERY} - {KEEP}) = 0"


@query("st1_session_rollover", _ROLL)
def st1(spark, d):
    """Turns at which sessions are summarised, every 4 stored rows with 1 kept: the closed form."""
    n = F.row_number().over(Window.partitionBy("session_id").orderBy("id")).cast("long")
    return turns(spark, d).select("session_id", n.alias("turn_no")).where(S.rollovers(F.col("turn_no"), EVERY, KEEP))


@query("st1_session_rollover_stream", _ROLL)
def st1_stream(spark, d):
    """The same from a stream with state."""
    rows = stream(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("id"))
    return sinks.drain(stateful.rollover_stream(rows, EVERY, KEEP), "rollovers")


@query("st2_pager_stream")
def st2(spark, d):
    """Turns are added to a cache of 300 tokens per conversation; each later turn reads the first again. Tests hold it against a plain loop."""
    rows = stream(spark, d, "conversations")
    tokens = F.ceil(F.length("text") / 4).cast("long")
    ops = rows.select(F.col("conv_id").alias("cache"), F.explode(F.array(
        F.struct((F.col("turn") * 2).alias("ord"), F.lit("add").alias("op"), F.col("turn").cast("string").alias("item"), tokens.alias("tokens")),
        F.struct((F.col("turn") * 2 + 1).alias("ord"), F.lit("read").alias("op"), F.lit("0").alias("item"), F.lit(0).cast("long").alias("tokens")),
    )).alias("o")).select("cache", "o.*")
    return sinks.drain(stateful.pager_stream(ops, 300), "pager")


@query("st3_incremental_read", "SELECT event_id AS id, event_type FROM events")
def st3(spark, d):
    """All events through a file stream with a checkpoint: each file once, none missed."""
    return sinks.drain(stream(spark, d, "events").select(F.col("event_id").alias("id"), "event_type"), "incremental")


@query("st3_high_water_mark", "SELECT event_id AS id FROM events WHERE epoch_us(ts) // 1000 > 1704844800000")
def st3_mark(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("created_at"))
    return sinks.after_mark(rows, 1_704_844_800_000)[0].select("id")


@query("st4_log_tail")
def st4(spark, d):
    """The last event of every micro-batch; how many there are depends on the files."""
    path = new_path(spark, "tail")
    sinks.each_batch(stream(spark, d, "events"), sinks.tail(f"{path}/rows", "event_id"), f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/rows").select("event_id", "event_type")


@query("st5_poll_and_diff", over("old_files new_files", """SELECT path, 'added' AS change, 1 AS poll FROM old_files UNION ALL SELECT coalesce(o.path, n.path), CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'modified' END, 2
FROM old_files o FULL JOIN new_files n ON o.path = n.path WHERE o.hash IS DISTINCT FROM n.hash OR o.path IS NULL OR n.path IS NULL"""))  # fmt: skip
def st5(spark, d):
    """Two polls: the first finds everything new, the second what changed."""
    path = new_path(spark, "polls")
    held, out = RunTable(spark, f"{path}/snapshots", "path bigint, hash string", ["path"]), []
    for n, snapshot in enumerate(snapshots(spark, d), 1):
        sinks.diff_with_last(held, f"{path}/changes")(snapshot, n)
        out.append(spark.read.parquet(f"{path}/changes/batch={n}").withColumn("poll", F.lit(n)))
    return reduce(DataFrame.unionByName, out)


@query("st6_incremental_upsert", over("old_files new_files", "SELECT path, hash FROM new_files UNION ALL SELECT path, hash FROM old_files WHERE path NOT IN (SELECT path FROM new_files)"))
def st6(spark, d):
    """The file table after two batches, one of which comes twice; equal hashes are skipped."""
    held = RunTable(spark, new_path(spark, "upserts"), "path bigint, hash string", ["path"])
    write = sinks.upsert_changed(held)
    old, new = snapshots(spark, d)
    for n, batch in ((0, old), (1, new), (1, new), (2, new)):
        write(batch, n)
    return held.read()


@query("st7_config_reload", "SELECT event_id, event_type FROM events WHERE event_type <> 'error'")
def st7(spark, d):
    """Events that the configuration of their micro-batch lets through."""
    path = new_path(spark, "config")
    spark.createDataFrame([("error",)], "deny string").coalesce(1).write.json(f"{path}/config")
    read = lambda s: {"deny": [r.deny for r in s.read.schema("deny string").json(f"{path}/config").collect()]}
    write = lambda batch, n, config: batch.where(~F.col("event_type").isin(config["deny"])).write.mode("overwrite").parquet(f"{path}/rows/batch={n}")
    sinks.each_batch(stream(spark, d, "events").select("event_id", "event_type"), sinks.with_config(read, write), f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/rows").select("event_id", "event_type")


@query("st8_breaker_stream", f"""WITH {_CALLS} SELECT user_id AS provider, id, coalesce((SELECT count(*) FROM c WHERE c.user_id = s.user_id AND c.failed AND c.id > coalesce(s.ok, -1) AND c.id < s.id) >= 3 AND t - last <= {RESET_MS}, false) AS open FROM s""")
def st8(spark, d):
    """W10 from a stream with state per provider."""
    calls = stream(spark, d, "events").select(F.col("user_id").alias("provider"), F.col("event_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("t"), F.col("event_type").isin("error", "view", "click").alias("failed"))
    return sinks.drain(stateful.breaker_stream(calls, reset_ms=RESET_MS), "breaker")


@query("st8_breaker_in_order", f"""WITH {_CALLS} SELECT user_id AS provider, id, coalesce((SELECT count(*) FROM c WHERE c.user_id = s.user_id AND c.failed AND c.id > coalesce(s.ok, -1) AND c.id < s.id) >= 3 AND t - last <= {RESET_MS}, false) AS open FROM s""")
def st8_in_order(spark, d):
    """The same in order of event time, with rows that wait for the watermark; a last row beyond all times lets them go."""
    path = new_path(spark, "ordered")
    schema = "provider bigint, at timestamp, id bigint, failed boolean"
    spark.createDataFrame([], schema).write.parquet(f"{path}/end")
    calls = stream(spark, d, "events").select(F.col("user_id").alias("provider"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("id"), F.col("event_type").isin("error", "view", "click").alias("failed"))
    calls = calls.unionByName(spark.readStream.schema(schema).parquet(f"{path}/end"))
    last = spark.sql("SELECT CAST(NULL AS bigint) AS provider, TIMESTAMP '2200-01-01' AS at, CAST(-1 AS bigint) AS id, false AS failed")
    return timed.drain_closed(timed.breaker_in_order(calls, "3650 days", reset_ms=RESET_MS), lambda: last.write.mode("append").parquet(f"{path}/end"), path).where("id >= 0")


@query("st9_single_writer", "SELECT event_id, user_id FROM events")
def st9(spark, d):
    """One stream is the only writer; each batch writes its own folder, so that a repeated one replaces itself."""
    path = new_path(spark, "writer")
    sinks.each_batch(stream(spark, d, "events").select("event_id", "user_id"), sinks.append_once(f"{path}/rows"), f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/rows").select("event_id", "user_id")


_MANIFEST = "SELECT user_id AS task, CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_type END AS symbol, event_id AS ts, value AS tokens FROM events"


@query("m1_upsert", f"WITH m AS ({_MANIFEST}) SELECT task, symbol, ts, tokens FROM m WHERE symbol IS NULL UNION ALL (SELECT task, symbol, max(ts), arg_max(tokens, ts) FROM m WHERE symbol IS NOT NULL GROUP BY task, symbol)")
def m1(spark, d):
    """Manifest entries: the last of each task and symbol; those without a symbol never replace one another."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("task"), F.when(F.col("event_id") % 10 != 0, F.col("event_type")).alias("symbol"), F.col("event_id").alias("ts"), F.col("value").alias("tokens"))
    return M.upsert(rows.where("ts < 5000"), rows.where("ts >= 5000"), ["task", "symbol"], ["ts"])


@query("m2_insert_or_ignore", over("edges", "SELECT src, CASE WHEN src % 3 = 0 THEN max(dst) ELSE min(dst) END AS dst FROM edges GROUP BY src"))
def m2(spark, d):
    """The first edge of every source stays: a third of them are held with their last one, which the batch cannot replace."""
    e = edges(spark, d).select("src", "dst")
    held = e.where("src % 3 = 0").groupBy("src").agg(F.max("dst").alias("dst"))
    return M.insert_ignore(held, e, ["src"], ["dst"])


@query("m1_runs", over("edges", "SELECT src, CASE WHEN src % 5 = 0 THEN max(dst) + 1 WHEN src % 3 = 0 THEN max(dst) ELSE min(dst) END AS dst FROM edges WHERE src % 7 <> 0 GROUP BY src"))
def m1_runs(spark, d):
    """A kept table after a batch of puts, one of inserts that ignore what is held, puts with deletes, and a merge of the runs."""
    e = edges(spark, d).select("src", "dst")
    held = RunTable(spark, new_path(spark, "edges"), "src bigint, dst bigint", ["src"])
    held.write(e.where("src % 3 = 0"))
    held.insert_ignore(e)
    held.write(e.where("src % 5 = 0 AND src % 7 <> 0").select("src", (F.col("dst") + 1).alias("dst")), e.where("src % 7 = 0"))
    held.write(e.where("false"))
    held.compact()
    return held.read()


@query("m3_cascade_delete", over("symbols edges", """SELECT 'symbols' AS relation, count(*) AS n, count(parent_id) AS linked FROM (SELECT CASE WHEN p.file IN ('Brand#1', 'Brand#2') THEN NULL ELSE s.parent_id END AS parent_id FROM symbols s LEFT JOIN symbols p ON p.id = s.parent_id WHERE s.file NOT IN ('Brand#1', 'Brand#2'))
UNION ALL SELECT 'edges', count(*), count(*) FROM edges e WHERE e.src NOT IN (SELECT id FROM symbols WHERE file IN ('Brand#1', 'Brand#2')) AND e.dst NOT IN (SELECT id FROM symbols WHERE file IN ('Brand#1', 'Brand#2'))
UNION ALL SELECT 'chunks', 25 - 2, 0 UNION ALL SELECT 'files', 25 - 2, 23"""))  # fmt: skip
def m3(spark, d):
    """Two files go: their symbols and the edges of those, and links to them become null."""
    s = symbols(spark, d).withColumn("file_id", F.substring_index("file", "#", -1).cast("long"))
    files = s.select(F.col("file_id").alias("id")).distinct()
    chunks = files.select(F.col("id").alias("file_id"), F.lit(None).cast("long").alias("symbol_id"))
    out = M.delete_files({"files": files, "symbols": s, "edges": edges(spark, d), "chunks": chunks}, spark.createDataFrame([(1,), (2,)], "id long"))
    linked = {"files": "id", "symbols": "parent_id", "edges": "src", "chunks": "symbol_id"}
    return reduce(DataFrame.unionByName, [t.agg(F.count("*").alias("n"), F.count(linked[name]).alias("linked")).select(F.lit(name).alias("relation"), "n", "linked") for name, t in out.items()])


@query("m4_delete_where", "SELECT doc_id AS id FROM documents WHERE NOT (lang = 'en' AND n_chars < 1000)")
def m4(spark, d):
    return table(spark, d, "documents").where("NOT (lang = 'en' AND n_chars < 1000)").select(F.col("doc_id").alias("id"))


@query("m5_generated_ids", "SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) AS id FROM documents")
def m5(spark, d):
    """Dense ids in the order of source and document."""
    return M.with_ids(table(spark, d, "documents").select("source", "doc_id"), ["source", "doc_id"]).select("doc_id", F.col("id").cast("long").alias("id"))


@query("m6_versions", "SELECT doc_id AS path, 2 AS version FROM documents WHERE doc_id % 2 = 0")
def m6(spark, d):
    """A table changed twice: readers see the second version as a whole."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.lit(1).alias("n"))
    held = RunTable(spark, new_path(spark, "versions"), "path bigint, n int", ["path"])
    held.write(docs)
    n = held.write(docs.where("false"), docs.where("path % 2 = 1"))
    return held.read().select("path", F.lit(n).alias("version"))


_OPS = "SELECT event_id AS ord, user_id AS task_id, CASE WHEN event_type = 'error' THEN 'delete' WHEN event_type = 'signup' AND value < 5 THEN 'clear' ELSE 'set' END AS op, 'k' || CAST(floor(value) AS BIGINT) % 3 AS key, props AS value FROM events"


@query("m7_working_memory", f"""WITH o AS ({_OPS}), c AS (SELECT task_id, max(ord) AS c FROM o WHERE op = 'clear' GROUP BY 1), l AS (SELECT task_id, key, arg_max(op, ord) AS op, arg_max(value, ord) AS value, max(ord) AS ord FROM o WHERE op <> 'clear' GROUP BY ALL)
SELECT l.task_id, key, value FROM l LEFT JOIN c ON c.task_id = l.task_id WHERE op = 'set' AND (c.c IS NULL OR ord > c.c)""")  # fmt: skip
def m7(spark, d):
    """Key-value state of every task after sets, deletes and clears; events stand for operations."""
    e = table(spark, d, "events")
    op = F.when(F.col("event_type") == "error", "delete").when((F.col("event_type") == "signup") & (F.col("value") < 5), "clear").otherwise("set")
    ops = e.select(F.col("event_id").alias("ord"), F.col("user_id").alias("task_id"), op.alias("op"), F.concat(F.lit("k"), (F.floor("value") % 3).cast("string")).alias("key"), F.col("props").alias("value"))
    return M.working_memory(ops)


def _timed(spark, d):
    return table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))


@query("ext_tumbling_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def ext_tumbling(spark, d):
    """Extension: usage by day."""
    return windows.windowed_usage(_timed(spark, d), "1 day").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("ext_sliding_windows", "SELECT s AS start, event_type, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS s, event_type FROM events) GROUP BY ALL")
def ext_sliding(spark, d):
    """Extension: usage by day, every 12 hours."""
    return windows.windowed_usage(_timed(spark, d), "1 day", "12 hours").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("ext_session_windows", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 3 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s")
def ext_sessions(spark, d):
    """Extension: sessions of a user with gaps under three hours."""
    return windows.sessions(_timed(spark, d), "3 hours").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")
