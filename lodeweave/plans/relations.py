"""The data model over the test tables, in Spark and as SQL for the oracle.

files and chunks come from documents, symbols from part, edges from consecutive lines of an order,
usage and the action log from events, turns from conversations, facts from embeddings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import table


def token_estimate(text: Column) -> Column:
    """A token for every four characters, rounded up."""
    return F.ceil(F.length(text) / 4).cast("long")


def files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("id"),
        F.concat_ws("", "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang").alias("path"),
        F.sha2("text", 256).alias("hash"),
        "lang",
        (F.col("doc_id") * 1000).alias("mtime"),
    )


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("file_id"), F.col("text").alias("content"), token_estimate(F.col("text")).alias("token_count"))


def symbols(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_brand").alias("file"),
        (F.col("p_partkey") - F.col("p_partkey") % 10).alias("parent_id"),
        F.col("p_type").alias("kind"),
        F.col("p_name").alias("name"),
        F.concat_ws(".", "p_brand", "p_name").alias("qualified_name"),
        (F.col("p_size") * 10).alias("start"),
        (F.col("p_size") * 10 + 60).alias("end"),
    )


def edges(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    after = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"))
    pairs = lines.join(after, ["l_orderkey", "l_linenumber"]).select(F.col("l_partkey").alias("src"), "dst").distinct()
    return pairs.select("src", "dst", F.when(F.col("src") % 3 == 0, "imports").otherwise("calls").alias("kind"), F.lit(0.8).alias("confidence"))


def usage(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"),
        F.col("event_type").alias("provider"),
        F.concat(F.lit("m"), (F.col("user_id") % 5).cast("string")).alias("model"),
        F.floor("value").alias("tokens_in"),
        F.get_json_object("props", "$.k").cast("long").alias("tokens_out"),
    )


def actions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("event_id").alias("ord"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), F.concat(F.lit("task-"), F.col("user_id").cast("string")).alias("task_id"), F.col("event_type").alias("kind"), F.col("props").alias("payload")
    )


def turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("id"), "role", F.col("text").alias("content"))


def facts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.concat(F.lit("label,"), F.col("label").cast("string")).alias("tags"), (F.col("vec_id") * 1000).alias("ts"))


def plan_steps(spark: SparkSession, d: str) -> DataFrame:
    """One row per step (order) and file (part) of the order."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("step"), F.col("l_partkey").alias("file")).distinct()


def snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents")
    old = docs.where("doc_id % 10 <> 0").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("hash"))
    new = docs.where("doc_id % 10 <> 1").select(F.col("doc_id").alias("path"), F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("hash"))
    return old, new


_CTES = {
    "files": "SELECT doc_id AS id, source || '/' || doc_id || '.' || lang AS path, sha256(text) AS hash, lang, doc_id * 1000 AS mtime FROM documents",
    "chunks": "SELECT doc_id AS id, doc_id AS file_id, text AS content, CAST((length(text) + 3) // 4 AS BIGINT) AS token_count FROM documents",
    "symbols": "SELECT p_partkey AS id, p_brand AS file, p_partkey - p_partkey % 10 AS parent_id, p_type AS kind, p_name AS name, p_brand || '.' || p_name AS qualified_name, p_size * 10 AS \"start\", p_size * 10 + 60 AS \"end\" FROM part",
    "edges": "SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst, CASE WHEN a.l_partkey % 3 = 0 THEN 'imports' ELSE 'calls' END AS kind, 0.8::DOUBLE AS confidence FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1",
    "usage": "SELECT event_id AS id, epoch_us(ts) // 1000 AS ts, event_type AS provider, 'm' || (user_id % 5) AS model, CAST(floor(value) AS BIGINT) AS tokens_in, CAST(props->>'$.k' AS BIGINT) AS tokens_out FROM events",
    "actions": "SELECT event_id AS ord, epoch_us(ts) // 1000 AS ts, 'task-' || user_id AS task_id, event_type AS kind, props AS payload FROM events",
    "turns": "SELECT conv_id AS session_id, turn AS id, role, text AS content FROM conversations",
    "facts": "SELECT vec_id AS id, embedding, 'label,' || label AS tags, vec_id * 1000 AS ts FROM embeddings",
    "plan_steps": "SELECT DISTINCT l_orderkey AS step, l_partkey AS file FROM lineitem",
    "old_files": "SELECT doc_id AS path, sha256(text) AS hash FROM documents WHERE doc_id % 10 <> 0",
    "new_files": "SELECT doc_id AS path, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS hash FROM documents WHERE doc_id % 10 <> 1",
}


def over(names: str, body: str) -> str:
    """``body`` with the named relations before it, for the oracle."""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({_CTES[n]})" for n in names.split()) + "\n" + body
