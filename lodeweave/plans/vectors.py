"""Vectors, embedder, summariser, table function."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import code as C
from ..operators import vectors as V
from .registry import query, table, wide_table
from .relations import facts, turns


def _query_vector(spark, d) -> list[float]:
    return facts(spark, d).where("id = 0").first()["embedding"]


@query("k1_vector_top_k", "WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0) SELECT vec_id AS id, round(list_sum(list_transform(list_zip(embedding, q.v), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ^ 2)), 6) AS score FROM embeddings, q WHERE label <> 3 ORDER BY list_sum(list_transform(list_zip(embedding, q.v), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ^ 2)), vec_id LIMIT 10")
def k1(spark, d):
    """Ten nearest vectors by squared L2 with a filter."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return V.top_k(rows, _query_vector(spark, d), where="label <> 3").select("id", F.round("score", 6).alias("score"))


@query("k2_cosine_top_k", "WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0) SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], q.v), 6) AS score FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], q.v) DESC, vec_id LIMIT 10")
def k2(spark, d):
    return V.top_k(facts(spark, d), _query_vector(spark, d), metric="cosine").select("id", F.round("score", 6).alias("score"))


@query("x4_cosine", "SELECT a.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def x4(spark, d):
    a = facts(spark, d).select("id", "embedding")
    b = a.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("b"))
    return a.join(b, "id").select("id", F.round(V.cosine(F.col("embedding"), F.col("b")), 6).alias("cosine"))


@query("e1_embedder", r"""WITH w AS (SELECT item_id AS id, unnest([x FOR x IN string_split_regex(lower(text), '\s+') IF x <> '']) AS w FROM benchmark),
c AS (SELECT id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS place, sum(CASE WHEN substr(md5(w), 9, 1) >= '8' THEN 1 ELSE -1 END) AS n FROM w GROUP BY ALL),
l AS (SELECT id, sqrt(sum(n * n)) AS norm FROM c GROUP BY id) SELECT id, place::INT AS place, round(n / norm, 6) AS value FROM c JOIN l USING (id) WHERE n <> 0""")  # fmt: skip
def e1(spark, d):
    """Benchmark texts through the hashing embedder: every component that is not 0."""
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), V.hashing_embedder()("text").alias("v"))
    return rows.select("id", F.posexplode("v").alias("place", "value")).where("value <> 0").withColumn("value", F.round("value", 6))


@query("e2_summariser", "SELECT conv_id AS session_id, string_agg(replace(substr(text, 1, 40), chr(10), ' '), ' | ' ORDER BY turn) AS summary FROM conversations GROUP BY conv_id")
def e2(spark, d):
    return turns(spark, d).groupBy("session_id").agg(V.summariser()("id", "content").alias("summary"))


@query("e3_table_function", r"SELECT doc_id AS id, unnest(regexp_extract_all(text, '(?m)^(The|And) (\w+)', 2)) AS name FROM documents")
def e3(spark, d):
    """Symbols by a table function: lines that begin with 'The' or 'And' become functions, all other text comments, so that nothing in it is read as code."""
    code = F.regexp_replace(F.regexp_replace("text", "(?dm)^", "//"), r"(?dm)^//(?:The|And) (\w+)", "function _$1() {} //")  # a name may begin with a digit
    rows = wide_table(spark, d, "documents").select(F.col("doc_id").alias("id"), code.alias("code"), F.lit("typescript").alias("lang"), F.lit("f").alias("stem"))
    return C.extract_symbols(rows, "id").where("kind = 'function'").select("id", F.expr("substr(name, 2)").alias("name"))
