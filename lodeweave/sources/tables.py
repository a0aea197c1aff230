"""Catalog tables: the relational model, vector collections, the encrypted shared store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import decrypt, encrypt
from ..operators.joins import new_by_hash

#: Relation and columns of the data model.
MODEL = {
    "files": "id BIGINT, path STRING, hash STRING, lang STRING, mtime BIGINT, indexed_at BIGINT",
    "symbols": "id BIGINT, file_id BIGINT, parent_id BIGINT, kind STRING, name STRING, qualified_name STRING, `start` INT, `end` INT, signature STRING, docstring STRING",
    "edges": "src BIGINT, dst BIGINT, kind STRING, confidence DOUBLE",
    "chunks": "id BIGINT, symbol_id BIGINT, file_id BIGINT, content STRING, token_count INT, embedding_ref STRING",
    "sessions": "id STRING, created_at BIGINT, updated_at BIGINT, summary STRING",
    "session_turns": "id BIGINT, session_id STRING, role STRING, content STRING, ts BIGINT",
    "facts": "id STRING, text STRING, embedding ARRAY<FLOAT>, ts BIGINT, tags STRING",
    "manifests": "task_id STRING, file STRING, symbol STRING, chunk_id STRING, tokens INT, reason STRING, ts BIGINT",
    "cold_context": "id STRING, content STRING, tokens INT, metadata STRING, evicted_at BIGINT",
    "shared_facts": "id STRING, content_enc STRING, content_hash STRING, author STRING, created_at BIGINT",
    "usage": "id BIGINT, ts BIGINT, provider STRING, model STRING, tag STRING, tokens_in BIGINT, tokens_out BIGINT, cost_usd DOUBLE, latency_ms BIGINT",
}
VECTOR = "id STRING, vector ARRAY<FLOAT>, content STRING, relativePath STRING, startLine INT, endLine INT, fileExtension STRING, metadata STRING"


def open_model(spark: SparkSession, database: str) -> list[str]:
    """Create what is missing of the model; may run again at any time. Returns the tables there."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    for name, columns in MODEL.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS `{database}`.`{name}` ({columns}) USING parquet")
    return sorted(t.name for t in spark.catalog.listTables(database))


class VectorStore:
    """Collections of vectors, a table each; a dimension is kept as a table property and checked on insert."""

    def __init__(self, spark: SparkSession, database: str):
        self.spark, self.database = spark, database
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")

    def _name(self, collection: str) -> str:
        return f"`{self.database}`.`{collection}`"

    def create(self, collection: str, dimension: int) -> None:
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self._name(collection)} ({VECTOR}) USING parquet TBLPROPERTIES ('dimension' = '{dimension}')")

    def has(self, collection: str) -> bool:
        return self.spark.catalog.tableExists(f"{self.database}.{collection}")

    def drop(self, collection: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name(collection)}")

    def collections(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables(self.database))

    def insert(self, collection: str, rows: DataFrame) -> None:
        (found,) = [r.value for r in self.spark.sql(f"SHOW TBLPROPERTIES {self._name(collection)} ('dimension')").collect()]
        size = F.size("vector")
        right = F.when(size == int(found), F.col("vector")).otherwise(F.raise_error(F.concat(F.lit(f"dimension is not {found}: "), size.cast("string"))))
        columns = [c.split()[0] for c in VECTOR.split(", ")]
        rows.withColumn("vector", right).select(*columns).write.insertInto(f"{self.database}.{collection}")

    def table(self, collection: str) -> DataFrame:
        return self.spark.table(f"{self.database}.{collection}")

    def delete(self, collection: str, ids: DataFrame) -> None:
        """Write what stays beside the table, then replace it."""
        from .worktables import stored

        kept = stored(self.table(collection).join(ids.select("id"), "id", "left_anti"), "kept")
        kept.select(*self.table(collection).columns).write.insertInto(f"{self.database}.{collection}", overwrite=True)


def push_facts(facts: DataFrame, store: DataFrame, key: bytes, author: str) -> DataFrame:
    """Rows for the shared store: new texts by content hash, sealed. ``facts``: id, text, created_at."""
    hashed = facts.withColumn("content_hash", F.sha2("text", 256))
    fresh = new_by_hash(hashed, store)
    return fresh.select("id", encrypt(F.col("text"), F.lit(key)).alias("content_enc"), "content_hash", F.lit(author).alias("author"), "created_at")


def pull_facts(store: DataFrame, key: bytes, since: int = -1) -> DataFrame:
    """Facts after a mark, opened."""
    return store.where(F.col("created_at") > since).select("id", decrypt(F.col("content_enc"), F.lit(key)).alias("text"), "author", "created_at")
