"""Exact dedup: a tree-merge of sorted digest runs, in DataFrame operations only.

Rows are dealt into runs by their id; a run holds one entry per digest, in order of the digest: the smallest id and the
number of rows. In each binomial round, runs are exchanged so that those of ``fan_in`` neighbours meet, stand in order
of (run, digest), and are folded into one: entries of equal digest are neighbours then. Only entries that agree in
length and in an independent hash too are merged, at every level. A round's key is (run, digest), so copies of
one text meet gradually: no task reads more than ``fan_in`` entries of a text.
On the way back the result joins the first runs, whose entries join the rows by (run, digest): a hot
text is spread over all runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .work import documents, stored

SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def digests(text: Column) -> list[Column]:
    """The digest, and what must agree besides before two texts count as equal: length and an independent hash."""
    norm = normalised(text)
    return [F.sha2(norm, 256).alias("text_sha256"), F.octet_length(norm).alias("__len"), F.xxhash64(norm).alias("__hash")]


def merged_runs(runs: DataFrame, same: list[str], fan_in: int) -> DataFrame:
    """One round: ``fan_in`` neighbouring sorted runs become one. One exchange and one sort; the fold is a sort aggregation over it."""
    near = runs.withColumn("__run", F.expr(f"__run div {fan_in}").cast("int"))
    near = near.repartition("__run", same[0]).sortWithinPartitions("__run", *same, "least.none", "least.id")
    return near.groupBy("__run", *same).agg(F.min("least").alias("least"), F.sum("group_size").alias("group_size"))


def exact_groups(rows: DataFrame, id_col: str = "doc_id", fan_in: int = 8, rounds: int = 3) -> DataFrame:
    """Add ``keep_id``, ``group_size`` and ``kept`` to rows that carry ``digests()``.

    The smallest id stays; null ids come last. Of repeated rows with the same id and text one is
    kept. Ids may be null or repeat; an empty table gives an empty result.
    """
    same = ["text_sha256", "__len", "__hash"]
    rows = rows.withColumn("__run", F.pmod(F.xxhash64(F.col(id_col)), F.lit(fan_in**rounds)).cast("int"))
    least = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id")))
    leaf = rows.groupBy("__run", *same).agg(least.alias("least"), F.count("*").alias("group_size"))
    leaf = merged = stored(leaf.sortWithinPartitions("__run", *same), "runs")
    for _ in range(rounds):
        merged = merged_runs(merged, same, fan_in)
    merged = merged.select("__run", *same, F.col("least.id").alias("keep_id"), "group_size")
    root = merged.drop("__run")  # one run is left
    back = leaf.select("__run", *same).join(root, same)
    out = rows.join(back, ["__run", *same])
    turn = Window.partitionBy("__run", *same, id_col).orderBy(F.lit(1))
    out = out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id")) & (F.row_number().over(turn) == 1))
    return out.drop("__run", "__len", "__hash")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``df`` and ``text_sha256``, ``keep_id``, ``group_size``, ``kept`` for every row.

    Equal: identical after each run of ASCII white space becomes one space; null counts as empty, and very long texts whole.
    An empty table gives an empty result. Columns of those names in ``df`` are replaced.
    """
    own = [c for c in df.columns if c not in ("text_sha256", "keep_id", "group_size", "kept", "__len", "__hash", "__run")]
    return exact_groups(df.select(*own, *digests(F.col(text_col))), id_col)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group of equal texts."""
    rows = stored(documents(spark, sf_dir).select("doc_id", *digests(F.col("text"))), "digests")
    return exact_groups(rows).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM d
"""
