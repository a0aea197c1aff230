"""From raw documents to packed training batches: five stages, each over all rows its predecessor kept.

All stages but the last return the columns of ``documents``; the mix returns a row per copy. Every stage takes nulls in any
column, repeated rows, very long texts and an empty table (which gives an empty one); other columns come along.

Decisions are made on keys: a stage that drops rows names them by where they stand in their file, and whole rows meet only
that list. Up to BROADCAST_ROWS dropped rows no row is shuffled, beyond that each once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.llm.exact_dedup import digests, exact_groups
from lodeweave.llm.langid import identify, train
from lodeweave.llm.mixing import mix
from lodeweave.llm.ngram_join import near_duplicates
from lodeweave.llm.packing import pack, word_count
from lodeweave.llm.work import documents, scratch, stored

#: A document goes when no language reaches this multiple of the posterior of knowing nothing, 1/k for k languages.
LEAST_OVER_UNINFORMED = 1.2
#: Lists of dropped rows up to this many are broadcast.
BROADCAST_ROWS = 200_000
ROW = ("__file", "__row")


def whole() -> Column:
    """The row as one column, so that no operator's column meets one of its own."""
    return F.struct("*").alias("__row")


def with_row(docs: DataFrame) -> DataFrame:
    """Each row's file and number in the file, the same whenever the file is read; what is not just read from files is stored first."""
    if docs._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation":
        docs = stored(docs, "rows")
    return docs.select("*", F.col("_metadata.file_path").alias(ROW[0]), F.col("_metadata.row_index").alias(ROW[1]))


def without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows but for those named in ``dropped``."""
    dropped = stored(dropped.select(*ROW), "dropped")
    side = F.broadcast(dropped) if dropped.count() <= BROADCAST_ROWS else dropped
    return rows.join(side, [*ROW], "left_anti").drop(*ROW)


def least_score(languages: int) -> float:
    """The limit of the posterior: 0.3 for four languages. One language has posterior 1 for every text, so nothing can be told from it."""
    return LEAST_OVER_UNINFORMED / languages if languages > 1 else 0.0


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a recognisable language: no letters, or no language above the limit. Where nothing was learned, only those without letters."""
    model = train(docs)
    if not len(model.keys):
        return docs.where(F.col("text").rlike(r"\p{L}"))
    rows = with_row(docs)
    found = identify(rows, model, names=("__lang", "__score"), carry=ROW)
    return without(rows, found.where((F.col("__lang") == "und") | (F.col("__score") < least_score(len(model.languages)))))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of equal texts; of repeated rows one."""
    rows = with_row(docs)
    groups = exact_groups(stored(rows.select(*ROW, "doc_id", *digests(F.col("text"))), "digests"))
    return without(rows, groups.where("NOT kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near duplicates; all without a word."""
    rows = with_row(docs)
    return without(rows, near_duplicates(rows, carry=ROW).where("NOT kept"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows of a document as the mix takes copies of it; none of a document that it leaves out."""
    copies = mix(docs.select("doc_id", "source", whole()), word_count(F.col("__row.text"))).where("copies > 0")
    return copies.select(F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))), "__row").select("__row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of words in length buckets and batches."""
    return pack(docs, word_count(F.col("text")))


STAGES = [("language ID", language), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing", mixed), ("packing", packed)]

#: Language ID, the join and the bucket bounds are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; the work tables of each go when its result is stored, and that when the next one's is."""
    docs, path = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as tables:
            docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            result = tables.pop()
            if path:
                tables.append(path)
            path = result
    return STAGES[-1][1](spark, docs, sf_dir)
