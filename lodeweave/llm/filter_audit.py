"""Filter interaction audit: what each of five filters removes in every order in which they can be applied.

A text's failures are five bits. A table of 32 masks by 120 orders, made once, says at which step of an order a mask
fails first. Tasks count masks by part and label, index the table with them and add up removals by order and step with
``bincount``; they hand on one array per part and order, and Spark sums those. Copies are found by a least id per
digest, in two steps over salted keys: rows of equal id, text and part are one row before anything is joined.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .packing import WORD
from .work import documents, map_arrow, stored

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MASKS, STEPS = 1 << len(FILTERS), len(FILTERS)
#: The rows of a text are dealt over so many keys by their ids.
SALTS = 64
#: Parts that a task counts at a time; beyond that it hands on what it has.
PARTS = 4_096


def first_failures() -> np.ndarray:
    """MASKS x orders: the step, from 0, at which the order removes a row that fails the filters of the mask; STEPS: never."""
    steps = np.array([[o.index(f) for o in ORDERS] for f in FILTERS])
    bits = (np.arange(MASKS)[:, None] >> np.arange(STEPS)) & 1
    return np.where(bits[:, :, None] == 1, steps, STEPS).min(axis=1)


def masks(text: Column, words: Column, least_words: int, distinct_percent: int, capitals_percent: int) -> Column:
    """Bits of the filters that a text fails by itself: A to D."""
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = [
        F.size(words) < least_words,
        F.lit(100) * F.size(F.array_distinct(words)).cast("long") < F.lit(distinct_percent) * F.size(words).cast("long"),
        F.lit(100) * capitals.cast("long") > F.lit(capitals_percent) * F.length(text).cast("long"),
        text.rlike("[#$%&*|]"),
    ]
    return sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(fails)), F.lit(0)).cast("int")


def with_copies(rows: DataFrame) -> DataFrame:
    """Add filter E to ``mask``: a smaller id has the same text. ``rows``: id, part, mask, digest, bytes, n."""
    same = ["digest", "bytes"]
    rows = stored(rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")), "masks")
    leaf = rows.groupBy(*same, "salt").agg(F.min("id").alias("least"), F.max("id").alias("most"))
    root = leaf.groupBy(*same).agg(F.min("least").alias("first"), F.max("most").alias("last")).where("first < last").drop("last")
    back = leaf.select(*same, "salt").join(root, same)
    copy = F.when(F.col("id") > F.col("first"), F.lit(MASKS >> 1)).otherwise(F.lit(0))
    return rows.join(back, [*same, "salt"], "left").withColumn("mask", F.col("mask") + copy)


def removals(rows: DataFrame) -> DataFrame:
    """Per part and order the array ``v``, one for each task that has rows of the part.

    ``rows``: part, mask, good, toxic, n. ``v``: rows removed at each step and those kept, the same of good and of toxic
    rows, rows that fail each filter, and rows that fail it only.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = np.arange(len(ORDERS)) * (STEPS + 1) + first_failures()
        bits = ((np.arange(MASKS) >> np.arange(STEPS)[:, None]) & 1).astype(np.int64)
        alone = np.eye(MASKS, dtype=np.int64)[1 << np.arange(STEPS)]
        held: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for part, counts in held.items():
                at = [np.bincount(places.ravel(), np.repeat(c, len(ORDERS)), len(ORDERS) * (STEPS + 1)) for c in counts]
                by_order = np.concatenate([a.reshape(len(ORDERS), -1) for a in at], axis=1).astype(np.int64)
                whole = np.concatenate([bits @ counts[0], alone @ counts[0]])
                v = np.concatenate([by_order, np.tile(whole, (len(ORDERS), 1))], axis=1)
                arrays = pa.ListArray.from_arrays(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32), v.ravel())
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(ORDERS), pa.string()), pa.array(ORDERS), arrays], names=["part", "filter_order", "v"])
            held.clear()

        for batch in batches:
            parts = batch.column(0).dictionary_encode()
            at = parts.indices.to_numpy().astype(np.int64) * MASKS + batch.column(1).to_numpy()
            n = batch.column(4).to_numpy()
            kinds = [n, *(np.where(batch.column(i).to_numpy(zero_copy_only=False), n, 0) for i in (2, 3))]
            counts = np.stack([np.bincount(at, w, len(parts.dictionary) * MASKS).reshape(-1, MASKS) for w in kinds], axis=1).astype(np.int64)
            for part, c in zip(parts.dictionary.to_pylist(), counts, strict=True):
                held[part] = held[part] + c if part in held else c
            if len(held) > PARTS:
                yield from flush()
        yield from flush()

    return map_arrow(rows.select("part", "mask", "good", "toxic", "n"), run, "part string, filter_order string, v array<bigint>")


def filter_audit(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", least_words: int = 200, distinct_percent: int = 50, capitals_percent: int = 3
) -> DataFrame:
    """Per ``part``, ``filter_order`` and ``step`` (from 1): kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A row fails A with fewer than ``least_words`` words, B with fewer distinct words than ``distinct_percent`` of them, C with
    more capitals A-Z than ``capitals_percent`` of its code points, D with any of ``#$%&*|``, E if a smaller id has exactly its text.
    A null text is empty, a null part the empty string. A row without an id fails no E and has no label; rows that repeat an id
    count one by one and fail no E by each other; labels of an id (quality = 1, toxic = 1) hold if any of its label rows says so.
    Every part has all 600 rows; an empty table gives an empty result. Very long texts count whole; other columns are ignored.
    """
    t = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    t = t.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    mask = masks(F.col("text"), F.col("words"), least_words, distinct_percent, capitals_percent)
    t = t.select("id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").alias("bytes"))
    t = with_copies(t.groupBy("id", "part", "mask", "digest", "bytes").agg(F.count("*").alias("n")))
    t = t.groupBy("id", "part", "mask").agg(F.sum("n").alias("n"))  # a hot id is a row per part and mask
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(f"__{c}")
    flags = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(is_one("quality"), is_one("toxic"))
    t = t.join(flags, "id", "left").withColumns({"good": F.coalesce("__quality", F.lit(False)), "toxic": F.coalesce("__toxic", F.lit(False))})

    width = 3 * (STEPS + 1) + 2 * STEPS
    out = removals(t).groupBy("part", "filter_order").agg(F.array(*(F.sum(F.col("v")[i]) for i in range(width))).alias("v"))
    out = out.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(STEPS))))
    out = out.withColumn("filter", F.expr(f"instr('{FILTERS}', substring(filter_order, step, 1))"))
    at = lambda first, place: F.element_at("v", F.lit(first) + F.col(place))
    out = out.withColumn("removed", at(0, "step"))
    return out.select(
        "part",
        "filter_order",
        "step",
        F.aggregate(F.slice("v", F.col("step") + 1, F.lit(STEPS + 1) - F.col("step")), F.lit(0).cast("long"), lambda a, b: a + b).alias("kept"),
        "removed",
        (at(3 * (STEPS + 1), "filter") - F.col("removed")).alias("redundant"),
        at(3 * (STEPS + 1) + STEPS, "filter").alias("unique_fails"),
        at(STEPS + 1, "step").alias("good_lost"),
        at(2 * (STEPS + 1), "step").alias("toxic_lost"),
        F.sum("removed").over(Window.partitionBy("part", "filter")).alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all ``documents`` by language."""
    return filter_audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP13_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), m AS (
  SELECT part,
         CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * len(regexp_extract_all(x, '[A-Z]')) > 3 * length(x) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY x) THEN 16 ELSE 0 END AS mask,
         coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL), false) AS good, coalesce(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL), false) AS toxic
  FROM t
), c AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, mask
), l AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f
), o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), s AS (  -- each mask with the step of an order that removes it and whether it fails the filter of a step
  SELECT *, (mask >> (ascii(filter_order[step]) - 65)) & 1 = 1 AS fails,
         coalesce(list_min(list_filter([1, 2, 3, 4, 5], lambda i: (mask >> (ascii(filter_order[i]) - 65)) & 1 = 1)), 6) AS first
  FROM c, o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), r AS (
  SELECT part, filter_order, step, sum(CASE WHEN first > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN first = step THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN first < step AND fails THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = 1 << (ascii(filter_order[step]) - 65) THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN first = step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN first = step THEN toxic ELSE 0 END) AS toxic_lost
  FROM s GROUP BY part, filter_order, step
)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, filter_order[step]))::BIGINT AS shapley
FROM r
"""
