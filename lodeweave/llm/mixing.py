"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

A source whose target is r times its size takes floor(r) whole copies of each of its documents and a sample of
fixed size, in words, for the rest. Inclusion probabilities in the sample are in proportion to a measure of the
documents, their size by default; those that would reach 1 are certain, and the others share what these leave.
Documents are ranked by random odds over inclusion odds, u / (1 - u) : p / (1 - p), and taken in that order.
Ranks are cut into ranges of the ratio. Sums of the ranges tell which range holds the last document taken: only
the documents of that one are put in order, so that rows move for nothing else and no task orders a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from .packing import word_count
from .work import documents, stored

#: Source tables up to this many rows are broadcast and put in order by one task; larger ones join with salted keys.
BROADCAST_SOURCES = 20_000
SALTS = 32
#: Rows of a range about the last document taken, and most ranges of a source.
RANGE_ROWS = 512
MAX_RANGES = 65_536
#: Leading bits of a measure that make its class, so that a source has at most 8 * 60 classes.
MEASURE_BITS = 4


def ordered_sums(df: DataFrame, order: list[Column], sums: list[str], many: bool) -> DataFrame:
    """Add ``row``, from 1 in the order, and ``before_c`` for each c of ``sums``: its sum over the rows before.

    ``many``: ranges of the order are sorted apart and offset by the sums of the ranges before, else by one task.
    """
    new = lambda w: [F.row_number().over(w).alias("row"), *(F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")).alias(f"before_{c}") for c in sums)]
    if not many:
        return df.select("*", *new(Window.orderBy(*order)))
    parts = stored(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    held = parts.groupBy("__part").agg(F.count("*").alias("__rows"), *(F.sum(c).alias(f"__{c}") for c in sums))  # a row per range
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    names = {"__rows": "row"} | {f"__{c}": f"before_{c}" for c in sums}
    held = held.select("__part", *(F.coalesce(F.sum(a).over(before), F.lit(0)).alias(a) for a in names))
    out = parts.select("*", *new(Window.partitionBy("__part").orderBy(*order))).join(F.broadcast(held), "__part")
    return out.withColumns({b: F.col(b) + F.col(a) for a, b in names.items()}).drop("__part", *names)


def source_targets(totals: DataFrame, share: tuple[int, int] = (3, 2), most: int = 2, weights: tuple[int, ...] = (5, 2, 1), many: bool = False) -> DataFrame:
    """Add ``weight``, ``target`` and ``place`` to one row per ``source`` with its ``source_size``.

    Weights repeat over the sources by code point, null last. Targets share share[0]/share[1] of all
    sizes by weight and stop at ``most`` times the source's size, the excess going to the others.
    Sources in order of size to weight: those before the first that can take its part are capped.
    """
    up, down = share
    t = ordered_sums(totals, [F.col("source").asc_nulls_last()], [], many)
    t = t.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("row") - 1) % len(weights) + 1).cast("int")).cast("long")).drop("row")
    t = ordered_sums(t, [(F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last()], ["source_size", "weight"], many)
    t = stored(t.withColumnRenamed("row", "place"), "places")
    whole = t.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    if whole["weight"] is None:
        return t.select(*totals.columns, "place", "weight", F.lit(0.0).alias("target"))
    wide = lambda c: (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")
    rest, rest_weight = F.lit(up * whole["size"]) - most * down * F.col("before_source_size"), F.lit(whole["weight"]) - F.col("before_weight")
    t = t.withColumns({"rest": rest, "rest_weight": rest_weight})  # rest: times down
    free = t.where(wide(most * down * F.col("source_size")) * F.col("rest_weight").cast("decimal(15,0)") >= wide("rest") * F.col("weight"))
    first = free.orderBy("place").first() or Row(place=1 << 31, rest=0, rest_weight=1)
    part = (F.lit(first["rest"]) * F.col("weight")).cast("double") / F.lit(float(down * first["rest_weight"]))
    return t.select(*totals.columns, "place", "weight", F.when(F.col("place") < first["place"], (most * F.col("source_size")).cast("double")).otherwise(part).alias("target"))


def inclusion(classes: DataFrame, sources: DataFrame, many: bool) -> DataFrame:
    """Add ``__rate``, ``__sure`` and ``__rest`` to ``sources``.

    A document of measure x is certain for the sample if its class m > ``__sure`` and else in it with probability
    ``__rate`` * x; ``__rest`` is what the certain ones leave of the words that the sample needs. ``classes``: of each
    (source, m) the words, the sum of measure times size, and the largest measure. From the largest m down, the first whose
    largest measure does not reach 1 is found.
    """
    needs = sources.select("__source", "__sid", "__need")
    c = classes.join(needs if many else F.broadcast(needs), F.col("source").eqNullSafe(F.col("__source")))
    down = Window.partitionBy("__sid").orderBy(F.desc("m"))
    above, below = down.rowsBetween(Window.unboundedPreceding, -1), down.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    c = c.withColumn("left", F.col("__need") - F.coalesce(F.sum("words").over(above), F.lit(0)))
    c = c.withColumn("moment", F.sum("moment").over(below).cast("double"))
    c = c.where((F.col("moment") > 0) & (F.col("left") * F.col("most") < F.col("moment")))
    c = c.groupBy("__sid").agg(F.max_by(F.struct((F.col("left") / F.col("moment")).alias("__rate"), F.col("m").alias("__sure"), F.col("left").alias("__rest")), "m").alias("x"))
    return sources.join(c.select("__sid", "x.*"), "__sid", "left")


def random_number(id_col: str, seed: int) -> Column:
    """Between 0 and 1, the same for an id in every run: 52 bits of a digest. Rows without an id: the same for a size."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), F.col("size"))))
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def leading(x: Column) -> Column:
    """The class of a measure: cut to its MEASURE_BITS leading bits."""
    shift = F.greatest(F.lit(0), F.length(F.bin(x)) - MEASURE_BITS)
    return F.call_function("shiftleft", F.call_function("shiftright", x, shift), shift)


def mix(df: DataFrame, size: Column, id_col: str = "doc_id", source_col: str = "source", measure: Column | None = None, seed: int = 42, share: tuple[int, int] = (3, 2), most: int = 2, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """All columns of ``df`` and ``size``, ``source_size``, ``target``, ``copies``, ``taken`` (copies * size) for every row.

    Sizes, ``share``, ``most`` and ``weights`` are those of ``source_targets``. ``measure`` (whole numbers; null and less
    than 1 count as 1; default: the size) sets the odds within a source; those that reach 1 are certain, with all of their class. A null source is a source of its
    own. Repeated rows are sampled one by one; rows with the same id share the random number, ties go by id and size. Rows of size 0 take
    no words, whatever their copies. Very long texts are documents like others: the last one may be half beside the target. An
    empty table gives an empty result. Columns of those names in ``df`` are replaced.
    """
    new = ["size", "source_size", "target", "copies", "taken"]
    own = [c for c in df.columns if c not in new]
    rows = df.select(*own, size.alias("size")) if measure is None else df.select(*own, size.alias("size"), measure.alias("__measure"))
    rows = rows.withColumn("__x", F.greatest(F.coalesce(F.col("size" if measure is None else "__measure").cast("long"), F.lit(1)), F.lit(1).cast("long")))
    rows = rows.withColumn("__m", leading(F.col("__x")))
    narrow = stored(rows.select(*dict.fromkeys([id_col, source_col]), "size", "__x", "__m"), "sizes")
    classes = stored(narrow.groupBy(F.col(source_col).alias("source"), F.col("__m").alias("m")).agg(F.sum("size").alias("words"), F.sum(F.col("__x").cast("decimal(18,0)") * F.col("size").cast("decimal(18,0)")).alias("moment"), F.max("__x").alias("most"), F.count("*").alias("rows")), "measures")
    totals = stored(classes.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("rows").alias("rows")), "totals")
    many = totals.count() > BROADCAST_SOURCES
    sources = source_targets(totals, share, most, weights, many)
    base = F.floor(F.col("target") / F.greatest(F.lit(1), F.col("source_size"))).cast("int")
    sources = sources.withColumn("__base", base).withColumn("__need", F.col("target") - base * F.col("source_size"))
    ranges = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.lit(1.0), F.least(F.lit(float(MAX_RANGES)), F.col("rows") / RANGE_ROWS)))))
    sources = sources.withColumn("__ranges", ranges).drop("rows", "weight").withColumnsRenamed({"source": "__source", "place": "__sid"})
    sources = stored(inclusion(classes, sources, many), "sources")

    def ranked(rows: DataFrame, sources: DataFrame) -> DataFrame:
        """Rows with their source's columns, ``__q``, the ratio by which they are ranked (null: not in the sample), and its range."""
        if many:
            side = sources.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            out = rows.withColumn("__s", F.pmod(F.xxhash64(F.col(id_col), F.col("size")), F.lit(SALTS)).cast("int"))
            out = out.join(side, F.col(source_col).eqNullSafe(F.col("__source")) & (F.col("__s") == F.col("__salt"))).drop("__s", "__salt")
        else:
            out = rows.join(F.broadcast(sources), F.col(source_col).eqNullSafe(F.col("__source")))
        u, p = random_number(id_col, seed), F.col("__rate") * F.col("__x")
        out = out.withColumn("__certain", (F.col("__need") > 0) & (F.col("__m") > F.col("__sure")))
        out = out.withColumn("__q", F.when((F.col("__rate") > 0) & ~F.col("__certain"), u / (1 - u) * ((1 - p) / p)))
        return out.withColumn("__range", F.floor(F.col("__q") / (1 + F.col("__q")) * F.col("__ranges")).cast("int"))

    sums = ranked(narrow, sources).where("__q IS NOT NULL").groupBy("__sid", "__rest", "__range").agg(F.sum("size").alias("sum"))
    sums = sums.withColumn("to", F.sum("sum").over(Window.partitionBy("__sid").orderBy("__range")))
    last = sums.where("to > __rest").groupBy("__sid").agg(F.min_by(F.struct(F.col("__range").alias("__last"), (F.col("to") - F.col("sum")).alias("__offset")), "__range").alias("x"))
    sources = stored(sources.join(last.select("__sid", "x.*"), "__sid", "left"), "lasts")

    out = ranked(rows, sources)
    at_last = F.coalesce(F.col("__range") == F.col("__last"), F.lit(False))
    order = Window.partitionBy("__sid").orderBy("__q", id_col, "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("__offset") + F.coalesce(F.sum("size").over(order), F.lit(0))
    ordered = out.where(at_last).withColumn("__in", before + F.col("size") / 2 <= F.col("__rest"))
    clear = out.where(~at_last).withColumn("__in", F.coalesce(F.col("__certain"), F.lit(False)) | (F.col("__q").isNotNull() & (F.col("__last").isNull() | (F.col("__range") < F.col("__last")))))
    copies = (F.col("__base") + F.when(F.col("__in"), 1).otherwise(0)).cast("long")
    out = clear.unionByName(ordered)
    return out.withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies")).select(*own, *new)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document in a mix of 150 % of all words."""
    rows = stored(documents(spark, sf_dir).select("doc_id", "source", word_count(F.col("text")).alias("size")), "words")
    return mix(rows, F.col("size")).select("doc_id", "size", "source_size", "target", "taken", "copies")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, size, (('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, 'null:' || size)), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u,
         greatest(size, 1) AS x, greatest(length(bin(greatest(size, 1))) - 4, 0)::BIGINT AS shift
  FROM (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents)
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM d GROUP BY source
), w AS (
  SELECT source, source_size, [5, 2, 1][(rk - 1) % 3 + 1]::BIGINT AS weight FROM s
), r AS (
  SELECT *, row_number() OVER o AS place,
         3 * sum(source_size) OVER () - 4 * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_weight
  FROM w WINDOW o AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST)
), f AS (
  SELECT place AS first, rest::BIGINT AS rest, rest_weight::BIGINT AS rest_weight FROM r
  WHERE 4 * source_size * rest_weight >= rest * weight ORDER BY place LIMIT 1
), t AS (
  SELECT source, source_size,
         CASE WHEN place < f.first THEN (2 * source_size)::DOUBLE
              ELSE (f.rest * weight)::DOUBLE / (2.0::DOUBLE * f.rest_weight::DOUBLE) END AS target
  FROM r, f
), b AS (
  SELECT *, CASE WHEN target >= 2 * source_size THEN 2 WHEN target >= source_size THEN 1 ELSE 0 END AS base FROM t
), m AS (  -- each document with its measure, whose rows of the same or a smaller one have this moment and whose larger ones these words
  SELECT d.*, (x >> shift) << shift AS m, source_size, target, base, target - base * source_size AS need FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
), p AS (
  SELECT source, m, most, need - coalesce(sum(words) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS rest,
         (sum(moment) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS moment
  FROM (SELECT source, m, need, sum(size)::BIGINT AS words, sum(x * size) AS moment, max(x) AS most FROM m GROUP BY source, m, need) WINDOW o AS (PARTITION BY source ORDER BY m DESC)
), i AS (
  SELECT source, max_by(rest / moment, m) AS rate, max(m) AS sure, max_by(rest, m) AS rest FROM p WHERE moment > 0 AND rest * most < moment GROUP BY source
), q AS (
  SELECT m.*, rate, sure, rest, need > 0 AND m > sure AS certain,
         CASE WHEN rate > 0 AND NOT (need > 0 AND m > sure) THEN u / (1.0::DOUBLE - u) * ((1.0::DOUBLE - rate * x) / (rate * x)) END AS ratio
  FROM m LEFT JOIN i ON m.source IS NOT DISTINCT FROM i.source
), c AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source, ratio IS NULL ORDER BY ratio, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q
), e AS (
  SELECT *, (base + CASE WHEN coalesce(certain, false) OR (ratio IS NOT NULL AND before + size / 2.0::DOUBLE <= rest) THEN 1 ELSE 0 END)::BIGINT AS copies FROM c
)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM e
"""
