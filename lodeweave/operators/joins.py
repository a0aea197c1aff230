"""Joins: containment, intervals, fuzzy names, change diffs, look-ups, and the resolution cascade."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.partitions import tasks_for


def innermost_interval(points: DataFrame, spans: DataFrame, key: str, point_id: str, at: str = "line", start: str = "start", end: str = "end", span_id: str = "id", width: int = 64) -> DataFrame:
    """Each point with the id of the span of its key that holds it: the latest start wins, then the lowest id; null without one.

    Of equal spans only the lowest id can win. Spans are cut at multiples of ``width`` (about their length), so
    that a point meets the spans of its key and strip by an equi join; the best is a maximum, so partial
    aggregation cuts the matches before they are shuffled.
    """
    s = spans.groupBy(F.col(key).alias("__k"), F.col(start).alias("__s"), F.col(end).alias("__e")).agg(F.min(span_id).alias("__i"))
    strip = lambda c: F.floor(c / width)
    s = s.where("__s <= __e").withColumn("__strip", F.explode(F.sequence(strip(F.col("__s")), strip(F.col("__e")))))
    p = points.withColumn("__p", strip(F.col(at)))
    hit = p.join(s, (p[key] == s["__k"]) & (p["__p"] == s["__strip"]) & p[at].between(s["__s"], s["__e"]))
    best = hit.groupBy(point_id).agg(F.max_by("__i", F.struct("__s", -F.col("__i"))).alias("span_id"))
    return points.join(best, point_id, "left")


def apart(df: DataFrame) -> DataFrame:
    """The side of a join that is never broadcast: the driver builds what is, and in a job of many steps that adds up."""
    return df.hint("merge")


#: Names up to this length meet by what is left of them after deletions, longer ones by a part that no edit touched.
SHORT_NAME = 24
#: Bytes of names that a task takes: a name becomes hundreds of keys.
NAME_BYTES = 256 << 10
#: Characters that the beginnings of near names share.
HEAD = 3


def deletions(name: Column, limit: int, first: int | None = None) -> Column:
    """Hashes of the strings that up to ``limit`` deletions leave: two names within ``limit`` edits have one in common.

    ``first``: of these strings only so many characters. Two names within ``limit`` edits have one in common then too, and for it
    their first ``first + limit`` characters are enough.
    """
    without = lambda s: F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1)))).otherwise(F.array().cast("array<string>"))
    levels = [F.array(name)]
    for _ in range(limit):
        levels.append(F.array_distinct(F.flatten(F.transform(levels[-1], without))))
    left = F.flatten(F.array(*levels))
    left = left if first is None else F.transform(left, lambda s: F.substr(s, F.lit(1), F.lit(first)))
    return F.transform(F.array_distinct(left), lambda s: F.xxhash64(s))


def parts(name: Column, limit: int) -> Column:
    """Hashes of a long name's ``limit`` + 1 parts with the name's length and the part's number."""
    n = F.length(name)
    start = lambda i: F.floor(n * i / (limit + 1)).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(limit)), lambda i: F.xxhash64(n, i, F.substr(name, start(i) + 1, start(i + 1) - start(i))))


def wanted_parts(name: Column, limit: int) -> Column:
    """Hashes of the parts that names within ``limit`` edits may have: one of theirs stands in ``name``, moved by ``limit`` at most."""
    around = lambda: F.sequence(F.lit(-limit), F.lit(limit))
    start = lambda n, i: F.floor(n * i / (limit + 1)).cast("int")

    def one(n: Column, i: Column, move: Column) -> Column:
        at = start(n, i) + move
        return F.when(at >= 0, F.xxhash64(n, i, F.substr(name, F.greatest(at, F.lit(0)) + 1, start(n, i + 1) - start(n, i))))

    each = F.transform(around(), lambda m: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(limit)), lambda i: F.transform(around(), lambda k: one(F.length(name) + m, i, k)))))
    return F.array_distinct(F.filter(F.flatten(each), lambda h: h.isNotNull()))


def with_shared_heads(wanted: DataFrame, names: DataFrame, target: str, name: str, limit: int, keep: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Both sides without what begins like nothing of the other side. Beginnings are few, so this costs little beside the names' own keys."""

    def heads(df: DataFrame, column: str) -> DataFrame:
        return df.select(F.substring(column, 1, HEAD + limit).alias("__head")).distinct().withColumn("__key", F.explode(deletions(F.col("__head"), limit, HEAD)))

    sides = [(wanted, target, heads(wanted, target)), (names, name, heads(names, name))]
    shared = keep(sides[0][2].select("__key").join(apart(sides[1][2]), "__key", "left_semi").distinct(), "heads")
    return tuple(df.withColumn("__head", F.substring(c, 1, HEAD + limit)).join(apart(h.join(apart(shared), "__key", "left_semi")), "__head", "left_semi").drop("__head") for df, c, h in sides)


def near_names(wanted: DataFrame, names: DataFrame, target: str, name: str, limit: int, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """Pairs of a target and a name within ``limit`` edits, with their ``distance``; both sides without nulls, a pair may come more than once.

    Candidates share a hash: of what deletions leave of a short name, of a part of a long one. Keys are as many
    as names, so that no length or letter makes a hot one. With ``keep``, which stores a table, and sides that are stored, names
    that begin like none of the other side are left out first: a name becomes hundreds of keys, a beginning few.
    """
    most = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = [min(tasks_for(x, NAME_BYTES), most) for x in (wanted, names)]
    if keep:
        wanted, names = with_shared_heads(wanted, names, target, name, limit, keep)
    wanted, names = (x.repartition(n) for x, n in zip((wanted, names), tasks, strict=True))
    size, n, none = F.length(target), F.length(name), F.array().cast("array<bigint>")
    of_target = F.when(size <= SHORT_NAME, deletions(F.col(target), limit)).otherwise(wanted_parts(F.col(target), limit))
    by_rest = F.when(n <= SHORT_NAME + limit, deletions(F.col(name), limit)).otherwise(none)
    by_part = F.when(n > SHORT_NAME - limit, parts(F.col(name), limit)).otherwise(none)
    names = names.withColumn("__key", F.explode(F.concat(by_rest, by_part)))
    pairs = wanted.withColumn("__key", F.explode(of_target)).join(apart(names) if keep else names, "__key")
    return pairs.withColumn("distance", F.levenshtein(target, name, limit)).where("distance >= 0").drop("__key")


def nearest_names(targets: DataFrame, names: DataFrame, target: str = "target", name: str = "name", order: str = "ord", limit: int = 2) -> DataFrame:
    """For each distinct target the name within ``limit`` edits: fewest edits, then the first by ``order``."""
    names = names.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("__name")).agg(F.min(order).alias("__ord"))
    wanted = targets.select(target).where(F.col(target).isNotNull()).distinct()
    pairs = near_names(wanted, names, target, "__name", limit)
    return pairs.groupBy(target).agg(F.min_by(F.struct(F.col("__name").alias("name"), "distance"), F.struct("distance", "__ord")).alias("best")).select(target, "best.*")


def contains_either(a: Column, b: Column) -> Column:
    return a.contains(b) | b.contains(a)


def unmatched(rows: DataFrame, others: DataFrame, key: str, column: str = "file") -> DataFrame:
    """Rows of a key whose value neither contains nor is contained in any of the key's other values; keys without others give none."""
    o = others.select(F.col(key).alias("__k"), F.col(column).alias("__c"))
    left = rows.join(o.select("__k").distinct(), rows[key] == F.col("__k"), "left_semi")
    return left.join(o, (left[key] == o["__k"]) & contains_either(left[column], o["__c"]), "left_anti")


def change_diff(old: DataFrame, new: DataFrame, key: str = "path", value: str = "hash") -> DataFrame:
    """added, removed and modified keys between two snapshots."""
    a, b = old.select(F.col(key).alias("__a"), F.col(value).alias("__old")), new.select(F.col(key).alias("__b"), F.col(value).alias("__new"))
    kind = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(~F.col("__old").eqNullSafe(F.col("__new")), "modified")
    return a.join(b, a["__a"] == b["__b"], "full_outer").select(F.coalesce("__a", "__b").alias(key), kind.alias("change")).where("change IS NOT NULL")


def cost(usage: DataFrame, rates: DataFrame) -> DataFrame:
    """Usage with ``cost_usd`` by the model's rates a token; unknown models cost nothing. ``rates``: model, rate_in, rate_out (a price list)."""
    joined = usage.join(F.broadcast(rates), "model", "left")
    return joined.withColumn("cost_usd", F.coalesce("rate_in", F.lit(0.0)) * F.col("tokens_in") + F.coalesce("rate_out", F.lit(0.0)) * F.col("tokens_out")).drop("rate_in", "rate_out")


def new_by_hash(rows: DataFrame, held: DataFrame, hash_col: str = "content_hash", order: str = "id") -> DataFrame:
    """Rows whose hash is not held yet, of equal ones the first."""
    first = Window.partitionBy(hash_col).orderBy(order)
    fresh = rows.join(held.select(hash_col).distinct(), hash_col, "left_anti")
    return fresh.withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r")


def resolve_edges(edges: DataFrame, symbols: DataFrame, bindings: DataFrame | None, fuzzy_limit: int = 2, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """Resolve call targets by six ordered strategies; the first hit wins.

    ``edges``: src_qn, dst_qn, kind, confidence. ``symbols``: ord (insertion order), name, qualified_name.
    ``bindings``: local, target, or None. Adds target, score, resolved, strategy. Look-ups are joins on small
    distinct tables; only what no look-up settles goes to the fuzzy join. ``keep`` stores the table between steps: with
    it the driver plans a few joins at a time, without it all of them at once, which takes it hundreds of MB.
    """
    known = symbols.select(F.col("qualified_name").alias("__qn")).distinct()
    by_name = symbols.groupBy(F.lower("name").alias("__n")).agg(F.count("*").alias("__count"), F.min_by("qualified_name", "ord").alias("__first"), F.min("ord").alias("__ord"))
    step = keep or (lambda df, label: df)
    by_name = step(by_name, "names")

    def look(df: DataFrame, expression: Column, table: DataFrame, key: str, out: dict[str, str]) -> DataFrame:
        t = table.select(F.col(key).alias("__look"), *(F.col(c).alias(n) for c, n in out.items()))
        some = F.coalesce(expression, "src_qn")  # rows that ask for nothing are most: by a null they would all go to one task
        return df.join(apart(t) if keep else t, expression.isNotNull() & (some == F.col("__look")), "left").drop("__look")

    dst, src = F.col("dst_qn"), F.split("src_qn", r"\.")
    e = look(edges, dst, known, "__qn", {"__qn": "exact"})
    e = look(e, F.concat(src[0], F.lit("."), dst), known, "__qn", {"__qn": "local1"})
    e = look(e, F.when(F.size(src) >= 3, F.concat(src[0], F.lit("."), F.get(src, F.lit(1)), F.lit("."), dst)), known, "__qn", {"__qn": "local2"})
    if bindings is None:
        e = e.withColumns({c: F.lit(None).cast("string") for c in ("bind", "bind_known")})
    else:
        bound = bindings.groupBy(F.col("local").alias("__local")).agg(F.min("target").alias("__target"))
        e = look(e, dst, bound, "__local", {"__target": "bind1"})
        e = look(e, F.lower(dst), bound, "__local", {"__target": "bind2"})
        e = e.withColumn("bind", F.coalesce("bind1", "bind2"))
        e = look(e, F.col("bind"), known, "__qn", {"__qn": "bind_known"})
    e = step(e, "looked")
    e = look(e, F.lower(dst), by_name, "__n", {"__count": "n1", "__first": "first1"})
    e = look(e, F.when(dst.contains("."), F.lower(F.substring_index(dst, ".", 1))), by_name, "__n", {"__count": "n2", "__first": "first2"})
    e = e.withColumn("rebuilt", F.when(F.col("n2") == 1, F.concat("first2", F.expr("substring(dst_qn, instr(dst_qn, '.'))"))))
    e = look(e, F.col("rebuilt"), known, "__qn", {"__qn": "rebuilt_known"})

    def hit(target: Column, score: float | Column, resolved: Column, strategy: str | Column) -> Column:
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(target.alias("target"), lit(score).cast("double").alias("score"), resolved.alias("resolved"), lit(strategy).alias("strategy"))

    yes, col = F.lit(True), F.col
    found = (
        F.when(col("kind") != "calls", hit(dst, col("confidence"), col("exact").isNotNull(), F.when(col("exact").isNotNull(), "exact").otherwise("unresolved")))
        .when(col("exact").isNotNull(), hit(dst, 1.0, yes, "exact"))
        .when(col("local1").isNotNull(), hit(col("local1"), 0.95, yes, "local_scope"))
        .when(col("local2").isNotNull(), hit(col("local2"), 0.95, yes, "local_scope"))
        .when(col("bind").isNotNull(), hit(col("bind"), 0.9, col("bind_known").isNotNull(), "file_alias"))
        .when(col("n1") == 1, hit(col("first1"), 0.85, yes, "import_resolved"))
        .when(col("rebuilt").isNotNull(), hit(col("rebuilt"), 0.75, col("rebuilt_known").isNotNull(), "type_hint"))
    )
    e = step(e.select(*edges.columns, found.alias("found"), F.when(found.isNull(), F.lower(dst)).alias("__fuzzy")), "named")
    wanted = step(e.where("__fuzzy IS NOT NULL").select(F.col("__fuzzy").alias("__t")).distinct(), "wanted")
    names = by_name.where("__n IS NOT NULL")
    pairs = step(near_names(wanted, names.select("__n"), "__t", "__n", fuzzy_limit, keep), "pairs")
    near = pairs.join(apart(names) if keep else names, "__n").groupBy("__t").agg(F.min_by("__first", F.struct("distance", "__ord")).alias("__near"))
    e = look(e, F.col("__fuzzy"), near, "__t", {"__near": "__near"})
    last = F.when(F.col("__near").isNotNull(), hit(F.col("__near"), 0.5, yes, "fuzzy")).otherwise(hit(dst, col("confidence"), F.lit(False), "unresolved"))
    return e.withColumn("found", F.coalesce("found", last)).select(*edges.columns, "found.*")
