"""Indexing end to end: from files to a table of files, symbols with parents, references, edges and chunks with their symbols."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.worktables import release, scratch, stored
from .code import extract_facts, split_code
from .joins import apart, innermost_interval, near_names, resolve_edges

#: The tables of an index. ``references`` holds what every file calls, imports and extends, resolved or waiting.
INDEX = {
    "files": "path string, hash string, lang string",
    "symbols": "id bigint, path string, parent_id bigint, kind string, name string, qualified_name string, start int, end int",
    "references": "path string, src_qn string, dst_qn string, kind string, confidence double, target string, score double, strategy string, src bigint, dst bigint",
    "edges": "src bigint, dst bigint, kind string, confidence double",
    "chunks": "path string, chunk int, symbol_id bigint, content string, token_count bigint, start_line int, end_line int",
}
#: Edits up to which a call may differ from a name.
FUZZY = 2


def asked_names(reference: DataFrame) -> Column:
    """The names, as (q)ualified or (n)ame keys, that decide a reference before it comes to names that are only near."""
    dst, src = F.col("dst_qn"), F.split("src_qn", r"\.")
    q, n = lambda c: F.concat(F.lit("q:"), c), lambda c: F.concat(F.lit("n:"), F.lower(c))
    keys = F.array(
        q(dst), q(F.concat(src[0], F.lit("."), dst)), q(F.concat(src[0], F.lit("."), F.get(src, F.lit(1)), F.lit("."), dst)),
        n(dst), n(F.substring_index(dst, ".", 1)), *([q(F.col("target"))] if "target" in reference.columns else []),
    )
    return F.array_distinct(F.filter(keys, lambda k: k.isNotNull()))


def to_decide_again(references: DataFrame, changed: DataFrame) -> DataFrame:
    """References whose target may be another one now. ``changed``: names and qualified_names of symbols that came or went.

    A reference meets the symbols by the names it asked for; only those that no exact name settled meet near ones.
    """
    keys = changed.select(F.explode(F.array(F.concat(F.lit("q:"), "qualified_name"), F.concat(F.lit("n:"), F.lower("name")))).alias("key"))
    asked = references.select("path", "src_qn", "dst_qn", "kind", F.explode(asked_names(references)).alias("key"))
    exact = asked.join(apart(keys), "key", "left_semi").drop("key")
    open_calls = references.where("kind = 'calls' AND strategy IN ('fuzzy', 'unresolved')").withColumn("wanted", F.lower("dst_qn"))
    wanted = step(open_calls.select("wanted").where("wanted IS NOT NULL").distinct(), "wanted")
    names = step(changed.where("name IS NOT NULL").select(F.lower("name").alias("near")).distinct(), "near-names")
    near = step(near_names(wanted, names, "wanted", "near", FUZZY, step).select("wanted").distinct(), "near")
    close = open_calls.join(apart(near), "wanted", "left_semi").select("path", "src_qn", "dst_qn", "kind")
    return exact.unionByName(close).distinct()


def index_files(files: DataFrame, held: dict[str, DataFrame], size: int = 2500, overlap: int = 300, removed: DataFrame | None = None) -> dict[str, DataFrame]:
    """The index after a batch of files (path, code, lang, stem): files whose hash is held are skipped, those of others replaced whole.

    ``removed``: path of files that are gone. Calls are resolved against all symbols of all files. References are kept, resolved or
    not: symbols that come or go meet those that asked for their names, or near ones, and only these are decided again, so that the
    index is the same for any order of the same batches. A symbol's id depends on its path and qualified name only; of equal
    names in a file the last counts. A batch that comes again changes nothing. Every table is stored, so that an executor's loss
    repeats one step. Files without a path are left out, null code is empty, of repeated paths one counts.
    """
    with scratch(files.sparkSession) as made:

        def lasting(df: DataFrame, label: str) -> DataFrame:
            out = step(df, label)
            made.pop()
            return out

        return _index_files(files, held, size, overlap, removed, lasting)


def step(df: DataFrame, label: str) -> DataFrame:
    """A step of many: stored, and what it took of the driver given back."""
    out = stored(df, label)
    release(df.sparkSession)
    return out


def _index_files(files: DataFrame, held: dict[str, DataFrame], size: int, overlap: int, removed: DataFrame | None, lasting: Callable[[DataFrame, str], DataFrame]) -> dict[str, DataFrame]:
    """``index_files`` with work tables that are dropped after it, but for what ``lasting`` stores."""
    files = files.where("path IS NOT NULL").dropDuplicates(["path"]).withColumn("hash", F.sha2(F.coalesce("code", F.lit("")), 256))
    changed = step(files.join(apart(held["files"].select("path", "hash")), ["path", "hash"], "left_anti"), "changed")
    gone = changed.select("path") if removed is None else step(changed.select("path").unionByName(removed.select("path")).distinct(), "gone")
    if gone.isEmpty():
        return held
    rest = lambda name: held[name].join(apart(gone), "path", "left_anti")
    out = {"files": lasting(rest("files").unionByName(changed.select("path", "hash", "lang")), "files")}

    sym_id = lambda qualified: F.xxhash64("path", qualified)
    facts = step(extract_facts(changed, "path"), "facts")
    found = facts.where("qualified_name IS NOT NULL").withColumns({"id": sym_id("qualified_name"), "parent_id": F.when(F.col("parent").isNotNull(), sym_id("parent"))})
    symbols = out["symbols"] = lasting(rest("symbols").unionByName(found.select(held["symbols"].columns)), "symbols")

    new = facts.where("src_qn IS NOT NULL").select("path", "src_qn", "dst_qn", "kind", "confidence", sym_id("src_qn").alias("src"))
    kept = rest("references")
    key = ["path", "src_qn", "dst_qn", "kind"]
    again = None
    if not kept.isEmpty():
        depends = ["path", "name", "qualified_name", "start"]  # what an answer depends on
        before, after = held["symbols"].join(apart(gone), "path", "left_semi").select(*depends, F.lit(-1).alias("n")), found.select(*depends, F.lit(1).alias("n"))
        moved = step(before.unionByName(after).groupBy(depends).agg(F.sum("n").alias("n")).where("n <> 0"), "moved")
        again = step(to_decide_again(kept, moved), "again")
    undecided = new if again is None else new.unionByName(kept.join(apart(again), key, "left_semi").select(*new.columns))

    order = F.struct("path", "start")
    decided = resolve_edges(undecided, symbols.select(order.alias("ord"), "name", "qualified_name"), None, FUZZY, keep=step)
    ends = symbols.groupBy(F.col("qualified_name").alias("target")).agg(F.min_by("id", order).alias("dst"))
    decided = decided.join(apart(ends), "target", "left").withColumn("dst", F.when(F.col("resolved"), F.col("dst"))).select(held["references"].columns)
    decided = decided if again is None else kept.join(apart(again), key, "left_anti").unionByName(decided)
    references = out["references"] = lasting(decided, "references")
    out["edges"] = lasting(references.where("dst IS NOT NULL").groupBy("src", "dst", "kind").agg(F.max("score").alias("confidence")), "edges")  # an edge is held once

    spans = found.select("path", "id", F.col("start_line").alias("start"), F.col("end_line").alias("end"))
    chunks = split_code(changed, "path", size=size, overlap=overlap).withColumn("__key", F.struct("path", "chunk"))
    chunks = innermost_interval(chunks, spans, "path", "__key", at="start_line")
    chunks = chunks.select("path", "chunk", F.col("span_id").alias("symbol_id"), "content", F.ceil(F.length("content") / 4).alias("token_count"), "start_line", "end_line")
    out["chunks"] = lasting(rest("chunks").unionByName(chunks), "chunks")
    return out


def empty_index(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], schema) for name, schema in INDEX.items()}
