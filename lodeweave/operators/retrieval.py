"""Context retrieval for plan steps: candidates by file and by vector, first of equals, within a token budget."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import token_estimate
from .predicates import path_fragments
from .sequences import budget_in_order, first_of_each


class VectorSearch(Protocol):
    """What a vector store offers to retrieval: for steps (step, intent) rows of step, rank, path and content."""

    def search(self, steps: DataFrame, k: int) -> DataFrame: ...


Progress = Callable[[str], None]


def graph_candidates(expected: DataFrame, files: DataFrame, chunks: DataFrame, limit: int = 10) -> DataFrame:
    """For each step and expected file at most ``limit`` chunks, by id, of the files whose path contains it.

    ``expected``: step, fragment, n (its place in the step). ``files``: id, path. ``chunks``: id, file_id, content.
    """
    wanted = expected.select("fragment").distinct()
    hits = path_fragments(files.select(F.col("id").alias("file_id"), "path"), wanted)
    found = hits.join(chunks.select("id", "file_id", "content"), "file_id")
    rank = F.row_number().over(Window.partitionBy("fragment").orderBy("id"))
    found = found.select("fragment", "id", "content", rank.alias("rank")).where(F.col("rank") <= limit)
    return expected.join(found, "fragment").select("step", F.struct(F.lit(0).alias("side"), "n", "rank").alias("ord"), F.col("fragment").alias("path"), "content")


def retrieve(steps: DataFrame, expected: DataFrame, files: DataFrame, chunks: DataFrame, vectors: VectorSearch | None = None, budget: int = 8000, k: int = 5, progress: Progress = lambda _: None) -> DataFrame:
    """(step, id, path, content, tokens, used): what each step is shown.

    Graph candidates come before vector candidates; of equal path and first 64 characters the first stays;
    one that does not fit into the budget is skipped. Candidates of a step are limited by their sources.
    """
    found = graph_candidates(expected, files, chunks)
    progress("graph candidates")
    if vectors is not None:
        hits = vectors.search(steps, k)
        found = found.unionByName(hits.select("step", F.struct(F.lit(1).alias("side"), F.lit(0).alias("n"), F.col("rank").cast("int").alias("rank")).alias("ord"), "path", "content"))
        progress("vector candidates")
    unique = first_of_each(found, [F.col("step"), F.col("path"), F.substring("content", 1, 64)], "ord")
    ranked = unique.withColumn("id", F.row_number().over(Window.partitionBy("step").orderBy("ord"))).withColumn("tokens", token_estimate(F.col("content")))
    taken = budget_in_order(ranked.select("step", "id", "ord", "tokens"), budget, "step")
    return ranked.join(taken, ["step", "id"]).select("step", "id", "path", "content", "tokens", "used")
