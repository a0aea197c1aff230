"""Ordered logic as windows: budgets, groups, overlaps, caches, breakers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import BLOCK, LAST, MAX, SUM, in_blocks, running


def budget_prefix(df: DataFrame, budget: int, tokens: str = "token_count", order: str = "id", per: list[str] = []) -> DataFrame:  # noqa: B006
    """Smallest first while the running sum stays within the budget: the greedy fill, as sizes only grow."""
    w = Window.partitionBy(*per).orderBy(tokens, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(tokens).over(w)).where(F.col("used") <= budget)


def budget_in_order(df: DataFrame, budget: int, per: str, tokens: str = "tokens", order: str = "ord", item: str = "id") -> DataFrame:
    """Items of a request in arrival order; one that does not fit is skipped and later ones still may.

    A fold over the request's candidates, which retrieval has limited; not for unbounded groups.
    """
    rows = df.groupBy(per).agg(F.array_sort(F.collect_list(F.struct(order, item, tokens))).alias("all"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<struct<{item}:{df.schema[item].dataType.simpleString()},used:bigint>>").alias("taken"))

    def step(acc: Column, x: Column) -> Column:
        used = acc["used"] + x[tokens]
        taken = F.concat(acc["taken"], F.array(F.struct(x[item].alias(item), used.alias("used"))))
        return F.when(used <= budget, F.struct(used.alias("used"), taken.alias("taken"))).otherwise(acc)

    return rows.select(per, F.explode(F.aggregate("all", start, step)["taken"]).alias("t")).select(per, "t.*")


def first_of_each(df: DataFrame, keys: list[Column], order: str) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("__r = 1").drop("__r")


def parallel_groups(steps: DataFrame, plan: str = "plan", step: str = "step", file: str = "file") -> DataFrame:
    """Group number (from 1) of each step of a plan: a new group starts when a step touches a file of any earlier step."""
    first = F.min(step).over(Window.partitionBy(plan, file))
    per_step = steps.withColumn("__first", first).groupBy(plan, step).agg(F.bool_or(F.col("__first") < F.col(step)).alias("conflict"))
    w = Window.partitionBy(plan).orderBy(step)
    start = (F.col("conflict") | (F.row_number().over(w) == 1)).cast("long")
    return per_step.withColumn("__start", start).withColumn("group", F.sum("__start").over(w)).drop("__start")


def file_conflicts(results: DataFrame, plan: str = "plan", step: str = "step", file: str = "file", success: str = "success") -> DataFrame:
    """The first successful step owns a file; each later successful one conflicts with it."""
    owner = F.min(step).over(Window.partitionBy(plan, file))
    return results.where(success).select(plan, file, owner.alias("step_a"), F.col(step).alias("step_b")).where("step_b <> step_a")


#: Forms in which an agent's output names a modified file (fixed values).
MODIFIED = [r"(?m)^(?:Edit|Write|Created?|Modified?):\s+(.+\.(?:ts|js|py|rs|go|java))", r"(?m)^\+\+\+\s+b/(.+)", r"(?m)^diff --git a/\S+ b/(\S+)"]


def modified_files(output: Column) -> Column:
    """Distinct files that an output names, trimmed."""
    found = [F.regexp_extract_all(output, F.lit(p), F.lit(1)) for p in MODIFIED]
    return F.array_distinct(F.transform(F.concat(*found), lambda x: F.trim(x)))


def with_overlap(chunks: DataFrame, per: str, order: str, content: str = "content", start: str = "start_line", overlap: int = 300) -> DataFrame:
    """Prefix each chunk but the first with the end of the one before and move its start line up accordingly."""
    before = F.right(F.lag(content).over(Window.partitionBy(per).orderBy(order)), F.lit(overlap))
    lines = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    rows = chunks.withColumn("__before", before).withColumn("__lines", lines)
    moved = F.greatest(F.lit(1), F.col(start) - F.col("__lines"))
    return rows.withColumn(start, F.coalesce(moved, F.col(start))).withColumn(content, F.coalesce(F.concat("__before", F.lit("\n"), content), F.col(content))).drop("__before", "__lines")


def fifo_hot(items: DataFrame, capacity: int, per: str, order: str, tokens: str = "tokens") -> DataFrame:
    """``hot`` per item after all were added: the longest suffix of items that fit at all and together. Valid while nothing is read back. A scan in blocks."""
    fits, last_first = F.col(tokens) <= capacity, [F.desc(order)]
    rows = running(in_blocks(items, per, last_first), per, last_first, {"hot": (SUM, F.when(fits, F.col(tokens)).otherwise(0))})
    return rows.withColumn("hot", fits & (F.col("hot") <= capacity)).drop(BLOCK)


def breaker_open(calls: DataFrame, per: str, ts: str, order: str, failed: str, threshold: int = 3, reset_ms: int = 30_000) -> DataFrame:
    """``open``: whether the breaker blocks at a call: enough failures since the last success and the last of them is recent. Two scans in blocks."""
    by = [F.col(ts), F.col(order)]
    rows = in_blocks(calls, per, by)
    failures = {"__fails": (SUM, F.when(F.col(failed), 1).otherwise(0)), "__last": (MAX, F.when(F.col(failed), F.col(ts)))}
    rows = running(rows, per, by, failures, itself=False).withColumn("__fails", F.coalesce("__fails", F.lit(0)))
    rows = running(rows, per, by, {"__settled": (LAST, F.when(~F.coalesce(F.col(failed), F.lit(False)), F.col("__fails")))}, itself=False)
    since = F.col("__fails") - F.coalesce("__settled", F.lit(0))
    return rows.withColumn("open", F.coalesce((since >= threshold) & (F.col(ts) - F.col("__last") <= reset_ms), F.lit(False))).drop("__fails", "__last", "__settled", BLOCK)


def backoff(attempts: DataFrame, attempt: str = "attempt", base_ms: int = 500) -> DataFrame:
    return attempts.withColumn("delay_ms", (F.pow(F.lit(2.0), F.col(attempt) - 1) * base_ms).cast("long"))


def budget_events(turns: DataFrame, total: Column, per: str, order: str, tokens: str = "tokens", warn: float = 0.9) -> DataFrame:
    """Running share of a token budget and its severity; a total of 0 gives none. A scan in blocks."""
    by = [F.col(order)]
    rows = running(in_blocks(turns, per, by), per, by, {"used": (SUM, F.col(tokens))}, ties=True).drop(BLOCK)
    rows = rows.withColumn("ratio", F.when(total > 0, F.col("used") / total))
    return rows.withColumn("severity", F.when(F.col("ratio") >= 1.0, "error").when(F.col("ratio") >= warn, "warning"))


def keep_last(df: DataFrame, per: str, order: str, keep: int) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(per).orderBy(F.desc(order)))).where(F.col("__r") <= keep).drop("__r")


def rollovers(rows: Column, every: int, keep: int) -> Column:
    """Whether a session rolls over when its row number ``rows`` is stored, if pruning to ``keep`` < ``every`` follows each time."""
    return (rows >= every) & ((rows - every) % (every - keep) == 0)
