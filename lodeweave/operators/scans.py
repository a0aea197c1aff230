"""Running values along an ordered key, in as many tasks as the rows need: a scan over blocks.

Rows are cut into ranges of (key, order). Each block is summed up by key, the summaries of a key are scanned, and a row joins what its key
had in the blocks before with what its own block has up to it. Only a key that crosses a range's bound has anything before, so
that the table of what came before has at most a row per range.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.worktables import stored

BLOCK = "__block"


class Running(NamedTuple):
    """An aggregate of the rows before, the row itself included or not, and how two parts of a key, the earlier first, make one."""

    aggregate: Callable[[Column], Column]
    join: Callable[[Column, Column], Column]


SUM = Running(F.sum, lambda a, b: F.coalesce(a + b, a, b))
MAX = Running(F.max, lambda a, b: F.greatest(a, b))
MIN = Running(F.min, lambda a, b: F.least(a, b))
#: The last value that is not null.
LAST = Running(lambda c: F.last(c, ignorenulls=True), lambda a, b: F.coalesce(b, a))


def in_blocks(rows: DataFrame, per: str, order: list[Column], ranges: int | None = None) -> DataFrame:
    """Rows with the number of their range of (``per``, ``order``), stored; rows of equal order share one. ``ranges``: by default as many as their bytes need."""
    by = [F.col(per), *order]
    return stored((rows.repartitionByRange(ranges, *by) if ranges else rows.repartitionByRange(*by)).withColumn(BLOCK, F.spark_partition_id()), "blocks")


def running(blocks: DataFrame, per: str, order: list[Column], values: dict[str, tuple[Running, Column]], itself: bool = True, ties: bool = False) -> DataFrame:
    """Add each named value over the rows of the key up to the row in ``order``: without the row if not ``itself``, with its equals in order if ``ties``.

    ``blocks`` come from ``in_blocks`` with the same key and order. Null keys are one key; no rows before give null. An empty table gives an empty result.
    """
    inside = Window.partitionBy(per, BLOCK).orderBy(*order)
    if not (itself and ties):
        inside = inside.rowsBetween(Window.unboundedPreceding, 0 if itself else -1)
    names = {n: f"__{i}" for i, n in enumerate(values)}
    whole_block = Window.partitionBy(per, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    if any(r is LAST for r, _ in values.values()):  # depends on the order inside a block
        ends = blocks.select(per, BLOCK, *(r.aggregate(c).over(whole_block).alias(names[n]) for n, (r, c) in values.items())).groupBy(per, BLOCK).agg(*(F.first(x).alias(x) for x in names.values()))
    else:
        ends = blocks.groupBy(per, BLOCK).agg(*(r.aggregate(c).alias(names[n]) for n, (r, c) in values.items()))
    earlier = Window.partitionBy(per).orderBy(BLOCK)
    before = ends.select(
        F.col(per).alias("__per"), F.col(BLOCK).alias("__at"), F.row_number().over(earlier).alias("__n"),
        *(r.aggregate(F.col(names[n])).over(earlier.rowsBetween(Window.unboundedPreceding, -1)).alias(names[n]) for n, (r, _) in values.items()),
    )
    before = before.where("__n > 1").drop("__n")  # at most a row per block
    out = blocks.select("*", *(r.aggregate(c).over(inside).alias(n) for n, (r, c) in values.items()))
    out = out.join(F.broadcast(before), F.col(per).eqNullSafe(F.col("__per")) & (F.col(BLOCK) == F.col("__at")), "left")
    return out.withColumns({n: r.join(F.col(names[n]), F.col(n)) for n, (r, _) in values.items()}).drop("__per", "__at", *names.values())
