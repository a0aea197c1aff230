"""Roll-ups over the data model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(relation, n) for each table, in one plan."""
    return reduce(DataFrame.unionByName, [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("relation"), "n") for name, t in tables.items()])


def with_total(df: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """Groups and, in a row with ``is_total``, the grand total: one pass with rollup's outermost level."""
    out = df.groupingSets([[F.col(k) for k in keys], []], *keys).agg(*(a.alias(n) for n, a in aggregates.items()), F.grouping(keys[0]).cast("boolean").alias("is_total"))
    return out


def file_complexity(functions: DataFrame, file: str = "file", complexity: str = "complexity") -> DataFrame:
    """Most (at least 1) and mean (1 without functions) complexity of each file; null complexities are files without functions."""
    return functions.groupBy(file).agg(F.greatest(F.coalesce(F.max(complexity), F.lit(1)), F.lit(1)).alias("max_complexity"), F.coalesce(F.avg(complexity), F.lit(1.0)).alias("avg_complexity"))


def solid_score(violations: Column) -> Column:
    return F.greatest(F.lit(0), 100 - 5 * violations)


def quality_gate(max_complexity: Column, duplicate_rate: Column, score: Column, most: int = 15, rate: float = 0.15, least: int = 60) -> Column:
    return (max_complexity <= most) & (duplicate_rate <= rate) & (score >= least)
