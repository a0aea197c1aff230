"""Graph traversal and hash trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.worktables import stored


def closure(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """Nodes reachable from each seed in 1 to ``depth`` steps, with the least depth; the seed is left out.

    ``edges``: src, dst. ``seeds``: root. Breadth first: each step joins the frontier and drops what was
    seen, so that a node is expanded once per root. Steps are stored: each reads the edges once.
    """
    levels = [stored(seeds.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")).distinct(), "seeds")]
    for step in range(1, depth + 1):
        ahead = levels[-1].join(edges, F.col("node") == edges["src"]).select("root", F.col("dst").alias("node")).distinct()
        seen = levels[0].select("root", "node")
        for level in levels[1:]:
            seen = seen.unionByName(level.select("root", "node"))
        levels.append(stored(ahead.join(seen, ["root", "node"], "left_anti").withColumn("depth", F.lit(step)), f"level{step}"))
    out = levels[0].limit(0)
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


#: Hex digits of a hash that are added up at a time, and how often.
DIGITS, PARTS = 15, 4


def combined(hash_col: Column) -> Column:
    """A hash of a group's hashes that does not depend on their order: a digest of sums of their parts, so that groups add up piece by piece."""
    part = lambda i: F.conv(F.substr(hash_col, F.lit(1 + i * DIGITS), F.lit(DIGITS)), 16, 10).cast("decimal(20,0)")
    return F.sha2(F.concat_ws(":", F.count(hash_col).cast("string"), *(F.sum(part(i)).cast("string") for i in range(PARTS))), 256)


def leaf(path: Column, hash_col: Column) -> Column:
    return F.sha2(F.concat(path, F.lit(":"), hash_col), 256)


def folder_hashes(files: DataFrame, path: str = "path", hash_col: str = "hash") -> DataFrame:
    """A hash of each folder over its files' paths and hashes, whatever their order. A large folder is summed in parts."""
    folder = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return files.groupBy(folder.alias("folder")).agg(combined(leaf(F.col(path), F.col(hash_col))).alias("hash"), F.count("*").alias("n"))


def root_hash(folders: DataFrame) -> DataFrame:
    """One row: the hash of the tree, over its folders' names and hashes."""
    return folders.agg(combined(leaf(F.col("folder"), F.col("hash"))).alias("root"))


def changed_paths(old: DataFrame, new: DataFrame, path: str = "path", hash_col: str = "hash") -> DataFrame:
    """``path`` and ``change`` (added, removed, modified) between two trees: files are compared only below folders whose hashes differ."""
    from .joins import change_diff

    folder = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    changed = change_diff(folder_hashes(old, path, hash_col), folder_hashes(new, path, hash_col), "folder", "hash").select(F.col("folder").alias("__folder"))
    below = lambda df: df.select(path, hash_col).join(changed, folder == F.col("__folder"), "left_semi")
    return change_diff(below(old), below(new), path, hash_col)
