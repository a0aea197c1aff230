"""Source trees: recursive scans, project profile, hash scans, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators.predicates import ignored

#: Extension to language (fixed values).
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "go": "go", "rs": "rust", "java": "java",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "c": "cpp", "h": "cpp", "hpp": "cpp",
}
#: Folders that a walk never enters, besides those with a dot (fixed values).
SKIPPED = ["node_modules", "dist", "build"]
#: The same for the project profile, which has its own: languages by extension, and folders (fixed values).
PROFILE_LANGUAGES = {
    "ts": "TypeScript", "tsx": "TypeScript", "js": "JavaScript", "jsx": "JavaScript", "py": "Python", "rs": "Rust", "go": "Go", "java": "Java", "cpp": "C++", "c": "C", "rb": "Ruby",
}
PROFILE_SKIPPED = ["node_modules", "dist", "build", "target", "__pycache__"]


def scan(spark: SparkSession, folder: str, languages: dict[str, str] = LANGUAGES, skipped: list[str] = SKIPPED, content: bool = True, mapped: bool = True) -> DataFrame:
    """Files below ``folder``, only those with a mapped extension if ``mapped``: ``path`` (relative), ``lang``, ``mtime`` (ms), ``size`` and, if asked for, ``content``.

    Names that begin with a dot and skipped folders are left out, and files of no bytes, which Spark's file sources pass over.
    Without ``content`` no file is opened.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    base = folder.rstrip("/").split("://")[-1].lstrip("/")
    relative = F.expr(f"CASE WHEN locate('{base}/', __p) > 0 THEN substring(__p, locate('{base}/', __p) + {len(base) + 1}) ELSE __p END")
    raw = raw.withColumn("__p", F.regexp_replace("path", r"^[a-z0-9+.-]+:/*", "")).withColumn("rel", relative)
    parts = F.split("rel", "/")
    kept = ~F.exists(parts, lambda p: p.startswith(".") | p.isin(skipped))
    table = F.create_map(*(F.lit(x) for pair in languages.items() for x in pair))
    lang = table[F.lower(F.substring_index("rel", ".", -1))]
    columns = [F.col("rel").alias("path"), lang.alias("lang"), F.unix_millis("modificationTime").alias("mtime"), F.col("length").alias("size")]
    files = raw.where(kept).select(*columns, *(["content"] if content else []))
    return files.where("lang IS NOT NULL") if mapped else files


def project_profile(spark: SparkSession, folder: str, depth: int = 5) -> DataFrame:
    """``profile`` of a folder by the profile's own rules."""
    return profile(scan(spark, folder, PROFILE_LANGUAGES, PROFILE_SKIPPED, content=False, mapped=False), depth)


def profile(files: DataFrame, depth: int = 5) -> DataFrame:
    """Languages down to a depth, most files first: ``lang``, ``n``, and of all files ``file_count`` and whether a name speaks of tests (``has_tests``)."""
    near = files.where(F.size(F.split("path", "/")) <= depth + 1)
    name = F.lower(F.substring_index("path", "/", -1))
    whole = near.agg(F.count("*").alias("file_count"), F.coalesce(F.bool_or(name.contains("test") | name.contains("spec")), F.lit(False)).alias("has_tests"))
    return near.where("lang IS NOT NULL").groupBy("lang").agg(F.count("*").alias("n")).join(F.broadcast(whole)).orderBy(F.desc("n"), "lang")


def hashes(spark: SparkSession, folder: str, patterns: list[str] = [], languages: dict[str, str] = LANGUAGES) -> DataFrame:  # noqa: B006
    """(path, hash) of the files that no ignore pattern covers."""
    files = scan(spark, folder, languages)
    return files.where(~ignored(F.col("path"), patterns)).select("path", F.sha2("content", 256).alias("hash"))


def save_snapshot(hashed: DataFrame, path: str) -> None:
    hashed.select("path", "hash").write.mode("overwrite").parquet(path)


def load_snapshot(spark: SparkSession, path: str, build: DataFrame) -> DataFrame:
    """The saved snapshot; where there is none, ``build`` is saved and returned."""
    try:
        return spark.read.schema("path string, hash string").parquet(path)
    except AnalysisException:
        save_snapshot(build, path)
        return spark.read.schema("path string, hash string").parquet(path)
