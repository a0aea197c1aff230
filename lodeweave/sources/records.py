"""JSON lines, text logs, configuration and report files."""

from __future__ import annotations

import json
import logging
import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.logs import parse_lines
from .worktables import stored

RESULT = "name string, ms double, ok boolean"
ACTION = "ts bigint, taskId string, kind string, payload map<string,string>"


def append_actions(entries: DataFrame, path: str) -> None:
    """Append action-log entries as JSON lines; ``ts`` is given or now."""
    now = F.unix_millis(F.current_timestamp())
    rows = entries if "ts" in entries.columns else entries.withColumn("ts", now)
    rows.select("ts", "taskId", "kind", "payload").write.mode("append").json(path)


def read_actions(spark: SparkSession, path: str, strict: bool = True, last: int | None = None, schema: str = ACTION) -> DataFrame:
    """The log; blank lines are skipped. A bad line is an error, or dropped if not ``strict``; ``last`` keeps the newest so many."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    return rows.orderBy(F.desc("ts"), "taskId", "kind").limit(last) if last is not None else rows


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the text files below a path: file, line (from 0), raw.

    Files are read in byte splits, so that a large one is many tasks. A line's number is its place in its split and the lines
    of the file's splits before: a sum over one row per split. Lines end with a line feed, the last one may lack it;
    a carriage return stays at the end of its line.
    """
    rows = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("raw"))
    rows = stored(rows, "lines")  # numbers and sums are of the same splits
    splits = rows.groupBy("file", "split").agg(F.min("n").alias("first"), F.count("*").alias("lines"))
    before = F.coalesce(F.sum("lines").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(splits.select("file", "split", (before - F.col("first")).alias("shift")), ["file", "split"]).select("file", (F.col("n") + F.col("shift")).alias("line"), "raw")


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Entries of the text logs below a path, a log a file; entries may cross splits."""
    return parse_lines(read_lines(spark, path), "file")


def read_config(spark: SparkSession, path: str, defaults: dict) -> dict:
    """A configuration file, JSON or YAML, over defaults. An absent one gives the defaults, a broken one too, with a warning in the log.

    Read through Spark, so that it can lie in any store; call it once a micro-batch to follow changes. Any other failure to read is raised.
    """
    try:
        text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition()):
            raise
        return dict(defaults)
    try:
        found = yaml_mapping(text)
    except ValueError as e:
        logging.getLogger(__name__).warning("%s is not read, the defaults hold: %s", path, e)
        return dict(defaults)
    return {**defaults, **found}


def yaml_mapping(text: str) -> dict:
    """The mapping in a JSON text or a YAML one: nested mappings and lists by indentation, JSON in a line, plain and quoted scalars, comments.

    No anchors, tags or text blocks: those are a ValueError, as is what is not a mapping.
    """
    lines = [(len(x) - len(x.lstrip(" ")), x.strip()) for x in (re.sub(r"(^|\s)#.*$", "", y) if '"' not in y and "'" not in y else y for y in text.split("\n")) if x.strip() not in ("", "---")]

    def scalar(x: str) -> object:
        if x.startswith(("{", "[", '"')):
            return json.loads(x)
        if x[:1] == "'" and x[-1:] == "'" and len(x) > 1:
            return x[1:-1].replace("''", "'")
        if x.startswith(tuple("&*!|>%@`")):
            raise ValueError(f"not read: {x}")
        if x.lower() in ("", "~", "null"):
            return None
        if x.lower() in ("true", "false"):
            return x.lower() == "true"
        for kind in (int, float):
            try:
                return kind(x)
            except ValueError:
                pass
        return x

    def block(at: int, indent: int) -> tuple[object, int]:
        out: dict | list | None = None
        while at < len(lines) and lines[at][0] == indent:
            line = lines[at][1]
            item, pair = line == "-" or line.startswith("- "), re.match(r"""("[^"]*"|'[^']*'|[^\s:'"{\[#-][^:]*?|-?\w+)\s*:(?:\s+(.*))?$""", line)
            if isinstance(out, dict if item else list) or not (item or pair):
                raise ValueError(f"not read: {line}")
            out = out if out is not None else [] if item else {}
            rest = line[1:].strip() if item else (pair.group(2) or "").strip()
            at += 1
            if not rest and at < len(lines) and lines[at][0] > indent:
                value, at = block(at, lines[at][0])
            elif item and re.match(r"[\w\"'][^{\[]*?:(\s|$)", rest):
                lines[at - 1] = (indent + len(line) - len(rest), rest)
                value, at = block(at - 1, lines[at - 1][0])
            else:
                value = scalar(rest)
            if item:
                out.append(value)
            else:
                out[scalar(pair.group(1))] = value
        return out, at

    if text.lstrip()[:1] == "{":
        found, end = json.loads(text), len(lines)
    else:
        found, end = block(0, lines[0][0]) if lines else ({}, 0)
    if not isinstance(found, dict) or end < len(lines):
        raise ValueError("not a mapping")
    return found


def append_decisions(decisions: DataFrame, facts_path: str) -> None:
    """Decisions (title, body, ts) as facts tagged 'decision', with their markdown."""
    text = F.concat(F.lit("## "), "title", F.lit("\n\n"), "body", F.lit("\n"))
    decisions.select(F.sha2(F.concat_ws("|", "ts", "title"), 256).alias("id"), text.alias("text"), "ts", F.lit("decision").alias("tags")).write.mode("append").parquet(facts_path)


def write_results(results: DataFrame, path: str) -> None:
    """Benchmark results (name, ms, ok) of any number as JSON lines, a file a task."""
    results.select("name", "ms", "ok").write.mode("overwrite").json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESULT).option("mode", "FAILFAST").json(path)


def report_totals(results: DataFrame) -> DataFrame:
    """Number, success rate and mean time of benchmark results in one row."""
    return results.agg(F.count("*").alias("n"), F.avg(F.col("ok").cast("double")).alias("success_rate"), F.avg("ms").alias("mean_ms"))
