"""Filters and projections."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def point_lookup(rows: DataFrame, wanted: list[str], column: str, order: str = "id") -> DataFrame:
    """A row for each of the (few) values ``wanted``: the first by ``order`` that has it, or nulls and an ``error``."""
    hits = rows.where(F.col(column).isin(wanted)).groupBy(F.col(column).alias("__key")).agg(F.min_by(F.struct(*rows.columns), order).alias("__row"))
    asked = rows.sparkSession.createDataFrame([(x,) for x in dict.fromkeys(wanted)], "wanted string")
    out = asked.join(hits, F.col("wanted") == F.col("__key"), "left")
    return out.select("wanted", "__row.*", F.when(F.col("__key").isNull(), F.concat(F.lit("not found: "), "wanted")).alias("error"))


def keyword(df: DataFrame, column: str, words: str) -> DataFrame:
    """Rows whose column contains ``words`` in any case; % and _ in them are wildcards."""
    return df.where(F.col(column).ilike(f"%{words}%"))


def snippet(df: DataFrame, column: str, text: str, length: int = 40) -> DataFrame:
    """Rows that contain the first ``length`` characters of the trimmed text."""
    return keyword(df, column, text.strip()[:length])


def path_fragments(paths: DataFrame, fragments: DataFrame, path: str = "path", fragment: str = "fragment") -> DataFrame:
    """Pairs of a path and a fragment that it contains, in any case. ``fragments`` is a request's short list."""
    return paths.join(fragments, F.expr(f"{path} ILIKE concat('%', {fragment}, '%')"))


def glob_regex(glob: str) -> str:
    """Anchored, any case; * is any text, ? any character."""
    return "(?i)^" + "".join(".*" if c == "*" else "." if c == "?" else re.sub(r"([.+^${}()|\[\]\\])", r"\\\1", c) for c in glob) + "$"


def matches_any(value: Column, globs: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [value.rlike(glob_regex(g)) for g in globs], F.lit(False))


def command_verdict(command: Column, allow: list[str] = [], deny: list[str] = []) -> Column:  # noqa: B006
    """(allowed, reason) of a command line by its first word; deny wins, a non-empty allow list must match."""
    first = F.regexp_extract(F.trim(command), r"^(\S*)", 1)
    verdict = lambda ok, *reason: F.struct(F.lit(ok).alias("allowed"), F.concat(*reason).alias("reason"))
    out = verdict(True, F.lit("Command permitted by policy"))
    if allow:
        out = F.when(~matches_any(first, allow), verdict(False, F.lit("Command '"), first, F.lit("' not in allow list"))).otherwise(out)
    if deny:
        out = F.when(matches_any(first, deny), verdict(False, F.lit("Command '"), first, F.lit("' matches deny list"))).otherwise(out)
    return out


def path_allowed(path: Column, mode: str, forbidden: list[str] = [], writable: list[str] = []) -> Column:  # noqa: B006
    """Forbidden paths first; for writes a non-empty writable list must match. Reading is free otherwise."""
    ok = ~matches_any(path, forbidden)
    return ok & matches_any(path, writable) if mode == "write" and writable else ok


def name_allowed(name: Column, deny: list[str] = [], allow: list[str] = []) -> Column:  # noqa: B006
    """Environment variables (deny list) and domains (allow list; empty allows all)."""
    ok = ~matches_any(name, deny)
    return ok & matches_any(name, allow) if allow else ok


def normal_domain(raw: Column) -> Column:
    """Lower case, without scheme, path and port."""
    bare = F.regexp_replace(raw, "(?i)^https?://", "")
    return F.lower(F.split_part(F.split_part(bare, F.lit("/"), F.lit(1)), F.lit(":"), F.lit(1)))


def domain_matches(domain: Column, patterns: list[str]) -> Column:
    """Equal, or for ``*.x`` a true sub-domain of x."""
    each = [domain.endswith(p[1:].lower()) if p.startswith("*.") else domain == p.lower() for p in patterns]
    return reduce(lambda a, b: a | b, each, F.lit(False))


def egress_allowed(raw: Column, allow: list[str] = [], deny: list[str] = []) -> Column:  # noqa: B006
    domain = normal_domain(raw)
    ok = ~domain_matches(domain, deny)
    return ok & domain_matches(domain, allow) if allow else ok


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether a relative path is ignored: a dot name anywhere, or a pattern that fits it or one of its parents.

    /x: from the root; x/: a directory of that name at any depth; a/b: the whole path; x: the last name.
    Only * is a wildcard; ? keeps its meaning in a regular expression; case counts.
    """
    parts = F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda p: p != "")
    dotted = F.exists(parts, lambda p: p.startswith("."))
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))

    def one(pattern: str) -> Column:
        rooted, folder, bare = pattern.startswith("/"), pattern.endswith("/"), pattern.strip("/")
        body = re.sub(r"([.+^${}()|\[\]\\])", r"\\\1", bare).replace("*", ".*")
        if folder and rooted:
            return F.exists(prefixes, lambda p: p.rlike(f"^{body}$") | p.startswith(bare + "/"))
        if folder:
            n = bare.count("/") + 1
            runs = F.transform(F.sequence(F.lit(1), F.size(parts) - n + 1), lambda i: F.array_join(F.slice(parts, i, F.lit(n)), "/"))
            return (F.size(parts) >= n) & F.exists(F.when(F.size(parts) >= n, runs), lambda p: p.rlike(f"^{body}$"))
        if rooted or "/" in bare:
            return F.exists(prefixes, lambda p: p.rlike(f"^{body}$"))
        return F.exists(parts, lambda p: p.rlike(f"^{body}$"))

    return dotted | reduce(lambda a, b: a | F.coalesce(b, F.lit(False)), [one(p) for p in patterns if p.strip("/")], F.lit(False))


def preview(text: Column, length: int) -> Column:
    """The first ``length`` characters in one line."""
    return F.regexp_replace(F.substring(text, 1, length), "\n", " ")


#: Words of an intent and the agent that they choose, in this order (fixed values).
INTENTS = [
    ("code_gen", ["implement", "write", "create", "add", "generate", "code"]),
    ("search", ["find", "search", "locate", "scan", "grep", "list"]),
    ("refactor", ["rename", "refactor", "move", "extract", "reorganize", "restructure"]),
]


def dispatch(intent: Column, choices: dict[str, str], default: str = "auto", first: str = "first") -> Column:
    """The agent for an intent; ``auto`` falls back to ``default``, and that to ``first``."""
    resolve = lambda choice, other: (other if other != "auto" else first) if choice == "auto" else choice
    out = F.lit(resolve(default, first))
    for name, words in reversed(INTENTS):
        out = F.when(F.lower(intent).rlike("|".join(words)), F.lit(resolve(choices.get(name, "auto"), default))).otherwise(out)
    return out


def key_error(provider: Column, key: Column, prefixes: dict[str, str], least: int = 8) -> Column:
    """What is wrong with an API key's form; null where nothing is."""
    out = F.when(F.length(key) < least, F.lit("Key too short"))
    for name, prefix in prefixes.items():
        out = F.when((provider == name) & ~key.startswith(prefix), F.lit(f"{name} keys start with {prefix}")).otherwise(out)
    return out


def relevant_levels(df: DataFrame, level: str = "level") -> DataFrame:
    """Errors and warnings; every row where there are none."""
    some = df.where(F.col(level).isin("error", "warn")).limit(1).select(F.lit(True).alias("__some"))
    joined = df.join(F.broadcast(some), F.lit(True), "left")
    return joined.where(F.col("__some").isNull() | F.col(level).isin("error", "warn")).drop("__some")
