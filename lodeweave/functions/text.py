"""Scalar text functions as column expressions."""

from __future__ import annotations

import hashlib
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def ascii_bounds(pattern: str) -> str:
    r"""A pattern whose ``\b`` sees ASCII words only, as its source dialect does; Java's sees letters of all scripts.

    Beside a letter only the other side has to be looked at.
    """
    parts = pattern.split(r"\b")
    out = parts[0]
    for part in parts[1:]:
        if re.match(r"\w|\\w", part):
            out += r"(?<!\w)"
        elif re.search(r"(?<!\\)\w$|\\w$", out):
            out += r"(?!\w)"
        else:
            out += r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
        out += part
    return out


def token_estimate(text: Column) -> Column:
    """A token for every four characters (code points), rounded up."""
    return F.ceil(F.length(text) / 4).cast("long")


def strip_ansi(text: Column, final: str = "mGKHF") -> Column:
    """Without terminal escapes that end in one of ``final`` (a character class)."""
    return F.regexp_replace(text, rf"\x1b\[[0-9;]*[{final}]", "")


def log_level(line: Column) -> Column:
    """error, warn, info, debug or unknown; the first that the line mentions, in this order (fixed values)."""
    low = F.lower(line)
    levels = {"error": ["error", "fatal", " err:", '"level":50'], "warn": ["warn", '"level":40'], "info": ["info", '"level":30'], "debug": ["debug", "verbose", '"level":20']}
    out = F.lit("unknown")
    for level, marks in reversed(levels.items()):
        out = F.when(reduce(lambda a, b: a | b, [low.contains(m) for m in marks]), F.lit(level)).otherwise(out)
    return out


def or_null(text: Column) -> Column:
    return F.when(text != "", text)


def iso_time(line: Column) -> Column:
    return or_null(F.regexp_extract(line, r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}", 0))


FRAME = r"^at (?:(\S+) \()?(.+?):(\d+):(\d+)\)?$"


def stack_frame(line: Column) -> Column:
    """(raw, fn, file, line, col) of a stack line; all but raw are null where it has another form."""
    trimmed = F.trim(line)
    part = lambda i: or_null(F.regexp_extract(trimmed, FRAME, i))
    return F.struct(trimmed.alias("raw"), part(1).alias("fn"), part(2).alias("file"), part(3).cast("int").alias("line"), part(4).cast("int").alias("col"))


def running_sums(numbers: Column, block: int = 64) -> Column:
    """The sum up to and with each number of an array, by sums of blocks: no fold that copies an array at every step."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    let = lambda x, of: F.get(F.transform(F.array(x), of), F.lit(0))  # noqa: E731  # x is evaluated once, whatever is read of it

    def over(a: Column) -> Column:
        blocks = F.when(F.size(a) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / block).cast("int")), lambda b: total(F.slice(a, b * block + 1, F.lit(block)))))
        before = let(blocks, lambda sums: F.transform(sums, lambda _, i: total(F.slice(sums, F.lit(1), i))))
        return let(before, lambda held: F.transform(a, lambda _, i: F.get(held, F.floor(i / block).cast("int")) + total(F.slice(a, i - i % block + 1, i % block + 1))))

    return let(numbers, over)


def match_offsets(text: Column, pattern: str | Column, lines: bool = False) -> Column:
    """Array of (text, start) and, if asked for, line of all matches of a pattern that never matches nothing; offsets in code points from 0, lines from 1."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    found, between = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    breaks = lambda t: F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))

    def placed(x: Column) -> Column:
        before = lambda of: running_sums(F.zip_with(x["between"], F.array_insert(x["found"], 1, F.lit("")), lambda b, m: of(b) + of(m)))
        sums = F.arrays_zip(x["found"].alias("text"), before(F.length).alias("start"), *([before(breaks).alias("line")] if lines else []))
        return F.transform(F.slice(sums, F.lit(1), F.size(x["found"])), lambda s: F.struct(s["text"].alias("text"), s["start"].alias("start"), *([(s["line"] + 1).alias("line")] if lines else [])))

    one = F.array(F.struct(found.alias("found"), between.alias("between")))
    none = F.array().cast(f"array<struct<text:string,start:int{',line:int' if lines else ''}>>")
    return F.when(F.rlike(text, pattern), F.get(F.transform(one, placed), F.lit(0))).otherwise(none)  # most texts have none


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def host(url: Column) -> Column:
    """Lower-case host of a URL; empty where it is not one."""
    return F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))


def truncate_for_embedding(text: Column, max_tokens: int) -> Column:
    """The first four characters a token; one space for an empty text."""
    return F.when(F.length(text) == 0, F.lit(" ")).otherwise(F.substring(text, 1, max_tokens * 4))


def tags(text: Column) -> Column:
    """Comma-separated tags, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda t: t != "")


def file_tokens(output: Column) -> Column:
    return F.regexp_extract_all(output, F.lit(r"[^\s]+\.[a-zA-Z]{1,6}"), F.lit(0))


def command_candidates(prompt: Column) -> Column:
    """Commands in a prompt, one a line: after ``$ ``, between back-quotes, or the line itself."""
    line = lambda t: F.when(t.startswith("$ "), F.substr(t, F.lit(3))).when(t.startswith("`") & t.endswith("`"), F.regexp_replace(t, "^`|`$", "")).otherwise(t)
    return F.transform(F.filter(F.transform(F.split(prompt, "\n"), lambda x: F.trim(x)), lambda t: t != ""), line)


def fenced_json(text: Column) -> Column:
    """The JSON of a fenced block, else from the first brace to the last; null without either."""
    fenced, braces = F.regexp_extract(text, r"```json\n([\s\S]+?)\n```", 1), F.regexp_extract(text, r"\{[\s\S]+\}", 0)
    return F.coalesce(or_null(fenced), or_null(braces))


STEP = "struct<step:int,intent:string,expectedFiles:array<string>,toolsNeeded:array<string>>"


def plan_steps(raw: Column) -> Column:
    """Steps of a plan given as a JSON array, with or without a code fence; missing parts get defaults, bad JSON gives null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(raw), r"^```[a-z]*\n?", ""), r"\n?```$", "")
    steps = F.from_json(bare, f"array<{STEP}>", {"mode": "PERMISSIVE"})
    none = F.array().cast("array<string>")
    fill = lambda s, i: F.struct(
        F.coalesce(s["step"], i + 1).alias("step"), F.coalesce(s["intent"], F.lit("")).alias("intent"), F.coalesce(s["expectedFiles"], none).alias("expectedFiles"), F.coalesce(s["toolsNeeded"], none).alias("toolsNeeded")
    )
    return F.transform(steps, fill)


def passphrase_key(passphrase: str, salt: bytes) -> bytes:
    """A 256-bit key; derived once on the driver."""
    return hashlib.scrypt(passphrase.encode(), salt=salt, n=16384, r=8, p=1, dklen=32)


def encrypt(text: Column, key: Column) -> Column:
    """AES-256-GCM as base64 of iv, tag and data, joined by colons."""
    sealed = F.aes_encrypt(text, key, F.lit("GCM"))
    n = F.octet_length(sealed)
    part = lambda a, b: F.base64(F.substring(sealed, a, b))
    return F.concat_ws(":", part(F.lit(1), F.lit(12)), part(n - 15, F.lit(16)), part(F.lit(13), n - 28))


def decrypt(sealed: Column, key: Column) -> Column:
    """The text of what ``encrypt`` made; null for anything else or another key."""
    parts = F.split(sealed, ":")
    raw = lambda i: F.unbase64(parts[i])
    return F.try_aes_decrypt(F.concat(raw(0), raw(2), raw(1)), key, F.lit("GCM")).cast("string")


#: What is masked in texts that leave: our rules for the described kinds of secrets.
SECRET_PATTERNS = [
    r"AKIA[0-9A-Z]{16}",
    r"gh[ps]_[A-Za-z0-9]{20,}",
    r"sk-[A-Za-z0-9_-]{16,}",
    r"(?i)\bbearer\s+[A-Za-z0-9._~+/-]{16,}=*",
    r"""(?i)\b(?:api[_-]?key|token|secret|password)\s*[:=]\s*["']?[A-Za-z0-9+/_.-]{8,}["']?""",
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    r"[a-z][a-z0-9+]*://[^\s:/@]+:[^\s/@]+@",
]
MASK = "***REDACTED***"


def mask_secrets(text: Column) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, ascii_bounds(p), MASK), SECRET_PATTERNS, text)
