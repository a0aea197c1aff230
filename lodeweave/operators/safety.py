"""Command blocklist, injection scan and the composite verdict."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import ascii_bounds, match_offsets
from .predicates import command_verdict

#: Destructive commands: pattern, its name, reason; the first that matches counts (fixed values).
BLOCKLIST = [
    (r"(?i)\brm\s+(-[a-z]*r[a-z]*f[a-z]*|-[a-z]*f[a-z]*r[a-z]*)\s", "rm -rf", "recursive force delete"),
    (r"\brmdir\s+/", "rmdir /", "delete root directory"),
    (r"\bmkfs\b", "mkfs", "format filesystem"),
    (r"\bdd\s+if=/", "dd if=/", "disk overwrite from root"),
    (r"\bshred\b", "shred", "secure file deletion"),
    (r"(?i)\bDROP\s+TABLE\b", "DROP TABLE", "drop database table"),
    (r"(?i)\bDROP\s+DATABASE\b", "DROP DATABASE", "drop entire database"),
    (r"(?i)\bDROP\s+SCHEMA\b", "DROP SCHEMA", "drop database schema"),
    (r"(?i)\bTRUNCATE\s+TABLE\b", "TRUNCATE TABLE", "truncate table data"),
    (r"(?i)\bgit\s+push\s+.*--force\b", "git push --force", "force push overwrites remote history"),
    (r"(?i)\bgit\s+push\s+.*-f\b", "git push -f", "force push overwrites remote history"),
    (r"(?i)\bgit\s+reset\s+--hard\s+.*HEAD", "git reset --hard", "destructive history rewrite"),
    (r"(?i)\bgit\s+clean\s+-[a-z]*f[a-z]*", "git clean -f", "delete untracked files"),
    (r"(?i)\bchmod\s+777\s+-R", "chmod 777 -R", "world-writable recursive chmod"),
    (r"(?i)\bchmod\s+-R\s+777", "chmod -R 777", "world-writable recursive chmod"),
    (r"(?i)\bchown\s+-R\s+.*\s+/", "chown -R ... /", "recursive chown from root"),
    (r":\(\)\s*\{[^}]*\|[^}]*\}", ":(){ :|:& };:", "fork bomb"),
    (r">\s*/etc/passwd", "> /etc/passwd", "overwrite system password file"),
    (r">\s*/etc/shadow", "> /etc/shadow", "overwrite shadow password file"),
    (r">\s*/dev/sd[a-z]", "> /dev/sd*", "write to block device"),
    (r"(?i)openssl\s+enc\s+.*-e.*-k\s", "openssl enc -e -k", "mass file encryption"),
]

#: Prompt injections: pattern, its name, severity, replacement, reason (fixed values).
INJECTIONS = [
    (r"(?i)ignore\s+(all\s+)?(previous|prior|above|earlier)\s+(instructions?|prompts?|rules?|directives?)", "ignore previous instructions", "high", "[INJECTION_REMOVED]", "instruction override attempt"),
    (r"(?i)disregard\s+(all\s+)?(previous|prior|above|earlier|your)\s+(instructions?|prompts?|rules?|directives?)", "disregard previous instructions", "high", "[INJECTION_REMOVED]", "instruction override attempt"),
    (r"(?i)forget\s+(everything|all)\s+(you\s+)?(know|were told|have been told)", "forget everything", "high", "[INJECTION_REMOVED]", "instruction override attempt"),
    (r"(?i)you\s+are\s+now\s+(?:\w+\s+){0,4}(?:AI|assistant|bot|model|GPT|LLM|agent)\b", "you are now <persona>", "high", "[INJECTION_REMOVED]", "persona injection attempt"),
    (r"(?i)\bsystem\s*:\s*[\w\s]{0,50}", "system: <content>", "high", "[SYSTEM_TAG_REMOVED]", "system prompt injection"),
    (r"(?i)<\s*system\s*>", "<system>", "high", "[SYSTEM_TAG_REMOVED]", "system XML tag injection"),
    (r"(?i)\bassistant\s*:\s*", "assistant: (role injection)", "medium", "[ROLE_TAG_REMOVED] ", "role injection attempt"),
    (r"(?i)\bhuman\s*:\s*", "human: (role injection)", "medium", "[ROLE_TAG_REMOVED] ", "role injection attempt"),
    (r"(?i)<tool_call\b[^>]*>", "<tool_call>", "high", "[TOOL_CALL_REMOVED]", "embedded tool call tag"),
    (r"(?i)<function_calls?\b[^>]*>", "<function_calls>", "high", "[TOOL_CALL_REMOVED]", "embedded function call tag"),
    (r"(?i)do\s+anything\s+now\b", "do anything now (DAN)", "high", "[INJECTION_REMOVED]", "jailbreak pattern (DAN)"),
    (r"(?i)jailbreak\b", "jailbreak", "medium", "[INJECTION_REMOVED]", "jailbreak keyword"),
    (r"(?i)repeat\s+(everything|the\s+(above|previous|entire|full|whole))\s*(instructions?|prompt|system|text)?", "repeat everything above", "medium", "[INJECTION_REMOVED]", "prompt leak attempt"),
    (r"(?i)print\s+(your\s+)?(system|original|full|entire|initial)\s+(prompt|instructions?|directives?)", "print system prompt", "medium", "[INJECTION_REMOVED]", "prompt leak attempt"),
    (r"\x1b\[[0-9;]*[A-Za-z]", "ANSI escape sequence", "low", "", "ANSI escape code — possible terminal injection"),
]


def blocked(command: Column) -> Column:
    """(pattern, reason) of the first entry that matches; null where none does."""
    out = F.lit(None).cast("struct<pattern:string,reason:string>")
    for regex, name, reason in reversed(BLOCKLIST):
        out = F.when(command.rlike(ascii_bounds(regex)), F.struct(F.lit(name).alias("pattern"), F.lit(reason).alias("reason"))).otherwise(out)
    return out


def verdict(command: Column, allow: list[str] = [], deny: list[str] = []) -> Column:  # noqa: B006
    """(allowed, reason, blocked_by): the blocklist before the policy."""
    hit, policy = blocked(command), command_verdict(command, allow, deny)
    make = lambda ok, reason, by: F.struct(F.lit(ok).alias("allowed"), reason.alias("reason"), F.lit(by).cast("string").alias("blocked_by"))
    return F.when(hit.isNotNull(), make(False, F.concat(F.lit("BLOCKED ["), hit["pattern"], F.lit("]: "), hit["reason"]), "blocklist")).when(~policy["allowed"], make(False, policy["reason"], "policy")).otherwise(make(True, policy["reason"], None))


def suspicious(text: Column) -> Column:
    """Whether any pattern matches: one pass over the many texts that are clean."""
    return text.rlike("|".join(f"(?:{ascii_bounds(p[0])})" for p in INJECTIONS))


def injections(text: Column) -> Column:
    """Array of (pattern, severity, reason, start) of all matches in the original text, by pattern, then by place."""
    rules = F.array(*(F.struct(F.lit(ascii_bounds(regex)).alias("regex"), F.lit(name).alias("name"), F.lit(severity).alias("severity"), F.lit(reason).alias("reason")) for regex, name, severity, _, reason in INJECTIONS))
    named = lambda rule: F.transform(match_offsets(text, rule["regex"]), lambda m: F.struct(rule["name"].alias("pattern"), rule["severity"].alias("severity"), rule["reason"].alias("reason"), m["start"].alias("start")))
    return F.when(suspicious(text), F.flatten(F.transform(rules, named))).otherwise(F.array().cast("array<struct<pattern:string,severity:string,reason:string,start:int>>"))


def sanitised(text: Column) -> Column:
    """All patterns replaced, one after the other. A replacement makes no pattern match where none did, so clean texts stay."""
    return F.when(suspicious(text), reduce(lambda t, p: F.regexp_replace(t, ascii_bounds(p[0]), p[3]), INJECTIONS, text)).otherwise(text)
