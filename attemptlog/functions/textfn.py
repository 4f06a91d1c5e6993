"""Text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prompt marker and the brace-block pattern.
PROMPT_MARKER = "PROBLEM STATEMENT:"
FIRST_BRACE_BLOCK = r"\{[\s\S]*?\}"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_all(c) -> Column:
    """Python ``str.strip()``: all Unicode whitespace at both ends (Q29)."""
    c = _c(c)
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def lower_ids(c) -> Column:
    """F1."""
    return F.lower(_c(c))


def clean_prompt(c, marker: str = PROMPT_MARKER) -> Column:
    """text after the last marker, a word-bounded marker + space removed,
    whitespace stripped."""
    c = _c(c)
    after = F.when(F.instr(c, marker) > 0,
                   F.element_at(F.split(c, F.lit(_regex_quote(marker))), -1)).otherwise(c)
    no_marker = F.regexp_replace(after, r"\b" + _regex_quote(marker) + r" \b", "")
    return strip_all(no_marker)


def _regex_quote(s: str) -> str:
    out = []
    for ch in s:
        out.append("\\" + ch if ch in r"\.^$|?*+()[]{}" else ch)
    return "".join(out)


def first_brace_block(c) -> Column:
    """first ``{...}`` block (non-greedy, across lines); '' when absent."""
    return F.regexp_extract(_c(c), FIRST_BRACE_BLOCK, 0)


def ascii_lower(c) -> Column:
    """drop non-ASCII characters, lower-case."""
    return F.lower(F.regexp_replace(_c(c), r"[^\x00-\x7F]+", ""))


def parse_list(c, element: str = "double") -> Column:
    """list text such as "[1, None, 3]" -> ARRAY."""
    txt = F.regexp_replace(_c(c), r"\bNone\b", "null")
    return F.from_json(txt, f"array<{element}>")


def split_paths(c, sep: str = "@$", min_entry: int = 0) -> Column:
    """path string -> ARRAY<STRUCT<start, path, end>>; empty string -> [].
    Entries whose trimmed text is no longer than ``min_entry`` are left out."""
    c = _c(c)
    parts = F.when((c.isNull()) | (c == ""), F.array().cast("array<string>")) \
             .otherwise(F.split(c, F.lit(_regex_quote(sep))))
    if min_entry:
        parts = F.filter(parts, lambda p: F.length(F.trim(p)) > min_entry)
    return F.transform(parts, lambda p: F.struct(
        F.split(p, ",")[0].alias("start"), F.split(p, ",")[1].alias("path"),
        F.split(p, ",")[2].alias("end")))
