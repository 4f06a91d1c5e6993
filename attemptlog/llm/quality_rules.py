"""Line-first cleaning: drop failing lines, then documents that lost too much."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Line rules.  A line fails if one of them holds.
RULES = {
    "navigation": r"(\|[^|]*){3,}|^[\x20\x09]*(home|menu|next|previous|back to top|read more|share)[\x20\x09]*$",
    "boilerplate": (r"licensed under the|terms of (use|service)|privacy policy|all rights reserved|"
                    r"cookie|enable javascript|subscribe to our|sign up for|general public license"),
}
#: Symbols and exclamation marks a word from which a line counts as punctuation noise.
MAX_SYMBOLS, MAX_SHOUTS = 1.0, 0.5
#: Words without any sentence mark from which a line counts as unpunctuated.
MAX_UNPUNCTUATED = 60
#: Documents keep at least this share of their word characters.
MIN_KEPT = 0.5
MIN_WORDS, MAX_REPEAT = 50, 50


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def repeated_words(w: Column) -> Column:
    """Words that stand in a 3-word window found twice or more in ``w``.

    Windows are sorted by a 64-bit hash of their words (equal hashes of different
    windows within one text are left out of account: below 1e-8 for a million
    words), neighbours with equal hashes are the repeated ones, and the
    words that their starts cover are counted without overlap.  A text whose hashes
    all differ is not sorted."""
    def covered(sorted_w):
        twice = F.filter(sorted_w, lambda x, k: (x["h"] == F.get(sorted_w, k - 1)["h"])
                         | (x["h"] == F.get(sorted_w, k + 1)["h"]))
        at = F.sort_array(F.transform(twice, lambda x: x["p"]))
        last = F.aggregate(at, F.struct(F.lit(-9).alias("p"), F.lit(0).cast("long").alias("n")), lambda acc, p: F.struct(
            p.alias("p"), (acc["n"] + F.least(p - acc["p"], F.lit(3))).alias("n")))
        return last["n"]

    def counted(h):
        placed = F.transform(h, lambda x, k: F.struct(x.alias("h"), k.alias("p")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")) \
            .otherwise(F.transform(F.array(F.sort_array(placed)), covered)[0])
    # transform over a one-element array binds an array to a name: it is made once, not once a word
    hashes = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda x, k: F.xxhash64(
        x, F.get(w, k + 1), F.get(w, k + 2)))
    return F.when(F.size(w) >= 3, F.transform(F.array(hashes), counted)[0]).otherwise(F.lit(0)).cast("long")


def _symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long")


def line_fails(line: Column) -> Column:
    """Whether a line with words breaks one of the rules."""
    n = F.regexp_count(line, F.lit(WORD))
    low = F.lower(line)
    noise = (_symbols(line) > MAX_SYMBOLS * n) | (
        F.char_length(line) - F.char_length(F.replace(line, F.lit("!"), F.lit(""))) > MAX_SHOUTS * n)
    bare = (n > MAX_UNPUNCTUATED) & ~line.rlike(r"[.?!:;。！？]")
    return low.rlike(RULES["navigation"]) | low.rlike(RULES["boilerplate"]) | noise | bare


def clean_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the cleaned text and the measures of every row.

    Adds ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words`` (all over the whole text), ``base_failed`` (under 50 words,
    or over half of the words in repeated 3-word windows), ``clean_text`` (the
    lines that pass the rules; repeated lines only their first time),
    ``kept_chars`` (word characters in it) and ``kept``: not ``base_failed``
    and at least half of the word characters left.

    Null and empty text: no words, measures 0, failed.  Columns named like the
    added ones are replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumn("_w", words(t)).withColumn("_lines", F.split(t, "\n", -1))
    full = F.filter("_lines", lambda x: x.rlike(WORD))
    d = d.withColumn("_full", full)
    d = d.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.char_length(F.regexp_replace(t, SPACE, "")).cast("long"),
        "n_symbols": _symbols(t),
        "n_dup_lines": (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long"),
        "n_repeat_words": repeated_words(F.col("_w")),
        "clean_text": F.array_join(F.filter(F.array_distinct("_full"), lambda x: ~line_fails(x)), "\n"),
    })
    d = d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                     | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words")))
    d = d.withColumn("kept_chars", F.char_length(F.regexp_replace("clean_text", SPACE, "")).cast("long"))
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("kept_chars") >= MIN_KEPT * F.col("word_chars"))) \
        .drop("_w", "_lines", "_full")
