"""Personal data: proposed by pattern, confirmed by checksum, scored by context."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Kind(NamedTuple):
    name: str
    pattern: str            # of the rule, as SQL engines without lookbehind take it
    spark_pattern: str      # matches the same, without retrying inside a long run
    needs: str              # a character that every match holds
    base: bool
    score: float            # before the validator's and the context's share
    context: str            # words near the span that raise the score


#: The first four are fixed by contract.  In ``spark_pattern`` a run of mail
#: characters or digits is entered only at its start (or where the last match
#: ended) and possessively, which matches the same spans in linear time and
#: without deep recursion on very long runs.
KINDS = [
    Kind("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
         r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         "@", True, 0.7, r"mail|contact|write|correo|courriel|schreib"),
    Kind("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
         ".", True, 0.6, r"\bip\b|server|host|address|login"),
    Kind("card", r"[0-9]([\x20-]?[0-9])+", r"[0-9](?:[\x20\-]?[0-9])++",
         "", True, 0.5, r"card|visa|master|credit|payment|tarjeta|carte|karte"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9\-]+[0-9]",
         "+", True, 0.6, r"phone|call|tel|mobile|fax|whatsapp"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}([A-Z0-9]{11,30}|( [A-Z0-9]{4}){2,7}( [A-Z0-9]{1,3})?)",
         r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)",
         "", False, 0.3, r"iban|account|bank|konto|cuenta|compte"),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
         "-", False, 0.3, r"ssn|social security|tax id"),
    Kind("tel", r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}", r"\(?[0-9]{3}\)?[ .\-][0-9]{3}[ .\-][0-9]{4}",
         "", False, 0.3, r"phone|call|tel|mobile|fax|whatsapp"),
]
#: Added to the score by a checksum that holds, and by a context word.
CHECKED, CONTEXT = 0.4, 0.3
#: Added spans need this score; base spans stay whatever theirs is.
THRESHOLD = 0.6
#: Code points before and after a span in which context words count.
BEFORE, AFTER = 40, 20


#: Matches laid at once, and code points of a text cut at once for the context (with those that may follow).
BLOCK, PIECE, OVERLAP = 256, 4096, 64


def _plausible(kind: Kind, match: Column) -> Column:
    """Whether a match is long enough to pass the check of its kind."""
    least = {"card": 16, "phone": 9}.get(kind.name)
    return F.char_length(match) >= least if least else F.lit(True)


def _found(text: Column, kind: Kind) -> Column:
    """Matches that may pass, with positions: the pieces between matches and the matches
    themselves, laid end to end.  Text without the needed character or
    any digit-like start is not searched twice.

    Matches are laid in blocks of BLOCK, each an array of its own that is appended once, so
    the work of a text with very many matches stays near their number."""
    found = F.regexp_extract_all(text, F.lit(kind.spark_pattern), F.lit(0))
    parts = F.split(text, kind.spark_pattern, -1)
    sized = F.zip_with(F.slice(parts, F.lit(1), F.size(found)), found, lambda a, b: F.struct(
        F.char_length(a).alias("gap"), F.char_length(b).alias("len"), b.alias("match")))
    spans = "array<struct<start:int,end:int,match:string>>"
    empty = F.array().cast(spans)

    def lay(acc: Column, x: Column) -> Column:
        end = acc["at"] + x["gap"] + x["len"]
        span = F.struct((acc["at"] + x["gap"]).alias("start"), end.alias("end"), x["match"].alias("match"))
        return F.struct(end.alias("at"), F.when(_plausible(kind, x["match"]), F.array_append(acc["out"], span))
                        .otherwise(acc["out"]).alias("out"))

    def block(done: Column, part: Column) -> Column:
        return F.array_append(done, F.aggregate(part, F.struct(F.element_at(done, -1)["at"].alias("at"), empty.alias("out")), lay))

    def laid(all_sized: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(all_sized), F.lit(BLOCK))
        blocks = F.transform(starts, lambda k: F.slice(all_sized, k, F.lit(BLOCK)))
        start = F.array(F.struct(F.lit(0).alias("at"), empty.alias("out")))
        return F.flatten(F.aggregate(blocks, start, block, lambda done: F.transform(done, lambda d: d["out"])))
    there = F.instr(text, kind.needs) > 0 if kind.needs else F.lit(True)
    # the array of pieces is made once and bound as the only element of another
    once = F.element_at(F.transform(F.array(sized), laid), 1)
    return F.when(there & text.rlike(kind.spark_pattern), once).otherwise(empty)


def luhn_ok(digits: Column) -> Column:
    """Whether a digit string passes the Luhn check."""
    n = F.char_length(digits)

    def add(acc, i):
        d = F.substr(digits, n - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)
    return (n > 0) & (F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add) % 10 == 0)


def mod97_ok(iban: Column) -> Column:
    """Whether an account number without blanks leaves 1 modulo 97."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))

    def step(acc, i):
        c = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(c < 58, (acc * 10 + c - 48) % 97).otherwise((acc * 100 + c - 55) % 97)
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.char_length(turned), F.lit(1))), F.lit(0), step) == 1


def _valid(kind: Kind, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.char_length(digits)
    if kind.name == "ip":
        return F.forall(F.split(match, r"\."), lambda p: (F.char_length(F.ltrim(p, F.lit("0"))) <= 3)
                        & (F.lpad(F.ltrim(p, F.lit("0")), 3, "0") <= "255"))
    if kind.name == "card":
        return (n >= 16) & (n <= 19) & luhn_ok(digits)
    if kind.name == "phone":
        return (n >= 8) & (n <= 15)
    if kind.name == "iban":
        return mod97_ok(F.replace(match, F.lit(" "), F.lit("")))
    return F.lit(True)


def find_pii(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """Add ``out``: array of (kind, start, end, match, score, base) per row.

    Base spans (email, ip, card, phone) are the leftmost non-overlapping matches
    of their kind that pass the kind's check.  The method adds account
    numbers with a valid checksum (iban) and, only where a context word is near,
    ``ssn`` and ``tel``, if they reach the threshold and overlap no base span.
    Positions count code points, the end is exclusive; spans stand by kind, then
    start.  The score is the kind's own plus the checksum's and the context's
    share, at most 1.

    Null text counts as empty and gives an empty array.  A column named like
    ``out`` is replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    checked = {"card", "iban"}

    def confirmed(k: Kind) -> Column:
        return F.filter(_found(t, k), lambda x: _valid(k, x["match"]))

    def cut(at: Column, size: Column) -> Column:
        # a text is cut into pieces once: looking up a code point takes time by its place
        return F.substr(F.get(F.col("_pii_pieces"), F.floor(at / PIECE).cast("int")), (at % PIECE + 1).cast("int"), size.cast("int"))

    def scored(k: Kind) -> Column:
        def one(x):
            first = F.greatest(x["start"] - BEFORE, F.lit(0))
            near = F.concat(cut(first, x["start"] - first), F.lit(" "), cut(x["end"], F.lit(AFTER)))
            near = F.lower(near).rlike(k.context)
            own = F.lit(k.score + (CHECKED if k.name in checked else 0.0))
            score = F.least(F.round(own + F.when(near, CONTEXT).otherwise(0.0), 2), F.lit(1.0))
            return F.struct(F.lit(k.name).alias("kind"), x["start"].alias("start"), x["end"].alias("end"),
                            x["match"].alias("match"), score.alias("score"), F.lit(k.base).alias("base"))
        return F.transform(F.col(f"_pii_{k.name}"), one)

    tmp = {f"_pii_{k.name}": confirmed(k) for k in KINDS}
    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.char_length(t) / PIECE).cast("int")),
                         lambda k: F.substr(t, k * PIECE + 1, F.lit(PIECE + OVERLAP)))
    some = F.concat(*[F.col(c) for c in tmp])
    found = docs.withColumns(tmp).withColumn("_pii_pieces", F.when(F.size(some) > 0, pieces))
    base = F.concat(*[F.col(f"_pii_{k.name}") for k in KINDS if k.base])

    def added(k: Kind) -> Column:
        return F.filter(scored(k), lambda x: (x["score"] >= THRESHOLD) & ~F.exists(
            base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return found.withColumn(out, F.concat(*[scored(k) if k.base else added(k) for k in KINDS])).drop(*tmp, "_pii_pieces")


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", spans: str = "pii", out: str = "redacted") -> DataFrame:
    """Add the text with every span replaced by its kind in angle brackets.
    Spans are taken from the right; of overlapping ones the rightmost goes in
    whole and the others only as far as they stand before it."""
    order = F.reverse(F.sort_array(F.transform(F.col(spans), lambda x: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))))
    t = F.coalesce(F.col(text), F.lit(""))
    init = F.struct(F.lit("").alias("tail"), F.char_length(t).alias("until"))
    done = F.aggregate(order, init, lambda acc, x: F.struct(
        F.concat(F.lit("<"), x["kind"], F.lit(">"),
                 F.substr(t, x["end"] + 1, F.greatest(acc["until"] - x["end"], F.lit(0))), acc["tail"]).alias("tail"),
        F.least(x["start"], acc["until"]).alias("until")))
    return docs.withColumn("_done", done) \
        .withColumn(out, F.concat(F.substr(t, F.lit(1), F.col("_done.until")), F.col("_done.tail"))).drop("_done")
