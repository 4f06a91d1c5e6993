"""Url allow and block lists that follow redirects and canonical links."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attemptlog.llm.graph import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: What a browser reads no links from: comments and elements whose content is no markup of the page.
HIDDEN = "(?is)<!--.*?(?:-->|\\z)|" + "|".join(rf"<{x}\b.*?(?:</{x}\b[^>]*>|\z)" for x in ("script", "style", "template", "textarea"))
TAGS = r"(?is)<(?:link|meta)\b[^>]*>"
#: Target of a refresh: seconds, a mark, then the url with or without ``url=`` and quotes; else what follows ``url=``.
_JUMP = r"""(?is)^\s*+(?:[\d.]*+(?:\s*+[;,]|\s)\s*+(?:url\s*+=\s*+)?+|url\s*+=\s*+)["']?+\s*+([^"'>\s;,][^"'>\s]*+)"""
_TARGET = r"""(?is)\burl\s*=\s*["']?\s*([^"'>\s]+)"""


class Rule(NamedTuple):
    verdict: str            # "allow" or "block"
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end,
    A-Z lower-cased; empty for null or without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty as the host."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def url_node(url: Column) -> Column:
    """The url without its fragment and with a lower-case host: the identity of a
    page.  Null without ``://``."""
    scheme = F.regexp_extract(url, r"(?s)^(.*?://)", 1)
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(scheme, url_host(url), rest))


def match_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest fitting rule (null if none fits).  Of
    equally long rules an allow wins."""
    text = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.verdict == "allow")):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text = F.when(fits, r.text).otherwise(text)
        verdict = F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def attribute_pattern(name: str) -> str:
    """Pattern of an attribute in a tag; the value is in one of three groups."""
    return rf"""(?is)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""


def _attribute(tag: Column, name: str) -> Column:
    return F.concat(*[F.regexp_extract(tag, attribute_pattern(name), k) for k in (1, 2, 3)])


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Edges ``src``, ``dst`` from each page to the targets of all its canonical
    links and refresh redirects.  ``//host/x``, ``/x`` and ``x`` are resolved
    against the page's url; tags are read from the whole html, but not in
    comments, scripts, styles, templates and text areas, and ``canonical`` must be
    a whole word of ``rel``.

    Null html and null urls or such without ``://`` give no edge, nor do targets
    that are the page itself; repeated pages repeat their edges.  Further columns
    are not read.
    """
    h, tag, content = F.col(html), F.col("_tag"), F.col("_content")
    jump = F.regexp_extract(content, _JUMP, 1)
    jump = F.when(jump == "", F.regexp_extract(tag, _TARGET, 1)).otherwise(jump)
    rel = F.concat(F.lit(" "), F.regexp_replace(F.lower(_attribute(tag, "rel")), r"\s", " "), F.lit(" "))
    refresh = F.lower(F.trim(_attribute(tag, "http-equiv"))) == "refresh"
    e = pages.select(F.col(url).alias("_u"), h.alias("_h")) \
        .filter(F.col("_h").rlike("(?i)canonical|refresh") & (F.instr("_u", "://") > 0)) \
        .select("_u", F.explode(F.regexp_extract_all(F.regexp_replace("_h", HIDDEN, " "), F.lit(TAGS), F.lit(0))).alias("_tag")) \
        .filter(tag.rlike("(?i)canonical|refresh")) \
        .withColumn("_content", _attribute(tag, "content")) \
        .select("_u", F.when(tag.rlike("(?i)^<link"), F.when(rel.contains(" canonical "), _attribute(tag, "href")))
                .otherwise(F.when(refresh, jump)).alias("_t")) \
        .select("_u", F.replace(F.trim(F.col("_t")), F.lit("&amp;"), F.lit("&")).alias("_t")) \
        .filter("_t != ''")
    scheme, t = F.regexp_extract("_u", r"(?s)^(.*?://)", 1), F.col("_t")
    site = F.concat(scheme, url_host(F.col("_u")))
    folder = F.concat(F.regexp_extract(url_path(F.col("_u")), r"(?s)^(.*/)", 1))
    full = F.when(t.contains("://"), t) \
        .when(t.startswith("//"), F.concat(F.replace(scheme, F.lit("//"), F.lit("")), t)) \
        .when(t.startswith("/"), F.concat(site, t)) \
        .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), t))
    return e.select(url_node(F.col("_u")).alias("src"), url_node(full).alias("dst")).filter("src != dst")


def judge_urls(pages: DataFrame, links: DataFrame, rules: Sequence[Rule], url: str = "url") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to ``pages``.

    A url that a rule fits gets the rule's verdict, so an explicit allow holds
    whatever its aliases are.  The others are blocked if any url of their
    component over ``links`` (redirects and canonical links, ``src``/``dst``
    made by :func:`url_node`) is blocked by a rule, also one that is no page
    itself; else they are allowed.

    Null urls and urls without ``://`` have an empty host and path, no rule and
    the verdict allow.  Repeated urls get the same verdict, each row its own
    result row; columns named like the added ones are replaced.
    """
    clash = [c for c in ("host", "path", "rule", "verdict") if c in pages.columns and c != url]
    base = pages.drop(*clash)
    parts = connected_components(links)
    _, own = match_rule(url_host(F.col("node")), url_path(F.col("node")), rules)
    bad = parts.filter(own == "block").select("component").distinct()
    blocked = parts.join(bad, "component", "left_semi").select(F.col("node").alias("_node"),
                                                               F.lit(True).alias("_blocked"))
    host, path = url_host(F.col(url)), url_path(F.col(url))
    j = base.withColumn("_node", url_node(F.col(url))).join(blocked, "_node", "left") \
        .withColumns({"host": host, "path": path})
    text, verdict = match_rule(F.col("host"), F.col("path"), rules)
    return j.withColumn("rule", text) \
        .withColumn("verdict", F.coalesce(verdict, F.when(F.col("_blocked"), "block"), F.lit("allow"))) \
        .drop("_node", "_blocked")
