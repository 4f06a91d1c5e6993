"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attemptlog.llm import (conversation_repair, decontaminate, html_extract, langid, merkle, mixing, ngram_join, pii,
                            quality_model, quality_rules, sharding, simhash, url_filter)

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- 1: html extraction -------------------------------------------------------------------------
@query("op1_html_extract")
def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = html_extract.extract_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return text.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


# -- 2: url filters -----------------------------------------------------------------------------
RULES = [url_filter.Rule("block", "net", "/"), url_filter.Rule("allow", "example.net", "/en/"),
         url_filter.Rule("block", "example.com", "/de/"), url_filter.Rule("allow", "org", "/fr/")]

_LOW = f"'{url_filter.UPPER}', '{url_filter.LOWER}'"


def _rule_sql(host: str, path: str, what: str) -> str:
    cases = " ".join(
        f"WHEN ({host} = '{r.host}' OR ends_with({host}, '.{r.host}')) AND starts_with({path}, '{r.path}') "
        f"THEN '{r.text if what == 'rule' else r.verdict}'"
        for r in sorted(RULES, key=lambda r: -len(r.text)))
    return f"CASE {cases} END"


def _host_sql(url: str) -> str:
    return f"translate(coalesce(regexp_extract({url}, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), {_LOW})"


def _path_sql(url: str) -> str:
    return f"coalesce(regexp_extract({url}, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '')"


def _node_sql(url: str) -> str:
    return (f"CASE WHEN contains({url}, '://') THEN regexp_extract({url}, '(?s)^(.*?://)', 1) || {_host_sql(url)} || "
            f"regexp_extract({url}, '(?s)^.*?://[^/?#]*([^#]*)', 1) END")


_Q = "''"
def _attr_sql(name: str) -> str:
    pattern = url_filter.attribute_pattern(name).replace("'", "''")
    return " || ".join(f"regexp_extract(tag, '{pattern}', {k})" for k in (1, 2, 3))


# Seconds and marks before the url of a refresh.
_WAIT = rf'(?is)^\s*(?:[\d.]*(?:\s*[;,]|\s)\s*(?:url\s*=\s*)?|url\s*=\s*)["{_Q}]?\s*'
OP2_SQL = rf"""
WITH RECURSIVE p AS (SELECT page_id, url, html, {_host_sql('url')} AS host, {_path_sql('url')} AS path,
                            {_node_sql('url')} AS node FROM pages),
raw AS (SELECT url, host, path, node, unnest(regexp_extract_all(
    regexp_replace(html, '{url_filter.HIDDEN}', ' ', 'g'), '{url_filter.TAGS}')) AS tag FROM p WHERE contains(url, '://')),
tags AS (SELECT url, host, path, node, tag, regexp_matches(tag, '(?i)^<link') AS is_link, {_attr_sql('rel')} AS rel,
  {_attr_sql('http-equiv')} AS equiv, {_attr_sql('href')} AS href, {_attr_sql('content')} AS content FROM raw),
jumps AS (SELECT *, CASE WHEN regexp_matches(content, '{_WAIT}') THEN
    regexp_extract(regexp_replace(content, '{_WAIT}', ''), '(?s)^[^"{_Q}>\s;,][^"{_Q}>\s]*') ELSE '' END AS jump FROM tags),
targets AS (SELECT url, host, path, node, CASE
    WHEN is_link THEN CASE WHEN list_contains(string_split_regex(lower(rel), '\s'), 'canonical') THEN href END
    WHEN lower(trim(equiv, ' ')) = 'refresh' THEN CASE WHEN jump <> '' THEN jump
      ELSE regexp_extract(tag, '(?is)\burl\s*=\s*["{_Q}]?\s*([^"{_Q}>\s]+)', 1) END END AS t FROM jumps),
full_urls AS (SELECT node AS src, regexp_extract(url, '(?s)^(.*?://)', 1) AS scheme, host, path,
  replace(trim(t, ' '), '&amp;', '&') AS t FROM targets),
resolved AS (SELECT src, CASE WHEN contains(t, '://') THEN t
  WHEN starts_with(t, '//') THEN replace(scheme, '//', '') || t
  WHEN starts_with(t, '/') THEN scheme || host || t
  ELSE scheme || host || (CASE WHEN regexp_extract(path, '(?s)^(.*/)', 1) = '' THEN '/'
                          ELSE regexp_extract(path, '(?s)^(.*/)', 1) END) || t END AS u FROM full_urls WHERE t <> ''),
link AS (SELECT src, {_node_sql('u')} AS dst FROM resolved),
edge AS (SELECT src AS a, dst AS b FROM link WHERE src <> dst UNION SELECT dst, src FROM link WHERE src <> dst),
seed AS (SELECT DISTINCT a AS node FROM edge),
bad(node) AS (
  SELECT node FROM seed WHERE {_rule_sql(_host_sql('node'), _path_sql('node'), 'verdict')} = 'block'
  UNION SELECT edge.b FROM bad JOIN edge ON edge.a = bad.node)
SELECT page_id, host, path, {_rule_sql('host', 'path', 'rule')} AS rule,
  coalesce({_rule_sql('host', 'path', 'verdict')},
           CASE WHEN node IN (SELECT node FROM bad) THEN 'block' END, 'allow') AS verdict
FROM p
"""


@query("op2_url_filters", OP2_SQL)
def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    judged = url_filter.judge_urls(pages.select("page_id", "url"), url_filter.page_links(pages), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


# -- 3: benchmark decontamination ---------------------------------------------------------------
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), " + _LOW + r"), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP3_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, {_WORDS} AS ws FROM benchmark),
bw AS (SELECT DISTINCT item, n, array_to_string(ws[i:i + n - 1], ' ') AS w FROM (
  SELECT item, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, i, n, array_to_string(ws[i:i + n - 1], ' ') AS w FROM (
  SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)),
hit AS (SELECT rid, i, dw.n, item FROM dw JOIN bw ON dw.w = bw.w AND dw.n = bw.n),
words AS (SELECT rid, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
items AS (SELECT rid, count(DISTINCT item)::BIGINT AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS l FROM hit GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""


@query("op3_decontaminate", OP3_SQL)
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_benchmark(docs, _table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    items = F.sort_array(F.array_distinct(F.transform("hits", lambda x: x["item"])))
    return found.select(
        "doc_id", "n_words", decontaminate.covered_words(F.col("hits")).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"))


# -- 4: mixing ----------------------------------------------------------------------------------
OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  md5('17' || chr(1) || coalesce(doc_id::VARCHAR, 'null') || chr(1) || coalesce(md5(text), 'null')) AS uid FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
  (row_number() OVER (ORDER BY (source IS NULL), source) - 1) % 3 + 1.0::DOUBLE AS weight FROM d GROUP BY source),
lim AS (SELECT source_size * 3.0::DOUBLE AS cap, weight FROM s),
-- the first round clamps nothing; each next one clamps what the level is above
fill(k, level, clamped) AS (
  SELECT 0, (SELECT sum(source_size)::DOUBLE FROM s) / (SELECT sum(weight) FROM lim), 0::BIGINT
  UNION ALL
  SELECT k + 1, ((SELECT sum(source_size)::DOUBLE FROM s) - (SELECT coalesce(sum(cap), 0) FROM lim WHERE cap < weight * level))
      / (SELECT sum(weight) FROM lim WHERE NOT cap < weight * level),
    (SELECT count(*) FROM lim WHERE cap < weight * level)
  FROM fill WHERE (SELECT count(*) FROM lim WHERE cap < weight * level) > clamped
    AND (SELECT count(*) FROM lim WHERE NOT cap < weight * level) > 0),
t AS (SELECT source, source_size, least(weight * (SELECT level FROM fill ORDER BY k DESC LIMIT 1), source_size * 3.0::DOUBLE) AS target
      FROM s),
w AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
g AS (SELECT source, uid, sum(size) AS n FROM d GROUP BY source, uid),
c AS (SELECT source, uid, n, sum(n) OVER (PARTITION BY source ORDER BY uid) - n AS before FROM g)
SELECT d.doc_id, d.size, w.source_size, w.target,
  (d.size * (w.whole + CASE WHEN d.size > 0 AND (c.before + c.n / 2 < w.target - w.whole * w.source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source
JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.uid = c.uid
"""


@query("op4_mix_sources", OP4_SQL)
def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = mixing.measure(_table(spark, sf_dir, "documents"))
    m = mixing.copies_of(measured, mixing.plan_mix(measured))
    return m.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


# -- 5: personal data ---------------------------------------------------------------------------
def _op5_sql() -> str:
    def near(k) -> str:
        return (f"regexp_matches(lower(substr(text, greatest(s - {pii.BEFORE}, 0) + 1, s - greatest(s - {pii.BEFORE}, 0)) || ' ' "
                f"|| substr(text, e + 1, {pii.AFTER})), '{k.context}')")
    digits = "list_transform(string_split(reverse(regexp_replace(m, '[^0-9]', '', 'g')), ''), lambda c, i: "
    luhn = (f"list_sum({digits} CASE WHEN i % 2 = 0 THEN c::INT * 2 - CASE WHEN c::INT > 4 THEN 9 ELSE 0 END "
            "ELSE c::INT END)) % 10 = 0")
    n_digits = "length(regexp_replace(m, '[^0-9]', '', 'g'))"
    turned = "substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4)"
    valid = {
        "ip": "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR lpad(ltrim(x, '0'), 3, '0') > '255')) = 0",
        "card": f"{n_digits} BETWEEN 16 AND 19 AND {luhn}",
        "phone": f"{n_digits} BETWEEN 8 AND 15",
        "iban": (f"list_reduce(list_prepend(0::BIGINT, list_transform(string_split({turned}, ''), lambda c: "
                 "(ascii(c) - 48)::BIGINT)), lambda a, c: CASE WHEN c < 10 THEN (a * 10 + c) % 97 ELSE (a * 100 + c - 7) % 97 END) = 1"),
    }
    parts = []
    for i, k in enumerate(pii.KINDS):
        rx = k.pattern.replace("'", "''")
        parts.append(f"""
k{i}a AS (SELECT rid, text, regexp_extract_all(text, '{rx}') AS ms, string_split_regex(text, '{rx}') AS ps FROM d),
k{i}b AS (SELECT rid, text, unnest(ms) AS m, unnest(ps[1:len(ms)]) AS gap, unnest(range(len(ms))) AS pos FROM k{i}a),
k{i} AS (SELECT rid, {i} AS k, '{k.name}' AS kind, (e - length(m))::BIGINT AS s, e::BIGINT AS e, m, text FROM (
  SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY rid ORDER BY pos) AS e FROM k{i}b) WHERE {valid.get(k.name, 'true')})""")
    base = " UNION ALL ".join(f"SELECT * FROM k{i}" for i, k in enumerate(pii.KINDS) if k.base)
    more = " UNION ALL ".join(
        f"SELECT * FROM k{i} WHERE {k.score + (pii.CHECKED if k.name == 'iban' else 0)} + CASE WHEN {near(k)} "
        f"THEN {pii.CONTEXT} ELSE 0 END >= {pii.THRESHOLD}" for i, k in enumerate(pii.KINDS) if not k.base)
    tell = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s)"
    count = ", ".join(f"coalesce(n_{k.name}, 0)::BIGINT AS n_{k.name}" for k in pii.KINDS if k.base)
    counts = ", ".join(f"count(*) FILTER (kind = '{k.name}') AS n_{k.name}" for k in pii.KINDS if k.base)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),{','.join(parts)},
base AS ({base}),
added AS (SELECT * FROM ({more}) x WHERE NOT EXISTS
  (SELECT 1 FROM base b WHERE b.rid = x.rid AND b.s < x.e AND x.s < b.e)),
bs AS (SELECT rid, {tell} AS spans, {counts} FROM base GROUP BY rid),
al AS (SELECT rid, {tell} AS spans FROM (SELECT * FROM base UNION ALL SELECT * FROM added) GROUP BY rid)
SELECT doc_id, {count}, sha256(coalesce(bs.spans, '')) AS base_sha256, coalesce(al.spans, '') AS spans
FROM d LEFT JOIN bs USING (rid) LEFT JOIN al USING (rid)
"""


@query("op5_pii", _op5_sql())
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_pii(docs)
    def count(name: str):
        return F.size(F.filter("pii", lambda x: x["kind"] == name)).cast("long").alias(f"n_{name}")
    base = pii.span_list(F.filter("pii", lambda x: x["base"]))
    return found.select("doc_id", *[count(k.name) for k in pii.KINDS if k.base], F.sha2(base, 256).alias("base_sha256"),
                        pii.span_list(F.col("pii")).alias("spans"))


# -- 6: sharding --------------------------------------------------------------------------------
@query("op6_shard")
def op6_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


# -- 7: quality rules ---------------------------------------------------------------------------
_NAV, _BOIL = (quality_rules.RULES[k].replace("'", "''") for k in ("navigation", "boilerplate"))
OP7_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
tri AS (SELECT rid, i, ws[i] || chr(1) || ws[i + 1] || chr(1) || ws[i + 2] AS t
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, t) AS n FROM tri) WHERE n >= 2),
rep AS (SELECT rid, count(DISTINCT i + o)::BIGINT AS n FROM twice, (SELECT unnest([0, 1, 2]) AS o) GROUP BY rid),
l AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
full_lines AS (SELECT rid, line, count(*) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid, line),
dup AS (SELECT rid, sum(n - 1)::BIGINT AS n FROM full_lines GROUP BY rid),
judged AS (SELECT rid, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
  length(line) - length(translate(line, '{quality_rules.SYMBOLS}', '')) AS sym, length(line) - length(replace(line, '!', '')) AS shout
  FROM full_lines),
good AS (SELECT rid, sum(length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')))::BIGINT AS kept_chars FROM judged
  WHERE NOT (regexp_matches(lower(line), '{_NAV}') OR regexp_matches(lower(line), '{_BOIL}')
    OR sym > {quality_rules.MAX_SYMBOLS} * n OR shout > {quality_rules.MAX_SHOUTS} * n
    OR (n > {quality_rules.MAX_UNPUNCTUATED} AND NOT regexp_matches(line, '[.?!:;。！？]'))) GROUP BY rid),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (length(text) - length(translate(text, '{quality_rules.SYMBOLS}', '')))::BIGINT AS n_symbols,
  coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(kept_chars, 0) AS kept_chars
  FROM d JOIN w USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN good USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT} * n_words) AS base_failed,
  NOT (n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT} * n_words)
    AND kept_chars >= {quality_rules.MIN_KEPT} * word_chars AS kept
FROM m
"""


@query("op7_quality_rules", OP7_SQL)
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = quality_rules.clean_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return c.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "base_failed", "kept")


# -- 8: n-gram Jaccard join ---------------------------------------------------------------------
OP8_SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), {_LOW}), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT rid, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g FROM d),
n AS (SELECT rid, count(*)::BIGINT AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS x, b.rid AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.rid <> b.rid GROUP BY ALL),
link AS (SELECT x, y FROM p JOIN n nx ON nx.rid = x JOIN n ny ON ny.rid = y WHERE 100 * i >= 85 * (nx.n + ny.n - i)),
reach(a, b) AS (SELECT rid, rid FROM d UNION SELECT reach.a, link.y FROM reach JOIN link ON link.x = reach.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN n USING (rid)
JOIN (SELECT a AS rid, min(e.doc_id) AS component_id FROM reach JOIN d e ON e.rid = b GROUP BY a) c USING (rid)
"""


@query("op8_ngram_jaccard", OP8_SQL)
def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.ngram_components(docs).select("doc_id", "n_shingles", "component_id")


# -- 9: quality classifier ----------------------------------------------------------------------
def _remainder(n: int):
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


@query("op9_quality_classifier")
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").filter(_remainder(4) != 2)
    vectors = quality_model.learn_vectors(docs)
    net = quality_model.learn_net(docs, labels, vectors)
    scored = quality_model.score_quality(docs, vectors, net)
    return scored.select("doc_id", (_remainder(4) == 2).alias("held_out"), "score",
                         (F.col("score") >= 0.7).cast("int").alias("predicted"))


# -- 10: language identification ----------------------------------------------------------------
@query("op10_language_id")
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.learn_languages(docs.filter(_remainder(3) != 1))
    return langid.identify(docs.select("doc_id", "text"), model) \
        .select("doc_id", (_remainder(3) == 1).alias("held_out"), "lang_pred", "score")


# -- 11: conversation structure repair ----------------------------------------------------------
def crc32_sql(text: str) -> str:
    """Unsigned crc32 of ASCII text, bit by bit, for DuckDB."""
    bit = "CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END"
    byte = f"list_reduce(list_prepend(xor(c, b), range(8)), lambda x, _: {bit})"
    codes = f"list_transform(string_split({text}, ''), lambda z: ascii(z)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {byte}), 4294967295)"


_KEY11 = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
OP11_SQL = rf"""
WITH RECURSIVE k AS (SELECT coalesce('+' || conv_id::VARCHAR, '') AS key, conv_id, turn, coalesce(role, ' ') AS role,
  coalesce(text, ' ') AS text, {crc32_sql(_KEY11)} % 20 AS k FROM conversations),
d AS (SELECT key, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy FROM k WHERE k <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, role, sha256(strlen(role) || ':' || role || text), copy) AS i FROM d),
f AS (SELECT key, turn, role, text, i, left(role, 1) AS ini, lag(left(role, 1)) OVER (PARTITION BY key ORDER BY i) || left(role, 1) AS pair,
  CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 1
    WHEN row_number() OVER (PARTITION BY key, role, text ORDER BY i) > 1 THEN 2
    WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 3 ELSE 0 END AS fault FROM o),
ins(q, n, q2, lines) AS (VALUES (0, 0, 0, ''), (0, 1, 2, 'user:' || chr(10)), (0, 2, 3, 'user:' || chr(10) || 'assistant:' || chr(10)),
  (1, 0, 1, ''), (1, 1, 2, 'user:' || chr(10)), (1, 2, 3, 'user:' || chr(10) || 'assistant:' || chr(10)),
  (2, 0, 2, ''), (2, 1, 3, 'assistant:' || chr(10)), (3, 0, 3, ''), (3, 1, 2, 'user:' || chr(10)), (3, 2, 3, 'user:' || chr(10) || 'assistant:' || chr(10))),
edit(letter, ini, q, q2, cost, role) AS (
  SELECT 'D', NULL::VARCHAR, unnest([0, 1, 2, 3]), unnest([0, 1, 2, 3]), 4, NULL::VARCHAR
  UNION ALL SELECT 'R', NULL::VARCHAR, unnest([0, 1, 2, 3]), unnest([2, 2, 3, 2]), 3, unnest(['user', 'user', 'assistant', 'user'])
  UNION ALL SELECT 'K', unnest(['s', 'u', 'u', 'u', 'a']), unnest([0, 0, 1, 3, 2]), unnest([1, 2, 2, 2, 3]), 0, NULL::VARCHAR),
way(key, i, q, cost, audit, lines) AS (
  SELECT DISTINCT key, 0::BIGINT, 0, 0::BIGINT, '', '' FROM k
  UNION ALL
  SELECT key, i, q, cost, audit, lines FROM (
    SELECT w.key, f.i, edit.q2 AS q, w.cost + 3 * ins.n + edit.cost + CASE WHEN letter <> 'D' AND fault = 3 THEN 3 ELSE 0 END AS cost,
      w.audit || repeat('I', ins.n) || letter AS audit,
      w.lines || ins.lines || CASE WHEN letter = 'D' THEN '' ELSE coalesce(edit.role, f.role) || ':' || f.text || chr(10) END AS lines,
      row_number() OVER (PARTITION BY w.key, edit.q2 ORDER BY w.cost + 3 * ins.n + edit.cost + CASE WHEN letter <> 'D' AND fault = 3 THEN 3 ELSE 0 END,
        w.audit || repeat('I', ins.n) || letter) AS nth
    FROM way w JOIN f ON f.key = w.key AND f.i = w.i + 1 JOIN ins ON ins.q = w.q
    JOIN edit ON edit.q = ins.q2 AND (letter = 'D' OR fault IN (0, 3)) AND (letter <> 'K' OR edit.ini = f.ini)) WHERE nth = 1),
done AS (SELECT key, cost, audit, lines FROM (
  SELECT w.key, w.cost + 3 * ins.n AS cost, w.audit || repeat('I', ins.n) AS audit, w.lines || ins.lines AS lines,
    row_number() OVER (PARTITION BY w.key ORDER BY w.cost + 3 * ins.n, w.audit || repeat('I', ins.n)) AS nth
  FROM way w JOIN ins ON ins.q = w.q AND ins.q2 IN (0, 3)
  WHERE w.i = (SELECT coalesce(max(f.i), 0) FROM f WHERE f.key = w.key)) WHERE nth = 1),
s AS (SELECT key, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 1) AS blank,
  count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
  count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY key)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, cost::BIGINT AS cost, audit,
  sha256(CASE WHEN lines = '' THEN '' ELSE left(lines, length(lines) - 1) END) AS repaired_sha256
FROM (SELECT DISTINCT key, conv_id FROM k) c JOIN done USING (key) LEFT JOIN s USING (key)
"""


@query("op11_conversation_repair", OP11_SQL)
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_damaged(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


# -- 12: SimHash near duplicates ----------------------------------------------------------------
@query("op12_simhash_near_dedup")
def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.simhash_components(docs).select("doc_id", "fingerprint", "component_id")


# -- 13: Merkle manifest ------------------------------------------------------------------------
def _leaf_sql(text: str) -> str:
    def told(c: str) -> str:
        return f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    return "sha256(" + " || ".join(told(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


OP13_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '+' || lang END AS grp, {_leaf_sql('text')} AS leaf,
  CASE WHEN {crc32_sql('doc_id::VARCHAR')} % 3 = 0 THEN {_leaf_sql(f"translate(text, {_LOW})")} END AS other FROM documents),
p AS (SELECT *, row_number() OVER () AS rid, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf, other NULLS FIRST) - 1 AS idx,
  count(*) OVER (PARTITION BY grp) AS n FROM d),
tree(lev, grp, idx, n, h) AS (
  SELECT 0, grp, idx, n, leaf FROM p
  UNION ALL
  SELECT lev + 1, grp, idx // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM tree WHERE n > 1
  GROUP BY lev, grp, idx // 8, (n + 7) // 8),
sub AS (SELECT grp, lev, h AS subroot FROM tree WHERE n = 1),
top0 AS (SELECT grp, subroot, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS n FROM sub),
top(lev, idx, n, h) AS (
  SELECT 0, idx, n, subroot FROM top0
  UNION ALL
  SELECT lev + 1, idx // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM top WHERE n > 1
  GROUP BY lev, idx // 8, (n + 7) // 8),
root AS (SELECT lev, h AS root FROM top WHERE n = 1),
kids AS (SELECT lev, 't' || grp AS grp, idx, h FROM tree UNION ALL SELECT lev, '/', idx, h FROM top),
beside AS (SELECT a.lev, a.grp, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
  coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM kids a JOIN kids b ON a.lev = b.lev AND a.grp = b.grp AND a.idx // 8 = b.idx // 8 GROUP BY a.lev, a.grp, a.idx),
step AS (
  SELECT rid, k AS lev, 't' || grp AS grp, idx // (8 ** k)::BIGINT AS idx, k AS nth FROM (
    SELECT rid, grp, idx, unnest(range(sub.lev)) AS k FROM p JOIN sub USING (grp))
  UNION ALL
  SELECT rid, k, '/', idx // (8 ** k)::BIGINT, 1000 + k FROM (
    SELECT rid, top0.idx, unnest(range((SELECT lev FROM root))) AS k FROM p JOIN top0 USING (grp))),
path AS (SELECT rid, string_agg(l || r, '' ORDER BY nth) AS sib, list(l || '|' || r ORDER BY nth) AS steps
  FROM step JOIN beside USING (lev, grp, idx) GROUP BY rid),
fin AS (SELECT p.rid, coalesce(sib, '') AS sib,
  list_reduce(list_prepend(coalesce(other, leaf), coalesce(steps, [])), lambda acc, x: sha256(split_part(x, '|', 1) || acc || split_part(x, '|', 2))) AS acc
  FROM p LEFT JOIN path USING (rid))
SELECT p.doc_id, p.leaf, sub.subroot, root.root, sha256(fin.sib) AS proof_sha256, fin.acc AS folded_root, fin.acc = root.root AS verified
FROM p JOIN fin USING (rid) JOIN sub ON sub.grp = p.grp, root
"""


@query("op13_merkle_manifest", OP13_SQL)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    def leaf(text):
        return merkle.leaf_hash([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text])
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    made = merkle.merkle_manifest(docs, leaf(F.col("text")),
                                  other_leaf=F.when(tampered, leaf(merkle.lower_ascii(F.col("text")))))
    return made.select("doc_id", "leaf", "subroot", "root", merkle.proof_hash(F.col("path")).alias("proof_sha256"),
                       "folded_root", "verified")
