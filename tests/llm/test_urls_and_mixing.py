import heapq
import random
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attemptlog.llm import graph, mixing, queries, sharding, url_filter
from attemptlog.llm.queries import RULES
from tests.llm.helpers import DOCS, docs_frame, with_clashes


def components_by_hand(edges):
    part = {}

    def find(x):
        while part.setdefault(x, x) != x:
            x = part[x]
        return x
    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            part[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(part)}


@pytest.mark.parametrize("edges", [
    [], [(1, 1), (None, 2), (3, None)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 50)],
    [(5, 4), (4, 5), (5, 4), (9, 8), (8, 2), (7, 7)]])
def test_components_match_union_find(spark, edges):
    df = spark.createDataFrame(edges, "src long, dst long")
    got = graph.connected_components(df).collect()
    assert len(got) == len({r["node"] for r in got})
    assert {r["node"]: r["component"] for r in got} == components_by_hand(edges)


def test_random_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]
    got = graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {r["node"]: r["component"] for r in got} == components_by_hand(edges)


def test_block_follows_links_and_allow_stands(spark):
    pages = spark.createDataFrame([
        (1, "http://a.example.com/x", '<link rel="canonical" href="http://b.example.com/de/1">', "clash"),
        (2, "http://B.example.com/de/1#top", "", "clash"),
        (3, "http://c.example.org/fr/2", "<LINK href='http://a.example.com/x' rel=canonical>", "clash"),
        (4, "http://d.example.com/en", '<meta http-equiv="refresh" content="0; url=/next?a=1&amp;b=2">', "clash"),
        (5, "http://d.example.com/next?a=1&b=2", '<link rel=canonical href="//spam.net/z">', "clash"),
        (6, "http://www.example.net/en/", None, "clash"), (7, None, "x", "clash"), (8, "no-scheme/net/", "", "clash"),
        (9, "http://net?x", "", "clash"), (10, "https://NET/", "", "clash"), (10, "https://NET/", "", "clash"),
        (None, "http://other.com/", "", "clash")], "page_id long, url string, html string, rule string")
    got = url_filter.judge_urls(pages, url_filter.page_links(pages), RULES).collect()
    assert len(got) == 12
    by = defaultdict(list)
    for r in got:
        by[r["page_id"]].append((r["host"], r["path"], r["rule"], r["verdict"]))
    assert by[1] == [("a.example.com", "/x", None, "block")]            # alias of a blocked page
    assert by[2] == [("b.example.com", "/de/1", "example.com/de/", "block")]
    assert by[3] == [("c.example.org", "/fr/2", "org/fr/", "allow")]    # allowed by rule, whatever it links to
    assert by[4][0][3] == "block" and by[5][0][3] == "block"            # by a target that is no page
    assert by[6][0][2:] == ("example.net/en/", "allow")
    assert by[7] == [("", "", None, "allow")] == by[8]
    assert by[9] == [("net", "", None, "allow")]
    assert by[10] == [("net", "/", "net/", "block")] * 2
    assert by[None] == [("other.com", "/", None, "allow")]


def test_forms_of_redirects_and_canonical_links(spark):
    refresh = ["0;url='http://x.net/'", "0; http://x.net/", "5,http://x.net/", "0; URL = http://x.net/", "0 url=http://x.net/",
               ";url=http://x.net/", "url=http://x.net/", "0;url= 'http://x.net/ '", "1.5 ; http://x.net/"]
    tags = [f'<meta http-equiv="refresh" content="{x}">' for x in refresh] \
        + ["<meta content='0;url=\"http://x.net/\"' http-equiv=refresh>", "<meta http-equiv=refresh content=0;url=http://x.net/>",
           "<meta http-equiv=refresh content=0; url=http://x.net/>"] \
        + [f"<link {x} href='http://x.net/'>" for x in ('rel="shortlink canonical"', "rel='canonical shortlink'", "rel=canonical",
                                                       'rel="a canonical b"', "rel='a\ncanonical'")]
    none = ['<meta http-equiv="refresh" content="30">', '<meta http-equiv="refresh" content="30 " name="x">',
            '<meta http-equiv="refresh" content="0;url=">', '<meta http-equiv="refresh" content="30 ; ">',
            '<link rel="not-canonical" href="http://x.net/">', '<link rel="shortlink" title="canonical" href="http://x.net/">']
    inner = '<meta http-equiv="refresh" content="0; http://x.net/?url=http://y.com/">'
    rows = [(f"http://p{k}.com/", t) for k, t in enumerate(tags + none + [inner])]
    got = url_filter.page_links(spark.createDataFrame(rows, "url string, html string")).collect()
    assert sorted((r["src"], r["dst"]) for r in got) == sorted(
        [(f"http://p{k}.com/", "http://x.net/") for k in range(len(tags))]
        + [(f"http://p{len(tags) + len(none)}.com/", "http://x.net/?url=http://y.com/")])


EDGE_PAGES = {
    "a comment": ("<!-- <link rel=canonical href='http://no.net/'> --><link rel=canonical href='http://yes.com/'>", ["yes.com"]),
    "an open comment": ("<link rel=canonical href='http://yes.com/'><!-- <link rel=canonical href='http://no.net/'>", ["yes.com"]),
    "a script": ("<script>s = '<meta http-equiv=\"refresh\" content=\"0;url=http://no.net/\">'</script>", []),
    "a style": ("<STYLE><link rel=canonical href='http://no.net/'></STYLE >", []),
    "a template": ("<template><link rel=canonical href='http://no.net/'></template>", []),
    "a text area": ("<textarea><link rel=canonical href='http://no.net/'></textarea>", []),
    "parts of words": ("<link rel='canonical-old' href='http://no.net/'><link rel=xcanonical href='http://no.net/'>", []),
    "other attributes": ("<link data-rel=canonical href='http://no.net/'><link rel=canonical data-href='http://no.net/'>", []),
    "several": ("<link rel=canonical href='http://one.com/'><meta http-equiv=' Refresh' content='1;http://two.com/'>"
                "<link href='http://three.com/' rel='x CANONICAL'>", ["one.com", "three.com", "two.com"]),
    "a comment in a script": ("<script><!-- </script><link rel=canonical href='http://yes.com/'>", ["yes.com"]),
    "null": (None, []), "empty": ("", [])}


@pytest.mark.parametrize("repeats", [1, 2])
def test_links_are_read_from_the_markup_alone(spark, repeats):
    rows = [(f"http://p{k}.org/", x) for k, (x, _) in enumerate(EDGE_PAGES.values())] * repeats
    got = url_filter.page_links(with_clashes(spark.createDataFrame(rows, "url string, html string"))).collect()
    assert sorted((r["src"], r["dst"]) for r in got) == sorted(
        (f"http://p{k}.org/", f"http://{host}/") for k, (_, hosts) in enumerate(EDGE_PAGES.values()) for host in hosts * repeats)


def test_op2_with_edges_equals_its_sql(spark, tmp_path):
    import duckdb
    refresh = ["0;url='http://x.net/'", "0; http://x.net/", "5,http://x.net/", "0 url=http://x.net/", "0;url=", "30", "url=x/y",
               "0;url= 'http://x.net/ '", "1.5 ; /fr/", "0; http://x.org/?url=http://y.net/", "//spam.net/a&amp;b"]
    pages = [f'<meta http-equiv="refresh" content="{x}">' for x in refresh] + [x for x, _ in EDGE_PAGES.values()] \
        + [f"<link rel=canonical href='http://h{k + 1}.com/'>" for k in range(12)] + ["<link rel=canonical href=//spam.net/z>"] \
        + ["<meta content=0;url=http://x.net/ http-equiv=refresh>", "<meta http-equiv=refresh content=0; url=http://x.net/>"]
    chain = len(refresh) + len(EDGE_PAGES)
    rows = [(k, f"http://H{k - chain}.com/" if chain <= k <= chain + 12 else f"http://p{k}.com/d/{k}", x) for k, x in enumerate(pages)]
    rows += [(900, None, pages[0]), (901, "none", pages[0]), (902, "http://x.org/fr/", pages[0]), (902, "http://x.org/fr/", pages[0])]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = queries.op2_url_filters(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({queries.OP2_SQL})").fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    verdicts = {r["page_id"]: r["verdict"] for r in got}
    assert all(verdicts[chain + k] == "block" for k in range(13)) and verdicts[chain - 1] == "allow"


def test_urls_of_an_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filter.judge_urls(pages, url_filter.page_links(pages), RULES).count() == 0


def targets_by_hand(sizes):
    """Sources in order with their sizes: level by trying every clamped set."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    total, clamped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in clamped]
        if not free:
            return {s: 3.0 * sizes[s] for s in names}
        level = (total - sum(3 * sizes[s] for s in clamped)) / sum(w[s] for s in free)
        more = {s for s in free if w[s] * level > 3 * sizes[s]}
        if not more:
            return {s: 3.0 * sizes[s] if s in clamped else w[s] * level for s in names}
        clamped |= more


def mixed(df):
    measured = mixing.measure(df)
    return mixing.copies_of(measured, mixing.plan_mix(measured)).collect()


def test_mix_meets_targets_and_repeats(spark):
    rng = random.Random(1)
    texts = [" ".join(["w"] * rng.randint(0, 40)) for _ in range(600)] + [None, "", " \t\n", "one two"]
    sources = [rng.choice(["a", "b", "c", "big", "big", "big", None]) for _ in texts]
    sources[:3] = ["tiny"] * 3
    df = with_clashes(docs_frame(spark, texts, sources=sources))
    first, again = mixed(df), mixed(df.repartition(5))
    key = lambda r: (r["doc_id"], r["copies"])
    assert sorted(map(key, first)) == sorted(map(key, again)) and len(first) == len(texts)
    sizes = defaultdict(int)
    for t, s in zip(texts, sources, strict=True):
        sizes[s] += len((t or "").split())
    want, taken, top = targets_by_hand(sizes), defaultdict(int), defaultdict(int)
    for r in first:
        assert 0 <= r["copies"] <= 3 and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] += r["size"] * r["copies"]
        top[r["source"]] = max(top[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= top[s] / 2 + 1e-6


def test_mix_edge_tables(spark):
    assert mixed(spark.createDataFrame([], DOCS)) == []
    rows = mixed(docs_frame(spark, [None, ""], sources=[None, "x"]))
    assert [r["copies"] for r in rows] == [0, 0] and {r["target"] for r in rows} == {0.0}
    same = mixed(docs_frame(spark, ["a b c"] * 5, ids=[7] * 5))
    assert len({r["copies"] for r in same}) == 1
    nulls = mixed(docs_frame(spark, ["a b", "c d"], ids=[None, None], sources=[None, None]))
    assert sum(r["copies"] * r["size"] for r in nulls) in (2, 4, 6)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 60), st.integers(1, 700)), min_size=1, max_size=6, unique_by=lambda x: x[0]),
       st.integers(1, 7))
def test_dealt_classes_equal_the_heap(classes, n):
    classes = sorted(classes, reverse=True)
    heap, loads = [(0, k) for k in range(n)], [0] * n
    for size, count in classes:
        for _ in range(count):
            load, k = heap[0]
            heapq.heapreplace(heap, (load + size, k))
            loads[k] += size
    got = [0] * n
    for size, shards, upto in sharding.deal_classes(classes, n):
        for k, a, b in zip(shards, [0, *upto], upto):
            got[k] += size * (b - a)
    assert got == loads


def test_shards_against_brute_force(spark):
    rng = random.Random(2)
    texts = ["x" * rng.randint(0, 300) + rng.choice("abé") for _ in range(300)] + [None] * 4 + [""] * 3 + ["dup text"] * 50
    df = with_clashes(docs_frame(spark, texts, ids=[i % 320 for i in range(len(texts))]))
    got = sharding.assign_shards(df, 7).collect()
    assert len(got) == len(texts)
    groups = defaultdict(int)
    for t in texts:
        groups[t] += len((t or "").encode()) + 16
    heap = [(0, k) for k in range(7)]
    for size in sorted(groups.values(), reverse=True):
        load, k = heap[0]
        heapq.heapreplace(heap, (load + size, k))
    loads, slots, place = defaultdict(int), defaultdict(list), {}
    for r in got:
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        assert place.setdefault(r["group"], r["shard"]) == r["shard"]
    assert sorted(loads.values()) == sorted(x for x, _ in heap)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    text_of = defaultdict(set)
    for i, t in enumerate(texts):
        text_of[i % 320].add(None if t is None else zlib.crc32(t.encode()))
    assert all(r["text_crc32"] in text_of[r["doc_id"]] for r in got)
    assert sharding.assign_shards(spark.createDataFrame([], DOCS)).count() == 0
