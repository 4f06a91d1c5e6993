import pytest

from attemptlog.llm.html_extract import extract_text, main_text
from tests.llm.helpers import with_clashes

ARTICLE = ("<h1>Title &amp; more</h1><p>First para, with   some\ntext and <b>bold</b> words&nbsp;that go on.</p>"
           "<ul><li>one item</li><li>two</li></ul><p>Second para, longer, with commas, and so on.</p><p>End</p>")
TEXT = ("Title & more\nFirst para, with some text and bold words that go on.\none item\ntwo\n"
        "Second para, longer, with commas, and so on.\nEnd")
NOISE = {
    "menu": "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News, sports, and so on, for all</a></li></ul></nav>",
    "header": "<header><h1>The Site, Of All, The Sites</h1></header>",
    "footer": "<footer>&copy; the site, all of it, and some more text to be long enough.</footer>",
    "sidebar": "<div class='col sidebar'><p>Side text, with, commas, many, of, them, and long enough to score well.</p></div>",
    "aside": "<aside><p>Aside text, with, commas, many, of, them, and long enough to score well.</p></aside>",
    "notice": "<div id=cookie-notice><p>We use cookies, partners, pixels, and more, on this site, yes.</p></div>",
    "advert": "<div class=ad>Buy now, cheap, fast, good, and more, more, more.</div>",
    "form": "<form><p>Name, mail, phone, address, and so on, please</p><input name=x><button>Go</button></form>",
    "script": "<script>var t='</p>, a, b, c';</script><style>p{margin:0}</style><noscript><p>On, please, on</p></noscript>",
    "comments": "<section id=comments><p>Nice, article, thanks, a lot, I liked it, very much, indeed, so.</p></section>",
    "comment list": "<ol class=comment-list><li class='comment'><p>Me, too, and, all, of, us, here, as well.</p></li></ol>",
    "html comment": "<!-- <p>hidden, text, with, commas, and, more</p> -->",
}


@pytest.mark.parametrize("name", NOISE)
@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<div class=wrap><div class='content main'>{}</div></div>",
                                  "<main><div>{}</div></main>"])
def test_noise_around_the_article_goes(name, wrap):
    page = "<!DOCTYPE html><html><head><title>T</title></head><body>{0}{1}{0}</body></html>"
    assert main_text(page.format(NOISE[name], wrap.format(ARTICLE))) == TEXT


@pytest.mark.parametrize("name", ["advert", "form", "script", "html comment", "aside", "comments"])
def test_noise_inside_the_article_goes(name):
    half = ARTICLE.index("<ul>")
    page = f"<body><article>{ARTICLE[:half]}{NOISE[name]}{ARTICLE[half:]}</article></body>"
    assert main_text(page) == TEXT


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("   ", ""), ("<html></html>", ""), ("plain only", "plain only"),
    ("<p>just text<p>more &lt;b&gt; text", "just text\nmore <b> text"),
    ("<article><p><b>open bold<br><p>next</article>", "open bold\nnext"),
    ("<article><p>never closed", "never closed"),
    ("<div><a href=1>a</a><a href=2>b</a><a href=3>c</a></div><table><tr><td>cell one</td><td>cell, two</td></tr></table>",
     "cell one cell, two"),
    ("<main><h2>Head</h2><section><p>Sec one, is long enough to count here.</p></section><section><p>Sec two, also long "
     "enough here.</p></section></main>", "Head\nSec one, is long enough to count here.\nSec two, also long enough here."),
    ("<article><p>a < b and 1 <2 &amp;&amp; c</p></article>", "a < b and 1 <2 && c"),
    ("<article></p></div><p>stray ends</p></article>", "stray ends"),
    ("<article class='has-sidebar'><p>kept, as the name only speaks of the layout</p></article>",
     "kept, as the name only speaks of the layout"),
])
def test_odd_pages(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("part, text", [
    ("<section id='discussion'><h2>Discussion</h2><p>We found, as expected, an effect.</p></section>",
     "Discussion\nWe found, as expected, an effect."),
    ("<section id=related-work><p>Others have tried this before.</p></section>", "Others have tried this before."),
    ("<h2 id='search'>Search</h2>", "Search"), ("<h2 id=comments>Comments in code</h2>", "Comments in code"),
    ("<p class='legal'>The law, as it stands, says so.</p>", "The law, as it stands, says so."),
    ("<p id=copyright>Terms last for 70 years.</p>", "Terms last for 70 years."),
    ("<p>A <code id=search>find</code> and a <a class=related href=x>linked word</a> in a longer sentence.</p>",
     "A find and a linked word in a longer sentence."),
    ("<table class='side-effects'><tr><td>Nausea</td></tr></table>", "Nausea"),
    ("<div class=share><a href=a>Mail it</a> <a href=b>Post it to all your friends</a></div>", None),
    ("<div class=share>Share this</div>", None),
    ("<h2 class=advert>Buy</h2>", None),
])
@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<div class='content main'>{}</div>", "<main><div>{}</div></main>"])
def test_names_that_articles_use_as_well(part, text, wrap):
    half = ARTICLE.index("<ul>")
    page = f"<body>{wrap.format(ARTICLE[:half] + part + ARTICLE[half:])}</body>"
    lines = TEXT.split("\n")
    assert main_text(page) == "\n".join(lines[:2] + ([text] if text else []) + lines[2:])


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main><article class=post>{}</article></main>", "<main><div>{}</div></main>"])
def test_weak_names_outside_the_article_go(wrap):
    other = ("<div class=related><p>Other, things, to read, many, of, them, and long enough to score well.</p></div>"
             "<article class=teaser><p>Another, page, of, ours, told, in short, but long enough to score well.</p></article>")
    assert main_text(f"<body>{other}{wrap.format(ARTICLE)}{other}</body>") == TEXT
    assert main_text(f"<body><article class='post trending'>{ARTICLE}</article></body>") == TEXT


@pytest.mark.parametrize("page, text", [
    ("<article><p>icon <svg class=i href='#a'/> then text</p><p>more text</p></article>", "icon then text\nmore text"),
    ("<article><p>one <svg/> two</p><p>three</p><p><svg><text>gone</text></svg>four</p></article>", "one two\nthree\nfour"),
    ("<article><p>one <svg viewBox='0 0 1 1'> two</p><p>three</p></article>", "one two\nthree"),
    ("<article><p>empty <math/> sum</p><p>more text</p></article>", "empty sum\nmore text"),
    ("<article><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p><p>more text</p></article>",
     "So x=2 holds.\nmore text"),
])
def test_foreign_elements(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("page, text", [
    (f"<body><form id=aspnetForm><input type=hidden name=v><div id=content>{ARTICLE}</div></form></body>", TEXT),
    (f"<body><form id=f><input name=q><button>Find</button><div id=content>{ARTICLE}</div></form></body>", TEXT),
    (f"<body><form><div id=content>{ARTICLE}</div><input type=submit></form></body>", TEXT),
    ("<body><form><h3>Mail</h3><p>Have our letters, all of them, sent to you.</p><input name=m></form>"
     f"<div id=content>{ARTICLE}</div></body>", TEXT)])
def test_forms_around_articles_stay(page, text):
    assert main_text(page) == text


LINKS = "<ul><li><a href=a>Smith, A.</a></li><li><a href=b>Jones, B.</a></li><li><a href=c>Brown, C.</a></li></ul>"


@pytest.mark.parametrize("part, text", [
    (f"<h2>Sources</h2>{LINKS}", "Sources\nSmith, A.\nJones, B.\nBrown, C."), (f"<h2>Related</h2>{LINKS}", "Related"), (LINKS, None),
    ("<section id=cookies><h2>How cookies are baked</h2><p>With sugar, and butter.</p></section>",
     "How cookies are baked\nWith sugar, and butter."),
    ("<section id='navigation'><h2>Navigation</h2><p>By the stars, at sea.</p></section>", "Navigation\nBy the stars, at sea."),
    ("<section class='cookies'><h2>Cookies</h2><p>We use them, as you see.</p></section>", None),
    ("<section id='cookies'><p>We use them, as you see.</p></section>", None),
    ("<section id='comments'><h2>Comments</h2><p>Nice one, thanks.</p></section>", None),
    ("<section id='ads'><h2>Ads</h2><p>Buy one, now.</p></section>", None)])
def test_sections_and_lists_of_an_article(part, text):
    half = ARTICLE.index("<ul>")
    lines = TEXT.split("\n")
    assert main_text(f"<body><article>{ARTICLE[:half]}{part}{ARTICLE[half:]}</article></body>") == "\n".join(
        lines[:2] + ([text] if text else []) + lines[2:])


@pytest.mark.parametrize("part, text", [
    ("<dl><dt>Word</dt><dd>what it means</dd></dl>", "Word\nwhat it means"), ("<pre>x = 1</pre>", "x = 1"),
    ("<ul><li>one</li><li>two</li></ul>", "one\ntwo"), ("<table><tr><td>cell</td></tr></table>", "cell"),
    ("<blockquote>as they said</blockquote>", "as they said"), ("<p>Short one</p>", "Short one"),
    ("<p>&copy; 2020 All rights reserved</p>", None), ("<ul><li><a href=a>Home</a></li><li><a href=b>About</a></li></ul>", None)])
def test_blocks_beside_the_best_container(part, text):
    page = f"<body><div class=wrap><div class=content>{ARTICLE}</div>{part}</div></body>"
    assert main_text(page) == "\n".join([TEXT] + ([text] if text else []))


def test_very_long_and_deep_pages():
    many = "".join(f"<p>Paragraph {k}, of many.</p>" for k in range(20_000))
    assert main_text(f"<article>{many}</article>").count("\n") == 19_999
    deep = "<div>" * 3000 + "<p>deep, down, here</p>" + "</div>" * 3000
    assert main_text(deep) == "deep, down, here"


def test_frame_keeps_rows_and_columns(spark):
    rows = [(1, "u", f"<article>{ARTICLE}</article>", "clash"), (1, "u", f"<article>{ARTICLE}</article>", "clash"),
            (None, None, None, None), (3, "v", "", "x")]
    df = with_clashes(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    got = sorted(((r["page_id"] or 0, r["text"]) for r in extract_text(df).collect()))
    assert got == [(0, ""), (1, TEXT), (1, TEXT), (3, "")]
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert extract_text(empty).columns == ["page_id", "url", "html", "text"] and extract_text(empty).count() == 0
