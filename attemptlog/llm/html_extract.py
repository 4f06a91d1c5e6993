"""Main text of web pages by scoring the element tree."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements without an end tag, with raw content, and those that a new block closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg object".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"},
         "option": {"select"}}
#: Elements that never hold article text.
DROP = frozenset("head nav footer aside button select option input label dialog menu canvas audio video".split()) | RAW
DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
#: Words of class names and ids that speak against an element, also beside a good word; that do so with a second
#: sign; and that speak for it.
STRONG = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored comment comments commentlist disqus cookie cookies "
    "consent gdpr footer nav navbar navigation menu sidebar breadcrumb breadcrumbs newsletter subscribe popup modal".split())
#: Those of the strong names that no heading of an article's section explains.
NEVER = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored comment comments commentlist disqus".split())
WEAK = frozenset(
    "aside banner promo promotion notice notices notification alert overlay side toolbar widget related recommended "
    "recommendations share sharing social signup login search pagination pager masthead topbar header skip copyright legal "
    "reply replies respond discussion feedback outbrain taboola teaser trending".split())
GOOD = frozenset("article body content main post entry story text page".split())
#: Containers that can be the article, with their head start.
CONTAINERS = {"article": 25.0, "main": 15.0, "div": 5.0, "section": 3.0, "td": 3.0, "body": 0.0, "center": 0.0}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks whose ids are made from their own words, as those of inline elements are.
TITLED = HEADINGS | frozenset("p dt caption figcaption legend summary".split())
CLASS_SCORE, SIBLING_SHARE, SIBLING_LEAST, MENU_DENSITY, MENU_LINKS = 25.0, 0.2, 3.0, 0.8, 3
#: Second signs against an element with a weak name: the share of its text in links, or so few characters.
WEAK_DENSITY, WEAK_SIZE = 0.5, 25
#: What a form is filled in with, and the text for each of them that a form around an article has at least.
CONTROLS, CONTROL_SIZE = frozenset("input select textarea button".split()), 200
#: Blocks that belong to the text beside the best container unless they are links.
BESIDE = frozenset("pre dl ul ol table blockquote figure".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
                    r"""|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_RIGHTS = re.compile(r"©|copyright|all rights reserved", re.I)
_HIDDEN_INPUT = re.compile(r"""\btype\s*=\s*["']?hidden\b""", re.I)
_NAME = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")


class Node:
    """An element: ``parts`` are texts and elements in page order."""

    __slots__ = ("tag", "attrs", "parent", "parts", "size", "linked", "links", "points", "weak", "controls", "wraps")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent, self.parts = tag, attrs, parent, []
        self.size = self.linked = self.links = 0
        self.points = 0.0
        self.weak = self.wraps = False
        self.controls = 0


def parse(source: str) -> Node:
    """The element tree of a page; end tags that nothing has opened are ignored and
    what is never closed ends with its parent."""
    root = node = Node("html", "", None)
    at = 0
    while m := _TOKEN.search(source, at):
        if m.start() > at:
            node.parts.append(source[at:m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            up = node
            while up is not None and up.tag != tag:
                up = up.parent
            if up is not None and up.parent is not None:
                node = up.parent
            continue
        attrs = m[3] if m[2] else m[6]
        if tag in ("html", "body") and not any(isinstance(x, Node) and x.tag == "body" for x in root.parts) or tag not in ("html", "body"):
            node = _fitting_parent(node, tag)
            if tag == "html":
                continue
            child = Node(tag, attrs, node)
            node.parts.append(child)
            if tag in RAW and not (tag == "svg" and attrs.endswith("/")):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*+>", re.I).search(source, at)
                at = end.end() if end else at if tag == "svg" else len(source)
            elif tag not in VOID and not attrs.endswith("/"):
                node = child
    if at < len(source):
        node.parts.append(source[at:])
    return root


def _fitting_parent(node: Node, tag: str) -> Node:
    """Where an element of ``tag`` goes: a block ends an open paragraph, an item the
    item before it."""
    ends = CLOSES.get(tag, ()) if tag not in BLOCK else {"p", *CLOSES.get(tag, ())}
    if not ends:
        return node
    stop = SCOPE.get(tag, ())
    up = node
    while up is not None and up.tag not in stop:
        if up.tag in ends:
            return up.parent
        if up.tag in BLOCK and "p" in ends and len(ends) == 1 and up.tag != "p":
            break
        up = up.parent
    return node


def _names(value: str) -> list[list[str]]:
    return [[w.lower() for w in _NAME.findall(name)] for name in value.split()]


def _judge(node: Node) -> float | None:
    """Score of an element's names, None if it is to be dropped."""
    if node.tag in DROP:
        return None
    weak = good = False
    strong: set[str] = set()
    named = False               # whether a class says so, not only an id
    own_words = node.tag in TITLED or node.tag not in BLOCK and node.tag not in CONTAINERS and node.tag != "th"
    for m in _ATTR.finditer(node.attrs) if node.attrs else ():
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "role":
            if value.lower() in DROP_ROLES:
                return None
            continue
        if m[1].lower() == "id" and own_words:
            continue
        for words in _names(value):
            if words and words[0] in ("has", "with", "no", "is"):
                continue
            if found := STRONG.intersection(words):
                strong |= found
                named = named or m[1].lower() == "class"
            elif GOOD.intersection(words):
                good = True
            elif WEAK.intersection(words):
                weak = True
    if node.tag in ("html", "body"):
        return 0.0
    if node.tag == "header" and not _inside(node, "article"):
        return None
    if strong and (node.tag == "article" or not good and node.tag != "main") and (named or not _titled(node, strong)):
        return None
    node.weak = weak and (node.tag == "article" or not good and node.tag != "main")
    return CLASS_SCORE if good else 0.0


def _inside(node: Node, tag: str) -> Node | None:
    up = node.parent
    while up is not None and up.tag != tag:
        up = up.parent
    return up


def _words(node: Node) -> set[str]:
    """Words of an element's text, lower-cased."""
    words, stack = set(), [node]
    while stack:
        for x in stack.pop().parts:
            if isinstance(x, str):
                words.update(w.lower() for w in _NAME.findall(x))
            else:
                stack.append(x)
    return words


def _titled(node: Node, names: set[str]) -> bool:
    """Whether an element is a section of an article whose heading has the words of
    its id and which has text besides."""
    if names & NEVER or node.tag not in ("section", "div") or not (_inside(node, "article") or _inside(node, "main")):
        return False
    heads = [x for x in node.parts if isinstance(x, Node) and x.tag in HEADINGS]
    return bool(heads) and names <= _words(heads[0]) and any(
        isinstance(x, Node) and x.tag in ("p", "pre", "table", "dl", "blockquote") for x in node.parts)


def _weigh(root: Node) -> tuple[list[Node], dict[int, float]]:
    """Drop what is no text and measure the rest, children before parents."""
    order, stack, names = [], [root], {}
    while stack:
        node = stack.pop()
        names[id(node)] = 0.0 if node is root else names[id(node)]
        order.append(node)
        kept = []
        for x in node.parts:
            if isinstance(x, str):
                kept.append(entities.unescape(x))
            elif (score := _judge(x)) is not None:
                names[id(x)] = score
                kept.append(x)
                stack.append(x)
            elif x.tag in CONTROLS and not _HIDDEN_INPUT.search(x.attrs):
                node.controls += 1
        node.parts = kept
    for node in reversed(order):
        own = commas = 0
        for x in node.parts:
            if isinstance(x, str):
                own += len(x.strip())
                commas += x.count(",")
            else:
                node.size += x.size
                node.links += x.links + (x.tag == "a")
                node.linked += x.size if x.tag == "a" else x.linked
                node.controls += x.controls
                node.wraps = node.wraps or x.wraps or x.tag in ("article", "main", "h1")
        node.size += own
    return order, names


def _remove(node: Node) -> None:
    """Take an element with all in it out of the tree."""
    node.parent.parts = [x for x in node.parent.parts if x is not node]
    up = node.parent
    while up is not None:
        up.size, up.linked, up.links = up.size - node.size, up.linked - node.linked, up.links - node.links
        up = up.parent
    node.parts = []


def _drop_weak(order: list[Node]) -> list[Node]:
    """Drop forms to be filled in, but not one around an article, and the elements
    with a weak name and a second sign: outside the article (or
    main part) of a page that has one, mostly links, or a few words without blocks."""
    texts = [x for x in order if x.tag == "article" and not x.weak and x.size] or [x for x in order if x.tag == "main" and x.size]
    above: set[int] = set()             # what holds an article is not outside
    for node in texts:
        up = node.parent
        while up is not None and id(up) not in above:
            above.add(id(up))
            up = up.parent
    held, gone = {id(x) for x in texts}, set()
    kept = []
    for node in order:                  # parents before children
        if id(node.parent) in gone:
            gone.add(id(node))
            continue
        if node.parent is not None and id(node.parent) in held:
            held.add(id(node))
        kept.append(node)
        if node.tag == "form" and not node.wraps and node.size < CONTROL_SIZE * node.controls:
            _remove(node)
            gone.add(id(node))
            kept.pop()
            continue
        if not node.weak or not node.size:
            continue
        block = node
        while block.parent is not None and block.tag == "a":
            block = block.parent        # a link is all link: its surroundings tell
        outside = bool(texts) and id(node) not in held and id(node) not in above
        few = node.tag in ("div", "section") and node.size <= WEAK_SIZE and not _holds(node)
        if outside or block.linked >= WEAK_DENSITY * block.size or few:
            _remove(node)
            gone.add(id(node))
            kept.pop()
    return kept


def _drop_menus(order: list[Node]) -> None:
    for node in order:
        if node.tag in ("ul", "ol", "div", "section", "table", "dl") and node.links >= MENU_LINKS and node.size \
                and node.linked >= MENU_DENSITY * node.size and node.parent is not None and not _listed(node):
            _remove(node)


def _listed(node: Node) -> bool:
    """Whether a list of links stands right under a heading of an article, as sources
    do; a heading with words of menus and adverts does not count."""
    if node.tag not in ("ul", "ol", "dl") or not _inside(node, "article"):
        return False
    before = None
    for x in node.parent.parts:
        if x is node:
            break
        if isinstance(x, Node) or x.strip():
            before = x
    return isinstance(before, Node) and before.tag in HEADINGS and not _words(before) & (STRONG | WEAK)


def _inline_text(node: Node) -> str:
    """Text of a block without the blocks inside it."""
    out, stack = [], [iter(node.parts)]
    while stack:
        for x in stack[-1]:
            if isinstance(x, str):
                out.append(x)
            elif x.tag not in BLOCK:
                stack.append(iter(x.parts))
                break
        else:
            stack.pop()
    return "".join(out)


def _holds(node: Node) -> bool:
    """Whether an element is a container: a division or cell without blocks in it is
    a paragraph."""
    return node.tag in ("article", "main", "body", "html") or node.tag in CONTAINERS and any(
        isinstance(x, Node) and x.tag in BLOCK for x in node.parts)


def _stands_beside(node: Node, top: Node) -> bool:
    """Whether a sibling of the best container belongs to the text."""
    density = node.linked / node.size
    if top.tag in ("article", "main"):
        return top.tag == "article" == node.tag and node.points >= max(SIBLING_LEAST, SIBLING_SHARE * top.points)
    if node.tag in HEADINGS:
        return True
    if node.tag == "p":
        text = _inline_text(node).strip()
        return not _RIGHTS.search(text) and (
            len(text) > 80 and density < 0.25 or density == 0 and (text.endswith((".", "!", "?")) or top.parent.tag != "body"))
    if node.tag in BESIDE:
        return density < 0.25 and not _RIGHTS.search(" ".join(_blocks([node])))
    return node.tag in CONTAINERS and density < 0.25 and node.points >= max(SIBLING_LEAST, SIBLING_SHARE * top.points)


def _pass_points(order: list[Node]) -> None:
    """Every block with text of its own gives points for length and commas: all to
    itself if it is a container, else to its parent, half to the next, then less."""
    for node in order:
        if node.tag not in BLOCK and node.tag != "td":
            continue
        text = _inline_text(node).strip()
        if not text:
            continue
        points = min(len(text) / 25, 1) + text.count(",") + min(len(text) / 100, 3)
        up, level = (node if _holds(node) else node.parent), 0
        while up is not None:
            up.points += points / (1 if level == 0 else 2 if level == 1 else level * 3)
            up, level = up.parent, level + 1


def _blocks(tops: list[Node]) -> list[str]:
    """Texts of the blocks under ``tops`` in page order."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(held).split()):
            out.append(text)
        held.clear()
    for top in tops:
        stack = [iter([top])]
        opened: list[Node] = []
        while stack:
            for x in stack[-1]:
                if isinstance(x, str):
                    held.append(x)
                    continue
                if x.tag in BLOCK:
                    flush()
                elif x.tag in ("br", "td", "th"):
                    held.append(" ")
                stack.append(iter(x.parts))
                opened.append(x)
                break
            else:
                stack.pop()
                if opened and len(stack) == len(opened):
                    if opened.pop().tag in BLOCK:
                        flush()
        flush()
    return out


def main_text(source: str | None) -> str:
    """Main text of one page: blocks joined by line ends; empty if there is none."""
    if not source:
        return ""
    root = parse(source)
    order, names = _weigh(root)
    order = _drop_weak(order)
    _drop_menus(order)
    _pass_points(order)
    best, most = None, 0.0
    for node in order:
        if node.tag in CONTAINERS and _holds(node) and node.points > 0 and node.size > 0:
            score = (CONTAINERS[node.tag] + names[id(node)] + node.points) * (1 - node.linked / node.size)
            if score > most:
                best, most = node, score
    if best is None:
        return "\n".join(_blocks([root]))
    whole = _inside(best, "article")
    top = whole if whole is not None else best
    if top.parent is None:
        return "\n".join(_blocks([top]))
    tops = [x for x in top.parent.parts if isinstance(x, Node) and (x is top or x.size and _stands_beside(x, top))]
    return "\n".join(_blocks(tops))


def extract_text(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """Add ``out``, the main text of every page.

    Elements that by tag, role or name hold menus, notices, adverts, forms, scripts,
    comments and the like are dropped, as are lists that are nearly all links and do not
    stand right under a heading of the article.  A form goes unless it is put around an article or
    has much text for each control; a section whose id is a word of its heading stays in an article.  Names
    that articles use as well ("related", "legal") count only outside the article, on
    elements that are mostly links or on a few words; ids of headings, paragraphs
    and inline elements do not count. Each
    block passes points for its length and commas to its ancestors; a container's
    points are discounted by the share of its text that is links.  The
    best container, the article it stands in and siblings of some weight are the
    main text.  Blocks are joined by a line end, white space in a block becomes
    one space; nothing is cut.

    Null and empty html give an empty text; broken markup is read as far as it
    goes.  A column named like ``out`` is replaced.
    """
    pages = pages.drop(out) if out != html else pages
    names = [c for c in pages.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(x.as_py()) for x in batch.column(html)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(text, pa.large_string()).cast(pa.string())],
                                             names=[*names, out])
    schema = pages.select(*names).withColumn(out, F.lit("")).schema
    return pages.mapInArrow(run, schema)
