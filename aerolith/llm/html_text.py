"""Main text of web pages by tree scoring.

The markup is read into a tree (unclosed and misnested tags close as in browsers).
Paragraphs pass points for their length and commas to their ancestors, halved per level
and discounted by each ancestor's link density; the best container is kept together with
those siblings that score a share of it. Where an ``article`` or ``main`` around it holds
most of the page's points, the siblings on the way up to it are asked too. Menus, headers,
footers, asides, notices, adverts, forms, comments of readers, scripts and styles are taken
out before: by tag and role, and by class where it names a block outside a paragraph. Words
that an article uses too (alert, legal, tags) take out a block of an article only if it is
short or made of links. Text blocks are joined in page order by one newline.

Defined results: null or empty html gives an empty text; a page without any paragraph
gives the text that is left of its body; of containers with equal points the deepest, then
the first, is the best; a very long page is read whole; an empty table gives no rows;
repeated rows give repeated rows; columns other than the html and those kept are not looked
at, and kept columns named ``text`` or ``n_chars`` raise.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from aerolith.llm.common import pieces

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                  r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)", re.DOTALL)
_ATTR = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.DOTALL)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noembed noframes".split())
#: Of these, what a browser does not read on to the end of the page where the end tag lacks.
_NOT_TO_THE_END = frozenset("svg math template noscript".split())
#: Elements that never hold article text.
DROPPED = RAW | frozenset("nav header footer aside form button select option input label fieldset menu dialog "
                          "object embed canvas audio video map head datalist".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dir div dl dt fieldset figcaption "
                   "figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary "
                   "table tbody td tfoot th thead tr ul".split())
INLINE_FORMAT = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp "
                          "small span strike strong sub sup time tt u var".split())
#: Opening one of these closes an open one of the same kind in the same container.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
           "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
_SCOPE = frozenset("ul ol dl table html body div article section td th".split())

def _words(text: str) -> re.Pattern:
    return re.compile(rf"(?:^|[\s_-])(?:{'|'.join(text.split())})(?=$|[\s_-])", re.IGNORECASE)


#: Class, id and role words of what is not the article.
_NOISE = _words(r"""ads? advert\w* advertising adsense sponsor\w* promo\w* comments? commentlist disqus respond reply replies
    cookies? consent gdpr popup modal overlay newsletter subscri\w* signup login share sharing social
    sidebar aside widgets? related recommend\w* more-?links nav navbar navigation menu breadcrumbs? pager pagination
    masthead topbar footer skip hidden complementary contentinfo""")
#: Words that name parts of articles too: noise outside of one, and in one where the text is short or linked.
_DOUBTFUL = _words("banner notice alert follow side popular trending header foot copyright legal tools? toolbar tags? taglist search")
_LAYOUT = re.compile(r"(?:^|[\s_-])(?:has|with|no|without)[_-]\S+", re.IGNORECASE)
_PARAGRAPHS = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6 div article section main".split())
_KEPT_ANYWAY = frozenset("html body article main".split())
_WS = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "attrs", "kids", "parent", "score", "size", "linked")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.kids: list[Node | str] = []
        self.score, self.size, self.linked = 0.0, 0, 0


def parse(text: str) -> Node:
    """The tree of a page; character references are decoded in text."""
    root = top = Node("html", "", None)
    at = 0
    while m := _TAG.search(text, at):
        if m.start() > at:
            top.kids.append(entities.unescape(text[at:m.start()]))
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                top.kids.append(m[0][9:].removesuffix("]]>"))
            continue
        if m[1]:
            node = top
            while node is not root and node.tag != tag:
                if tag in INLINE_FORMAT and node.tag in BLOCKS:
                    break
                node = node.parent
            if node is not root and node.tag == tag:
                top = node.parent
            if tag == "p" and node is root:
                top.kids.append(Node("br", "", top))
            continue
        if tag == "html":
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.IGNORECASE).search(text, at)
            at = end.end() if end else at if tag in _NOT_TO_THE_END else len(text)
            continue
        if tag in BLOCKS and tag != "br":
            node = top
            while node.tag not in _SCOPE and node.tag != "p" and node is not root:
                node = node.parent
            if node.tag == "p":
                top = node.parent
        if tag in _CLOSES:
            node = top
            while node is not root and node.tag not in _CLOSES[tag] and node.tag not in ("ul", "ol", "dl", "table"):
                node = node.parent
            if node.tag in _CLOSES[tag]:
                top = node.parent
        node = Node(tag, m[3] or "", top)
        top.kids.append(node)
        if tag not in VOID and not (m[3] or "").rstrip().endswith("/"):
            top = node
    if at < len(text):
        top.kids.append(entities.unescape(text[at:]))
    return root


def _names(node: Node) -> str:
    if "=" not in node.attrs:
        return ""
    return " ".join((a[1] or a[2] or a[3]) for a in _ATTR.findall(node.attrs) if a[0].lower() in ("class", "id", "role", "itemprop"))


def _hidden(node: Node) -> bool:
    attrs = node.attrs.lower()
    return bool(re.search(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none|visibility\s*:\s*hidden", attrs))


_TEXT = frozenset("p pre blockquote li dd dt h1 h2 h3 h4 h5 h6 td th figcaption".split())


def prune(root: Node) -> None:
    """Takes out what is not article text: by tag, role and, outside of paragraphs, by class."""
    _measure(root)
    todo = [(root, False, False)]
    while todo:
        node, in_text, in_article = todo.pop()
        kept = []
        for k in node.kids:
            if isinstance(k, Node):
                if k.tag in DROPPED and not (k.tag == "header" and _inside_article(k)):
                    continue
                if k.attrs and k.tag not in _KEPT_ANYWAY and (_hidden(k) or not in_text and _named_noise(k, in_article)):
                    continue
                todo.append((k, in_text or k.tag in _TEXT, in_article or k.tag in ("article", "main")))
            kept.append(k)
        node.kids = kept


def _named_noise(node: Node, in_article: bool) -> bool:
    names = _LAYOUT.sub(" ", _names(node))
    if not names or _holds_article(node):
        return False
    if _NOISE.search(names):
        return True
    slight = node.size < 60 or node.linked > 0.3 * node.size
    return bool(_DOUBTFUL.search(names)) and (slight or not in_article)


def _holds_article(node: Node) -> bool:
    """A layout element around the article, whatever its class says."""
    todo = list(node.kids)
    while todo:
        k = todo.pop()
        if isinstance(k, Node):
            if k.tag in ("h1", "main") or (k.tag == "article" and not _NOISE.search(_names(k))):
                return True
            todo += k.kids
    return False


def _inside_article(node: Node) -> bool:
    """A header of the article itself: its title stands there, no menu."""
    up = node.parent
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    return up is not None and any(isinstance(k, Node) and k.tag in ("h1", "h2", "h3") for k in node.kids)


def _measure(root: Node) -> list[Node]:
    """Text size and linked size of every node; the nodes from the leaves up."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [k for k in node.kids if isinstance(k, Node)]
    order.reverse()
    for node in order:
        node.size = sum(len(k.strip()) if isinstance(k, str) else k.size for k in node.kids)
        node.linked = node.size if node.tag == "a" else sum(k.linked for k in node.kids if isinstance(k, Node))
    return order


def _own_text(node: Node) -> str:
    """Text of a paragraph: its strings and those of the inline elements in it."""
    out, todo = [], list(reversed(node.kids))
    while todo:
        k = todo.pop()
        if isinstance(k, str):
            out.append(k)
        elif k.tag not in BLOCKS:
            todo += reversed(k.kids)
    return "".join(out)


def best_container(root: Node) -> list[Node | str]:
    """The container with the most points, and its siblings that hold article text too."""
    order = _measure(root)
    scored, points_below, total = [], {}, 0.0
    for node in order:
        if node.tag not in _PARAGRAPHS:
            continue
        text = _own_text(node).strip()
        if len(text) < 25:
            continue
        points = 1 + text.count(",") + min(len(text) / 100, 30)
        up, share = node.parent, 1.0
        if node.tag in ("div", "article", "section", "main", "td"):
            up = node  # text that stands in a container without a paragraph
        total += points
        while up is not None:
            if not up.score:
                scored.append(up)
                up.score = 1e-9
            up.score += points * share
            if up.tag in ("article", "main"):
                points_below[id(up)] = points_below.get(id(up), 0.0) + points
            share, up = share / 2, up.parent
    if not scored:
        return [root]

    def worth(node: Node) -> float:
        density = node.linked / node.size if node.size else 0.0
        return node.score * (1 - density) * (1.25 if node.tag in ("article", "main") else 1.0)

    best = max(scored, key=worth)  # the deepest of equals, as leaves come first
    least = 0.05 * worth(best)
    above, up = [best], best  # from the best container up to an article that holds most of the page's points
    while up is not None and not (up.tag in ("article", "main") and points_below[id(up)] >= 0.5 * total):
        up = up.parent
        above.append(up)
    if up is None:
        above = [best, best.parent] if best.parent is not None else [best]
    whole = up is not None and up.tag == "article"
    path = set(map(id, above))

    def stays(k: Node, before: bool) -> bool:
        if whole:  # the article's own parts, but for lists of links
            return k.linked <= 0.5 * k.size
        plain = k.size and k.linked < 0.25 * k.size
        prose = plain and (k.tag in ("p", "pre", "blockquote", "ul", "ol", "table", "figure") and k.size > 25
                           or k.tag in ("h1", "h2", "h3") or before and _holds_article(k))
        return bool(prose or (k.score and worth(k) >= least))

    out: list[Node | str] = []
    todo: list[tuple[Node | str, bool]] = [(above[-1], True)]
    while todo:
        node, kept = todo.pop()
        if isinstance(node, str) or id(node) not in path or node is best:
            if kept:
                out.append(node)
            continue
        inner, before = [], True
        for k in node.kids:
            on = isinstance(k, Node) and id(k) in path
            inner.append((k, on or (whole if isinstance(k, str) else stays(k, before))))
            before = before and not on
        todo += reversed(inner)
    return out


def blocks(nodes: list[Node | str]) -> list[str]:
    """The text blocks below the nodes: white space within one is one space."""
    out, own = [], []

    def close() -> None:
        text = _WS.sub(" ", "".join(own)).strip()
        own.clear()
        if text:
            out.append(text)

    for top in nodes:
        todo: list[Node | str | None] = [top]
        while todo:
            k = todo.pop()
            if k is None:
                close()
            elif isinstance(k, str):
                own.append(k)
            elif k.tag in BLOCKS:
                close()
                todo.append(None)
                todo += reversed(k.kids)
            else:
                todo += reversed(k.kids)
        close()
    return out


def main_text(page: str | None) -> str:
    """The article of one page, '' if there is none."""
    if not page:
        return ""
    root = parse(page)
    prune(root)
    return "\n".join(blocks(best_container(root)))


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """(*keep, text, n_chars): main text of every page, whole pages, no shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, html_col):
            text = [main_text(x) for x in b.column(html_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(text, pa.string()),
                                              pa.array([len(x) for x in text], pa.int64())], [*keep, "text", "n_chars"])

    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return pages.select(html_col, *keep).mapInArrow(run, f"{schema}, text string, n_chars bigint")
