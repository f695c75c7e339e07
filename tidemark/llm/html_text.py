"""The main text of web pages by tree scoring.

A page is parsed into a tree of elements (end tags may be missing, as HTML allows).
What is never article text is cut off first: scripts, forms (of one that wraps most of
the page, its controls only), navigation and elements whose class, id or role says
advert, comment, side bar and the like. A name says so if it consists of such words and of
layout words ("share-buttons"); a name with other words ("share-price") only together with the
form: many links or controls. Headings never go for a title's name. Of what a name speaks
against, elements that are or hold an article, are named like one as well or hold most of the
page's prose only score less. Every
paragraph then gives points for its length and its commas to its ancestors, less the
farther up; a container's points are discounted by the share of its text inside links.
The best container is kept with those siblings that score well, read like prose or are
sections of sentences like it, and their blocks are the text. Where that is little of the page's prose and nothing else is
an article by its name, names are left aside in a second try.

Defined cases: NULL or empty html gives an empty text, as does a page without text;
cut-off markup is read as far as it goes; repeated rows give equal results.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WHITE = re.compile(r"[ \t\n\r\f\v   -     　\x85\x1c-\x1f]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: A start tag of the key ends an open element of the value, unless one of SCOPES is in between.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol menu dl table body html article section div main aside".split())
DROPPED = frozenset(
    "head script style noscript iframe template svg math canvas object embed applet audio video map nav aside footer form button select "
    "option input textarea label fieldset dialog menu title xmp noembed noframes".split()
)
#: Words of a class, id or role that mark what is not the article, and those that mark what is.
UNLIKELY = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs comment comments commentlist "
    "discussion discuss disqus cookie cookies consent gdpr notice notices alert disclaimer foot footer footnav copyright legal head header masthead topbar "
    "menu menus nav navbar navigation navigational sidebar sidebars side aside rail widget widgets related recommended recommendations "
    "share sharing social promo promoted promotion sponsor sponsored outbrain taboola newsletter signup subscribe subscription "
    "login register popup modal overlay pager pagination paging search toolbar tags taglist reply replies respond responses feedback "
    "skip hidden complementary contentinfo noprint shoutbox trackback pingback cta paywall".split()
)
#: Words that stand beside these in names of the same things.
LAYOUT = frozenset(
    "box boxes container wrapper wrap area section block list item items link links button buttons btn bar inner outer slot unit left right top "
    "bottom column col row group panel pane module icon icons title heading label form posts stories articles entries thread threads count "
    "meta info site global fixed sticky small large mobile desktop primary secondary the".split()
)
NEGATING = frozenset("with has no without non".split())
TITLE_WORDS = frozenset("header head".split())
LIKELY = frozenset("article body content entry hentry main page post story text blog".split())
SPLIT_NAMES = re.compile(r"[^a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
PARAGRAPHS = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6 figcaption div section article main body".split())


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
CONTROLS = frozenset("form button select input textarea label".split())
COMMAS = ",，、،"
SENTENCE = re.compile(r"[.!?…。！？](?:\s|[\"'”’»)]|\Z)")


class Node:
    __slots__ = ("tag", "tokens", "names", "children", "parent", "block", "gone", "controls")

    def __init__(self, tag: str, tokens: tuple[tuple[str, ...], ...] = (), parent: Node | None = None, gone: bool = False):
        self.tag, self.tokens, self.parent, self.gone, self.controls = tag, tokens, parent, gone, False
        self.names = tuple(w for t in tokens for w in t)
        self.block: Node = self if tag in BLOCKS or parent is None else parent.block
        self.children: list = []


def _names(attributes: str) -> tuple[tuple[tuple[str, ...], ...], bool]:
    """The names in class, id and role, each as its words; is the element hidden?"""
    words: list[tuple[str, ...]] = []
    hidden = False
    for name, double, single, bare in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), double or single or bare
        if name in ("class", "id", "role"):
            tokens = CAMEL.sub("-", html.unescape(value)).lower().split()
            words += [tuple(w for w in SPLIT_NAMES.split(t) if w) for t in tokens]
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            hidden = True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = True
    return tuple(t for t in words if t), hidden


def parse(page: str) -> Node:
    """The tree of a page; text children are strings with character references decoded."""
    root = Node("#root")
    at, here, position = root, 0, 0
    opened: Counter = Counter()  # open elements by name, inline ones by their block as well: no search for what is not there

    def key(node: Node) -> tuple:
        return (node.tag, None if node.tag in BLOCKS else id(node.block))

    def leave(node: Node) -> Node:
        """End an open element and all in it."""
        inner = at
        while inner is not node:
            opened[key(inner)] -= 1
            inner = inner.parent
        opened[key(node)] -= 1
        return node.parent

    while True:
        found = TOKEN.search(page, position)
        if found is None:
            break
        if found.start() > here:
            at.children.append(html.unescape(page[here : found.start()]))
        here = position = found.end()
        if found.group(2) is None:
            continue
        tag = found.group(2).lower()
        if found.group(1):
            if opened[(tag, None if tag in BLOCKS else id(at.block))]:  # an inline end tag ends nothing beyond its block
                node = at
                while node.tag != tag:
                    node = node.parent
                at = leave(node)
            continue
        if opened[("p", None)] and tag in BLOCKS and tag not in ("body", "html"):  # a block ends an open paragraph
            node = at
            while node is not root and node.tag not in SCOPES and node.tag not in ("td", "th", "li", "dd", "blockquote", "figure", "p"):
                node = node.parent
            if node.tag == "p":
                at = leave(node)
        ends = CLOSES.get(tag, ())
        if any(opened[(e, None if e in BLOCKS else id(at.block))] for e in ends):
            node = at
            while node is not root and node.tag not in ends and not (node.tag in SCOPES and not (node.tag == "div" and tag == "li")):
                node = node.parent
            if node.tag in ends:
                at = leave(node)
        names, hidden = _names(found.group(3)) if found.group(3).strip() else ((), False)
        node = Node(tag, names, at, hidden)
        at.children.append(node)
        if tag in RAW and not found.group(0).endswith("/>"):
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, here)
            if tag in ("svg", "math", "template", "noscript") and end is None:
                continue
            here = position = end.end() if end else len(page)
        elif tag not in VOID and not (found.group(0).endswith("/>") and tag not in BLOCKS and tag not in ("a", "b", "i", "em", "strong", "span")):
            at = node
            opened[key(node)] += 1
    if here < len(page):
        at.children.append(html.unescape(page[here:]))
    return root


def _suspect(node: Node) -> int:
    """Do its names say that it is not article text? 2: yes; 1: one with other words in it does ("share-price"); 0: no.

    "with-sidebar" is not a side bar, an "article-header" not one of the page.
    """
    if node.tag in ("html", "body", "main", "#root"):
        return 0
    hits, level, before = set(), 0, ""
    for token in node.tokens:
        found = set()
        for word in token:
            if word in UNLIKELY and before not in NEGATING:
                found.add(word)
            before = word
        if found and not (node.tag in HEADINGS and found <= TITLE_WORDS):
            hits |= found
            level = max(level, 2 if all(w in UNLIKELY or w in LAYOUT or w in LIKELY or w in NEGATING for w in token) else 1)
    return 0 if hits <= TITLE_WORDS and LIKELY & set(node.names) else level


def _suspects(root: Node, nodes: list[Node]) -> set[int]:
    """Elements that names speak against: alone, or with their form where the name has other words in it."""
    levels = {id(n): _suspect(n) for n in nodes if n.tokens}
    out = {k for k, level in levels.items() if level == 2}
    if 1 not in levels.values():
        return out
    text, links, _, nodes = _measure(root)
    controls: set[int] = set()
    for node in reversed(nodes):
        if node.controls or any(id(c) in controls for c in node.children if not isinstance(c, str)):
            controls.add(id(node))
        if levels.get(id(node)) == 1 and (id(node) in controls or 3 * links[id(node)] > text[id(node)]):
            out.add(id(node))
    return out


def _holders(nodes: list[Node]) -> set[int]:
    """Elements with an article or a main element in them."""
    out: set[int] = set()
    for node in nodes:
        up = node.parent if node.tag in ("article", "main") else None
        while up is not None and id(up) not in out:
            out.add(id(up))
            up = up.parent
    return out


def _prune(root: Node) -> None:
    """Cut off what is never article text by its tag, and what is hidden."""
    stack, forms = [(root, False)], []
    while stack:
        node, article = stack.pop()
        article = article or node.tag == "article"
        kept = []
        for child in node.children:
            if isinstance(child, str):
                kept.append(child)
                continue
            node.controls |= child.tag in CONTROLS
            if child.tag == "header" and not child.gone and article:
                child.children = [c for c in child.children if not isinstance(c, str) and c.tag in ("h1", "h2", "h3", "hgroup")]
            elif child.tag == "form" and not child.gone:
                forms.append(child)
            elif child.gone or child.tag in DROPPED or child.tag == "header":
                continue
            kept.append(child)
            stack.append((child, article))
        node.children = kept
    if forms:
        nodes, prose = _prose(root)
        holders = _holders(nodes)
        cut = {id(f) for f in forms if id(f) not in holders and (not prose[id(f)] or 2 * prose[id(f)] < prose[id(root)])}
        for parent in {id(f.parent): f.parent for f in forms}.values():
            parent.children = [c for c in parent.children if id(c) not in cut]


def _without(top: Node, cut) -> list[tuple[Node, list]]:
    """Take out elements below ``top``; the children before, to put them back."""
    held, stack = [], [top]
    while stack:
        node = stack.pop()
        kept = [c for c in node.children if isinstance(c, str) or not cut(c)]
        if len(kept) < len(node.children):
            held.append((node, node.children))
            node.children = kept
        stack.extend(c for c in kept if not isinstance(c, str))
    return held


def _below(nodes: list[Node], ids: set[int]) -> set[int]:
    """The elements inside one of ``ids``."""
    out: set[int] = set()
    for node in nodes:
        if id(node.parent) in ids or id(node.parent) in out:
            out.add(id(node))
    return out


def _order(root: Node) -> list[Node]:
    """All elements, parents before their children."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(c for c in node.children if not isinstance(c, str))
    return out


def _measure(root: Node) -> tuple[dict[int, int], dict[int, int], dict[int, int], list[Node]]:
    """Of each element: characters of text, those inside links, commas; and the elements."""
    nodes = _order(root)
    text, links, commas = {}, {}, {}
    for node in reversed(nodes):
        n = c = inside = 0
        for child in node.children:
            if isinstance(child, str):
                n += len(child.strip())
                c += sum(map(child.count, COMMAS))
            else:
                n, c, inside = n + text[id(child)], c + commas[id(child)], inside + links[id(child)]
        text[id(node)], commas[id(node)] = n, c
        links[id(node)] = n if node.tag == "a" else inside
    return text, links, commas, nodes


def _own(node: Node, text: dict[int, int], commas: dict[int, int]) -> tuple[int, int]:
    """Characters and commas of an element's own run of text: strings and inline children, no blocks."""
    n = c = 0
    for child in node.children:
        if isinstance(child, str):
            n, c = n + len(child.strip()), c + sum(map(child.count, COMMAS))
        elif child.tag not in BLOCKS:
            n, c = n + text[id(child)], c + commas[id(child)]
    return n, c


def _prose(root: Node) -> tuple[list[Node], dict[int, int]]:
    """All elements, and of each the characters in paragraphs, without those inside links."""
    text, links, commas, nodes = _measure(root)
    prose: dict[int, int] = {}
    for node in reversed(nodes):
        n = sum(prose[id(c)] for c in node.children if not isinstance(c, str))
        if node.tag in PARAGRAPHS:
            length, _ = _own(node, text, commas)
            n += max(0, length - sum(links[id(c)] for c in node.children if not isinstance(c, str) and c.tag not in BLOCKS)) if length >= 25 else 0
        prose[id(node)] = n
    return nodes, prose


def _sentences(top: Node) -> bool:
    """Is there a paragraph of prose in it, with the end of a sentence?"""
    for node in _order(top):
        if node.tag in ("p", "blockquote", "pre", "li", "dd") or node is top:
            own = "".join("".join(_strings(c)) for c in node.children if isinstance(c, str) or c.tag not in BLOCKS)
            if len(own.strip()) >= 40 and SENTENCE.search(own):
                return True
    return False


def _strings(item: Node | str) -> list[str]:
    out, stack = [], [item]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            out.append(item)
        else:
            stack.extend(reversed(item.children))
    return out


def best(root: Node, doubtful: dict[int, float] | None = None) -> list[Node]:
    """The kept elements in page order: the best container and its siblings that belong to it.

    ``doubtful`` elements, by id, get no points for their names, and what is in them counts by a factor.
    """
    text, links, commas, nodes = _measure(root)
    doubtful, low = doubtful or {}, {}
    for node in nodes:
        low[id(node)] = min(doubtful.get(id(node), 1), low.get(id(node.parent), 1))
    score: dict[int, float] = {}
    owner: dict[int, Node] = {}
    for node in nodes:
        if node.tag not in PARAGRAPHS:
            continue
        length, marks = _own(node, text, commas)
        if length < 25:
            continue
        points = (1 + marks + min(length / 100, 3)) * low[id(node)]
        up, level = (node if node.tag in ("div", "section", "article", "main", "body", "td") else node.parent), 0
        while up is not None and up.tag != "#root" and level < 4:
            if id(up) not in score:
                words = set(up.names)
                score[id(up)] = 0 if id(up) in doubtful else ((8 if up.tag in ("article", "main") else 0) + (5 if words & LIKELY else 0)) * low[id(up)]
                owner[id(up)] = up
            score[id(up)] += points / (1, 2, 3, 6)[level]
            up, level = up.parent, level + 1
    for key in score:
        score[key] *= 1 - links[key] / max(text[key], 1)
    if not score:
        whole = [n for n in nodes if n.tag in ("article", "main")] or [n for n in nodes if n.tag == "body"] or [root]
        return whole[:1]
    top = max(score, key=lambda k: score[k])
    chosen = owner[top]
    for up_tag in ("article", "main"):  # the best container may be one section of the article
        node = chosen
        while node is not None and node.tag != up_tag:
            node = node.parent
        if node is not None:
            chosen = node
            break
    parent = chosen.parent
    if parent is None or chosen.tag in ("body", "html") or parent.tag == "#root":
        return [chosen]
    if chosen.tag in ("article", "main"):  # a title may stand before it
        return [c for c in parent.children if c is chosen or (not isinstance(c, str) and c.tag == "h1")]
    least = max(10.0, 0.2 * score.get(id(chosen), 0))
    kept = []
    for child in parent.children:
        if isinstance(child, str) or (id(child) in doubtful and child is not chosen):
            continue
        bonus = 0.2 * score.get(id(chosen), 0) if child.names and child.names == chosen.names else 0
        length = text[id(child)]
        density = links[id(child)] / max(length, 1)
        prose = child.tag in ("p", "h1", "h2", "h3", "h4", "blockquote", "ul", "ol", "pre") and length > 0 and density < 0.25
        alike = child.tag == chosen.tag and child.names == chosen.names and density < 0.25
        if child is chosen or score.get(id(child), 0) + bonus >= least or prose or (alike and _sentences(child)):
            kept.append(child)
    return kept


def blocks(kept: list[Node]) -> list[str]:
    """Texts of the blocks in page order, white space as one space each."""
    out, buffer = [], []

    def close() -> None:
        if buffer:
            line = WHITE.sub(" ", "".join(buffer)).strip(" ")
            if line:
                out.append(line)
            buffer.clear()

    for top in kept:
        stack = [(top, True)]
        while stack:
            item, opening = stack.pop()
            if isinstance(item, str):
                buffer.append(item)
                continue
            if item.tag in BLOCKS:
                close()
            elif item.tag == "br":
                buffer.append(" ")
            if opening:
                stack.append((item, False))
                stack.extend((c, True) for c in reversed(item.children))
        close()
    return out


def _claimed(root: Node, nodes: list[Node], suspects: set[int], total: int) -> bool:
    """Is there an article by tag or name outside all suspects, with prose of its own?"""
    held = _without(root, lambda n: id(n) in suspects)
    left, prose = _prose(root)
    text = _measure(root)[0]
    for node, children in held:
        node.children = children
    for node in left:
        if node.tag in ("article", "main") and text[id(node)] >= max(1, total // 20):
            return True
        if node.tag not in ("html", "body", "#root") and LIKELY & set(node.names) and prose[id(node)] >= max(25, total // 20):
            return True
    return False


def extract(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    _prune(root)
    nodes, prose = _prose(root)
    suspects = _suspects(root, nodes)
    if not suspects:
        return "\n\n".join(blocks(best(root)))
    total, holders = prose[id(root)], _holders(nodes)
    claimed = _claimed(root, nodes, suspects, total)
    most = {k for k in suspects if not claimed and total and 2 * prose[k] >= total}
    named = {id(n) for n in nodes if n.tag == "article" or LIKELY & set(n.names)}
    spared = suspects & (most | named | holders)
    held = _without(root, lambda n: id(n) in suspects and id(n) not in spared)
    doubtful: dict[int, float] = {}  # beside an article in its own right, only one that is not in another suspect counts much
    inner = _below(nodes, suspects)
    for node in nodes:
        if id(node) in spared and id(node) not in most:
            own = node.tag == "article" and LIKELY & set(node.names) and id(node) not in inner
            doubtful[id(node)] = 0.5 if own or not claimed else 0.1
    kept = best(root, doubtful)
    inside = sum(prose[id(n)] for n in kept)
    for top in kept:  # within the article, names count again
        entry = lambda n: top.tag != "article" and n.tag == "article" and LIKELY & set(n.names)  # noqa: B023, E731
        held += _without(top, lambda n: id(n) in suspects and 2 * prose[id(n)] < max(inside, 1) and not entry(n))
    out = "\n\n".join(blocks(kept))
    if not claimed and 4 * len(out) < total:
        for node, children in reversed(held):
            node.children = children
        out = max(out, "\n\n".join(blocks(best(root))), key=len)
    return out


@F.arrow_udf(T.StringType())
def main_text(pages: pa.Array) -> pa.Array:
    return pa.array([extract(p) for p in pages.to_pylist()], pa.string())


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    out = pages.select("page_id", "url", main_text("html").alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
