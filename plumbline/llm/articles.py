"""Main text of HTML pages by tree scoring.

A page is parsed into a tree, in one pass and whatever its faults: unclosed paragraphs and items end where the next one
begins, stray end tags are skipped, a cut page ends all that is open. A run of inline text between two block boundaries is a
block. Subtrees that can hold no article go first: scripts, styles, forms, menus, footers, asides, hidden elements, and
elements whose class, id or role names them as notices, adverts, sidebars or reader comments (unless such a name stands on
a wrapper that holds the page's only article).

Every remaining block then passes points to its ancestors: one from 25 characters on, one per comma, one per 100 characters
up to three, all discounted by the share of its text that is linked. The parent gets them whole, the grandparent half, each
further one a third of that by its distance. The container with the most points, discounted by its own link density, is the
best one. An ``article`` or ``main`` element around it counts as the container; otherwise its siblings are kept with it where
they score a fifth of it, are headings, or are plain paragraphs.

Kept blocks have character references decoded, white space (a line break element is some) turned into single spaces, and are
trimmed; they are joined by line feeds in page order.

Defined cases: a null or empty page, and one without text, gives an empty text; of containers with equal points the first in
the page is best; repeated rows give repeated results; an empty table gives an empty result; extra columns stay, those
called like the result are replaced. A page is handled by one task, in time and memory in proportion to its length.
"""

from __future__ import annotations

import re
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from plumbline.llm.shared import annotated

RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

# Element names, fixed by the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = HEADINGS | frozenset("p pre li dt dd td th blockquote figcaption caption address".split())
DEPTH = 512  # elements nested deeper count as their ancestor at this depth, as in browsers
#: An element that begins ends these, if they are open inside the nearest of the boundaries.
ENDS = {
    **dict.fromkeys(BLOCKS - {"option", "optgroup", "body", "head", "html"}, (frozenset(["p"]), frozenset("table td th caption button object".split()))),
    "li": (frozenset(["li", "p"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset("dt dd p".split()), frozenset(["dl"])), "dd": (frozenset("dt dd p".split()), frozenset(["dl"])),
    "tr": (frozenset("tr td th p".split()), frozenset(["table"])),
    "td": (frozenset("td th p".split()), frozenset(["tr", "table"])), "th": (frozenset("td th p".split()), frozenset(["tr", "table"])),
    **dict.fromkeys(("tbody", "thead", "tfoot"), (frozenset("tbody thead tfoot tr td th p".split()), frozenset(["table"]))),
    "option": (frozenset(["option"]), frozenset(["select"])), "body": (frozenset(["head"]), frozenset()),
}

# Never part of an article.
GONE = frozenset(
    "head script style noscript template iframe object embed canvas svg math nav aside footer form button select textarea input label menu dialog map audio video "
    "title noembed noframes xmp".split()
)
GONE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar tooltip status".split())
# Words in a class or id that name what stands beside an article.
BESIDE = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promos promoted promotion banner banners cookie cookies consent gdpr notice "
    "notices notification popup modal overlay lightbox sidebar sidebars rail nav navigation navbar menu menus submenu breadcrumb breadcrumbs footer footnav masthead topbar toolbar "
    "share sharing social related recommended recommendations recommendation newsletter subscribe subscription subscriptions signup login paywall search searchbox pagination pager widget widgets "
    "tagcloud skip alert alerts legal copyright outbrain taboola teaser teasers trending popular".split()
)
READERS = frozenset("comment comments commentary commentlist disqus disqusthread respond reply replies discussion discussions reactions".split())
# Words before "header" that make it the article's own.
CONTENT = frozenset("article content entry hentry post story".split())
# Words that say of a wrapper what it has, not what it is.
SAYS = frozenset("with without has have no is not".split())

_TOKENS = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>\x00]*)([^>\"']*+(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*+)*+)>|<(/?)([A-Za-z][^\s/>\x00]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|style|aria-hidden|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(?=[\s/]|$))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_COMMAS = re.compile("[,，、،﹐]")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "parent", "order", "names", "gone", "points", "chars", "linked", "holds", "readers")

    def __init__(self, tag, parent, order):
        self.tag, self.parent, self.order = tag, parent, order
        self.names, self.gone, self.points, self.chars, self.linked, self.holds, self.readers = False, False, 0.0, 0, 0, False, False


def _named(value: str) -> tuple[bool, bool]:
    """Whether one class or id names something beside an article, and whether that is what readers wrote."""
    words = [w.lower() for w in _WORD.findall(value)]
    for i, w in enumerate(words):
        if w in READERS or w in BESIDE or w == "header":
            if i and w == "header" and words[0] in CONTENT:
                continue
            if i and (words[i - 1] in SAYS or words[0] in SAYS):
                return False, False
            return True, w in READERS
    return False, False


def _described(node: Node, attributes: str) -> None:
    """What an element's attributes say of it; ``names`` means that a wrapper of the article may still be called so."""
    found = {}
    for m in _ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(found.get("style", "")):
        node.gone = True
    if found.get("role", "").lower() in GONE_ROLES:
        node.gone = True
    if found.get("itemprop", "").lower() == "articlebody" or found.get("role", "").lower() in ("main", "article"):
        node.holds = True
    if node.tag in ("html", "body"):
        return
    for value in f"{found.get('class', '')} {found.get('id', '')}".split():
        beside, readers = _named(value)
        node.names |= beside
        node.readers |= readers


def parsed(page: str) -> tuple[list[Node], list[tuple[Node, str, int]]]:
    """The elements of a page in order, and its blocks: the element around each, its text, and how many characters are linked."""
    root = Node("#root", None, 0)
    nodes, stack, blocks = [root], [root], []
    run, linked, links, at = [], 0, 0, 0
    around = root  # the innermost block element

    def close():
        nonlocal run, linked
        if run:
            text = " ".join(unescape("".join(run)).split())
            if text:
                blocks.append((around, text, min(linked, len(text))))
            run = []
        linked = 0

    def pop(upto):
        """Ends the elements from place ``upto`` of the stack on."""
        nonlocal links, around
        for e in stack[upto:]:
            if e.tag in BLOCKS or e.tag in GONE:
                close()
            elif e.tag == "a":
                links -= 1
        del stack[upto:]
        for around in reversed(stack):
            if around.tag in BLOCKS or around.tag in GONE:
                break

    def add(piece):
        nonlocal linked
        run.append(piece)
        if links:
            linked += len(piece)

    while m := _TOKENS.search(page, at):
        name = m[2] or m[5]
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if not name:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        name = name.lower()
        if m[1] or m[4]:
            place = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == name), 0)
            if place:
                # an inline end tag does not end the blocks around it
                if name in BLOCKS or name in GONE or not any(e.tag in BLOCKS for e in stack[place:]):
                    pop(place)
            elif name == "p":
                close()
            continue
        if name in ENDS and len(stack) > 1:
            ended, bounds = ENDS[name]
            place = len(stack)
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in bounds or stack[i].tag not in ended and stack[i].tag in BLOCKS and name not in ("td", "th", "tr", "li", "dt", "dd", "tbody", "thead", "tfoot", "body"):
                    break
                if stack[i].tag in ended:
                    place = i
            if place < len(stack):
                pop(place)
        if name == "a" and links:
            place = next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == "a")
            if not any(e.tag in BLOCKS for e in stack[place:]):
                pop(place)
        if name == "br":
            add(" ")
        if name in VOID:
            if name == "hr":
                close()
            continue
        node = Node(name, stack[-1], len(nodes))
        attributes = m[3] if m[3] is not None else m[6] or ""
        if attributes:
            _described(node, attributes)
        node.gone |= name in GONE
        if name in BLOCKS or name in GONE:
            close()
        if name in ("svg", "math") and attributes.rstrip().endswith("/"):
            continue
        nodes.append(node)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)|\Z", re.I).search(page, at)
            at = end.end()
            continue
        if len(stack) >= DEPTH:
            continue
        stack.append(node)
        if name in BLOCKS or name in GONE:
            around = node
        links += name == "a"
    if at < len(page):
        add(page[at:])
    close()
    return nodes, blocks


def _removed(nodes: list[Node]) -> None:
    """Marks all elements inside of one that can hold no article."""
    wraps = {"main", "article"}
    holds = [False] * len(nodes)  # an article, a main element or a first heading stands inside, and no reader wrote it
    titled = [False] * len(nodes)
    for n in reversed(nodes[1:]):
        if (n.tag in wraps or n.holds) and not n.names and not n.readers:
            holds[n.order] = True
        titled[n.order] |= n.tag == "h1"
        if n.parent is not None and not n.gone and not n.readers:
            holds[n.parent.order] |= holds[n.order]
            titled[n.parent.order] |= titled[n.order]
    for n in nodes[1:]:
        if n.names and not (holds[n.order] and not n.readers and n.tag not in ("header",)):
            n.gone = True
        if n.tag == "header":
            inside = n.parent
            while inside is not None and inside.tag not in wraps:
                inside = inside.parent
            n.gone |= inside is None or not titled[n.order]
        n.gone |= n.parent.gone


def main_text(page: str | None) -> str:
    """The blocks of a page's article, one per line."""
    if not page:
        return ""
    nodes, blocks = parsed(page)
    _removed(nodes)
    blocks = [(n, text, linked) for n, text, linked in blocks if not n.gone]
    if not blocks:
        return ""
    for node, text, linked in blocks:
        size, up = len(text), node
        points = (1.0 if size >= 25 else 0.0) + len(_COMMAS.findall(text)) + min(size / 100, 3.0)
        points *= 1 - linked / size
        # a block's own element is its paragraph, unless the text stands directly in a container
        level = 0
        if node.tag in PARAGRAPHS:
            up = node.parent
            node.chars += size
            node.linked += linked
        while up is not None:
            up.chars += size
            up.linked += linked
            up.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            up, level = up.parent, level + 1
    scores = [n.points * (1 - n.linked / n.chars) if n.chars and not n.gone else 0.0 for n in nodes]
    best = nodes[max(range(len(nodes)), key=lambda i: (scores[i], -i))]
    around = best
    whole = None
    while around is not None and whole is None:
        if around.tag == "article" or around.tag == "main" or around.holds:
            whole = around
        around = around.parent
    if whole is not None:
        # an article inside main is the closer one, and the title may stand before it there
        kept = {whole.order} | {n.order for n in nodes[: whole.order] if n.tag == "h1" and n.parent is whole.parent and n.parent.tag == "main" and not n.gone}
    else:
        kept = {best.order} | _siblings(best, nodes, scores)
    inside = [False] * len(nodes)
    for n in nodes:
        inside[n.order] = n.order in kept or n.parent is not None and inside[n.parent.order]
    return "\n".join(text for n, text, _ in blocks if inside[n.order])


def _siblings(best: Node, nodes: list[Node], scores: list[float]) -> set[int]:
    """The elements beside the best container that belong to the same article."""
    out = set()
    for n in nodes[1:]:
        if n.parent is not best.parent or n is best or n.gone or not n.chars:
            continue
        density = n.linked / n.chars
        plain = n.tag == "p" and density < 0.25
        if n.tag in HEADINGS and density < 0.5 or plain or n.tag != "article" and scores[n.order] >= max(1.0, 0.2 * scores[best.order]) and density < 0.5:
            out.add(n.order)
    return out


def _extractor():
    def extract(pages):
        out = []
        for page in pages:
            text = main_text(page.decode("utf-8", "replace") if page else "")
            out.append((text, len(text)))
        return out

    return extract


def extracted(pages: DataFrame, html: str = "html", into: str = "article") -> DataFrame:
    """``pages`` with ``into.text``, the main text, and ``into.n_chars``, its code points."""
    return annotated(pages, html, into, RESULT, _extractor)
