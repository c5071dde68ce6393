"""Main text of web pages by tree scoring.

Each paragraph passes points for its length and its commas to the elements around it, fewer the
farther up; an element's points are discounted by the share of its text that stands in links. The
element with the most points is the article's container. It and those of its siblings that look
like part of the article, by their text and the share of links in it, are kept, also higher up where
an element of the same kind holds enough points. Names of classes and most tags are evidence against
an element, outweighed where it holds most of the page's points or, for words that also stand in
ordinary names, where little of its text is linked; navigation, hidden parts and the like never count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|"
    r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\Z))",
    re.S,
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
HIDDEN = re.compile(r"\shidden(?=[\s/>])|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
# Fixed values of HTML: elements whose content is no markup, that have none, that start a block.
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
#: An opening tag ends open elements of these kinds, up to the nearest of the second list.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that never belong to an article's text, by tag; those left out unless they hold most of the page.
NEVER = frozenset("nav footer button select dialog menu svg canvas audio video object template head".split())
LEFT_OUT = frozenset("aside form".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
WORDS = frozenset(
    "ad ads adsense nav navbar navigation menu menubar footer sidebar aside widget breadcrumb breadcrumbs cookie "
    "cookies consent gdpr notice notices banner popup modal newsletter "
    "subscribe subscription signup login promo promos promotion masthead pagination pager toolbar disqus replies "
    "respond skyscraper".split()
)
PARTS = re.compile(r"advert|sponsor")
#: Marks of readers' words and of notices: they may outweigh an article, so only a page's heading inside speaks for them.
COMMENTS = re.compile(r"comment(?!ar|at)")
STRICT = frozenset("ad ads adsense cookie cookies consent gdpr notice notices disqus replies respond".split())
#: Words that leave an element out if they stand alone in a class or id, else only with links in its text.
WEAK = frozenset("share sharing social related recommended".split())
#: Before one of the words these tell of the layout, not of the element.
LAYOUT = frozenset("has have no not with without hide".split())
#: Share of a page's points that is most of it, share outside a left-out element that is next to nothing.
MOST, LITTLE = 0.5, 0.1
#: Share of linked characters from which text is a list of links, and of the best one's points that part of the article has.
LINKED, ENOUGH = 0.25, 0.2
GOOD = frozenset("article content entry post story".split())
KEEP = frozenset("html body main article".split())
#: Blocks of these elements pass their points to the element around them; other blocks' own element gets them.
PARAGRAPHS = frozenset("p pre td blockquote dd figcaption address".split())
#: Rows and lists are passed over: they are no containers of an article.
ROWS = frozenset("table tbody thead tfoot tr ul ol menu dir dl".split())
UNSCORED = HEADINGS | frozenset("li dt th caption legend summary".split())
#: Parts of an article: beside its container they stay whatever their length, if few of their characters are links.
PIECES = frozenset("p pre blockquote address figure ul ol dl dir table details".split())


class Element:
    """An element of the page: what it is, what is around it, its points and characters, and the points of all blocks inside.

    ``mark`` says what speaks against it: "never", "strict", "soft" or "weak"; ``out`` is the verdict on it.
    """

    __slots__ = ("chars", "good", "headed", "inside", "kept", "linked", "mark", "out", "parent", "points", "tag")

    def __init__(self, tag: str, parent: Element | None, mark: str, good: bool) -> None:
        self.tag, self.parent, self.mark, self.good = tag, parent, mark, good
        self.points, self.inside, self.chars, self.linked = 0.0, 0.0, 0, 0
        self.out = mark == "never" or parent is not None and parent.out
        self.kept, self.headed = False, tag in ("h1", "article", "main")

    def density(self) -> float:
        return self.linked / max(self.chars, 1)

    def score(self) -> float:
        named = self.tag in ("article", "main")
        return (self.points * (2.0 if named else 1.0) + 25.0 * named + 15.0 * self.good) * (1.0 - self.density())


def named_mark(names: list[str], parent: Element | None) -> str:
    """What the words of one class or id say against an element."""
    found = ""
    for before, name in zip(["", *names], names):
        if before in LAYOUT:
            continue
        if COMMENTS.match(name) or name in STRICT or PARTS.search(name):
            return "strict"
        if name in WORDS or name == "header" and not within(parent, "article"):
            found = "soft"
        elif name in WEAK and not found:
            found = "soft" if len(names) == 1 else "weak"
    return found


def open_element(tag: str, rest: str, parent: Element | None) -> Element:
    marks = set()
    good = False
    if tag not in KEEP:
        if tag in NEVER:
            marks.add("never")
        elif tag in LEFT_OUT or (tag == "header" and not within(parent, "article")):
            marks.add("soft")
    if "=" in rest or "hidden" in rest:
        given = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(rest)}
        values = [[w.lower() for w in NAME.findall(v)] for v in [*given.get("class", "").split(), given.get("id", "")]]
        good = any(w in GOOD for names in values for w in names)
        if tag not in KEEP:
            marks.update(named_mark(names, parent) for names in values)
            if given.get("role", "").lower() in ROLES or HIDDEN.search(rest):
                marks.add("never")
    mark = next((m for m in ("never", "strict", "soft", "weak") if m in marks), "")
    return Element(tag, parent, "never" if mark and mark != "weak" and tag not in BLOCK else mark, good)


def within(element: Element | None, tag: str) -> bool:
    while element is not None:
        if element.tag == tag:
            return True
        element = element.parent
    return False


def read_page(html: str) -> tuple[list[Element], list[tuple[Element, str, int]]]:
    """Elements of the page in order, and its blocks of text with the element each stands in and its linked characters."""
    root = Element("", None, "", False)
    elements, blocks = [root], []
    stack = [root]
    text: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        value = " ".join(unescape("".join(text)).split()) if text else ""
        if value:
            holder = next(e for e in reversed(stack) if e.tag in BLOCK or e is root)
            blocks.append((holder, value, min(linked, len(value))))
        text.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece and not stack[-1].out:
            text.append(piece)
            if links:
                linked += len(piece)

    def close(upto: int) -> None:
        nonlocal links
        if any(e.tag in BLOCK for e in stack[upto:]):
            flush()
        links -= sum(e.tag == "a" for e in stack[upto:])
        del stack[upto:]

    at, size = 0, len(html)
    while at < size:
        m = MARKUP.search(html, at)
        if m is None:
            add(html[at:])
            break
        add(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
                if stack[k].tag in BLOCK and tag not in BLOCK:
                    break
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at) if tag != "plaintext" else None
            at = end.end() if end else size
            continue
        if tag == "br" or tag == "wbr":
            add(" " if tag == "br" else "")
            continue
        if tag in BLOCK:
            flush()
            if tag in ENDS:
                same, border = ENDS[tag]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in border:
                        break
                    if stack[k].tag in same:
                        close(k)
                        if tag != "tr":
                            break
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag in BLOCK:
                    break
        if tag in VOID or m[3].endswith("/>") and tag not in BLOCK:
            continue
        element = open_element(tag, m[3], stack[-1])
        elements.append(element)
        stack.append(element)
        links += tag == "a"
    flush()
    return elements, blocks


def block_points(text: str) -> float:
    """One point for a paragraph, one per comma, one per 100 characters up to three."""
    return 1.0 + sum(map(text.count, ",،、，")) + min(len(text) / 100.0, 3.0)


def gather(elements: list[Element], blocks: list[tuple[Element, str, int]]) -> None:
    """Points, characters and linked characters of all blocks inside each element; links bring no points."""
    for e in elements:
        e.inside, e.chars, e.linked = 0.0, 0, 0
    for holder, text, linked in blocks:
        holder.inside += block_points(text) * (1.0 - linked / len(text))
        holder.chars += len(text)
        holder.linked += linked
    for e in reversed(elements[1:]):  # elements stand after those around them
        e.parent.inside += e.inside
        e.parent.chars += e.chars
        e.parent.linked += e.linked
        e.parent.headed |= e.headed and e.mark != "never"


def judge(elements: list[Element], blocks: list[tuple[Element, str, int]]) -> None:
    """Leave out the elements that something speaks against, unless they hold the article.

    An element with most of the page's points holds it if a heading or article stands inside, or if next
    to nothing stands outside of all such elements; notices and comments need the heading.
    """
    gather(elements, blocks)
    total = elements[0].inside
    marked = {id(elements[0]): False}
    for e in elements[1:]:
        marked[id(e)] = marked[id(e.parent)] or e.mark not in ("", "weak")
    free = sum(block_points(text) * (1.0 - linked / len(text)) for e, text, linked in blocks if not marked[id(e)])
    for e in elements[1:]:
        e.out = e.out or e.parent.out
        if e.out or not e.mark:
            continue
        if e.mark == "weak":
            e.out = e.density() >= LINKED
            continue
        alone = free < LITTLE * total and e.mark == "soft"
        e.out = not (total and e.inside >= MOST * total and (e.headed or alone))


def pass_points(elements: list[Element], blocks: list[tuple[Element, str, int]]) -> None:
    """The points of each block, shared out upwards."""
    for holder, text, _ in blocks:
        if holder.tag in UNSCORED:
            continue
        points = block_points(text)
        at = holder.parent if holder.tag in PARAGRAPHS else holder
        level = 0
        while at is not None and at.tag not in ("html", ""):
            if at.tag not in ROWS:
                at.points += points / (1.0 if level == 0 else 2.0 if level == 1 else 3.0 * level)
                level += 1
            at = at.parent


def keep_around(best: Element, children: dict[int, list[Element]]) -> None:
    """Keep the container, its siblings that look like the article, and those higher up beside enough of its kind."""
    best.kept = True
    at, first = best, True
    while at.parent is not None and at.parent.tag != "":
        beside = [e for e in children[id(at.parent)] if e is not at and not e.out and e.density() < LINKED]
        enough = [e for e in beside if e.inside >= ENOUGH * best.inside]
        if first or any(e.tag == at.tag for e in enough):
            for e in beside:
                if e.tag in HEADINGS:
                    e.kept = e.linked == 0
                elif at.tag in ("article", "main"):
                    e.kept = e.tag in PIECES or e.tag == at.tag and e in enough
                else:
                    e.kept = e.tag in PIECES or e in enough or first and e.chars > 80
        if at.tag in ("article", "main"):
            break
        at, first = at.parent, False


def main_text(html: str) -> str:
    """Text blocks of the article, joined by line feeds; empty if the page has none."""
    elements, blocks = read_page(html)
    judge(elements, blocks)
    blocks = [b for b in blocks if not b[0].out]
    gather(elements, blocks)
    pass_points(elements, blocks)
    scored = [e for e in elements if e.points > 0]
    if scored:
        children: dict[int, list[Element]] = {}
        for e in elements[1:]:
            children.setdefault(id(e.parent), []).append(e)
        keep_around(max(scored, key=Element.score), children)
    else:
        next((e for e in elements if e.tag in ("article", "main")), elements[0]).kept = True
    for e in elements[1:]:
        e.kept = e.kept or e.parent.kept
    return "\n".join(text for holder, text, _ in blocks if holder.kept)


def extract_text(html: Column) -> Column:
    """Main text of each whole page; a null or empty page, or one of markup alone, gives empty text.

    Character references are decoded, white space inside a block becomes one space, blocks stand in
    page order. Each row is read by itself, in time that grows with its length; markup that is cut
    off or badly nested is closed where a browser would close it, as far as text is concerned.
    """

    @F.arrow_udf("string")
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([main_text(page.as_py() or "") for page in batch], pa.string())

    return extract(html.cast("string"))
