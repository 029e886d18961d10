"""Main text of web pages by tree scoring.

The whole page is read into a tree by a tolerant scanner in time linear in its length: quoted attributes may hold `>`, raw elements (script, style, ...) end only at
their own end tag, paragraphs and list items end where HTML ends them, and stray end tags are ignored. Elements that hold no article
text by their tag, role or class are left out. Each paragraph passes points (one, its commas, and one for each 100 characters, three
at most) to its parent in full, to the next ancestor by half and to the further ones by less; a container's points, with a bonus by tag, are
discounted by its link density. The best container, or the nearest article or main element around it, is kept whole, with those of its siblings that have a fifth of its points or are
long paragraphs with few links. Without any paragraph, the text of the whole page outside the left-out elements is kept.

Character references are decoded, white space inside a block is one space, and blocks are joined by one space.

Defined cases: null and empty pages give an empty text; pages without markup are one block. Rows are independent: ties, repeated
rows and null ids need nothing. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table

NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
SPECIAL = re.compile(r"['\">]")
LONG_NUMBER = re.compile(r"&#[0-9]{4000,};?")
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes svg math object canvas".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
LEFT_OUT = frozenset("nav footer aside form button select option fieldset menu dialog head input label".split())
LEFT_OUT_ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog menu menubar toolbar form".split())
LEFT_OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager sidebar aside rail widget widgets toolbar "
    "footer foot masthead comment comments commentlist disqus respond replies reply share sharing social related recommended recommendations teaser skip hidden".split()
)
PARAGRAPHS = frozenset("p pre td blockquote li dd".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BONUS = {"article": 25.0, "main": 20.0, "section": 3.0, "div": 2.0, "td": 1.0, "body": -5.0, "html": -10.0}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table article section div main body html td th aside nav blockquote".split())


class Node:
    __slots__ = ("tag", "parent", "children", "out", "points", "chars", "linked", "commas", "head", "paragraph")

    def __init__(self, tag: str, parent: "Node | None", out: bool = False, head: bool = False):
        self.tag, self.parent, self.children, self.out, self.head = tag, parent, [], out, head
        self.points, self.chars, self.linked, self.commas, self.paragraph = 0.0, 0, 0, 0, False


class Scanner:
    """Where tags end. Each part of the page is looked at a fixed number of times, however many tags never end."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.hopeless: set[int] = set()  # places outside quotes from which no tag end is reached
        self.seen = (0, -1)  # from where to where no quote and no > is
        self.gone: set[str] = set()  # quotes that don't occur any more

    def _special(self, at: int) -> int:
        if not self.seen[0] <= at <= self.seen[1]:
            m = SPECIAL.search(self.page, at)
            self.seen = (at, m.start() if m else len(self.page))
        return self.seen[1]

    def end(self, at: int) -> int:
        """The place of the > that ends the tag whose attributes begin at a place; -1 if there is none."""
        if at > self.last:
            return -1
        passed, i = [], at
        while True:
            i = self._special(i)
            if i >= len(self.page):
                break
            quote = self.page[i]
            if quote == ">":
                return i
            close = -1 if quote in self.gone else self.page.find(quote, i + 1)
            if close < 0:
                self.gone.add(quote)
                break
            i = close + 1
            if i in self.hopeless:
                break
            passed.append(i)
        self.hopeless.update(passed)
        return self.page.find(">", at)  # quotes that aren't closed don't count


def _words(value: str) -> set[str]:
    return set(re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()))


def _left_out(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element holds no article text, and whether it is a header."""
    if tag in LEFT_OUT:
        return True, False
    head = tag == "header"
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return False, head
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")):
        return True, head
    if found.get("role", "").lower() in LEFT_OUT_ROLES:
        return True, head
    if tag in ("html", "body", "main", "article"):
        return bool(_words(found.get("class", "")) & {"comment", "comments", "ad", "advert"}), head
    names = _words(found.get("class", "")) | _words(found.get("id", ""))
    return bool(names & LEFT_OUT_WORDS), head or "header" in names


class Tree:
    """A page's elements; the open ones are on a stack, and for each tag and scope it is known which of them is the last."""

    def __init__(self):
        self.root = Node("#root", None)
        self.open, self.by_tag, self.scopes, self.outer = [self.root], {}, [0], [0]

    @property
    def at(self) -> Node:
        return self.open[-1]

    def last(self, tag: str) -> int:
        places = self.by_tag.get(tag)
        return places[-1] if places else -1

    def close_from(self, place: int) -> None:
        """Closes the element at a place of the stack and all in it."""
        while len(self.open) > place:
            self.by_tag[self.open.pop().tag].pop()
            for scopes in (self.scopes, self.outer):
                if scopes[-1] == len(self.open):
                    scopes.pop()

    def add(self, node: Node, stays_open: bool) -> None:
        self.at.children.append(node)
        if stays_open:
            place = len(self.open)
            self.by_tag.setdefault(node.tag, []).append(place)
            if node.tag in SCOPE:
                self.scopes.append(place)
                if node.tag not in ("td", "th"):
                    self.outer.append(place)
            self.open.append(node)


def parse(page: str) -> Node:
    tree, scan = Tree(), Scanner(page)
    pos, n = 0, len(page)
    while pos < n:
        start = page.find("<", pos)
        if start < 0:
            tree.at.children.append(page[pos:])
            break
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            after = n if end < 0 else end + 3
            tag = ""
        elif page.startswith(("<!", "<?"), start):
            end = page.find(">", start) if start < scan.last else -1
            after = n if end < 0 else end + 1
            tag = ""
        else:
            m = NAME.match(page, start + 1)
            end = scan.end(m.end()) if m else -1
            if end < 0:  # no tag
                after = start + 1
                tree.at.children.append(page[pos:after])
                pos = after
                continue
            after, tag, attributes = end + 1, m[0].lower(), page[m.end() : end]
        if start > pos:
            tree.at.children.append(page[pos:start])
        pos = after
        if not tag:
            continue
        if tag.startswith("/"):
            tag = tag[1:]
            place = tree.last(tag)
            if place > 0 and not ((tag in INLINE or tag in ("li", "p")) and place < tree.scopes[-1]):
                tree.close_from(place)
            elif tag in ("p", "br"):
                tree.add(Node("br", tree.at, tree.at.out), False)
            continue
        if tag in RAW:
            if not (attributes.rstrip().endswith("/") and tag in ("svg", "math")):
                m = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, pos)
                end = page.find(">", m.end()) if m else -1
                pos = n if end < 0 else end + 1
            continue
        if tag not in INLINE and tag != "br":  # blocks end open paragraphs
            place = tree.last("p")
            if place > tree.scopes[-1]:
                tree.close_from(place)
        if tag in CLOSED_BY:
            places = [x for x in map(tree.last, CLOSED_BY[tag]) if x > tree.outer[-1]]
            if places:
                tree.close_from(min(places))
        out, head = _left_out(tag, attributes)
        node = Node(tag, tree.at, out or tree.at.out, head)
        tree.add(node, tag not in VOID and not (attributes.endswith("/") and tag in INLINE))
    return tree.root


def blocks(node: Node) -> list[str]:
    """The text of a node in blocks, without what is left out."""
    out, run, stack = [], [], [iter(node.children)]
    block = [True]

    def flush():
        if run:
            text = " ".join(entities.unescape(LONG_NUMBER.sub("\ufffd", "".join(run))).split())
            if text:
                out.append(text)
            run.clear()

    while stack:
        for c in stack[-1]:
            if isinstance(c, str):
                run.append(c)
            elif not c.out:
                is_block = c.tag not in INLINE
                if is_block:
                    flush()
                block.append(is_block)
                stack.append(iter(c.children))
                break
        else:
            stack.pop()
            if block.pop():
                flush()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack += [c for c in x.children if not isinstance(c, str)]
    headed = set()  # elements with a heading in them
    for x in reversed(order):  # children before parents
        if x.tag in HEADINGS or x in headed:
            headed.update((x, x.parent))
    inside = set()  # elements in an article
    for x in order:
        if x.parent in inside or x.tag in ("article", "main"):
            inside.add(x)
        if x.parent is not None and x.parent.out or x.head and not (x.parent in inside and x in headed):
            x.out = True
    scored = set()
    for x in reversed(order):
        if x.out:
            continue
        texts = [c for c in x.children if isinstance(c, str)]
        inner = [c for c in x.children if not isinstance(c, str) and not c.out]
        x.chars = sum(len(c.strip()) for c in texts) + sum(c.chars for c in inner)
        x.commas = sum(c.count(",") + c.count("，") for c in texts) + sum(c.commas for c in inner)
        x.linked = x.chars if x.tag == "a" else sum(c.linked for c in inner)
        has_block = any(c.tag not in INLINE and c.tag != "br" for c in inner)
        x.paragraph = x.tag in PARAGRAPHS and not (x.tag in ("td", "li", "blockquote") and has_block) or x.tag in ("div", "section", "article", "main") and not has_block and x.chars > 0
        if x.paragraph and x.chars and x.linked < x.chars:
            points, up, share = 1 + x.commas + min(3.0, x.chars / 100), x.parent, 1.0
            if x.tag not in PARAGRAPHS:
                up = x
            for level in range(5):
                if up is None:
                    break
                up.points += points * share
                scored.add(up)
                share = 0.5 if level == 0 else 0.5 / (level + 2)
                up = up.parent
    best, most = None, 0.0
    for x in order:
        if x in scored and not x.out:
            x.points = (x.points + BONUS.get(x.tag, 0.0)) * (1 - x.linked / max(1, x.chars))
            if best is None or x.points > most:
                best, most = x, x.points
    if best is None:
        return " ".join(blocks(root))
    x = best
    while x is not None and x.tag not in ("article", "main"):
        x = x.parent
    best = best if x is None else x
    if best.parent is None:
        return " ".join(blocks(best))
    kept = []
    for c in best.parent.children:
        if isinstance(c, str) or c.out:
            continue
        if c is best:
            kept += blocks(c)
        elif c in scored and c.points >= max(10.0, most / 5) and c.tag != "header" or c.tag == "p" and c.chars > 80 and c.linked * 4 < c.chars and best.tag not in ("article", "main"):
            kept += blocks(c)
    return " ".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) to (page_id, url, text, n_chars)."""

    def run(batches):
        for b in batches:
            texts = [main_text(x) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
