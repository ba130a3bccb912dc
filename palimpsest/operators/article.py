"""The article of an HTML page: a tree of blocks scored by their text and by how much of it is links."""

from __future__ import annotations

import html.parser

from pyspark.sql import Column

from palimpsest.functions.arrow import of_texts

BLOCKS = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td th tr ul".split())
NEVER = frozenset(("script", "style", "noscript", "template", "svg", "nav", "footer", "aside", "form", "button", "select", "head"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: What a block's text is worth: characters outside links, less a fixed cost that short labels do not reach.
COST, LINKED, SHARE, LEAST = 25, 0.5, 0.75, 25


class Block:
    """A block element: runs of its own text and its child blocks in order; linked counts the characters in links."""

    __slots__ = ("tag", "items", "linked", "size", "value")

    def __init__(self, tag: str) -> None:
        self.tag, self.items, self.linked, self.size, self.value = tag, [], 0, 0, 0.0

    def text(self) -> str:
        return " ".join("".join(x for x in self.items if isinstance(x, str)).split())

    def blocks(self) -> list[Block]:
        return [x for x in self.items if isinstance(x, Block)]


class _Tree(html.parser.HTMLParser):
    """Blocks of a page. Elements left open end with the block around them; what stands in NEVER is left out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Block("html")
        self.open: list[tuple[str, Block]] = [("html", self.root)]  # every open element and the block that it is in
        self.hidden: list[str] = []
        self.links = 0
        self.title: list[str] = []
        self.in_title = False

    def handle_starttag(self, tag, attrs):
        if tag == "title":
            self.in_title = True
        elif tag == "body":
            self.hidden = []
        elif tag in NEVER or self.hidden:
            if tag not in VOID:
                self.hidden.append(tag)
        elif tag == "br":
            self.open[-1][1].items.append("\n")
        elif tag == "a":
            self.links += 1
        elif tag in BLOCKS and tag not in VOID:
            if self.open[-1][0] == tag and tag in ("p", "li", "dt", "dd", "tr", "td", "th"):
                self.handle_endtag(tag)
            block = Block(tag)
            self.open[-1][1].items.append(block)
            self.open.append((tag, block))

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        elif self.hidden:
            if tag in self.hidden:
                while self.hidden.pop() != tag:
                    pass
        elif tag == "a":
            self.links = max(0, self.links - 1)
        elif tag in BLOCKS and any(t == tag for t, _ in self.open[1:]):
            while self.open.pop()[0] != tag:
                pass
            self.links = 0

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.hidden:
            block = self.open[-1][1]
            block.items.append(data)
            n = len("".join(data.split()))
            block.size += n
            block.linked += n if self.links else 0


def _in_order(root: Block) -> list[Block]:
    """Blocks from the root down; no recursion, as pages may be nested deeply."""
    out, at = [root], 0
    while at < len(out):
        out += out[at].blocks()
        at += 1
    return out


def _worth(block: Block) -> float:
    """Value of a block's own text."""
    if not block.size or block.linked > LINKED * block.size:
        return 0.0
    return max(0.0, block.size - block.linked - COST)


def article(page: str) -> tuple[str, str]:
    """(title, text) of a page; the text is empty where no block is worth anything.

    A block is worth its characters outside links, less a cost, or nothing if it is mostly links; a block holds what is in it. The
    article is reached from the root by going on into a child as long as one holds SHARE of all that its parent holds. Of it
    the blocks that are worth something are kept, and headings before one that is, a line each.
    """
    tree = _Tree()
    tree.feed(page)
    tree.close()
    every = _in_order(tree.root)
    for b in reversed(every):
        b.value = _worth(b) + sum(x.value for x in b.blocks())
    top = tree.root
    while (best := max(top.blocks(), key=lambda b: b.value, default=None)) is not None and best.value >= SHARE * top.value > 0:
        top = best
    lines, heading, stack = [], None, [top]
    while stack:
        b = stack.pop()
        if isinstance(b, str):
            continue
        text = b.text()
        if b.tag in HEADINGS and text and b.linked <= LINKED * b.size:
            heading = text
        elif text and (_worth(b) > 0 or (b.size and b.linked <= LINKED * b.size and b.tag in ("p", "pre", "blockquote", "li", "td", "dd"))):
            lines += [heading, text] if heading else [text]
            heading = None
        stack += reversed(b.blocks())
    found = "\n".join(lines)
    return " ".join("".join(tree.title).split()), found if top.value >= LEAST else ""


def _article_text(page: str) -> str:
    title, text = article(page)
    return f"{title}\n\n{text}" if title and text else text


_texts = of_texts(_article_text)


def article_text(pages: Column) -> Column:
    """The article, its title before it; empty where none is found."""
    return _texts(pages)
