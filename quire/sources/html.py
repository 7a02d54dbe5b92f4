"""Chapters' HTML to blocks of words.

A tree is never built: start and end tags are taken as they come, with the ends that authors leave out put in,
and blocks, styles and sizes follow from the stack of open elements.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

from quire import config as C
from quire.functions.width import text_width

SKIPPED = {"script", "style", "head", "svg", "math"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements whose start ends an open paragraph.
ENDS_PARAGRAPH = {"address", "article", "aside", "blockquote", "center", "dd", "details", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "header", "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul", *HEADINGS}
#: Elements that end an open element of their own kind, and what they don't look beyond.
SAME = {"li": {"ol", "ul", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
INLINE = {"a", "b", "strong", "i", "em", "u", "code", "tt", "span", "font", "small", "big", "sub", "sup"}
WORDS = re.compile("[^ \t\n\r\xa0]+")
STYLES = {"b": C.BOLD, "strong": C.BOLD, "i": C.ITALIC, "em": C.ITALIC, "u": C.UNDERLINE, "code": C.CODE, "tt": C.CODE}


def local_name(tag: str) -> str:
    return tag.rpartition(":")[2].lower()


class Style:
    """What rules give an element: flags and a size ratio, or None."""

    __slots__ = ("flags", "ratio")

    def __init__(self, flags: frozenset = frozenset(), ratio: float | None = None) -> None:
        self.flags, self.ratio = flags, ratio


@dataclass
class Block:
    type: str
    heading_level: int = 0
    anchor_id: str | None = None
    section_title: str | None = None
    css_heading: bool = False
    css_page_break: bool = False
    css_centered: bool = False
    css_font_ratio: float = 1.0
    words: list = field(default_factory=list)


@dataclass
class Open:
    """An element that is open: what to go back to when it ends."""

    tag: str
    style: int
    ratio: float
    block: Block | None = None
    anchored: tuple | None = None  # of an anchor that counts only if text follows: what it was before
    pending: list = field(default_factory=list)  # marks to put on the first block that opens inside


class BlockParser(HTMLParser):
    """rules: (kind, key) -> (flags, ratio), kinds TAG, ID and CLASS, keys in lower case. own_style: of a style attribute, the same."""

    def __init__(self, rules: dict | None = None, own_style=None, strict: bool = False, p_closes_inline: bool = True) -> None:
        super().__init__(convert_charrefs=True)
        self.rules, self.own_style, self.strict, self.p_closes_inline = rules or {}, own_style, strict, p_closes_inline
        self.blocks: list[Block] = []
        self.block: Block | None = None
        self.stack: list[Open] = []
        self.style, self.ratio = 0, 1.0
        self.anchor: str | None = None
        self.skipping: list[str] = []
        self.waiting: list[list] = []  # [element, anchor, block open then]: anchors whose element has had no text yet

    # elements

    def handle_starttag(self, tag: str, attrs: list) -> None:
        tag = local_name(tag)
        if self.skipping or tag in SKIPPED:
            if tag not in VOID:
                self.skipping.append(tag)
            return
        if tag in ENDS_PARAGRAPH:
            self._imply("p", {"table", "td", "th"} | ({"li", "blockquote", "div"} if tag == "p" else set()))
        if tag in SAME:
            self._imply(tag, SAME[tag])
            if tag in ("dt", "dd"):
                self._imply("dd" if tag == "dt" else "dt", SAME[tag])
        if self.p_closes_inline and tag == "p":
            while self.stack and self.stack[-1].tag in INLINE and not any(e.tag == "a" for e in self.stack[-1:]):
                self._close()
        given: dict[str, str] = {}
        for name, value in attrs:
            given.setdefault(name.lower(), value or "")
        self._open(tag, given)
        if tag in VOID:
            self._close()

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if local_name(tag) not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        tag = local_name(tag)
        if self.skipping:
            if tag in self.skipping:
                while self.skipping.pop() != tag:
                    pass
            return
        if tag in VOID or not any(e.tag == tag for e in self.stack):
            return
        while self.stack[-1].tag != tag:
            self._close()
        self._close()

    def _imply(self, tag: str, barrier: set) -> None:
        """Ends an open `tag`, unless a barrier was opened since."""
        for e in reversed(self.stack):
            if e.tag == tag:
                self.handle_endtag(tag)
                return
            if e.tag in barrier:
                return

    def _styled(self, tag: str, attrs: dict) -> Style:
        flags, ratio = set(), None
        keys = [("TAG", tag), *([("ID", attrs["id"].lower())] if attrs.get("id") else []), *(("CLASS", c.lower()) for c in attrs.get("class", "").split())]
        found = [self.rules[k] for k in keys if k in self.rules]
        if attrs.get("style") and self.own_style:
            found.append(self.own_style(attrs["style"]))
        for f, r in found:
            flags |= f
            ratio = r if r is not None else ratio
        return Style(frozenset(flags), ratio)

    def _start(self, kind: str, level: int = 0) -> Block:
        self.block = Block(kind, level, self.anchor)
        self.anchor = None
        self.blocks.append(self.block)
        for e in self.stack:
            for mark in e.pending:
                mark(self.block)
            e.pending = []
        return self.block

    def _open(self, tag: str, attrs: dict) -> None:
        css = self._styled(tag, attrs)
        entry = Open(tag, self.style, self.ratio)
        self.stack.append(entry)
        if css.ratio is not None:
            self.ratio = min(C.RATIO_MOST, max(C.RATIO_LEAST, self.ratio * css.ratio))
        opens = tag in HEADINGS or tag in ("blockquote", "li", "pre", "hr") or (tag == "p" and (self.block is None or bool(self.block.words)))
        anchor = attrs.get("id") or attrs.get("name")
        if anchor:
            if tag == "a" or tag == "hr":
                self._anchored(anchor, opens)
            else:
                # it counts once text follows inside; until then it is held, and taken back if none does
                entry.anchored = (anchor, self.anchor, self.block if self.block is not None and not self.block.anchor_id and not opens else None)
                self._anchored(anchor, opens)
        if tag == "hr":
            self._start("HR")
            self.block = None
        elif tag == "br":
            if self.block is not None and self.block.words:
                self._start("PARAGRAPH")
        elif tag in HEADINGS:
            entry.block = self._start("HEADING", int(tag[1]))
            self.style |= C.BOLD | C.HEADING
        elif tag in ("blockquote", "li", "pre"):
            self._start({"blockquote": "BLOCKQUOTE", "li": "LIST_ITEM", "pre": "PRE"}[tag])
            self.style |= C.ITALIC if tag == "blockquote" else C.CODE if tag == "pre" else 0
        elif tag == "p":
            if opens:
                self._start("PARAGRAPH")
            elif not self.strict and self.anchor and not self.block.anchor_id:
                self.block.anchor_id, self.anchor = self.anchor, None
            elif not self.strict:
                self.anchor = None
        for flag, bit in (("bold", C.BOLD), ("italic", C.ITALIC), ("underline", C.UNDERLINE)):
            if flag in css.flags:
                self.style |= bit
        self.style |= STYLES.get(tag, 0)
        marks = []
        if "center" in css.flags:
            marks.append(lambda b: setattr(b, "css_centered", True))
        if "page_break_before" in css.flags:
            marks.append(lambda b: setattr(b, "css_page_break", True))
        if css.ratio is not None:
            ratio = self.ratio
            marks.append(lambda b: setattr(b, "css_font_ratio", max(b.css_font_ratio, ratio)))
        owns = opens or tag in INLINE or tag in ("p", "hr")
        if self.strict or owns:
            for mark in marks if self.block is not None else ():
                mark(self.block)
        else:
            entry.pending = marks

    def _anchored(self, anchor: str, opens: bool) -> None:
        if not opens and self.block is not None and not self.block.anchor_id:
            self.block.anchor_id = anchor
        self.anchor = anchor

    def _close(self) -> None:
        entry = self.stack.pop()
        if entry.anchored:  # no text in it: as if it had no anchor
            anchor, before, block = entry.anchored
            if block is not None and block.anchor_id == anchor:
                block.anchor_id = None
            if self.anchor == anchor:
                self.anchor = before
        if entry.block is not None and entry.block is self.block:
            if self.block.words:
                self.block.section_title = " ".join(w[0] for w in self.block.words)
            self.block = None
        self.style, self.ratio = entry.style, entry.ratio

    # text

    def handle_data(self, data: str) -> None:
        if self.skipping or not data:
            return
        found = list(WORDS.finditer(data))
        solid = bool(found) or (self.strict and "\xa0" in data)
        if solid:
            for e in self.stack:
                e.anchored = None
        if self.block is None:
            if not found and not self.strict:
                return
            self._start("PARAGRAPH")
        words = self.block.words
        if words and (not found or found[0].start() > 0):
            words[-1][3] = True
        for m in found:
            word = m[0] if len(m[0]) * 4 <= C.WORD_MAX_BYTES else m[0].encode()[: C.WORD_MAX_BYTES].decode("utf-8", "ignore")
            words.append([word, text_width(word), self.style, m.end() < len(data)])
        if found:
            self.block.css_font_ratio = max(self.block.css_font_ratio, self.ratio)

    def finish(self) -> list[Block]:
        self.close()
        while self.stack:
            self._close()
        return [b for b in self.blocks if b.type == "HR" or b.words]


def parse(html: str, rules: dict | None = None, own_style=None, strict: bool = False, p_closes_inline: bool = True) -> list[Block]:
    """Blocks with words, and rules; p_closes_inline: whether a new paragraph ends inline elements left open in the one before."""
    parser = BlockParser(rules, own_style, strict, p_closes_inline)
    parser.feed(html)
    return parser.finish()


class LinkParser(HTMLParser):
    """(title, href, level) of the list items of the first <nav>: an item's direct link, nested lists one level down."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.path: list[str] = []
        self.inside = self.done = False
        self.title: list[str] | None = None
        self.href = ""
        self.links: list[tuple[str, str, int]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        tag = local_name(tag)
        if self.done or tag in VOID:
            return
        if tag == "nav" and not self.inside:
            self.inside = True
            self.path = []
            return
        if self.inside:
            if tag == "li" and self.path and self.path[-1] == "li":
                self.path.pop()
            if tag == "a" and self.path and self.path[-1] == "li":
                href = dict(attrs).get("href")
                if href:
                    self.title, self.href = [], href
            self.path.append(tag)

    def handle_endtag(self, tag: str) -> None:
        tag = local_name(tag)
        if not self.inside or self.done:
            return
        if tag == "nav":
            self.done = True
            return
        if tag in self.path:
            while self.path.pop() != tag:
                pass
        if tag == "a" and self.title is not None:
            self.links.append(("".join(self.title), self.href, sum(t in ("ol", "ul") for t in self.path) - 1))
            self.title = None

    def handle_data(self, data: str) -> None:
        if self.title is not None:
            self.title.append(data)


def nav_links(html: str) -> Iterator[tuple[str, str, int]]:
    parser = LinkParser()
    parser.feed(html)
    parser.close()
    yield from ((t.strip(" \t\r\n\f\v"), h, max(0, n)) for t, h, n in parser.links if t.strip())
