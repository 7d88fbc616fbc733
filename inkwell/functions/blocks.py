"""Blocks of a page: a walk over its elements that keeps paths and counts, leaves out containers and marks references."""

from __future__ import annotations

from collections import Counter
from html.parser import HTMLParser

from inkwell.functions.segment import FORMULA, REF_CLOSE, REF_OPEN

#: Containers that hold no prose (first and second rule set), inline elements dropped by the first, kept as formulas by the second.
CONTAINERS_1 = frozenset("fig fig-group table table-wrap table-wrap-group caption boxed-text supplementary-material ref-list fn-group ack app app-group disp-formula list media graphic".split())
CONTAINERS_2 = frozenset("fig fig-group table table-wrap table-wrap-group caption supplementary-material ref-list fn-group ack app app-group media graphic boxed-text list disp-formula disp-quote".split())
INLINE_1 = frozenset("xref inline-formula disp-formula tex-math math graphic media ext-link uri email fn inline-graphic".split())
FORMULAS_2 = frozenset("inline-formula disp-formula tex-math math inline-graphic".split())
#: The same roles on web pages.
PAGE_CONTAINERS = frozenset("nav script style head header footer aside form ul ol".split())
BLOCKS = {"p": "prose", "h1": "title", "h2": "title", "h3": "title", "blockquote": "prose"}
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Walker(HTMLParser):
    """Collects (block_no, xpath, kind, tag, text, flags); unclosed elements end with their parent."""

    def __init__(self, version: int):
        super().__init__(convert_charrefs=True)
        self.version = version
        self.skip = PAGE_CONTAINERS | (CONTAINERS_1 if version == 1 else CONTAINERS_2)
        self.stack: list[tuple[str, str, Counter]] = [("", "", Counter())]
        self.out: list[dict] = []
        self.open: dict | None = None
        self.hidden = self.dropped = 0

    def handle_starttag(self, tag, attrs):
        _, path, children = self.stack[-1]
        children[tag] += 1
        here = f"{path}/{tag}[{children[tag]}]"
        if tag in VOID:
            if self.open is not None and tag == "br":
                self.open["parts"].append(" ")
            return
        if tag in BLOCKS:
            self.close_block()
        self.stack.append((tag, here, Counter()))
        outside = tag in self.skip or any(k == "class" and "ad" in (v or "").split() for k, v in attrs)
        if self.hidden or outside:
            self.hidden += 1
            return
        if tag in BLOCKS:
            self.open = {"xpath": here, "kind": BLOCKS[tag], "tag": tag, "parts": [], "flags": []}
        elif self.open is not None and self.version == 1 and tag in INLINE_1:
            self.dropped += 1
            self.open["parts"].append(" ")
        elif self.open is not None and self.version == 2:
            if tag in FORMULAS_2:
                self.open["parts"].append(FORMULA)
                self.open["flags"].append("formula_or_inline_graphic")
            elif tag == "sup" or tag == "a" and ("rel", "bibr") in attrs:
                self.open["parts"].append(REF_OPEN)

    def handle_endtag(self, tag):
        if tag not in (t for t, _, _ in self.stack):
            return
        while len(self.stack) > 1:
            top, _, _ = self.stack.pop()
            if self.hidden:
                self.hidden -= 1
            elif top in BLOCKS:
                self.close_block()
            elif self.version == 1 and top in INLINE_1 and self.dropped:
                self.dropped -= 1
            elif self.open is not None and self.version == 2:
                if top in FORMULAS_2:
                    self.open["parts"].append(FORMULA)
                elif top == "sup":
                    self.open["parts"].append(REF_CLOSE)
            if top == tag:
                break

    def handle_data(self, data):
        if self.open is not None and not self.hidden and not self.dropped:
            self.open["parts"].append(data)

    def close_block(self):
        if self.open is not None:
            self.out.append(self.open | {"text": " ".join("".join(self.open["parts"]).split())})
            self.open = None

    def blocks(self, html: str) -> list[dict]:
        self.feed(html)
        self.close()
        self.close_block()
        return self.out
