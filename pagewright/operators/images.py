"""The small style sheet of images written into their tags, for readers without style sheets.

A page is read once as elements with the element and the place among siblings that each has; every element that a rule
matches gets the winning declarations as its style, and the rest of the page stays as it is, character for character.
Elements with a style of their own stay, too.
"""

from __future__ import annotations

from dataclasses import dataclass
from html.parser import HTMLParser
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.names import CLASS_PREFIX

# The style sheet. Of the rules that match, a later one wins; "none" takes a declaration away.
IMAGE_SHEET = """
*            display:block; max-width:100%; height:auto
w25          width:25%
w50          width:50%
w75          width:75%
w100         width:100%
inline       display:inline-block; max-width:100%; height:auto; vertical-align:middle
vtop         vertical-align:top
vmid         vertical-align:middle
vbot         vertical-align:bottom
fit          display:inline-block; max-width:100%; height:auto; vertical-align:middle
full         display:inline-block; max-width:100%; width:100%; height:none; vertical-align:middle
float-left   display:inline-block; float:left; max-width:100%; height:none; margin:0 0.5em 0.4em 0
float-right  display:inline-block; float:right; max-width:100%; height:none; margin:0 0 0.4em 0.5em
"""
PARAGRAPH_SHEET = """
full         page-break-before:always; page-break-after:always; text-align:center
full:first   page-break-before:auto
left         text-align:left
center       text-align:center
right        text-align:right
"""
#: The order in which declarations are written.
IMAGE_ORDER = ("display", "float", "max-width", "width", "height", "margin", "vertical-align")
PARAGRAPH_ORDER = ("page-break-before", "page-break-after", "text-align")
#: Elements in which a paragraph can be the first one.
CONTAINERS = {"article", "blockquote", "body", "dd", "div", "dt", "li", "section", "table", "tbody", "td", "tfoot", "th", "thead", "tr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}


class Rule(NamedTuple):
    selector: str
    said: dict[str, str]


def sheet(source: str) -> list[Rule]:
    """The rules of a style sheet with a selector and declarations in each line."""
    split = (line.split(None, 1) for line in source.strip().splitlines())
    return [Rule(s, dict(d.strip().split(":", 1) for d in declarations.split(";"))) for s, declarations in split]


IMAGE_RULES, PARAGRAPH_RULES = sheet(IMAGE_SHEET), sheet(PARAGRAPH_SHEET)
KNOWN = {r.selector for r in IMAGE_RULES + PARAGRAPH_RULES} - {"*"}


@dataclass
class Element:
    """A start tag: where it is, what it says, the paragraph around it, and whether it is the first of its container."""

    name: str
    start: int
    source: str
    attributes: dict[str, str]
    paragraph: Element | None
    first: bool

    @property
    def kinds(self) -> set[str]:
        prefix = f"{CLASS_PREFIX}img-"
        return {c.removeprefix(prefix) for c in self.attributes.get("class", "").split() if c.startswith(prefix)} & KNOWN


class Elements(HTMLParser):
    """The elements of a page, in order."""

    def __init__(self, markup: str):
        super().__init__(convert_charrefs=False)
        self.found: list[Element] = []
        self.around: list[Element] = []
        self.children: list[int] = [0]
        self.lines = [0, *accumulate(len(x) + 1 for x in markup.split("\n"))]
        self.feed(markup)
        self.close()

    def handle_starttag(self, tag, attrs):
        up = self.around[-1] if self.around else None
        first = self.children[-1] == 0 and (up is None or up.name in CONTAINERS)
        paragraph = None if up is None else up if up.name == "p" else up.paragraph
        element = Element(tag, self.position(), self.get_starttag_text(), {k: v or "" for k, v in attrs}, paragraph, first)
        self.children[-1] += 1
        self.found.append(element)
        if tag not in VOID:
            self.around.append(element)
            self.children.append(0)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if any(x.name == tag for x in self.around):
            while self.around:
                self.children.pop()
                if self.around.pop().name == tag:
                    break

    def position(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column


def winning(rules: list[Rule], selectors: set[str], order: tuple[str, ...]) -> dict[str, str]:
    """What the matching rules say in the end, in order."""
    said: dict[str, str] = {}
    for rule in rules:
        if rule.selector == "*" or rule.selector in selectors:
            said |= rule.said
    return {name: said[name] for name in order if said.get(name, "none") != "none"}


def declarations(element: Element) -> dict[str, str]:
    """The declarations for an element; none for one that no class of images is about."""
    if element.name == "p":
        kinds = element.kinds | ({"full:first"} if element.first and "full" in element.kinds else set())
        return winning(PARAGRAPH_RULES, kinds, PARAGRAPH_ORDER)
    kinds = element.kinds | (element.paragraph.kinds if element.paragraph else set())
    return winning(IMAGE_RULES, kinds, IMAGE_ORDER) if element.name == "img" and kinds else {}


def styled(element: Element) -> str:
    """The source of a start tag with its declarations; an image also gets its width as an attribute, if it has none."""
    said = {} if "style" in element.attributes else declarations(element)
    if not said:
        return element.source
    added = {"style": ";".join(f"{k}:{v}" for k, v in said.items())}
    if element.name == "img" and "width" in said and "width" not in element.attributes:
        added["width"] = said["width"]
    end = "/>" if element.source.endswith("/>") else ">"
    return element.source.removesuffix(end).rstrip() + "".join(f' {k}="{v}"' for k, v in added.items()) + end


def inlined(markup: str) -> str:
    """A page with the style sheet of images in its tags; a page without images stays, as does one that has them already."""
    found = Elements(markup).found
    if all(x.name != "img" for x in found):
        return markup
    out, at = [], 0
    for x in found:
        out += [markup[at : x.start], styled(x)]
        at = x.start + len(x.source)
    return "".join(out) + markup[at:]


def self_closed(markup: Column) -> Column:
    """Image tags closed in themselves, as XHTML wants them."""
    return F.regexp_replace(markup, r"(?i)<img\b([^>]*?)(?<!/)>", "<img$1/>")


def inline_images(markup: Column) -> Column:
    """Pages with the style sheet of images in their tags, in Arrow batches."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("string")
    def run(v):
        import pyarrow as pa

        return pa.array([None if x is None else inlined(x) for x in v.to_pylist()], pa.string())

    return self_closed(run(markup))
