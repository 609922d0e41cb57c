"""Pages as trees in flat lists: parsing with a filter of tags, classes and styles, text offsets, wrapping, and writing.

Node 0 is the root. A text node has no tag. What an unknown tag holds is not part of the page; void tags hold nothing.
Text that no block holds is put in a paragraph when a page is written.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right, insort
from html.parser import HTMLParser

from pagewright.names import CLASS_PREFIX

# Tags, classes, attributes and styles that a page may have.
BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "div"}
MATH = set("math semantics annotation annotation-xml mrow mi mn mo mtext mspace mstyle msup msub msubsup mfrac msqrt mroot munder mover munderover mmultiscripts mprescripts none mtable mtr mtd mlabeledtr mpadded mphantom menclose maction mfenced merror".split())
TAGS = BLOCKS | MATH | set("strong em br span img table thead tbody tfoot tr th td".split())
VOID = set("br img hr input meta link base area col embed param source track wbr".split())
MATH_SPACE = "http://www.w3.org/1998/Math/MathML"
MATH_ATTRIBUTES = set(
    "xmlns alttext display encoding mathvariant mathsize mathcolor mathbackground displaystyle scriptlevel accent accentunder align alignmentscope bevelled charalign close columnalign columnlines columnspacing depth edge fence frame framespacing groupalign height largeop length lspace lquote maxsize minsize movablelimits notation open rowalign rowlines rowspacing rspace rquote separator separators stretchy symmetric voffset width".split()
)
INLINE_CLASSES = "underline underdot strike charbox shade highlight sup sub wavy double overline emphasis highlight-green highlight-blue highlight-pink highlight-orange highlight-purple ruby".split()
SPAN_CLASSES = {*INLINE_CLASSES, "marker", "note", "citation", "align-left", "align-center", "align-right"}
IMAGE_CLASSES = set("img-full img-fit img-inline img-float-left img-float-right img-w25 img-w50 img-w75 img-w100 img-left img-center img-right img-vtop img-vmid img-vbot".split())
BLOCK_CLASS = re.compile(r"note|citation|flush|indent|caption(-.*)?|align-.*|divider.*", re.S)
FONTS = ("宋体, SimSun, serif", "黑体, SimHei, sans-serif", "楷体, KaiTi, serif", "仿宋, FangSong, serif", "微软雅黑, Microsoft YaHei, sans-serif", "等线, DengXian, sans-serif", "serif", "sans-serif", "monospace", "cursive")
NUMBERS = ("data-pl", "data-pr", "data-indv", "data-spb", "data-spa", "data-lh")
CHARACTER_STYLES = ("text-align", "font-size", "font-family", "color")


def _character_value(name: str, value: str) -> str | None:
    v = value.strip()
    if name == "text-align":
        return v.lower() if v.lower() in ("left", "center", "right") else None
    if name == "font-size":
        m = re.fullmatch(r"(?i)([0-9]{1,4}(?:\.[0-9]+)?)\s*px", v)
        return f"{min(max(round(float(m[1])), 8), 72)}px" if m else None
    if name == "font-family":
        family = " ".join(re.sub("[\"']", "", v).split())
        return family if family in FONTS else None
    if re.fullmatch("#[0-9a-fA-F]{3,8}", v):
        return v.lower()
    return v if re.fullmatch("[a-zA-Z]{3,20}", v) else None


def _declarations(style: str) -> list[tuple[str, str]]:
    return [(name.strip().lower(), value) for name, colon, value in (d.partition(":") for d in style.split(";")) if colon]


def character_style(style: str) -> str:
    """The declarations for characters in a fixed order, of each the last that is valid."""
    said = {n: v for n, raw in _declarations(style) if n in CHARACTER_STYLES and (v := _character_value(n, raw))}
    return ";".join(f"{n}:{said[n]}" for n in CHARACTER_STYLES if n in said)


def _image_style(style: str) -> str:
    widths = [re.fullmatch(r"([0-9]{1,3})\s*%", v.strip()) for n, v in _declarations(style) if n == "width"]
    return f"width:{int(widths[-1][1])}%" if widths and widths[-1] and 1 <= int(widths[-1][1]) <= 100 else ""


def _classes(value: str, allowed) -> str:
    short = lambda c: c.removeprefix(CLASS_PREFIX) if c.startswith(CLASS_PREFIX) else None
    return " ".join(c for c in value.split() if short(c) is not None and allowed(short(c)))


def _kept(tag: str, name: str, value: str) -> str | None:
    """The value with which an attribute stays; nothing if it goes."""
    if tag == "img":
        known = {"class": lambda v: _classes(v, IMAGE_CLASSES.__contains__) or None, "style": lambda v: _image_style(v) or None}
        return value if name in ("src", "alt") else known.get(name, lambda v: None)(value)
    if tag == "span":
        known = {"class": lambda v: _classes(v, SPAN_CLASSES.__contains__) or None, "style": lambda v: character_style(v) or None}
        return value if name == f"data-{CLASS_PREFIX}marker" else known.get(name, lambda v: None)(value)
    if tag in MATH:
        return value if name in MATH_ATTRIBUTES and (name != "xmlns" or value == MATH_SPACE) else None
    if tag in BLOCKS:
        if name == "class":
            return _classes(value, BLOCK_CLASS.fullmatch) or None
        v = value.strip()
        fine = v in ("first", "hang") if name == "data-ind" else name in NUMBERS and re.fullmatch(r"-?[0-9]+(\.[0-9]+)?", v)
        return v if fine else None
    return None if name.startswith("on") else value


class Tree(HTMLParser):
    """A page: for each node its tag (nothing for text), its attributes or text, its parent and its children."""

    def __init__(self, markup: str):
        super().__init__(convert_charrefs=True)
        self.tag: list[str | None] = ["root"]
        self.held: list[dict | str] = [{}]
        self.parent: list[int] = [-1]
        self.kids: list[list[int]] = [[]]
        self.open: list[tuple[str, int]] = [("root", 0)]  # a skipped tag has no node
        self.feed(markup)
        self.close()
        self.place()

    def add(self, tag: str | None, held: dict | str, parent: int) -> int:
        self.tag.append(tag)
        self.held.append(held)
        self.parent.append(parent)
        self.kids.append([])
        return len(self.tag) - 1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        tag = {"b": "strong", "i": "em"}.get(tag, tag)
        found = {k: v for k, raw in attrs if raw is not None and (v := _kept(tag, k, raw)) is not None}
        if tag not in TAGS or (tag == "img" and "src" not in found):
            if tag not in VOID or tag == "img":
                self.open.append((tag, -1))
            return
        up = self.open[-1][1]
        node = self.add(tag, found, up)
        if up >= 0:
            self.kids[up].append(node)
        if tag not in VOID:
            # Below a skipped tag nothing is part of the page, though its tags are matched.
            self.open.append((tag, node))

    def handle_endtag(self, tag: str) -> None:
        tag = {"b": "strong", "i": "em"}.get(tag, tag)
        name, node = self.open[-1]
        if len(self.open) > 1 and (name == tag or node < 0):
            self.open.pop()

    def handle_data(self, data: str) -> None:
        up = self.open[-1][1]
        if up >= 0 and data:
            self.kids[up].append(self.add(None, data, up))

    def place(self) -> None:
        """Text nodes in order and where each begins in the text of the page."""
        self.texts, self.starts, at = [], [], 0
        stack = [0]
        while stack:
            node = stack.pop()
            if self.tag[node] is None:
                if self.held[node]:
                    self.texts.append(node)
                    self.starts.append(at)
                    at += len(self.held[node])
            else:
                stack += reversed(self.kids[node])
        self.length = at

    def text(self) -> str:
        return "".join(self.held[t] for t in self.texts)

    def covered(self, a: int, b: int) -> range:
        """Places in ``texts`` of the text nodes that a range touches."""
        return range(max(bisect_right(self.starts, a) - 1, 0), bisect_left(self.starts, b)) if a < b else range(0)

    def block_of(self, node: int) -> int | None:
        """The innermost block around a node."""
        node = self.parent[node]
        while node > 0 and self.tag[node] not in BLOCKS:
            node = self.parent[node]
        return node if node > 0 else None

    def wrap(self, wraps: list[tuple[int, int, str, dict]]) -> None:
        """Put the text in each range (start, end, tag, attributes) into an element; later ones are put inside earlier ones.

        One sweep: at each end of a range the set of active ones changes, and between two ends the text is put into
        these; elements stay open as long as the ones outside them do.
        """
        ends = sorted([(a, 1, i) for i, (a, b, *_) in enumerate(wraps) if a < b] + [(b, 0, i) for i, (a, b, *_) in enumerate(wraps) if a < b])
        active: list[int] = []
        k, fresh = 0, {}
        for start, node in zip(self.starts, self.texts):
            stop = start + len(self.held[node])
            at, opened, out = start, [], []
            while k < len(ends) and ends[k][0] <= start:
                k = self._moved(ends, k, active)
            if not active and (k == len(ends) or ends[k][0] >= stop):
                continue
            while at < stop:
                upto = min(ends[k][0], stop) if k < len(ends) else stop
                same = 0
                while same < len(opened) and same < len(active) and opened[same][0] == active[same]:
                    same += 1
                del opened[same:]
                for i in active[same:]:
                    up = opened[-1][1] if opened else self.parent[node]
                    element = self.add(wraps[i][2], dict(wraps[i][3]), up)
                    (self.kids[up] if opened else out).append(element)
                    opened.append((i, element))
                up = opened[-1][1] if opened else self.parent[node]
                (self.kids[up] if opened else out).append(self.add(None, self.held[node][at - start : upto - start], up))
                at = upto
                while k < len(ends) and ends[k][0] <= at:
                    k = self._moved(ends, k, active)
            fresh.setdefault(self.parent[node], {})[node] = out
        for up, new in fresh.items():
            self.kids[up] = [x for kid in self.kids[up] for x in new.get(kid, (kid,))]
        self.place()

    @staticmethod
    def _moved(ends: list, k: int, active: list[int]) -> int:
        _, begins, i = ends[k]
        if begins:
            insort(active, i)
        else:
            del active[bisect_left(active, i)]
        return k + 1

    def unwrap(self, chosen) -> None:
        """Take away the outermost elements that are chosen by tag and classes; what they hold stays."""
        stack = [0]
        while stack:
            node = stack.pop()
            if self.tag[node] is None:
                continue
            out = []
            for kid in self.kids[node]:
                if self.tag[kid] is not None and chosen(self.tag[kid], self.held[kid].get("class", "").split()):
                    for x in self.kids[kid]:
                        self.parent[x] = node
                    out += self.kids[kid]
                else:
                    out.append(kid)
                    stack.append(kid)
            self.kids[node] = out
        self.place()

    def html(self) -> str:
        """The page as markup, what is outside of blocks in paragraphs."""
        out: list[str] = []
        loose: list[str] = []

        def flush():
            if "".join(loose).strip():
                out.append(f"<p>{html.escape(''.join(loose), quote=False)}</p>")
            loose.clear()

        for kid in self.kids[0]:
            if self.tag[kid] is None:
                loose.append(self.held[kid])
                continue
            flush()
            written = self._written(kid)
            out.append(written if self.tag[kid] in BLOCKS else f"<p>{written}</p>")
        flush()
        return "".join(out)

    def _written(self, top: int) -> str:
        out, stack = [], [(top, False)]
        while stack:
            node, closing = stack.pop()
            tag = self.tag[node]
            if closing:
                out.append(f"</{tag}>")
            elif tag is None:
                out.append(html.escape(self.held[node], quote=False))
            else:
                attrs = "".join(f' {k}="{html.escape(v)}"' for k, v in sorted(self.held[node].items()))
                out.append(f"<{tag}{attrs}/>" if tag in VOID else f"<{tag}{attrs}>")
                if tag not in VOID:
                    stack.append((node, True))
                    stack += [(kid, False) for kid in reversed(self.kids[node])]
        return "".join(out)


def cleaned(markup: str) -> str:
    """A page with only what a page may have."""
    return Tree(markup).html()
