"""Declarative format rules over page HTML: conditions, plans, ranges and the formatter.

A page is a tree with text offsets (``tree``). Inline formats put the text of a range into elements, all of a run in one
sweep; block formats change the blocks that a range touches. Conditions that need no positions are native.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import cer_form, let, running, u_trim
from pagewright.names import CLASS_PREFIX
from pagewright.operators.tree import BLOCKS as TREE_BLOCKS
from pagewright.operators.tree import CHARACTER_STYLES, FONTS, INLINE_CLASSES, Tree

# Operations, what excludes what, and how inline ones are written.
GROUPS = {
    "block_tag": ("p", "heading1", "heading2", "heading3", "heading4", "heading5", "heading6"),
    "align": ("align_left", "align_center", "align_right"),
    "merge": ("merge",),
    "indent_mode": ("flush", "indent", "first_indent", "hang_indent"),
    "sup_sub": ("sup", "sub"),
}
SPANS = ("note", "citation", "underline", "strike", "charbox", "shade", "highlight", "sup", "sub", "wavy", "double", "overline", "emphasis", "highlight_green", "highlight_blue", "highlight_pink", "highlight_orange", "highlight_purple")
#: Tag and class by which an inline format is written.
INLINE = {"bold": ("strong", None), "italic": ("em", None)} | {n: ("span", CLASS_PREFIX + n.replace("_", "-")) for n in SPANS}
INDENTS = {"flush": "flush", "indent": "indent", "first_indent": "first", "hang_indent": "hang"}
OPS = {"remove", "none", "no_bold", "strip_ws", *INDENTS, *INLINE, *[o for g in GROUPS.values() for o in g]}
BLOCKS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "div", "blockquote", "li", "td", "th")
KEPT = (*BLOCKS, "strong", "em", "b", "i", "span", "sup", "sub", "u", "s", "a", "img", "br", "hr", "ul", "ol", "table", "thead", "tbody", "tr", "mark", "ruby", "rt")
VOID = ("img", "br", "hr")
PROTECTED = (f"{CLASS_PREFIX}divider", f"{CLASS_PREFIX}caption")


def group_of(op: Column) -> Column:
    return F.coalesce(*[F.when(op.isin(*ops), g) for g, ops in GROUPS.items()])


def conflict(a: Column, b: Column) -> Column:
    """Different operations of one group exclude each other, and remove excludes all."""
    return (a != b) & ((a == "remove") | (b == "remove") | F.coalesce(group_of(a) == group_of(b), F.lit(False)))


def regex_is_safe(pattern: str, most: int = 512) -> bool:
    """Neither too long nor with a group that is repeated by + or * and repeats something definite inside itself.

    Something definite is a character, an escape, a group, or a class without white space; a dot is not.
    """
    if len(pattern) > most:
        return False
    parts = re.findall(r"\\.|\[(?:\\.|[^\]\\])*\]|.", pattern, re.S)
    repeats: list[bool] = []  # for each open group: does it repeat something so far
    for i, (x, after) in enumerate(zip(parts, [*parts[1:], ""])):
        if x == "(":
            repeats.append(False)
        elif x == ")":
            if repeats and repeats.pop() and after in ("+", "*"):
                return False
        elif x in ("+", "*", "?") and i:
            before = parts[i - 1]
            definite = not re.search(r"\\[sS]", before) if before[0] == "[" else before not in (".", "+", "*", "?")
            if definite:
                opened = before == "("  # the mark of a special group, which says nothing of that group itself
                repeats = [True] * (len(repeats) - opened) + repeats[len(repeats) - opened :]
    return True


def translate_regex(text: str) -> str:
    """A pattern, or ``/pattern/flags``, in Python's dialect."""
    m = re.fullmatch(r"/(.*)/([a-z]*)", text, re.DOTALL)
    body, flags = (m[1], m[2]) if m else (text, "")
    for src, dst in ((r"\z", r"\Z"), (r"\h", r"[ \t\u3000]"), (r"\R", r"(?:\r\n|\n|\r)")):
        body = re.sub(r"(?<!\\)((?:\\\\)*)" + re.escape(src), lambda x, d=dst: x[1] + d, body)
    body = re.sub(r"\(\?<([A-Za-z_]\w*)>", r"(?P<\1>", body)
    body = re.sub(r"\\k<([A-Za-z_]\w*)>", r"(?P=\1)", body)
    kept = "".join(sorted(set(flags) & set("imsx")))
    return f"(?{kept}){body}" if kept else body


@dataclass
class Condition:
    type: str = "contains"
    pattern: str = ""
    scope: str = "page"
    formats: list[str] = field(default_factory=list)
    target: str = "match"
    between_end_pattern: str = ""
    group_formats: list[list[str]] = field(default_factory=list)
    match_formats: list[list[str]] = field(default_factory=list)

    def ranges(self, text: str) -> list[re.Match | tuple[int, int]]:
        """Where the pattern is: all occurrences (those of ``contains`` may overlap), or the one at an end."""
        p = self.pattern
        if self.type == "regex":
            return list(re.finditer(translate_regex(p), text))
        if self.type == "contains":
            return [(i, i + len(p)) for i in range(len(text) - len(p) + 1) if text.startswith(p, i)]
        if self.type == "prefix":
            return [(0, len(p))] if text.startswith(p) else []
        return [(len(text) - len(p), len(text))] if text.endswith(p) else []

    def holds(self, text: str) -> bool:
        return not self.pattern or bool(self.ranges(text))


@dataclass
class Rule:
    id: str
    conditions: list[Condition]
    mode: str = "first"

    @classmethod
    def of(cls, raw: dict) -> Rule:
        clean = lambda ops: [o for o in ops or [] if o in OPS]
        conds = [Condition(c.get("type", "contains"), c.get("pattern") or "", c.get("scope", "page"), clean(c.get("formats")), c.get("target", "match"), c.get("between_end_pattern") or "", [clean(x) for x in c.get("group_formats") or []], [clean(x) for x in c.get("match_formats") or []]) for c in raw.get("conditions", [])]
        return cls(str(raw.get("id")), conds, raw.get("mode", "first"))


class _Events(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.events: list[list] = []

    def handle_starttag(self, tag, attrs):
        tag = {"b": "strong", "i": "em"}.get(tag, tag)
        if tag in KEPT:
            self.events.append(["void" if tag in VOID else "open", tag, {k: v or "" for k, v in attrs if not k.startswith("on")}])

    def handle_endtag(self, tag):
        tag = {"b": "strong", "i": "em"}.get(tag, tag)
        if tag in KEPT and tag not in VOID:
            self.events.append(["close", tag, {}])

    def handle_data(self, data):
        self.events.append(["text", data, {}])


def parse_events(markup: str) -> list[list]:
    p = _Events()
    p.feed(markup)
    p.close()
    out: list[list] = []
    opened: list[str] = []
    for e in p.events:
        if e[0] == "close":
            if e[1] not in opened:
                continue
            while opened[-1] != e[1]:
                out.append(["close", opened.pop(), {}])
            opened.pop()
        elif e[0] == "open":
            opened.append(e[1])
        out.append(e)
    return out + [["close", t, {}] for t in reversed(opened)]


def serialize(events: list[list]) -> str:
    def attrs(a):
        return "".join(f' {k}="{html.escape(v)}"' for k, v in sorted(a.items()))

    return "".join(html.escape(e[1], quote=False) if e[0] == "text" else f"</{e[1]}>" if e[0] == "close" else f"<{e[1]}{attrs(e[2])}{'/' if e[0] == 'void' else ''}>" for e in events)


def page_text(events: list[list]) -> str:
    return "".join(e[1] for e in events if e[0] == "text")


class Formatter:
    """Applies operations to ranges of a page's text; per block the first operation of a group wins.

    Inline operations wait until something needs the elements that they make, and are then carried out in one sweep.
    """

    def __init__(self, markup: str):
        self.tree = Tree(markup)
        self.text = self.tree.text()
        self.taken: dict[int, set[str]] = {}
        self.waiting: list[tuple[int, int, str]] = []
        self.siblings: dict[int, list[int]] = {}
        self.order: dict[int, int] = {}
        # Whether the page may hold superscripts and subscripts, which take each other's place.
        self._other = dict.fromkeys(GROUPS["sup_sub"], True)

    def settle(self) -> None:
        if self.waiting:
            self.tree.wrap([(a, b, INLINE[op][0], {"class": INLINE[op][1]} if INLINE[op][1] else {}) for a, b, op in self.waiting])
            self.waiting = []

    def unwrap(self, elements: list[tuple[str, str | None]]) -> None:
        self.settle()
        for tag, cls in elements:
            self.tree.unwrap(lambda t, classes, tag=tag, cls=cls: t == tag and (cls is None or cls in classes))

    def inline(self, op: str, a: int, b: int) -> None:
        if a >= min(b, self.tree.length):
            return
        if op in GROUPS["sup_sub"]:
            other = "sub" if op == "sup" else "sup"
            if self._other[other]:
                self.unwrap([INLINE[other]])
                self._other[other] = False
            self._other[op] = True
        if op == "no_bold":
            self.unwrap([INLINE["bold"]])
        elif op == "remove":
            self.unwrap([("strong", None), ("em", None), *[("span", CLASS_PREFIX + c) for c in ("note", "citation", *INLINE_CLASSES)]])
            self._other = dict.fromkeys(GROUPS["sup_sub"], False)
        else:
            self.waiting.append((a, b, op))

    def _protected(self, block: int) -> bool:
        """Dividers and captions stay as they are."""
        return any(c in PROTECTED or c.startswith(tuple(f"{x}-" for x in PROTECTED)) for c in self._classes(block))

    def _classes(self, block: int) -> list[str]:
        return self.tree.held[block].get("class", "").split()

    def _next(self, block: int) -> int | None:
        """The block after another one below the same element."""
        t, up = self.tree, self.tree.parent[block]
        if up not in self.siblings:
            self.siblings[up] = [k for k in t.kids[up] if t.tag[k] in TREE_BLOCKS]
            self.order |= {k: i for i, k in enumerate(self.siblings[up])}
        after = self.order[block] + 1
        return self.siblings[up][after] if after < len(self.siblings[up]) else None

    def _ends(self, a: int, b: int) -> tuple[int | None, int | None]:
        """The blocks in which a range begins and ends."""
        t, places = self.tree, self.tree.covered(a, b)
        if not places or b > t.length:
            return None, None
        return t.block_of(t.texts[places[0]]), t.block_of(t.texts[places[-1]])

    def _blocks(self, first: int, last: int | None, stop_at_protected: bool = False) -> list[int]:
        found, block = [], first
        while block is not None and not (stop_at_protected and self._protected(block)):
            found.append(block)
            block = None if block == last else self._next(block)
        return found

    def block(self, op: str, a: int, b: int, free: bool = False, selected: bool = False) -> None:
        """``free``: the first operation of a group does not keep others away; ``selected``: the range is a selection."""
        t = self.tree
        first, last = self._ends(a, b)
        if first is None or self._protected(first):
            return
        if op == "merge":
            self._merge(self._blocks(first, last, True))
            return
        group = next((g for g, ops in GROUPS.items() if op in ops), None)
        blocks = [x for x in self._blocks(first, last) if not self._protected(x)]
        if group and not free:
            blocks = [x for x in blocks if group not in self.taken.get(x, ())]
        if not blocks:
            return
        if op in ("note", "citation") and selected and self._partly(blocks, a, b):
            self.inline(op, a, b)
            return
        own = {f"{CLASS_PREFIX}{x}" for x in ("flush", "indent")}
        for x in blocks:
            classes = self._classes(x)
            if op == "p" or op.startswith("heading"):
                t.tag[x] = "p" if op == "p" else "h" + op[-1]
                continue
            if op in ("note", "citation"):
                classes += [f"{CLASS_PREFIX}{op}"] * (f"{CLASS_PREFIX}{op}" not in classes)
            elif op.startswith("align_"):
                classes = [c for c in classes if not c.startswith(f"{CLASS_PREFIX}align-")] + [f"{CLASS_PREFIX}align-{op[6:]}"]
            elif op in ("flush", "indent"):
                classes = [c for c in classes if c not in own] + [f"{CLASS_PREFIX}{op}"]
            else:
                classes = [c for c in classes if c not in own]
                t.held[x] |= {"data-ind": INDENTS[op], "data-indv": "2"}
            t.held[x]["class"] = " ".join(classes)
        if group and not free:
            for x in blocks:
                self.taken.setdefault(x, set()).add(group)

    def _partly(self, blocks: list[int], a: int, b: int) -> bool:
        """Whether a range leaves out some of the text of blocks."""
        t, inside = self.tree, set(blocks)
        held = [k for k, node in enumerate(t.texts) if self._within(node, inside)]
        return bool(held) and (a > t.starts[held[0]] or b < t.starts[held[-1]] + len(t.held[t.texts[held[-1]]]))

    def _within(self, node: int, blocks: set[int]) -> bool:
        while node > 0 and node not in blocks:
            node = self.tree.parent[node]
        return node > 0

    def _merge(self, blocks: list[int]) -> None:
        """One block of several, or of one and the next, a blank between what they hold."""
        if len(blocks) < 2:
            after = self._next(blocks[0])
            if after is None or self._protected(after):
                return
            blocks = [blocks[0], after]
        self.settle()
        t, first, gone = self.tree, blocks[0], set(blocks[1:])
        for x in blocks[1:]:
            moved = ([t.add(None, " ", first)] if t.kids[first] and t.kids[x] else []) + t.kids[x]
            for kid in t.kids[x]:
                t.parent[kid] = first
            t.kids[first] += moved
            t.kids[x] = []
        for up in {t.parent[x] for x in gone}:
            t.kids[up] = [k for k in t.kids[up] if k not in gone]
        self.siblings = {}
        t.place()

    def strip(self, a: int, b: int) -> None:
        """Take the white space but newlines out of the blocks of a range."""
        self.settle()
        t = self.tree
        first, last = self._ends(a, b)
        if first is None or self._protected(first):
            return
        inside = {x for x in self._blocks(first, last) if not self._protected(x)}
        for node in t.texts:
            if self._within(node, inside):
                t.held[node] = re.sub(r"[^\S\n]+", "", t.held[node])
        t.place()

    def apply(self, step: Step) -> None:
        if step.op == "strip_ws":
            self.strip(step.start, step.end)
        elif step.op in ("remove", "no_bold") or (step.op in INLINE and (step.op != "note" or step.loose) and step.op != "citation"):
            self.inline(step.op, step.start, step.end)
        else:
            self.block(step.op, step.start, step.end, step.loose and not step.op.startswith("align_"), step.selected)


@dataclass
class Step:
    """An operation on a range. ``loose`` ones, of groups and single matches, do not keep others away and write notes inline."""

    op: str
    start: int
    end: int
    loose: bool = False
    selected: bool = False


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """A range without the line ends at its ends."""
    part = text[a:b]
    return a + len(part) - len(part.lstrip("\r\n")), b - len(part) + len(part.rstrip("\r\n"))


def plan(rule: Rule, text: str, selection: tuple[int, int] | None = None) -> list[Step]:
    """The steps of a rule on a page, in the order target, group, match, pattern, entry; later places of a kind come first."""
    steps: dict[str, list[Step]] = {k: [] for k in ("target", "group", "match", "pattern", "entry")}
    clamped = tuple(max(0, min(x, len(text))) for x in selection) if selection else None
    chosen = clamped if clamped and clamped[0] < clamped[1] else None
    for c in rule.conditions:
        own = chosen if c.scope == "selection" else None
        if not c.holds(text[slice(*own)] if own else text):
            continue
        ops = [o for o in c.formats if o != "none"]
        matches = c.ranges(text) if c.pattern else []
        spans = [m.span() if isinstance(m, re.Match) else m for m in matches]
        within = lambda span: own is None or (own[0] <= span[0] and span[1] <= own[1])  # noqa: B023, E731
        if c.target != "match":
            a, b = next(filter(within, spans), (None, None)) if c.type == "regex" else (None, None)
            if a is None:
                continue
            place = {"before": (0, a), "after": (b, len(text))}.get(c.target)
            if c.target == "between" and c.between_end_pattern:
                end = re.compile(translate_regex(c.between_end_pattern)).search(text, b)
                place = (b, end.start()) if end else None
            if place and own:
                place = (max(place[0], own[0]), min(place[1], own[1]))
            if place and place[0] < place[1]:
                steps["target"] += [Step(op, *place) for op in ops]
            continue
        single = c.type == "regex" and (c.group_formats or c.match_formats)
        if c.type == "regex" and c.group_formats:
            for m in reversed([m for m in matches if within(m.span())]):
                parts = [(*_trimmed(text, *m.span(k)), some) for k, some in enumerate(c.group_formats, 1) if k <= m.re.groups and m.start(k) >= 0]
                for a, b, some in sorted(parts, key=lambda x: x[0], reverse=True):
                    steps["group"] += [Step(op, a, b, loose=True) for op in some if op != "none" and a < b]
        if c.type == "regex" and c.match_formats:
            parts = [(*_trimmed(text, *span), some) for span, some in zip(spans, c.match_formats) if within(span)]
            for a, b, some in sorted(parts, key=lambda x: x[0], reverse=True):
                steps["match"] += [Step(op, a, b, loose=True) for op in some if op != "none" and a < b]
        if c.formats and c.pattern:
            inline = [op for op in ops if op in ("remove", "no_bold") or (op in INLINE and op not in ("note", "citation"))]
            steps["pattern"] += [Step(op, *span) for span in reversed(spans) if within(span) for op in inline]
            places = [own] if own else list(reversed(spans))
            steps["pattern"] += [Step(op, *span, selected=own is not None) for span in places for op in ops if op not in inline]
        elif c.formats or not single:
            if c.scope == "selection" and not selection:
                continue  # a tool for selections does nothing without one
            place = chosen if chosen and c.scope != "page" else (0, len(text))
            steps["entry"] += [Step(op, *place, selected=place == chosen) for op in ops]
        if rule.mode == "first":
            break
    return [s for part in steps.values() for s in part]


def apply_rules(markup: str, rules: list[dict], rule_id: str | None = None, selection: tuple[int, int] | None = None) -> tuple[str, str | None]:
    """The formatted page and null, or the page as it was and what went wrong.

    After ``remove`` only operations of groups and single matches go on, and it is left out where something was done before.
    """
    try:
        chosen = [Rule.of(r) for r in rules if rule_id is None or str(r.get("id")) == rule_id]
        if not chosen:
            return markup, "no such rule"
        patterns = [p for r in chosen for c in r.conditions for p in (c.pattern * (c.type == "regex"), c.between_end_pattern) if p]
        if not all(map(regex_is_safe, patterns)):
            return markup, "unsafe pattern"
        page, begun, removed = Formatter(markup), False, False
        for rule in chosen:
            for step in plan(rule, page.text, selection):
                if step.loose or not (removed or (step.op == "remove" and begun)):
                    page.apply(step)
                    begun, removed = True, removed or step.op == "remove"
        page.settle()
        return page.tree.html(), None
    except (re.error, ValueError, IndexError) as e:
        return markup, f"{type(e).__name__}: {e}"


def format_pages(df: DataFrame, html_col: str, rules: list[dict], rule_id: str | None = None) -> DataFrame:
    """Adds formatted, a struct of html and error; rules go along with the function."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("struct<html:string,error:string>")
    def run(v):
        import pyarrow as pa

        out = [apply_rules(x or "", rules, rule_id) for x in v.to_pylist()]
        return pa.array([{"html": h, "error": e} for h, e in out], pa.struct([("html", pa.string()), ("error", pa.string())]))

    return df.withColumn("formatted", run(F.col(html_col)))


def replace_rules(c: Column, rules: list[dict]) -> Column:
    """Ordered regex replacements as native expressions; ``keep_groups`` keeps these groups' text and nothing else."""
    for r in rules:
        if not r.get("enabled", True) or not regex_is_safe(r["pattern"]):
            continue
        flags = "".join(sorted(set(r.get("flags", "")) & set("ims")))
        to = "".join(f"${k}" for k in r["keep_groups"]) if r.get("keep_groups") else r.get("replacement", "").replace("\\", "\\\\").replace("$", "\\$")
        c = F.regexp_replace(c, (f"(?{flags})" if flags else "") + r["pattern"], to)
    return c


def contains_ranges(text: Column, term: str) -> Column:
    """Starts (from 0) of all occurrences of a term, overlapping ones too."""

    def starts(pieces):
        ends = running(pieces, F.lit(0), lambda a, x: a + F.length(x))
        return F.zip_with(pieces, ends, lambda x, e: e - F.length(x))

    # The text is cut before each occurrence; where one begins inside another, its piece is shorter than the term.
    cut = let(F.split(text, f"(?=\\Q{term}\\E)"), starts)
    first = F.when(F.startswith(text, F.lit(term)), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    later = let(cut, lambda c: F.slice(c, F.lit(2), F.size(c)))
    return F.when(F.contains(text, F.lit(term)), F.concat(first, later)).otherwise(F.array().cast("array<int>"))


def char_style(style: Column) -> Column:
    """The declarations for characters in a fixed order, of each the last that is valid; sizes are rounded, from 8 to 72 px."""
    size = r"(?i)^([0-9]{1,4}(?:\.[0-9]+)?)\s*px$"
    family = lambda v: u_trim(F.regexp_replace(F.translate(v, "\"'", ""), r"\s+", " "))
    forms = {
        "text-align": lambda v: F.when(F.lower(v).isin("left", "center", "right"), F.lower(v)),
        "font-size": lambda v: F.when(v.rlike(size), F.concat(F.greatest(F.lit(8), F.least(F.lit(72), F.bround(F.regexp_extract(v, size, 1).try_cast("double")).cast("int"))).cast("string"), F.lit("px"))),
        "font-family": lambda v: F.when(family(v).isin(*FONTS), family(v)),
        "color": lambda v: F.when(v.rlike("^#[0-9a-fA-F]{3,8}$"), F.lower(v)).when(v.rlike("^[a-zA-Z]{3,20}$"), v),
    }
    said = F.filter(F.split(F.coalesce(style, F.lit("")), ";"), lambda d: F.contains(d, F.lit(":")))
    pairs = F.transform(said, lambda d: F.struct(F.lower(u_trim(F.substring_index(d, ":", 1))).alias("name"), u_trim(F.substring(d, F.instr(d, ":") + 1, F.length(d))).alias("value")))

    def written(given, name):
        values = F.array_compact(F.transform(F.filter(given, lambda x: x["name"] == name), lambda x: forms[name](x["value"])))
        return F.concat(F.lit(f"{name}:"), F.try_element_at(values, F.lit(-1)))

    return let(pairs, lambda given: F.concat_ws(";", *[written(given, n) for n in CHARACTER_STYLES]))


def merge_barrier(prev: Column, cur: Column) -> Column:
    """Whether a paragraph must not go on the one before it: that ended, or this begins a list, quote or indent."""
    return prev.isNull() | prev.rlike(r"[。！？!?.：:；;…]$") | cur.rlike(r"^([0-9]+[.、)）]|[-•·*]|[　 ]{2}|[“「『（(])")


def merged_paragraphs(rows: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Paragraphs of each key with what goes on them joined."""
    from pyspark.sql import Window

    given = rows.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(text).alias("t"))
    w = Window.partitionBy("k").orderBy("o")
    grouped = given.withColumn("n", F.sum(F.when(merge_barrier(F.lag("t").over(w), F.col("t")), 1).otherwise(0)).over(w))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "t"))), lambda x: x["t"]), "")
    return grouped.groupBy(F.col("k").alias(key), "n").agg(whole.alias("text"))


def page_errors(text: Column) -> Column:
    """Kinds of suspicious places of a page: half-width marks beside Chinese, repeats, odd quotes, mixed fragments."""
    han = r"[\x{4e00}-\x{9fff}]"
    kinds = {"half_width": rf"{han}[,;:?!]", "repeat": rf"({han})\1\1", "mixed": rf"{han}[a-zA-Z]{{1,2}}{han}"}
    found = [F.when(text.rlike(p), k) for k, p in kinds.items()]
    odd = F.when(F.regexp_count(text, F.lit('"')) % 2 == 1, "quotes")
    return F.array_compact(F.array(*found, odd))


def outside_tables(markup: Column) -> Column:
    """A page without its tables; one that is not closed goes on to the end."""
    return F.regexp_replace(markup, r"(?is)<table\b.*?(?:</table\s*>|\z)", "")


def nonoverlapping(suggestions: Column, taken: Column) -> Column:
    """The suggestions (structs with start and end, in the order given) that overlap neither a span taken before nor one
    another that was kept; empty ones go."""
    meets = lambda spans, x: F.exists(spans, lambda k: (k["start"] < x["end"]) & (x["start"] < k["end"]))
    fine = F.filter(suggestions, lambda x: (x["start"] < x["end"]) & ~meets(taken, x))
    return F.aggregate(fine, F.slice(fine, 1, 0), lambda kept, x: F.when(meets(kept, x), kept).otherwise(F.concat(kept, F.array(x))))


def reads_differently(page: Column, again: Column) -> Column:
    """Whether a second recognition of a page differs in more than white space."""
    return cer_form(page) != cer_form(again)


def _has_format(e: list, op: str) -> bool:
    tag, cls = INLINE[op]
    return e[0] == "open" and e[1] == tag and (cls is None or cls in e[2].get("class", "").split())


def texts_with_format(markup: str, op: str) -> list[tuple[int, int, str]]:
    """Start, end and text of each stretch of a page that has an inline format."""
    found, inside, stack, at = [], 0, [], 0
    for e in parse_events(markup):
        if e[0] == "open":
            stack.append(_has_format(e, op))
            inside += stack[-1]
        elif e[0] == "close":
            inside -= stack.pop()
        elif e[0] == "text" and e[1]:
            if inside and found and found[-1][1] == at:
                found[-1] = (found[-1][0], at + len(e[1]), found[-1][2] + e[1])
            elif inside:
                found.append((at, at + len(e[1]), e[1]))
            at += len(e[1])
    return found


def replace_format(markup: str, op: str, to: str) -> str:
    """A page whose texts with one inline format have another instead; other classes and attributes stay."""
    tag, cls = INLINE[to]
    out, stack = [], []
    for e in parse_events(markup):
        if e[0] == "open":
            closing = [e[1]]
            if _has_format(e, op):
                kept = [c for c in e[2].get("class", "").split() if c != INLINE[op][1]]
                attrs = {k: v for k, v in e[2].items() if k != "class"}
                if cls is not None:
                    out.append(["open", tag, attrs | {"class": " ".join([*kept, cls])}])
                    closing = [tag]
                elif kept or (attrs and e[1] == "span"):
                    out += [["open", "span", attrs | ({"class": " ".join(kept)} if kept else {})], ["open", tag, {}]]
                    closing = [tag, "span"]
                else:
                    out.append(["open", tag, attrs])
                    closing = [tag]
            else:
                out.append(e)
            stack.append(closing)
        elif e[0] == "close":
            out += [["close", t, {}] for t in stack.pop()]
        else:
            out.append(e)
    return serialize(out)


def normal_rules(raw: list[dict]) -> list[dict]:
    """Rules as they are stored: known operations, targets and kinds only, an id and a name for each."""
    out = []
    for n, r in enumerate(raw, 1):
        rule = Rule.of(r)
        conditions = []
        for c in rule.conditions:
            target = c.target if c.target in ("match", "before", "after", "between") else "match"
            kind = c.type if c.type in ("contains", "regex", "prefix", "suffix") else "contains"
            conditions.append({"type": kind, "pattern": c.pattern, "scope": c.scope, "formats": c.formats, "target": target})
        out.append({"id": rule.id if r.get("id") is not None else str(n), "name": str(r.get("name") or f"rule {n}"), "mode": rule.mode if rule.mode in ("first", "all") else "first", "conditions": conditions})
    return out
