"""Document LaTeX read as one list of marks: zones of mathematics, blocks, labels and findings.

A text is scanned once. Its marks are the places where a command, an edge of an environment, a
brace, a dollar sign, a comment, a verbatim part or a blank line stands; everything else here is
computed from the marks and their places, in time that grows with the text (and a logarithm).
Nothing raises on content but LabelError. Offsets are code points.
"""

from __future__ import annotations

import posixpath
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from dataclasses import dataclass

from . import mathtex

# The vocabulary of the checked profile.
PACKAGES = {
    "amsfonts", "amsmath", "amssymb", "booktabs", "endnotes", "enumitem", "fontspec", "graphicx", "hyperref", "mathtools", "multicol", "multirow",
    "ragged2e", "soul", "todonotes", "ulem", "xcolor", "xfrac",
}
ENVIRONMENTS = {
    "align", "align*", "center", "description", "document", "enumerate", "equation", "equation*", "figure", "figure*", "flushleft", "flushright", "gather", "gather*",
    "itemize", "justify", "multicols", "multicols*", "quotation", "quote", "table", "tabular", "tabular*", "verbatim",
}
REQUIRES = {
    "align": "amsmath", "bottomrule": "booktabs", "cellcolor": "xcolor", "colorbox": "xcolor", "description": "enumitem", "endnote": "endnotes", "enumerate": "enumitem",
    "equation": "amsmath", "gather": "amsmath", "genfrac": "amsmath", "hl": "soul", "href": "hyperref", "includegraphics": "graphicx", "itemize": "enumitem",
    "justify": "ragged2e", "midrule": "booktabs", "multicols": "multicol", "multirow": "multirow", "setmainfont": "fontspec", "setmonofont": "fontspec", "sfrac": "xfrac",
    "sout": "ulem", "textcolor": "xcolor", "todo": "todonotes", "toprule": "booktabs", "url": "hyperref",
}
COMMANDS = {
    "Alph", "Roman", "alph", "arabic", "author", "bottomrule", "caption", "cellcolor", "centering", "cite", "cline", "color", "colorbox", "date", "documentclass", "emph",
    "endnote", "footnote", "hl", "hline", "href", "includegraphics", "item", "label", "ldots", "linewidth", "maketitle", "midrule", "multicolumn", "multirow", "newpage",
    "noindent", "pageref", "par", "qquad", "quad", "ref", "roman", "section", "setmainfont", "setmonofont", "sout", "subsection", "subsubsection", "tableofcontents",
    "textasciicircum", "textasciitilde", "textbackslash", "textbf", "textcolor", "textit", "textsc", "textsubscript", "textsuperscript", "texttt", "textwidth", "title", "todo",
    "toprule", "underline", "url", "usepackage",
}
FRAGMENTS = {"block", "document", "inline", "math", "resource-reference"}
CARRIERS = {"hlight", "linfrac", "nobarfrac", "skwfrac"}
LIST_OPTIONS, TODO_OPTIONS = {"label", "start"}, {"color", "inline"}
MAX_DEPTH = 4

#: Commands that define commands or environments, and the code of the finding.
DEFINES = dict.fromkeys(("def", "edef", "gdef", "let", "newcommand", "providecommand", "renewcommand"), "macro-definition") | dict.fromkeys(("newenvironment", "renewenvironment"), "custom-environment")
#: What a block's first mark makes of it.
HEADINGS = {"section": 1, "subsection": 2, "subsubsection": 3}
LISTS = {"description", "enumerate", "itemize"}
BLOCK_KINDS = dict.fromkeys(LISTS, "list") | {"table": "table", "tabular": "table", "figure": "figure"} | dict.fromkeys(("align", "displaymath", "equation", "gather"), "equation")
#: Environments of mathematics; those of rows keep their frame in a zone's text.
FRAMED, UNFRAMED = {"align", "eqnarray", "gather", "multline"}, {"displaymath", "equation"}
#: Environments whose edges only stand between blocks.
TRANSPARENT = {"multicols", "multicols*"}
BLOCK_WORDS = {*HEADINGS, "item", "newpage"}


@dataclass(frozen=True, slots=True)
class Mark:
    """kind: word (a command), sign (a backslash and another sign), begin, end, open, close, dollar, comment, verbatim or gap (a blank line)."""

    kind: str
    name: str
    start: int
    end: int

    @property
    def base(self) -> str:
        return self.name.removesuffix("*")


_LEX = re.compile(
    r"""(?P<verbatim>\\begin\{verbatim\}.*?(?:\\end\{verbatim\}|\Z)|\\verb\*?(?P<quote>[^\sA-Za-z*]).*?(?:(?P=quote)|(?=\n)|\Z))
      | (?P<comment>%[^\n]*)
      | \\begin\s*\{(?P<begin>[^{}\n]*)\} | \\end\s*\{(?P<end>[^{}\n]*)\}
      | \\(?P<word>[A-Za-z]+\*?) | \\(?P<sign>.)
      | (?P<open>\{) | (?P<close>\}) | (?P<dollar>\$) | (?P<gap>\n[ \t]*(?=\n))""",
    re.X | re.S,
)
_NAMED = {"begin", "end", "word", "sign"}


def marks(text: str) -> list[Mark]:
    """All marks of a text, in order; they don't overlap."""
    out = []
    for m in _LEX.finditer(text):
        kind = "verbatim" if m["verbatim"] is not None else m.lastgroup
        out.append(Mark(kind, m[kind] if kind in _NAMED else "", m.start(), m.end()))
    return out


@dataclass(frozen=True)
class Zone:
    start: int
    end: int
    display: bool
    tex: str


def _without(text: str, a: int, b: int, hidden: list[Mark]) -> str:
    """text[a:b] with blanks where these marks stand."""
    out = []
    for m in hidden:
        if a <= m.start and m.end <= b:
            out += [text[a : m.start], " "]
            a = m.end
    return "".join([*out, text[a:b]])


class _Places:
    """Where marks of each kind and name stand, and two dollar signs side by side."""

    def __init__(self, found: list[Mark]):
        self.at = defaultdict(list)
        for k, m in enumerate(found):
            self.at[m.kind, m.name].append(k)
            if m.kind == "dollar" and k + 1 < len(found) and found[k + 1].kind == "dollar" and found[k + 1].start == m.end:
                self.at["pair", ""].append(k)
        self.pairs = set(self.at["pair", ""])

    def after(self, k: int, kind: str, name: str = "") -> int | None:
        """The first such mark after mark k."""
        places = self.at[kind, name]
        i = bisect_right(places, k)
        return places[i] if i < len(places) else None


def _zones(text: str, found: list[Mark]) -> list[Zone]:
    places, hidden = _Places(found), [m for m in found if m.kind in ("comment", "verbatim")]
    starts = [m.start for m in hidden]
    out, k = [], 0
    while k < len(found):
        m, first, close, last = found[k], k, None, 0
        if m.kind == "sign" and m.name in "([":
            close = places.after(k, "sign", ")" if m.name == "(" else "]")
        elif m.kind == "begin" and m.base in FRAMED | UNFRAMED:
            close = places.after(k, "end", m.name)
        elif k in places.pairs:
            first, last = k + 1, 1
            close = places.after(first, "pair")
        elif m.kind == "dollar":
            close, gap = places.after(k, "dollar"), places.after(k, "gap")
            close = None if gap is not None and close is not None and gap < close else close
        if close is None:
            k = first + 1
            continue
        a, b, end = found[first].end, found[close].start, found[close + last].end
        inside = hidden[bisect_left(starts, m.start) : bisect_left(starts, end)]
        tex = _without(text, m.start, end, inside) if m.kind == "begin" and m.base in FRAMED else _without(text, a, b, inside)
        out.append(Zone(m.start, end, m.kind == "begin" or m.name == "[" or last == 1, tex.strip()))
        k = close + last + 1
    return out


def zones(text: str) -> list[Zone]:
    """All mathematics of a text: brackets, parentheses, dollars (inline ones within a paragraph) and environments; comments and verbatim don't count."""
    return _zones(text, marks(text))


def _groups(found: list[Mark]) -> dict[int, int]:
    """Where each braced group begins and ends."""
    out, stack = {}, []
    for m in found:
        if m.kind == "open":
            stack.append(m.start)
        elif m.kind == "close" and stack:
            out[stack.pop()] = m.end
    return out


def _environments(found: list[Mark]) -> tuple[dict[int, tuple[int | None, str | None]], list[Mark]]:
    """Of each environment's beginning: its end (None: there is none) and what is wrong; and the ends that end nothing.

    An end whose beginning lies farther out ends what is open within too; one without any beginning ends all that is open."""
    out, stack, stray, n_open = {}, [], [], Counter()
    for m in found:
        if m.kind == "begin":
            stack.append(m)
            n_open[m.name] += 1
        elif m.kind == "end" and not stack:
            stray.append(m)
        elif m.kind == "end":
            known = n_open[m.name] > 0
            while stack and not (known and stack[-1].name == m.name):
                x = stack.pop()
                n_open[x.name] -= 1
                out[x.start] = m.end, f"ended as {m.name}"
            if known:
                n_open[m.name] -= 1
                out[stack.pop().start] = m.end, None
    return out | {x.start: (None, f"unterminated {x.name}") for x in stack}, stray


def _body(found: list[Mark], size: int) -> tuple[int, int]:
    first = next((m.end for m in found if m.kind == "begin" and m.name == "document"), None)
    last = next((m.start for m in found if m.kind == "end" and m.name == "document" and first is not None and m.start >= first), None)
    return (0, size) if last is None else (first, last)


def body(text: str) -> tuple[int, int]:
    """Where the document's body begins and ends; all of a text without an envelope."""
    return _body(marks(text), len(text))


@dataclass(frozen=True)
class Block:
    kind: str
    level: int | None
    text: str
    start: int
    end: int
    warning: str | None = None
    label: int | None = None


class LabelError(ValueError):
    """A label without a block, or one that occurs twice."""


class _Extents:
    """Where blocks with a beginning of their own end."""

    def __init__(self, text: str, found: list[Mark], last: int):
        self.text, self.last = text, last
        self.environments, _ = _environments([m for m in found if m.name not in TRANSPARENT])
        self.groups, self.pairs = _groups(found), _Places(found).pairs
        self.gaps = [m.start for m in found if m.kind == "gap"]
        self.display, self.inline = {}, {}
        for z in _zones(text, found):
            (self.display if z.display else self.inline)[z.start] = z.end

    def to_gap(self, at: int) -> int:
        """The next blank line, where a broken block ends."""
        i = bisect_right(self.gaps, at)
        return self.gaps[i] + 1 if i < len(self.gaps) else self.last

    def of(self, k: int, m: Mark) -> tuple[int, str | None, int | None, str | None] | None:
        """(end, kind or None if it is no block, level, warning) of the block that mark k begins, if it does."""
        if m.kind in ("begin", "end") and m.name in TRANSPARENT:
            more = re.compile(r"(?:\s*\[[^\]]*\])?(?:\s*\{[^{}]*\})?").match(self.text, m.end)
            return (more.end() if m.kind == "begin" else m.end), None, None, None
        if m.kind == "begin":
            end, wrong = self.environments[m.start]
            return (self.to_gap(m.start) if end is None else end), BLOCK_KINDS.get(m.base, "p"), None, wrong
        if (m.kind == "sign" and m.name == "[") or k in self.pairs:
            end = self.display.get(m.start)
            return (self.to_gap(m.start), "equation", None, "unterminated display") if end is None else (end, "equation", None, None)
        if m.kind == "word" and m.base in HEADINGS:
            group = re.compile(r"\s*(?=\{)").match(self.text, m.end)
            if group:
                end = self.groups.get(group.end())
                return (self.to_gap(m.start), "heading", HEADINGS[m.base], "unbalanced braces") if end is None else (end, "heading", HEADINGS[m.base], None)
        if m.kind == "word" and m.name == "newpage":
            return m.end, "page", None, None
        return None


def blocks(text: str, marker: str = "%lw:") -> list[Block]:
    """Blocks in order. Headings, environments, display mathematics and page breaks outside groups are blocks; what lies between them is cut into paragraphs at blank lines. Broken blocks end at the next blank line, with a warning. A line marker kind:number above a block labels it."""
    every = marks(text)
    first, last = _body(every, len(text))
    found = [m for m in every if first <= m.start and m.end <= last]
    extents, out = _Extents(text, found, last), []
    label = re.compile(rf"{re.escape(marker)}([a-z]+):(\d+)")
    at = begin = first
    depth, pending = 0, None

    def put(a: int, b: int, kind: str, level: int | None, warning: str | None) -> None:
        nonlocal pending
        raw = text[a:b]
        if not raw.strip():
            return
        if pending and pending[0] not in (kind, "p" if kind == "heading" else kind):
            warning = warning or f"{pending[0]} label before {kind}"
        out.append(Block(kind, level, raw.strip(), a + len(raw) - len(raw.lstrip()), b, warning, pending and pending[1]))
        pending = None

    def prose(b: int) -> None:
        start = re.compile(r"\s*").match(text, begin, max(begin, b)).end()
        put(start, b, "figure" if "\\includegraphics" in text[start : min(b, start + 160)] else "p", None, "unbalanced braces" if depth else None)

    for k, m in enumerate(found):
        if m.start < at:
            continue
        named = label.match(text, m.start) if m.kind == "comment" else None
        line = (text.rfind("\n", begin, m.start) + 1 or begin) if named else begin
        if named and not text[line : m.start].strip():
            prose(line)
            if pending:
                raise LabelError("a label isn't followed by a block")
            pending, depth = (named[1], int(named[2])), 0
            begin = at = min(last, m.end + 1)
        elif m.start in extents.inline:
            at = extents.inline[m.start]
        elif m.kind in ("open", "close"):
            depth = max(0, depth + (1 if m.kind == "open" else -1))
        elif depth == 0 and m.kind == "gap":
            prose(m.start)
            begin = m.end
        elif depth == 0 and (extent := extents.of(k, m)):
            prose(m.start)
            end, kind, level, warning = extent
            if kind:
                put(m.start, end, kind, level, warning)
            begin = at = max(end, m.end)
    prose(last)
    if pending:
        raise LabelError("a label isn't followed by a block")
    labels = [b.label for b in out if b.label is not None]
    if len(labels) != len(set(labels)):
        raise LabelError("a label occurs twice")
    return out


@dataclass(frozen=True)
class Finding:
    """What breaks the profile: the code, what it is about, and where it stands."""

    code: str
    subject: str
    offset: int


_OPTIONS, _ARGUMENT = re.compile(r"\s*\[([^\]]*)\]"), re.compile(r"\s*(?:\[[^\]]*\])?\s*\{([^{}]*)\}")
_COUNTER = re.compile(r"\\(?:arabic|alph|Alph|roman|Roman)(?:\*|\{[A-Za-z]+\})?|\\(?:textbf|emph|textit|texttt|textsc|underline|sout)\{[^{}]*\}")


def _options(text: str, m: Mark, known: set[str]):
    """(key, value, whether it is allowed) of a command's or environment's options."""
    found = _OPTIONS.match(text, m.end)
    for item in found[1].split(",") if found else ():
        key, _, value = (x.strip() for x in item.partition("="))
        good = key in known and (key == "inline" or bool(value))
        if key == "start":
            good &= value.isdigit()
        elif key == "label":
            good &= not re.search(r"[\\{}\s,]", _COUNTER.sub("", value))
        yield item.strip(), good


class _Facts:
    """What the rules ask of a text."""

    def __init__(self, text: str, fragment: str, resources: set[str] | None):
        self.text, self.whole, self.inline, self.resources = text, fragment == "document", fragment == "inline", resources
        self.found = marks(text)
        self.zones = _zones(text, self.found)
        self.starts = [z.start for z in self.zones]
        self.packages = {p for m in self.found if m.name == "usepackage" for p in self.names(m)}

    def names(self, m: Mark) -> list[str]:
        """The names in a command's argument."""
        found = _ARGUMENT.match(self.text, m.end)
        return [x.strip() for x in found[1].split(",")] if found else []

    def in_math(self, at: int) -> bool:
        i = bisect_right(self.starts, at) - 1
        return i >= 0 and at < self.zones[i].end

    def lacks(self, name: str) -> str | None:
        """The package that a command or environment of a whole document needs and hasn't."""
        need = REQUIRES.get(name.removesuffix("*"))
        return need if self.whole and need and need not in self.packages else None


def _of_words(f: _Facts):
    """Findings about commands."""
    for m in f.found:
        if m.kind != "word":
            continue
        name = m.base
        if name in DEFINES:
            yield DEFINES[name], m.name, m.start
        elif name in CARRIERS:
            yield "forbidden-word-carrier", name, m.start
        elif name == "usepackage":
            yield from (("unapproved-package", p, m.start) for p in f.names(m) if p not in PACKAGES)
        elif name == "includegraphics" and f.resources is not None:
            path = ",".join(f.names(m)).replace("\\", "/")
            if not safe_path(path) or path not in f.resources:
                yield "new-resource", path, m.start
        elif name == "todo":
            yield from (("unknown-command", item, m.start) for item, good in _options(f.text, m, TODO_OPTIONS) if not good)
        if f.inline and name in BLOCK_WORDS:
            yield "invalid-nesting", name, m.start
        if name in DEFINES or name in CARRIERS or f.in_math(m.start):
            continue
        if name not in COMMANDS:
            yield "unknown-command", name, m.start
        if need := f.lacks(name):
            yield "unapproved-package", f"{need} for {name}", m.start


def _of_environments(f: _Facts):
    """Findings about environments: names, balance, packages, list depth and list options."""
    outside = [m for m in f.found if m.kind in ("begin", "end") and not f.in_math(m.start)]
    ends, stray = _environments(outside)
    depth = 0
    for m in f.found:
        if m.kind not in ("begin", "end"):
            continue
        if m.name in LISTS:
            depth = max(0, depth + (1 if m.kind == "begin" else -1))
            if m.kind == "begin" and depth > MAX_DEPTH:
                yield "invalid-nesting", f"list depth {depth}", m.start
        if f.inline:
            yield "invalid-nesting", m.name, m.start
        if m.kind == "begin":
            if need := f.lacks(m.name):
                yield "unapproved-package", f"{need} for {m.name}", m.start
            if m.name in LISTS:
                yield from (("unknown-command", item, m.start) for item, good in _options(f.text, m, LIST_OPTIONS) if not good)
    for m in outside:
        if m.kind == "begin" and m.name not in ENVIRONMENTS:
            yield "custom-environment", m.name, m.start
        if m.kind == "begin" and ends[m.start][1]:
            yield "broken-environment", f"{m.name}: {ends[m.start][1]}", m.start
    yield from (("broken-environment", f"{m.name}: ends nothing", m.start) for m in stray)


def _of_math(f: _Facts):
    """Findings about mathematics: every zone must parse; rows may end with an empty one."""
    for z in f.zones:
        try:
            mathtex.parse(re.sub(r"(?:\\\\\s*)+$", "", z.tex))
        except mathtex.MathError as e:
            yield "unknown-math-command", e.message, z.start
        except RecursionError:
            yield "unknown-math-command", "nested too deeply", z.start


def _of_whole(f: _Facts):
    """Findings about a whole document's envelope."""
    if f.whole and not any(m.kind == "word" and m.name == "documentclass" for m in f.found):
        yield "invalid-fragment-kind", "no documentclass", 0
    if f.whole and _body(f.found, len(f.text)) == (0, len(f.text)):
        yield "broken-environment", "no document", 0


def findings(text: str, fragment: str = "document", resources: set[str] | None = None) -> list[Finding]:
    """What breaks the profile, in order of place and code. With resources, images must be among them."""
    if fragment not in FRAGMENTS:
        return [Finding("invalid-fragment-kind", fragment, 0)]
    f = _Facts(text, fragment, resources)
    out = [Finding(*x) for rule in (_of_whole, _of_words, _of_environments, _of_math) for x in rule(f)]
    if fragment == "math" and not f.zones:
        out.append(Finding("invalid-nesting", "no mathematics", 0))
    return sorted(out, key=lambda x: (x.offset, x.code, x.subject))


def line_column(text: str, offsets: list[int]) -> list[tuple[int, int]]:
    """Lines and columns, from 1, of code-point offsets."""
    breaks = [m.start() for m in re.finditer("\n", text)]
    rows = [bisect_left(breaks, at) for at in offsets]
    return [(row + 1, at - (breaks[row - 1] + 1 if row else 0) + 1) for row, at in zip(rows, offsets, strict=True)]


def safe_path(path: str) -> bool:
    """Relative, without a scheme, and not leading out of its folder."""
    flat = posixpath.normpath(path)
    return bool(path) and not path.startswith("/") and not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path) and flat != ".." and not flat.startswith("../") and not set(path) & set("?#")
