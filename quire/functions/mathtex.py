"""Mathematical LaTeX: tokens, macros, a tree, and its canonical spelling.

A zone is parsed on its own, without state between zones, so the functions run in Arrow UDFs
and table functions over any number of rows. Failures are data: MathError carries a class, an
offset and the token.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

from . import mathsigns as S


class MathError(Exception):
    """kind: unknown_macro, unsupported, unbalanced, malformed, unexpected or definition."""

    def __init__(self, kind: str, message: str, pos: int = 0, token: str = ""):
        super().__init__(f"{message} at {pos}")
        self.kind, self.message, self.pos, self.token = kind, message, pos, token


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    pos: int


@dataclass(frozen=True)
class Node:
    """type, the text of a leaf, properties, and the children by slot."""

    type: str
    value: str = ""
    props: tuple[tuple[str, str], ...] = ()
    kids: tuple[tuple[str, Node], ...] = field(default=())

    def slot(self, name: str) -> Node | None:
        return next((k for s, k in self.kids if s == name), None)

    def slots(self, name: str) -> list[Node]:
        return [k for s, k in self.kids if s == name]

    def prop(self, name: str, default: str = "") -> str:
        return dict(self.props).get(name, default)


def row(items) -> Node:
    return Node("row", kids=tuple(("item", x) for x in items))


# --- tokens ---------------------------------------------------------------------------------

_LEX = re.compile(r"(?P<space>\s+)|(?P<macro>\\(?:[A-Za-z]+|.))|(?P<digits>[0-9]+)|(?P<sign>.)", re.S)
_SIGN_KIND = {"{": "lbrace", "}": "rbrace", "_": "sub", "^": "sup", "'": "prime", "&": "amp"}
_RAW = {"\\text": 1, "\\operatorname": 1, "\\mathrm": 1, "\\label": 1, "\\hspace": 1, "\\genfrac": 4}
_DECLARE = {"\\newcommand", "\\renewcommand", "\\def", "\\DeclareMathOperator"}


def group_end(text: str, at: int) -> int:
    """The place after the group that opens at at; -1 if it doesn't close."""
    depth = 0
    for m in re.compile(r"\\.|[{}]", re.S).finditer(text, at):
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if depth == 0:
            return m.end()
    return -1


def _skip(text: str, at: int) -> int:
    return re.compile(r"\s*").match(text, at).end()


def _group(text: str, at: int, macro: str, start: int) -> tuple[str, int]:
    at = _skip(text, at)
    if text[at : at + 1] != "{":
        raise MathError("malformed", f"{macro} without a braced argument", start, macro)
    end = group_end(text, at)
    if end < 0:
        raise MathError("unbalanced", "unterminated group", at, "{")
    return text[at + 1 : end - 1], end


def tokenize(text: str) -> list[Token]:
    """Tokens without white space; raw arguments, environment names and declarations are one token each."""
    out, at = [], 0
    while at < len(text):
        m = _LEX.match(text, at)
        if text[at] == "\\" and m.lastgroup != "macro":
            raise MathError("malformed", "lone backslash at the end", at, "\\")
        start, at, word = at, m.end(), m[0]
        if m.lastgroup == "space":
            continue
        if m.lastgroup == "digits":
            out.append(Token("digits", word, start))
        elif m.lastgroup == "sign":
            out.append(Token(_SIGN_KIND.get(word, "char"), word, start))
        elif word == "\\\\":
            out.append(Token("rowsep", word, start))
        elif word in ("\\begin", "\\end"):
            name, at = _group(text, at, word, start)
            out.append(Token(word[1:], name.strip(), start))
        elif word in _DECLARE:
            at = _declaration_end(text, at, word, start)
            out.append(Token("defspec", text[start:at], start))
        else:
            out.append(Token("macro", word, start))
            for _ in range(_RAW.get(word, 0)):
                raw, at = _group(text, at, word, start)
                out.append(Token("rawarg", raw, start))
    return [*out, Token("eof", "", len(text))]


_DEF_HEAD = re.compile(r"\s*\\[A-Za-z]+\s*(?:#[1-9]\s*)*(?=\{)")
_NEW_HEAD = re.compile(r"\s*(?:\{\s*\\[A-Za-z]+\s*\}|\\[A-Za-z]+)\s*(?:\[[^\]]*\]\s*)*(?=\{)")


def _declaration_end(text: str, at: int, macro: str, start: int) -> int:
    m = (_DEF_HEAD if macro == "\\def" else _NEW_HEAD).match(text, at)
    if not m:
        raise MathError("malformed", f"{macro} without a name and body", start, macro)
    return at + len(m[0]) + len(_group(text, m.end(), macro, start)[0]) + 2


# --- user macros ----------------------------------------------------------------------------

_SPEC = re.compile(r"\\(newcommand|renewcommand|def|DeclareMathOperator)\s*\{?\s*\\([A-Za-z]+)\s*\}?\s*((?:#[1-9]\s*)*)(?:\[\s*([0-9])\s*\]\s*)?(\[[^\]]*\]\s*)?\{(.*)\}\Z", re.S)
DEEPEST = 16


def macro_definition(spec: str) -> tuple[str, int, str]:
    """(name, number of arguments, body) of a declaration."""
    m = _SPEC.match(spec.strip())
    if not m or m[5]:
        raise MathError("definition", "unsupported declaration", 0, spec[:20])
    kind, name, marks, count, _, body = m.groups()
    n = marks.count("#") if kind == "def" else int(count or 0)
    if kind == "def" and [int(x) for x in re.findall("[1-9]", marks)] != list(range(1, n + 1)):
        raise MathError("definition", "parameters out of order", 0, name)
    if any(int(x) > n for x in re.findall(r"(?<!#)#([1-9])", body)):
        raise MathError("definition", "a parameter that isn't declared", 0, name)
    return name, n, f"\\operatorname{{{body}}}" if kind == "DeclareMathOperator" else body


def expand(text: str) -> tuple[str, list[str]]:
    """The text with its own macro declarations applied, and warnings; unchanged where nothing is declared."""
    if not re.search(r"\\(newcommand|renewcommand|def|DeclareMathOperator|ensuremath)(?![A-Za-z])", text):
        return text, []
    known: dict[str, tuple[int, str]] = {"ensuremath": (1, "#1")}
    warnings: list[str] = []

    def run(source: str, depth: int) -> str:
        if depth > DEEPEST:
            raise MathError("definition", "macros nest too deep", 0, source[:20])
        out, at = [], 0
        for m in iter(lambda: re.compile(r"\\[A-Za-z]+").search(source, at), None):
            out.append(source[at : m.start()])
            word, at = m[0], m.end()
            if word in _DECLARE:
                end = _declaration_end(source, at, word, m.start())
                name, n, body = macro_definition(source[m.start() : end])
                if word == "\\renewcommand" and name not in known:
                    warnings.append(f"\\{name} is redefined but was not defined")
                known[name], at = (n, body), end
            elif word[1:] in known:
                n, body = known[word[1:]]
                args = []
                for _ in range(n):
                    at = _skip(source, at)
                    if source[at : at + 1] == "{":
                        arg, at = _group(source, at, word, m.start())
                    else:
                        one = re.compile(r"\\[A-Za-z]+|\\.|[^\s{}]", re.S).match(source, at)
                        if not one:
                            raise MathError("malformed", f"{word} without its argument", m.start(), word)
                        arg, at = one[0], one.end()
                    args.append(arg)
                filled = re.sub(r"##|#([1-9])", lambda p: "#" if p[0] == "##" else args[int(p[1]) - 1], body)
                filled = run(filled, depth + 1)
                joins = re.search(r"\\[A-Za-z]+\Z", filled) and source[at : at + 1].isalpha()
                out.append(filled + " " * bool(joins))
            else:
                out.append(word)
        return "".join([*out, source[at:]])

    return run(text, 0), warnings


# --- tree -----------------------------------------------------------------------------------

_HEAD = "nary_head"


def _at_end(t: Token) -> bool:
    return t.kind == "eof"


def _at_brace(t: Token) -> bool:
    return t.kind == "rbrace"


class Parser:
    """Recursive descent over one zone."""

    def __init__(self, text: str):
        self.tokens, self.at, self.warnings = tokenize(text), 0, []

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def take(self) -> Token:
        self.at += 1
        return self.tokens[self.at - 1]

    def fail(self, kind: str, message: str, t: Token | None = None):
        t = t or self.now
        raise MathError(kind, message, t.pos, t.text)

    def name(self, t: Token | None = None) -> str:
        """The canonical macro name at a token, without backslash; empty for other tokens."""
        t = t or self.now
        return S.ALIASES.get(t.text[1:], t.text[1:]) if t.kind == "macro" else ""

    # sequences

    def sequence(self, stop, opener: Token | None = None, open_ended: bool = False) -> Node:
        """Atoms up to a token that stops, which is left."""
        items = []
        while not stop(self.now):
            if self.now.kind == "eof":
                if open_ended:
                    break
                self.fail("unbalanced", "the group isn't closed", opener)
            node = self.atom_with_scripts()
            if node:
                items.append(self.finished(node, stop))
        return row(items)

    def finished(self, node: Node, stop) -> Node:
        """An n-ary head gets its body, an operator name its operand, and a solidus makes a fraction."""
        if node.type == _HEAD:
            return self.nary(node, stop)
        if is_name(node):
            node = self.applied(node, stop)
        return self.solidus(node, stop)

    def nary(self, head: Node, stop) -> Node:
        sign = head.value
        if self.now.kind == "lbrace":
            body = self.braced()
        else:
            body = self.body(stop, sign not in S.NARY_OVER.values())
        return Node("nary", sign, head.props, (*head.kids, ("e", body)))

    def starts_nary(self) -> bool:
        return self.name() in S.NARY

    def ends_body(self) -> bool:
        t = self.now
        sign = t.text if t.kind == "char" else S.SYMBOLS.get(self.name(), "")
        return bool(sign) and (sign in S.RELATION_ENDS or sign in S.BINARY_ENDS)

    def over(self, stop) -> bool:
        if self.now.kind == "eof" and stop is not _at_end and not stop(self.now):
            self.fail("unbalanced", "the group isn't closed")
        return self.now.kind == "eof" or stop(self.now) or self.starts_nary()

    def one(self, stop) -> Node | None:
        node = self.atom_with_scripts()
        return node and self.finished(node, stop)

    def body(self, stop, integral: bool) -> Node:
        """Up to a relation, plus or minus or the next n-ary operator; an integral ends after its first differentials, where it has any."""
        items: list[Node] = []
        while not self.over(stop) and not self.ends_body():
            node = self.one(stop)
            if node is None:
                continue
            items.append(node)
            if not integral:
                continue
            if len(items) > 2 and differential(items[-2]):
                self.more_differentials(items, stop)
                break
            if holds_differential(node):
                break
        return row(items)

    def more_differentials(self, items: list[Node], stop) -> None:
        while True:
            back, pending = self.at, []
            while not self.over(stop) and (node := self.one(stop)) and node.type == "space":
                pending.append(node)
            if self.at == back or self.over(stop) or not node or not differential(node):
                self.at = back
                return
            items += [*pending, node, self.one(stop)]

    def applied(self, name: Node, stop) -> Node:
        """The operand of an operator name is the next atom; names in a row nest to the right."""
        operand = self.operand(stop)
        if operand is None:
            return name
        if is_name(operand):
            operand = self.applied(operand, stop)
        return Node("func", kids=(("fName", name), ("e", operand)))

    def operand(self, stop) -> Node | None:
        while self.name() in S.TOLERATED:
            self.tolerated()
        back = self.at
        if stop(self.now) or self.now.kind in ("eof", "rbrace", "amp", "rowsep", "sub", "sup", "prime", "end"):
            return None
        node = self.atom_with_scripts()
        if node and node.type == _HEAD:
            return self.nary(node, stop)
        if node is None or node.type in ("op", "space"):
            self.at = back
            return None
        return node

    def solidus(self, node: Node, stop) -> Node:
        """a/b as a fraction, to the left; a denominator that can't be one leaves the sign alone."""
        while node.type not in ("op", "space") and self.now.kind == "char" and self.now.text == "/":
            back = self.at
            self.take()
            below = None
            if not stop(self.now) and self.now.kind not in ("eof", "rbrace", "amp", "rowsep", "sub", "sup", "prime", "end"):
                below = self.atom_with_scripts()
            if below is None or below.type in ("op", "space", _HEAD):
                self.at = back
                break
            node = Node("frac", props=(("type", "lin"),), kids=(("num", node), ("den", below)))
        return node

    # scripts and arguments

    def atom_with_scripts(self) -> Node | None:
        base = self.atom()
        if base is None or base.type == _HEAD:
            return base
        sub = sup = None
        primes = 0
        while self.now.kind in ("prime", "sub", "sup"):
            t = self.take()
            if t.kind == "prime":
                primes += 1
            elif t.kind == "sub":
                if sub:
                    self.fail("malformed", "double subscript", t)
                sub = self.argument()
            else:
                if sup or primes:
                    self.fail("malformed", "double superscript", t)
                sup = self.argument()
        if primes:
            if sup:
                self.fail("malformed", "primes and a superscript")
            sup = row([Node("op", S.PRIME)] * primes)
        if not sub and not sup:
            return base
        if base.type == "opname" and base.value in S.LIMIT_NAMES:
            for pos, lim in (("upp", sup), ("low", sub)):
                base = Node("limit", props=(("pos", pos),), kids=(("e", base), ("lim", lim))) if lim else base
            return base
        return Node("script", kids=(("e", base), *((s, x) for s, x in (("sub", sub), ("sup", sup)) if x)))

    def braced(self) -> Node:
        t = self.take()
        out = self.sequence(_at_brace, t)
        self.take()
        return out

    def argument(self) -> Node:
        t = self.now
        if t.kind == "lbrace":
            return self.braced()
        if t.kind in ("eof", "rbrace", "amp", "rowsep", "sub", "sup", "end"):
            self.fail("malformed", "missing argument")
        node = self.atom()
        if node is None or node.type == _HEAD:
            self.fail("malformed", "this can't be an argument without braces", t)
        return node

    # atoms

    def atom(self) -> Node | None:
        t = self.now
        if t.kind == "lbrace":
            return self.braced()
        if t.kind == "digits":
            return Node("num", self.take().text)
        if t.kind == "begin":
            return self.environment()
        if t.kind == "char":
            return self.sign()
        if t.kind == "macro":
            return self.macro()
        self.fail("unbalanced" if t.kind == "rbrace" else "unexpected", f"{t.text or t.kind} doesn't belong here")

    def sign(self) -> Node:
        t = self.now
        if t.text in S.PAIRS:
            return self.pair(t)
        self.take()
        if t.text == "~":
            return Node("space", S.SPACES["~"])
        if t.text.isalpha():
            return Node("ident", t.text)
        if t.text.isascii() and t.text not in "+-=<>/:;,.!?*|()[]":
            self.fail("unknown_macro", f"{t.text!r} isn't mathematics", t)
        return Node("op", t.text)

    def pair(self, t: Token) -> Node:
        """A bracket with its partner is a delimiter; alone it is a sign."""
        closer, back = S.PAIRS[t.text], self.at
        self.take()
        inner = self.sequence(lambda x: x.kind in ("char", "macro") and x.text == closer or x.kind == "rbrace", t, True)
        if self.now.kind in ("eof", "rbrace"):
            self.at = back + 1
            return Node("op", S.DELIMITERS[t.text])
        self.take()
        return delimited(S.DELIMITERS[t.text], S.DELIMITERS[closer], inner)

    def delimiter(self, t: Token) -> str:
        spec = self.take()
        text = "\\" + self.name(spec) if spec.kind == "macro" else spec.text
        if text not in S.DELIMITERS:
            self.fail("malformed", f"{t.text} without a delimiter", spec)
        return S.DELIMITERS[text]

    def sized(self, t: Token) -> Node:
        """\\left must meet \\right; the other sizes may end with the zone."""
        strict = self.take().text == "\\left"
        opens = self.delimiter(t)
        if not strict and self.now.kind in ("sub", "sup", "prime"):
            return delimited("", opens, row([]))
        inner = self.sequence(self.closes, t, not strict)
        closes = ""
        if self.now.kind != "eof":
            self.take()
            closes = self.delimiter(t)
        elif strict:
            self.fail("unbalanced", "\\left without \\right", t)
        return delimited(opens, closes, inner)

    def closes(self, t: Token) -> bool:
        if t.kind != "macro":
            return False
        if t.text == "\\right" or t.text in S.CLOSE_SIZERS:
            return True
        after = self.tokens[self.at + 1].text if t is self.now and self.at + 1 < len(self.tokens) else ""
        return t.text in S.SIZERS and S.DELIMITERS.get(after, "?") in S.CLOSERS

    def tolerated(self) -> None:
        name = self.name(self.take())
        if name in S.TOLERATED_ARG and self.now.kind == "rawarg":
            self.take()
        self.warnings.append(f"\\{name} has no place in an equation")

    def macro(self) -> Node | None:
        t, name = self.now, self.name()
        if t.text in S.SPACES or name == "qquad":
            self.take()
            return row([Node("space", S.SPACES["\\quad"])] * 2) if name == "qquad" else Node("space", S.SPACES[t.text])
        if name in S.UNSUPPORTED:
            self.fail("unsupported", f"\\{name} has no equivalent")
        if name in ("limits", "nolimits", "right") or t.text in S.CLOSE_SIZERS:
            self.fail("unexpected", f"\\{name} doesn't belong here")
        if t.text == "\\left" or t.text in S.SIZERS or t.text in S.OPEN_SIZERS:
            return self.sized(t)
        if "\\" + name in S.PAIRS:
            return self.pair(Token("macro", "\\" + name, t.pos))
        self.take()
        if name == "middle":
            return Node("op", self.delimiter(t))
        if name in ("operatorname", "mathrm", "text"):
            raw = self.take().text
            return Node("text", raw) if name == "text" else Node("opname", raw.strip(), (("upright", "1"),) * (name == "mathrm"))
        if name in S.NAMES:
            return Node("opname", name)
        if name in S.FONTS:
            return restyled(self.argument(), S.FONTS[name], self, t)
        if name in S.NARY:
            return self.nary_head(name)
        if name in S.FRACTIONS:
            return self.fraction(name, t)
        if name == "sqrt":
            degree = None
            if self.now.kind == "char" and self.now.text == "[":
                opener = self.take()
                degree = self.sequence(lambda x: x.kind == "char" and x.text == "]", opener)
                self.take()
            return Node("rad", kids=((("deg", degree),) if degree else ()) + (("e", self.argument()),))
        if name in S.ACCENTS:
            return Node("accent", S.ACCENTS[name], kids=(("e", self.argument()),))
        if name in ("overline", "underline"):
            return Node("bar", props=(("pos", "top" if name == "overline" else "bot"),), kids=(("e", self.argument()),))
        if name in ("overbrace", "underbrace"):
            return Node("groupchr", props=(("pos", "top" if name == "overbrace" else "bot"),), kids=(("e", self.argument()),))
        if name in ("boxed", "phantom"):
            return Node(name, kids=(("e", self.argument()),))
        if name in ("overset", "underset"):
            lim, e = self.argument(), self.argument()
            return Node("limit", props=(("pos", "upp" if name == "overset" else "low"),), kids=(("e", e), ("lim", lim)))
        if name == "prescript":
            sup, sub, e = self.argument(), self.argument(), self.argument()
            return Node("prescript", kids=(("sub", sub), ("sup", sup), ("e", e)))
        if name == "pmod":
            inner = self.argument()
            return row([Node("space", S.SPACES["\\quad"]), delimited("(", ")", row([Node("opname", "mod", (("upright", "1"),)), Node("space", S.SPACES["\\:"]), *(inner.slots("item") if inner.type == "row" else [inner])]))])
        if name in S.ESCAPED:
            return Node("op", name)
        if t.text in S.DELIMITERS:
            return Node("op", S.DELIMITERS[t.text])
        if name in S.SYMBOLS:
            sign = S.SYMBOLS[name]
            return Node("ident" if sign.isalpha() else "op", sign)
        if name in S.SILENT:
            return None
        if name in S.TOLERATED:
            self.at -= 1
            self.tolerated()
            return None
        if name in ("}", "rangle", "rceil", "rfloor"):
            return Node("op", S.DELIMITERS["\\" + name])
        self.fail("unknown_macro", f"unknown macro {t.text}", t)

    def nary_head(self, name: str) -> Node:
        placed, props, kids = "", (), {}
        while self.name() in ("limits", "nolimits"):
            placed = self.name(self.take())
        while self.now.kind in ("sub", "sup"):
            t = self.take()
            if t.kind in kids:
                self.fail("malformed", f"double {t.kind}script", t)
            kids[t.kind] = self.argument()
        if placed:
            props = (("limits", "1" if placed == "limits" else "0"),)
        return Node(_HEAD, S.NARY[name], props, tuple((s, kids[s]) for s in ("sub", "sup") if s in kids))

    def fraction(self, name: str, t: Token) -> Node:
        if name == "genfrac":
            raw = [self.take().text.strip() for _ in range(4)]
            if raw[0] or raw[1] or raw[2] not in ("0pt", "0mm", "0cm") or raw[3]:
                self.fail("unsupported", "only a fraction without rule is known", t)
        kind, paren = S.FRACTIONS[name]
        num, den = self.argument(), self.argument()
        return Node("frac", props=(("type", kind),) + (("paren", "1"),) * paren, kids=(("num", num), ("den", den)))

    def environment(self) -> Node:
        t = self.take()
        env = S.ENVIRONMENT_ALIASES.get(t.text, t.text)
        if env not in S.MATRICES:
            self.fail("unknown_macro", f"unknown environment {t.text}", t)
        columns = ""
        if env == "array":
            if self.now.kind != "lbrace":
                self.fail("malformed", "array without columns", t)
            self.take()
            while self.now.kind != "rbrace":
                if self.now.text not in ("l", "c", "r"):
                    self.fail("malformed", "only l, c and r columns are known")
                columns += self.take().text
            self.take()
        stop = lambda x: x.kind in ("amp", "rowsep", "end")
        rows = [[self.sequence(stop, t)]]
        while self.now.kind != "end":
            if self.take().kind == "amp":
                rows[-1].append(self.sequence(stop, t))
            else:
                rows.append([self.sequence(stop, t)])
        if self.now.text != t.text:
            self.fail("unbalanced", f"{t.text} ends as {self.now.text}")
        self.take()
        if len(rows) > 1 and not any(c.kids for c in rows[-1]):
            rows.pop()
        if columns and any(len(r) > len(columns) for r in rows):
            self.fail("malformed", "more cells than columns", t)
        width = max(map(len, rows))
        rows = [r + [row([])] * (width - len(r)) for r in rows]
        return Node("matrix", env, (("cols", columns),) * bool(columns), tuple(("mr", Node("matrix_row", kids=tuple(("e", c) for c in r))) for r in rows))


def is_name(node: Node) -> bool:
    """An operator name, also with scripts or limits; upright text isn't one."""
    while node.type in ("script", "limit"):
        node = node.slot("e")
    return node.type == "opname" and not node.prop("upright")


def differential(node: Node) -> bool:
    return (node.type in ("ident", "op") and node.value in ("d", "∂", "ⅆ")) or (node.type in ("opname", "text") and node.value == "d")


def holds_differential(node: Node) -> bool:
    items = node.slots("item")
    return any(map(differential, items[:-1])) or any(holds_differential(k) for _, k in node.kids)


def delimited(opens: str, closes: str, inner: Node) -> Node:
    """A delimiter; round a lone matrix it is that matrix's environment."""
    items = inner.slots("item")
    while len(items) == 1 and items[0].type == "row":
        items = items[0].slots("item")
    if len(items) == 1 and items[0].type == "matrix" and set(items[0].prop("cols")) <= {"c"}:
        env = next((e for e, d in S.MATRICES.items() if d == (opens, closes)), None)
        if env:
            return Node("matrix", env, (), items[0].kids)
    return Node("delim", props=(("begChr", opens), ("endChr", closes)), kids=(("e", inner),))


def restyled(node: Node, style: str, parser: Parser, t: Token) -> Node:
    """Letters and digits in a Unicode style; other parts as they are."""
    if node.type in ("ident", "num") or (node.type == "op" and len(node.value) == 1):
        letters = [S.styled(c, style) or c for c in node.value]
        return Node("ident", letters[0]) if len(letters) == 1 else row([Node("ident", c) for c in letters])
    if node.type == "row":
        out = []
        for k in node.slots("item"):
            k = restyled(k, style, parser, t)
            out += k.slots("item") if k.type == "row" else [k]
        return row(out)
    return Node(node.type, node.value, node.props, tuple((s, restyled(k, style, parser, t)) for s, k in node.kids))


def parse(text: str) -> tuple[Node, list[str]]:
    """The tree of a zone and warnings; raises MathError."""
    text, warnings = expand(text)
    parser = Parser(text)
    return parser.sequence(_at_end), [*warnings, *parser.warnings]


# --- canonical spelling ---------------------------------------------------------------------


def joined(parts) -> str:
    """One blank between a macro name and a letter or digit, none elsewhere."""
    out = ""
    for p in parts:
        out += " " * bool(p and p[0].isalnum() and re.search(r"\\[A-Za-z]+\Z", out)) + p
    return out


def braced(node: Node) -> str:
    return "{" + spell(node) + "}"


def letter(sign: str) -> str:
    if sign in S.ESCAPED:
        return "\\" + sign
    return "'" if sign == S.PRIME else S.SPELLING.get(sign) or (S.DELIMITER_SPELLING.get(sign, sign) if sign else "")


def spell_row(items: list[Node]) -> str:
    """Neighbours of one style share a font macro."""
    parts, held, style = [], "", None
    for node in [*items, None]:
        plain, own = S.UNSTYLED.get(node.value, ("", None)) if node and node.type in ("ident", "num", "op") else ("", None)
        if style and own != style:
            parts.append(f"\\{S.FONT_SPELLING[style]}{{{held}}}")
            held, style = "", None
        if own:
            held, style = (joined([held, letter(plain)]) if held else letter(plain)), own
        elif node:
            parts.append(letter(node.value) if node.type in ("ident", "op") else spell(node))
    return joined(parts)


def single(node: Node) -> bool:
    """Whether a script base stays one atom without braces."""
    if node.type == "row":
        items = node.slots("item")
        return len(items) == 1 and single(items[0])
    return node.type not in ("nary", "func", "script", "limit") and not (node.type == "frac" and node.prop("type") == "lin")


def spell_script(node: Node) -> str:
    e, sub, sup = node.slot("e"), node.slot("sub"), node.slot("sup")
    base = spell(e) if single(e) else braced(e)
    marks = sup.slots("item") if sup else []
    if marks and all(m.type == "op" and m.value == S.PRIME for m in marks):
        return base + "'" * len(marks) + (f"_{braced(sub)}" if sub else "")
    return base + (f"_{braced(sub)}" if sub else "") + (f"^{braced(sup)}" if sup else "")


def spell_limit(node: Node) -> str:
    e, lim, low = node.slot("e"), node.slot("lim"), node.prop("pos") == "low"
    if low and e.type == "limit" and e.prop("pos") == "upp" and is_name(e.slot("e")):
        return f"{spell(e.slot('e'))}_{braced(lim)}^{braced(e.slot('lim'))}"
    if is_name(e):
        return f"{spell(e)}{'_' if low else '^'}{braced(lim)}"
    return f"\\{'underset' if low else 'overset'}{braced(lim)}{braced(e)}"


def spell_nary(node: Node) -> str:
    name = next(n for n, s in S.NARY.items() if s == node.value)
    placed, over = node.prop("limits"), node.value in S.NARY_OVER.values()
    out = "\\" + name + ("" if not placed or (placed == "1") == over else "\\limits" if placed == "1" else "\\nolimits")
    for slot, mark in (("sub", "_"), ("sup", "^")):
        if node.slot(slot):
            out += mark + braced(node.slot(slot))
    e = node.slot("e")
    items = e.slots("item") if e.type == "row" else [e]
    lone = items[0] if len(items) == 1 else None
    grouped = lone and lone.type == "frac" and lone.prop("type") == "lin" and lone.slot("num").type == "row" and len(lone.slot("num").kids) != 1
    return joined([out, braced(e) if grouped else spell(e)])


def spell_fraction(node: Node) -> str:
    num, den, kind = node.slot("num"), node.slot("den"), node.prop("type")
    if kind == "lin":
        return "/".join(braced(x) if x.type == "row" and len(x.kids) != 1 else spell(x) for x in (num, den))
    name = next(n for n, shape in S.FRACTIONS.items() if shape == (kind, bool(node.prop("paren"))))
    return f"\\{name}" + ("{}{}{0pt}{}" if name == "genfrac" else "") + braced(num) + braced(den)


def spell_matrix(node: Node) -> str:
    body = " \\\\\n".join(" & ".join(map(spell, r.slots("e"))) for r in node.slots("mr"))
    return f"\\begin{{{node.value}}}" + (f"{{{node.prop('cols')}}}" if node.value == "array" else "") + f"\n{body}\n\\end{{{node.value}}}"


def spell_name(node: Node) -> str:
    if node.value in S.NAMES:
        return "\\" + node.value
    return f"\\{'mathrm' if node.prop('upright') else 'operatorname'}{{{node.value}}}"


_SPELL = {
    "row": lambda n: spell_row(n.slots("item")), "ident": lambda n: spell_row([n]), "op": lambda n: spell_row([n]), "num": lambda n: n.value,
    "text": lambda n: f"\\text{{{n.value}}}", "opname": spell_name, "space": lambda n: next(m for m, s in S.SPACES.items() if s == n.value),
    "script": spell_script, "limit": spell_limit, "nary": spell_nary, "frac": spell_fraction, "matrix": spell_matrix,
    "func": lambda n: joined([spell(n.slot("fName")), spell(n.slot("e"))]),
    "rad": lambda n: "\\sqrt" + (f"[{spell(n.slot('deg'))}]" if n.slot("deg") else "") + braced(n.slot("e")),
    "delim": lambda n: joined(["\\left" + S.DELIMITER_SPELLING.get(n.prop("begChr"), n.prop("begChr")), " , ".join(map(spell, n.slots("e"))), "\\right" + S.DELIMITER_SPELLING.get(n.prop("endChr"), n.prop("endChr"))]),
    "accent": lambda n: f"\\{next(m for m, s in S.ACCENTS.items() if s == n.value)}{braced(n.slot('e'))}",
    "bar": lambda n: f"\\{'overline' if n.prop('pos') == 'top' else 'underline'}{braced(n.slot('e'))}",
    "groupchr": lambda n: f"\\{'overbrace' if n.prop('pos') == 'top' else 'underbrace'}{braced(n.slot('e'))}",
    "boxed": lambda n: "\\boxed" + braced(n.slot("e")), "phantom": lambda n: "\\phantom" + braced(n.slot("e")),
    "prescript": lambda n: f"\\prescript{braced(n.slot('sup'))}{braced(n.slot('sub'))}{braced(n.slot('e'))}",
}


def spell(node: Node) -> str:
    """The canonical LaTeX of a tree."""
    return _SPELL[node.type](node)


#: Characters of a zone whose canonical spelling is remembered: within a document it is asked for again and again.
REMEMBERED = 1000


def canonical(text: str) -> str:
    """The canonical spelling of a zone; a second pass changes nothing."""
    return _canonical(text) if len(text) <= REMEMBERED else spell(parse(text)[0])


@lru_cache(1024)
def _canonical(text: str) -> str:
    return spell(parse(text)[0])


def flat(node: Node):
    """Rows (id, parent, slot, ord, type, value, props) of a tree, depth first; a subtree is a range of ids."""
    count = 0

    def walk(n: Node, parent: int | None, slot: str, order: int):
        nonlocal count
        own, count = count, count + 1
        yield own, parent, slot, order, n.type, n.value, dict(n.props)
        for k, (s, kid) in enumerate(n.kids):
            yield from walk(kid, own, s, k)

    yield from walk(node, None, "", 0)
