"""Mathematical LaTeX: fixed spellings, errors, and canonical forms that are their own canonical form."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.functions import mathsigns, omml
from quire.functions import mathtex as M

SPELLINGS = {
    "a + b": "a+b", r"\alpha\beta x": r"\alpha\beta x", r"x^2_i": "x_{i}^{2}", "f''": "f''", r"\frac1 2": r"\frac{1}{2}", r"\dfrac{a}{b}": r"\frac{a}{b}",
    r"\sum_{i=1}^n a_i b_i = c": r"\sum_{i}^{n}a_{i}b_{i}=c".replace("_{i}^", "_{i=1}^"), r"\int f\,dx\,dy + g": r"\int f\,dx\,dy+g", r"\int \frac{dx}{x} \cdot h": r"\int\frac{dx}{x}\cdot h",
    "(a)": r"\left(a\right)", "[0, b)": r"[0,b)", r"\ln\tan x y": r"\ln\tan xy", r"\lim_{x \to 0} f": r"\lim_{x\to0}f".replace("to0", "to 0"), r"\mathbf{AB}c": r"\mathbf{AB}c",
    r"\left(\begin{matrix}a&b\\c&d\end{matrix}\right)": "\\begin{pmatrix}\na & b \\\\\nc & d\n\\end{pmatrix}", r"\begin{align*}a&=b\\c&=d\end{align*}": "\\begin{matrix}\na & =b \\\\\nc & =d\n\\end{matrix}",
    r"\sqrt[3]{x}": r"\sqrt[3]{x}", "a/b": "a/b", "{a+b}/c": "{a+b}/c", r"\le": r"\leq", r"\sum\nolimits_k a": r"\sum\nolimits_{k}a", r"\overset{a}{=}": r"\overset{a}{=}",
    r"\Big|_{x=0}": r"\left.\right|_{x=0}", r"\binom{n}{k}": r"\binom{n}{k}", r"\hat{x}": r"\hat{x}", r"\text{if }x": r"\text{if }x", r"\newcommand{\R}{\mathbb{R}}x\in\R": r"x\in\mathbb{R}",
    r"\def\v#1{\vec{#1}}\v{a}+\v b": r"\vec{a}+\vec{b}", r"\rho\frac{d}{S}": r"\rho\frac{d}{S}", r"x \% y": r"x\%y", r"\operatorname{foo} x": r"\operatorname{foo}x",
}


@pytest.mark.parametrize("tex", sorted(SPELLINGS))
def test_spelling(tex):
    assert M.canonical(tex) == SPELLINGS[tex]
    assert M.canonical(SPELLINGS[tex]) == SPELLINGS[tex]


@pytest.mark.parametrize(("tex", "kind"), [(r"\nosuch", "unknown_macro"), ("x^1^2", "malformed"), ("{a", "unbalanced"), ("a}", "unbalanced"), (r"\left(a", "unbalanced"), ("a&b", "unexpected"), (r"\over", "unsupported"), (r"\begin{pmatrix}a\end{bmatrix}", "unbalanced"), (r"\frac{a}", "malformed"), (r"\begin{array}{lc}a&b&c\end{array}", "malformed"), ("\\", "malformed"), (r"\newcommand{\a}[1]{#2}\a x", "definition"), (r"\def\a{\a}\a", "definition"), ("a_", "malformed")])
def test_errors(tex, kind):
    with pytest.raises(M.MathError) as e:
        M.canonical(tex)
    assert e.value.kind == kind and 0 <= e.value.pos <= len(tex)


ATOMS = st.sampled_from(["a", "x", "12", r"\alpha", "+", "=", r"\sin", r"\,", r"\text{t}", r"\leq", "'", "/", "d", r"\mathbf{Q}", "|", ","])


def grow(inner):
    return st.one_of(
        st.tuples(inner, inner).map("".join), inner.map(lambda x: f"{{{x}}}"), st.tuples(inner, inner).map(lambda t: rf"\frac{{{t[0]}}}{{{t[1]}}}"),
        st.tuples(inner, inner).map(lambda t: rf"{{{t[0]}}}_{{{t[1]}}}"), st.tuples(inner, inner).map(lambda t: rf"\sum_{{{t[0]}}} {t[1]}"), st.tuples(inner, inner).map(lambda t: rf"\int_{{{t[0]}}} {t[1]} dx"),
        inner.map(lambda x: rf"\sqrt{{{x}}}"), inner.map(lambda x: f"({x})"), inner.map(lambda x: rf"\left[{x}\right\}}"), st.tuples(inner, inner).map(lambda t: rf"\begin{{cases}}{t[0]}&{t[1]}\\{t[1]}\end{{cases}}"), inner.map(lambda x: rf"\hat{{{x}}}"),
    )


@settings(max_examples=300, deadline=None)
@given(st.recursive(ATOMS, grow, max_leaves=12))
def test_canonical_is_idempotent(tex):
    try:
        once = M.canonical(tex)
    except M.MathError:
        return
    assert M.canonical(once) == once


def test_flat_ids_are_ranges():
    rows = list(M.flat(M.parse(r"\frac{a+b}{c}+\sqrt{d}")[0]))
    assert [r[0] for r in rows] == list(range(len(rows))) and all(r[1] is None or r[1] < r[0] for r in rows)


@pytest.mark.parametrize("name", sorted(mathsigns.SYMBOLS))
def test_every_symbol_has_one_spelling(name):
    """A symbol's spelling is read back as the same character, and equations keep it."""
    node, warnings = M.parse(f"a\\{name} b")
    once = M.spell(node)
    assert not warnings and M.canonical(once) == once
    assert M.spell(omml.from_xml(omml.to_xml(node))) == once


def test_arrows_and_strokes():
    names = {"longleftarrow": "⟵", "Longleftrightarrow": "⟺", "nRightarrow": "⇏", "rightarrowtail": "↣", "upuparrows": "⇈", "Lleftarrow": "⇚", "leftharpoondown": "↽", "nless": "≮", "nsimeq": "≄", "nvDash": "⊭", "AA": "Å", "rightarrow": "→"}
    assert {n: mathsigns.SYMBOLS[n] for n in names} == names
    assert M.canonical("\\rightarrow") == "\\to" and mathsigns.SPELLING["⊭"] == "\\nvDash"


@pytest.mark.parametrize(("pair", "latex"), [("\u27e8\u27e9", "\\left\\langle x\\right\\rangle"), ("\u3008\u3009", "\\left\\langle x\\right\\rangle"), ("\u2329\u232a", "\\left\\langle x\\right\\rangle"), ("\u23a1\u23a6", "\\left[x\\right]")])
def test_delimiters_of_equations(pair, latex):
    node, _ = M.parse("\\left(x\\right)")
    xml = omml.to_xml(node).replace('val="("', f'val="{pair[0]}"').replace('val=")"', f'val="{pair[1]}"')
    assert M.spell(omml.from_xml(xml)) == latex and M.canonical(latex) == latex
