"""No parser raises on content, whatever it is, and time follows length."""

import random
import time

import pytest

from quire.functions import inlines
from quire.operators import documents as D
from quire.sources import files, word

PIECES = [
    "\\begin{", "\\end{", "{", "}", "[", "]", "$", "$$", "\\[", "\\]", "\\(", "\\)", "%", "\n", "\n\n", " ", "\\\\", "\\", "&", "_", "^", "x", "12", "\\frac", "\\left(", "\\right", "\\begin{itemize}", "\\end{itemize}",
    "\\item", "\\begin{tabular}{|l|c|}", "\\end{tabular}", "\\begin{matrix}", "\\end{matrix}", "\\section{", "\\newpage", "%lw:p:1\n", "%lw:list:2\n", "\\verb|", "\\begin{verbatim}", "\\end{verbatim}", "\\begin{document}",
    "\\end{document}", "\\newcommand{\\a}[1]{#1}", "\\a", "#1", "\\multicolumn{2}{c}{", "\\href{", "\\textbf{", "\\sum_", "\\sqrt[", "'", "~", "--", "\\begin{x}", "\\end{y}", "é", "\U0001d400", "\\footnote{", "\\begin{multicols}{2}", "\\end{multicols}",
]
PARSERS = {
    "zones": D._zones, "canonical": D._canonical, "math tokens": D._tokens, "nodes": D._nodes, "omml": D._omml, "blocks": D._blocks, "runs": D._runs, "respelled": D._respelled, "items": D._items, "cells": D._cells,
    "findings": lambda t: D._findings(t, "document"), "inline findings": lambda t: D._findings(t, "inline"), "resources": lambda t: D._with_resources(t, "block", []), "marks": D._marks, "tokens": D._tokenize,
    "equation XML": D._latex, "package": word._package, "parts": lambda t: files._parts(t.encode()),
}


@pytest.mark.parametrize("name", sorted(PARSERS))
def test_random_texts(name):
    rnd = random.Random(3)
    for _ in range(400):
        text = "".join(rnd.choice(PIECES) for _ in range(rnd.randrange(40)))
        list(PARSERS[name](text))


def test_the_tokens_give_the_text_again():
    rnd = random.Random(4)
    for _ in range(300):
        text = "".join(rnd.choice(PIECES) for _ in range(rnd.randrange(40)))
        assert "".join(t for _, _, t in D._tokenize(text)) == text


@pytest.mark.parametrize("name", sorted(PARSERS))
@pytest.mark.parametrize("piece", ["{", "\\textbf{", "\\begin{x}\n\n", "$x\n\n", "\\begin{itemize}\\item ", "word $x$ \\emph{y}\n\n", "\\[", "% c\n", "x^{", "\\left("])
def test_deep_and_long_texts(name, piece):
    began = time.perf_counter()
    list(PARSERS[name](piece * (20_000 // len(piece))))
    assert time.perf_counter() - began < 8


@pytest.mark.parametrize("name", ["zones", "blocks", "findings", "marks", "tokens"])
def test_a_megabyte_takes_seconds(name):
    text = "\\section{One}\n\nPlain words with $x_1 + y$ and \\textbf{more} of {them} % and a comment\n\n\\begin{itemize}\n\\item a\n\\end{itemize}\n\n"
    began = time.perf_counter()
    assert len(list(PARSERS[name](text * (1_000_000 // len(text))))) > 3
    assert time.perf_counter() - began < 8


def test_short_texts_that_once_failed():
    assert [r[1] for r in D._blocks("\\begin{\\end{x}")] == ["p"]
    assert inlines.runs("{" * 3000 + "x" + "}" * 3000)[-1].kind == "text"
