"""The vocabulary of mathematical LaTeX."""

from __future__ import annotations

import unicodedata

# Symbols by category, macro name and character. Arrows of a direction, Greek letters and most struck relations follow from Unicode names.
_BINARY = {
    "pm": "±", "mp": "∓", "times": "×", "div": "÷", "cdot": "·", "ast": "∗", "star": "⋆", "circ": "∘", "bullet": "∙", "oplus": "⊕", "ominus": "⊖",
    "otimes": "⊗", "oslash": "⊘", "odot": "⊙", "wedge": "∧", "vee": "∨", "cap": "∩", "cup": "∪", "setminus": "∖", "uplus": "⊎", "sqcap": "⊓",
    "sqcup": "⊔", "wr": "≀", "boxplus": "⊞", "boxminus": "⊟", "boxtimes": "⊠", "dotsquare": "⊡", "circledast": "⊛", "circledcirc": "⊚", "capdot": "⩀",
    "cupdot": "⩁", "curlymeet": "⋏", "curlyvee": "⋎", "dotplus": "∔", "dotminus": "∸", "ltimes": "⋉", "rtimes": "⋊", "timesbar": "⨰",
    "pitchfork": "⋔", "cbrt": "∛", "fourthroot": "∜", "sslash": "⫽",
}
_RELATION = {
    "leq": "≤", "geq": "≥", "neq": "≠", "approx": "≈", "equiv": "≡", "sim": "∼", "simeq": "≃", "cong": "≅", "asymp": "≍", "propto": "∝", "prec": "≺",
    "succ": "≻", "preceq": "⪯", "succeq": "⪰", "ll": "≪", "gg": "≫", "lesssim": "≲", "gtrsim": "≳", "subset": "⊂", "supset": "⊃", "subseteq": "⊆",
    "supseteq": "⊇", "nsubseteq": "⊈", "in": "∈", "notin": "∉", "ni": "∋", "vdash": "⊢", "models": "⊨", "perp": "⊥", "top": "⊤", "doteq": "≐",
    "dashv": "⊣", "nmid": "∤", "nparallel": "∦", "sqsubset": "⊏", "sqsubseteq": "⊑", "sqsupset": "⊐", "sqsupseteq": "⊒", "backsim": "∽",
    "Bumpeq": "≎", "circeq": "≗", "eqring": "≖", "eqcolon": "⋕", "eqmeasured": "≞", "equest": "≚", "estimates": "≙", "questeq": "≟",
    "curlyeqprec": "⋞", "curlyeqsucc": "⋟", "precsim": "≾", "succsim": "≿", "precnsim": "⋨", "succnsim": "⋩", "lll": "⋘", "ggg": "⋙",
    "lessapprox": "⪅", "gtrapprox": "⪆", "Vdash": "⊩", "VDash": "⊫", "Vvdash": "⊪", "nvDash": "⊭", "nVdash": "⊮", "nVDash": "⊯", "multimap": "⊷",
    "nasymp": "≏", "nlsim": "≴", "ngsim": "≵", "notni": "∌", "npreccurlyeq": "⋠", "nsucccurlyeq": "⋡", "ntless": "≸", "ntgtr": "≹",
    "ntriangleleft": "⋤", "ntrianglelefteq": "⋢", "ntriangleright": "⋥", "ntrianglerighteq": "⋣",
}
_LOGIC = {
    "forall": "∀", "exists": "∃", "nexists": "∄", "neg": "¬", "emptyset": "∅", "infty": "∞", "partial": "∂", "nabla": "∇", "hbar": "ℏ", "ell": "ℓ",
    "aleph": "ℵ", "beth": "ℶ", "wp": "℘", "diamond": "⋄", "square": "□", "triangle": "△", "complement": "∁", "gimel": "ℷ", "daleth": "ℸ", "mho": "℧",
    "eth": "ð", "Finv": "Ⅎ", "Game": "⅁", "Euler": "ℇ", "Ydown": "⅄", "AA": "Å", "blacksquare": "■",
}
_ARROW = {
    "to": "→", "mapsto": "↦", "mapsup": "↥", "mapsdown": "↧", "nearrow": "↗", "searrow": "↘", "nwarrow": "↖", "swarrow": "↙",
    "rightleftharpoons": "⇌", "leftrightharpoons": "⇋", "leftrightarrows": "⇆", "rightleftarrows": "⇄", "leftrightsquigarrow": "↭",
    "leftrightdasharrow": "⇿", "circlearrowleft": "↺", "circlearrowright": "↻", "curvearrowleft": "↶", "curvearrowright": "↷", "Lsh": "↲", "Rsh": "↳",
    "uplsh": "↰", "uprsh": "↱", "carriagereturn": "↵", "barleftarrow": "↸", "barrightarrow": "↹",
}
_MISC = {
    "ldots": "…", "cdots": "⋯", "vdots": "⋮", "ddots": "⋱", "therefore": "∴", "because": "∵", "angle": "∠", "frown": "⌢", "smile": "⌣", "|": "‖",
    "parallel": "∥", "dagger": "†", "ddagger": "‡", "bowtie": "⋈", "flat": "♭", "imath": "ı", "jmath": "ȷ", "iddots": "⋰", "measuredangle": "∡",
    "sphericalangle": "∢", "rightangle": "∟", "perspective": "⌆", "Colon": "::",
}
# Directions of arrows, and the forms that macro names have, by their Unicode names.
_DIRECTIONS = {"left": "LEFTWARDS", "right": "RIGHTWARDS", "leftright": "LEFT RIGHT", "up": "UPWARDS", "down": "DOWNWARDS", "updown": "UP DOWN"}
_ARROW_FORMS = {
    "{d}arrow": "{u} ARROW", "{c}arrow": "{u} DOUBLE ARROW", "long{d}arrow": "LONG {u} ARROW", "Long{d}arrow": "LONG {u} DOUBLE ARROW",
    "n{d}arrow": "{u} ARROW WITH STROKE", "n{c}arrow": "{u} DOUBLE ARROW WITH STROKE", "{d}arrowtail": "{u} ARROW WITH TAIL", "hook{d}arrow": "{u} ARROW WITH HOOK",
    "twohead{d}arrow": "{u} TWO HEADED ARROW", "{d}{d}arrows": "{u} PAIRED ARROWS", "{i}{d}arrow": "{u} TRIPLE ARROW", "dash{d}arrow": "{u} DASHED ARROW",
    "{d}squigarrow": "{u} SQUIGGLE ARROW", "{d}harpoonup": "{u} HARPOON WITH BARB UPWARDS", "{d}harpoondown": "{u} HARPOON WITH BARB DOWNWARDS",
}
# Greek letters whose plain name means the variant form, and forms of their own.
_GREEK_FORMS = {
    "varepsilon": "ε", "epsilon": "ϵ", "theta": "θ", "vartheta": "ϑ", "varkappa": "ϰ", "varpi": "ϖ", "varrho": "ϱ", "varsigma": "ς", "varphi": "φ",
    "phi": "ϕ",
}
# Other characters of the same symbol, as equations have them.
_SIGN_ALIASES = {"•": "bullet", "◊": "diamond", "ⅎ": "Finv"}


def _pairs(text: str) -> dict[str, str]:
    words = text.split()
    return dict(zip(words[::2], words[1::2], strict=True))


def _greek() -> dict[str, str]:
    """Letters by their Unicode names; capitals only where they differ from Latin ones."""
    names = "alpha beta gamma delta zeta eta iota kappa lambda mu nu xi pi rho sigma tau upsilon chi psi omega".split()
    out = {n: unicodedata.lookup(f"GREEK SMALL LETTER {n.replace('lambda', 'lamda').upper()}") for n in names}
    capitals = "Gamma Delta Theta Lambda Xi Pi Sigma Upsilon Phi Psi Omega".split()
    return out | {n: unicodedata.lookup(f"GREEK CAPITAL LETTER {n.replace('Lambda', 'Lamda').upper()}") for n in capitals} | _GREEK_FORMS


def _negated() -> dict[str, str]:
    """n and the name of a relation: the character with a stroke, where Unicode has one."""
    out = {}
    for name, sign in (_RELATION | {"less": "<", "gtr": ">"}).items():
        struck = unicodedata.normalize("NFC", sign + "\u0338")
        if len(struck) == 1:
            out[f"n{name}"] = struck
    return out


def _arrows() -> dict[str, str]:
    """Every form of arrow in every direction that Unicode has."""
    out = {}
    for name, form in _ARROW_FORMS.items():
        for way, words in _DIRECTIONS.items():
            try:
                out[name.format(d=way, c=way.capitalize(), i=way[0].upper())] = unicodedata.lookup(form.format(u=words))
            except KeyError:
                continue
    return out


CATEGORIES = {"greek": _greek(), "binary": _BINARY, "relation": _RELATION | {n: s for n, s in _negated().items() if n not in _RELATION}, "logic": _LOGIC, "arrow": _ARROW | _arrows(), "misc": _MISC}
SYMBOLS = {name: sign for group in CATEGORIES.values() for name, sign in group.items()}
SPELLING = {sign: "\\" + name for name, sign in reversed(SYMBOLS.items()) if len(sign) == 1} | {"−": "-", "ε": "\\varepsilon", "ϵ": "\\epsilon", "∉": "\\notin", "≠": "\\neq"} | {sign: "\\" + name for sign, name in _SIGN_ALIASES.items()}
# Other spellings of the same symbol.
ALIASES = {"rightarrow": "to", "longrightarrow": "to", "le": "leq", "ge": "geq", "implies": "Rightarrow", "ne": "neq", "land": "wedge", "lor": "vee", "lnot": "neg", "varnothing": "emptyset", "dots": "ldots", "lbrace": "{", "rbrace": "}", "Vert": "|"}
# N-ary operators; those of the second line have limits above and below.
NARY_SIDE = _pairs("int ∫ iint ∬ iiint ∭ oint ∮ oiint ∯ oiiint ∰ iiiint ⨌ fint ⨍ sqint ⨎")
NARY_OVER = _pairs("sum ∑ prod ∏ coprod ∐ bigcup ⋃ bigcap ⋂ bigvee ⋁ bigwedge ⋀ bigoplus ⨁ bigotimes ⨂ bigodot ⨀ biguplus ⨄ bigsqcup ⨆")
NARY = NARY_SIDE | NARY_OVER
# Accents, by code point of the combining mark; the wide forms share it.
ACCENTS = {n: chr(c) for n, c in (("vec", 0x20D7), ("ddot", 0x308), ("hat", 0x302), ("dot", 0x307), ("bar", 0x305), ("tilde", 0x303), ("check", 0x30C), ("acute", 0x301), ("grave", 0x300), ("breve", 0x306), ("dddot", 0x20DB), ("ddddot", 0x20DC), ("widehat", 0x302), ("widetilde", 0x303))}
# Spaces.
SPACES = {"\\,": "\u2009", "\\:": "\u2005", "\\;": "\u2004", "\\quad": "\u2003", "\\ ": " ", "~": "\u00a0"}
# Operator names, and those that take limits.
LIMIT_NAMES = set("lim max min sup inf limsup liminf argmax argmin gcd lcm colim injlim projlim".split())
NAMES = set("sin cos tan cot sec csc sinh cosh tanh coth arcsin arccos arctan arg deg det dim exp hom ker lg ln log Pr arsinh arcosh artanh sech sgn".split()) | LIMIT_NAMES
# Delimiters after \left and \right.
DELIMITERS = {"(": "(", ")": ")", "[": "[", "]": "]", "\\{": "{", "\\}": "}", "\\langle": "\u2329", "\\rangle": "\u232a", "\\lceil": "⌈", "\\rceil": "⌉", "\\lfloor": "⌊", "\\rfloor": "⌋", "|": "|", "\\|": "‖", "/": "/", "\\backslash": "\\", ".": "", "\\vert": "|"}
# Other characters of the same delimiter, as equations have them: two more angle brackets, and the corners of tall square ones.
_DELIMITER_ALIASES = {"\u27e8": "\\langle", "\u27e9": "\\rangle", "\u3008": "\\langle", "\u3009": "\\rangle", "\u23a1": "[", "\u23a3": "[", "\u23a4": "]", "\u23a6": "]"}
DELIMITER_SPELLING = {sign: name for name, sign in reversed(DELIMITERS.items())} | {"|": "|"} | _DELIMITER_ALIASES
CLOSERS = set(")]}|‖⌉⌋\u232a")
PAIRS = {"(": ")", "[": "]", "\\{": "\\}", "\\langle": "\\rangle", "\\lceil": "\\rceil", "\\lfloor": "\\rfloor"}
SIZERS = {"\\big", "\\Big", "\\bigg", "\\Bigg"}
OPEN_SIZERS, CLOSE_SIZERS = {s + "l" for s in SIZERS}, {s + "r" for s in SIZERS}
# Matrix environments by delimiters, and environments that are read as matrix.
MATRICES = {"matrix": None, "pmatrix": ("(", ")"), "bmatrix": ("[", "]"), "Bmatrix": ("{", "}"), "vmatrix": ("|", "|"), "Vmatrix": ("‖", "‖"), "cases": ("{", ""), "array": None}
ROW_ENVIRONMENTS = "align aligned gather gathered eqnarray multline split alignat flalign".split()
ENVIRONMENT_ALIASES = {e + s: "matrix" for e in ROW_ENVIRONMENTS for s in ("", "*")}
# Fractions by shape, the first spelling of a shape is canonical.
FRACTIONS = {"frac": ("bar", False), "dfrac": ("bar", False), "tfrac": ("bar", False), "binom": ("noBar", True), "genfrac": ("noBar", False), "sfrac": ("skw", False)}
# Font macros and the Unicode style each stands for.
FONTS = {"mathbf": "bold", "mathit": "italic", "mathcal": "script", "mathscr": "script", "mathfrak": "fraktur", "mathbb": "double-struck", "mathsf": "sans-serif", "mathtt": "monospace", "boldsymbol": "bold-italic", "bm": "bold-italic"}
FONT_SPELLING = {"bold": "mathbf", "italic": "mathit", "script": "mathcal", "fraktur": "mathfrak", "double-struck": "mathbb", "sans-serif": "mathsf", "monospace": "mathtt", "bold-italic": "boldsymbol"}
ESCAPED = set("%#&$_")
# Macros that are read and dropped, those of the second set with an argument.
TOLERATED, TOLERATED_ARG, SILENT = {"label", "nonumber", "hspace", "!", "notag"}, {"label", "hspace"}, {"displaystyle", "textstyle"}
UNSUPPORTED = {"substack", "atop", "over"}
RELATION_ENDS, BINARY_ENDS = set("=<>≤≥≠≈≡∼→⇒∈⊂"), set("+-")
PRIME = "′"
_STYLES = {"bold": "BOLD", "italic": "ITALIC", "script": "SCRIPT", "fraktur": "FRAKTUR", "double-struck": "DOUBLE-STRUCK", "sans-serif": "SANS-SERIF", "monospace": "MONOSPACE", "bold-italic": "BOLD ITALIC"}
_OLDER = {"script": "SCRIPT", "fraktur": "BLACK-LETTER", "double-struck": "DOUBLE-STRUCK"}


def styled(letter: str, style: str) -> str | None:
    """A letter or digit in a mathematical style, by its Unicode name; None if there is none."""
    try:
        name = unicodedata.name(letter)
    except ValueError:
        return None
    if letter.isascii() and letter.isdigit():
        names = [f"MATHEMATICAL {_STYLES[style]} {name}"]
    else:
        plain = name.replace("LATIN ", "").replace("GREEK ", "").replace("LETTER ", "")
        names = [f"MATHEMATICAL {_STYLES[style]} {plain}"] + [f"{_OLDER.get(style)} {plain}"] * (style in _OLDER) + ["PLANCK CONSTANT"] * (letter == "h" and style == "italic")
    for n in names:
        try:
            return unicodedata.lookup(n)
        except KeyError:
            continue
    return None


UNSTYLED = {s: (c, style) for style in _STYLES for c in [*map(chr, range(65, 91)), *map(chr, range(97, 123)), *"0123456789", *map(chr, range(0x3B1, 0x3CA)), *map(chr, range(0x391, 0x3AA))] if (s := styled(c, style))}
