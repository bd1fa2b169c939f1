"""Text functions as Spark column expressions: all run inside generated code, none in Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of special characters in prose.
ESCAPES = {"\\": "\\textbackslash{}", "{": "\\{", "}": "\\}", "$": "\\$", "&": "\\&", "#": "\\#", "_": "\\_", "%": "\\%", "~": "\\textasciitilde{}", "^": "\\textasciicircum{}"}
TYPOGRAPHY = (("…", "\\ldots{}"), ("—", "---"), ("–", "--"), ("“", "``"), ("”", "''"), (" ", "~"))
# Named colours.
COLOURS = {"red": "FF0000", "green": "00FF00", "blue": "0000FF", "cyan": "00FFFF", "magenta": "FF00FF", "yellow": "FFFF00", "black": "000000", "white": "FFFFFF", "gray": "808080", "darkgray": "A9A9A9", "lightgray": "D3D3D3", "brown": "BF8040", "lime": "BFFF00", "olive": "808000", "orange": "FF8000", "pink": "FFBFBF", "purple": "BF0040", "teal": "008080", "violet": "800080"}
# Units in English Metric Units.
UNITS = {"cm": 360000.0, "mm": 36000.0, "in": 914400.0, "pt": 12700.0, "bp": 12700.0}

#: Private-use characters that stand for a backslash and braces while the others are replaced.
_MARKS = {"\\": "", "{": "", "}": ""}


def url_escape(text: Column) -> Column:
    """Special characters spelled out, in one pass: what a replacement brings in is not replaced again."""
    out = text
    for plain, mark in _MARKS.items():
        out = F.replace(out, F.lit(plain), F.lit(mark))
    for plain, spelled in ESCAPES.items():
        out = F.replace(out, F.lit(_MARKS.get(plain, plain)), F.lit(spelled))
    return out


def prose_escape(text: Column) -> Column:
    """Special characters and typographic signs spelled out."""
    out = url_escape(text)
    for sign, spelled in TYPOGRAPHY:
        out = F.replace(out, F.lit(sign), F.lit(spelled))
    return out


def prose_unescape(text: Column) -> Column:
    """Spelled dashes, quotes and ties to their signs, the longest spelling first."""
    out = text
    for sign, spelled in TYPOGRAPHY[1:]:
        out = F.replace(out, F.lit(spelled), F.lit(sign))
    return out


def url_unescape(text: Column) -> Column:
    """Undoes url_escape; a backslash that begins no known spelling stays."""
    spelled = sorted(ESCAPES.items(), key=lambda x: -len(x[1]))
    pattern = "|".join(f"\\Q{s}\\E" for _, s in spelled)
    parts, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    plain = F.create_map(*[F.lit(x) for p, s in spelled for x in (s, p)])
    return F.array_join(F.transform(F.arrays_zip(parts.alias("a"), found.alias("b")), lambda x: F.concat(x["a"], F.coalesce(plain[x["b"]], F.lit("")))), "")


def strip_comments(text: Column) -> Column:
    """Every line is cut at its first percent sign that has no backslash just before it."""
    return F.regexp_replace(text, r"(?m)(^|[^\\\n])%[^\n]*", "$1")


def heading_level(style: Column) -> Column:
    """0 for a title, 1-3 for section names, the digit of headingN, else null."""
    plain = F.regexp_replace(F.lower(style), "[^a-z0-9]", "")
    number = F.regexp_extract(plain, "^heading([1-9])$", 1)
    return (
        F.when(style.isNull() | (style == ""), F.lit(None))
        .when(plain.endswith("title"), F.lit(0)).when(plain.endswith("subsubsection"), F.lit(3)).when(plain.endswith("subsection"), F.lit(2)).when(plain.endswith("section"), F.lit(1))
        .when(number != "", number.cast("int"))
    ).cast("int")


def colour(value: Column, model: Column) -> Column:
    """RRGGBB of a colour argument: hex under the HTML model, else hex or a name, else null."""
    trimmed = F.trim(value)
    hexed = F.when(trimmed.rlike("^[0-9A-Fa-f]{6}$"), F.upper(trimmed))
    names = F.create_map(*[F.lit(x) for pair in COLOURS.items() for x in pair])
    return F.when(F.upper(F.trim(model)) == "HTML", hexed).otherwise(F.coalesce(hexed, F.try_element_at(names, F.lower(trimmed))))


def toggle(present: Column, value: Column) -> Column:
    """A three-state switch: absent is off, present without a value is on, else by the value."""
    return F.when(~present, F.lit(False)).when(value.isNull(), F.lit(True)).otherwise(~F.lower(value).isin("0", "false", "off", "none"))


def squeeze(text: Column) -> Column:
    """Runs of white space to one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def space_runs(text: Column) -> Column:
    """Lengths of the runs of blanks, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit("( +)"), F.lit(1)), F.length)


def length_emu(options: Column, key: str) -> Column:
    """key=1.5cm in an option list to English Metric Units, half to even; null without a known unit."""
    pattern = rf"(?:^|,)\s*{key}\s*=\s*([0-9]*\.?[0-9]+)\s*(cm|mm|in|pt|bp)\b"
    number, unit = F.regexp_extract(options, pattern, 1), F.regexp_extract(options, pattern, 2)
    scale = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    return F.when(number != "", F.bround(number.cast("double") * F.try_element_at(scale, unit)).cast("long"))


def size_options(width: Column, height: Column) -> Column:
    """Sizes in English Metric Units as graphics options in big points; sizes of 0 or null are left out."""
    one = lambda name, x: F.when(x > 0, F.format_string(f"{name}=%.5fbp", x / 12700.0))
    return F.concat_ws(",", one("width", width), one("height", height))


def line_column(text: Column, offset: Column) -> tuple[Column, Column]:
    """Line and column, from 1, of a code-point offset; offsets outside are clamped."""
    before = F.substring(text, F.lit(1), F.greatest(F.lit(0), F.least(offset, F.length(text))).cast("int"))
    lines = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))
    return (lines + 1).cast("long"), (F.length(F.substring_index(before, "\n", -1)) + 1).cast("long")


def node_id(ordinal: Column) -> Column:
    """n and eight digits; null for a negative ordinal."""
    return F.when(ordinal >= 0, F.format_string("n%08d", ordinal))


def column_spec(spec: Column) -> tuple[Column, Column, Column]:
    """Number of l, c and r columns, bars at both edges, bars within."""
    plain = F.regexp_replace(spec, r"\s+", "")
    return F.regexp_count(plain, F.lit("[lcr]")), plain.startswith("|") & plain.endswith("|"), F.regexp_like(plain, F.lit(r"[lcr]\|+[lcr]"))


def content_key(*columns: Column) -> Column:
    """A digest that is equal for equal values and nothing else."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


# Spellings of switches, and properties that are numbers.
ON, OFF, NUMBERS = ("1", "on", "true"), ("0", "off", "false"), ("count",)


def switch_value(value: Column, prop: Column) -> Column:
    """on and off for their spellings, trimmed numbers for numeric properties, all else as it is."""
    plain = F.lower(F.trim(value))
    return F.when(prop.isin(*NUMBERS), F.trim(value)).when(plain.isin(*ON), "on").when(plain.isin(*OFF), "off").otherwise(value)


def math_text(text: Column) -> Column:
    """Text of mathematics with one glyph for equals: minus signs, dots, primes; no white space."""
    return F.regexp_replace(F.translate(text, "-·’'", "−⋅′′"), r"\s+", "")


def spelled_spaces(text: Column) -> Column:
    """Blanks after a blank as control spaces, so that all of them show."""
    return F.regexp_replace(text, "(?<= ) ", r"\\ ")


def spelled_hyphens(text: Column) -> Column:
    """Hyphens after a hyphen kept apart, so that they don't become dashes."""
    return F.regexp_replace(text, "(?<=-)-", "{}-")


# Counters of list labels and the number formats they stand for.
COUNTERS = {"arabic": "decimal", "alph": "lowerLetter", "Alph": "upperLetter", "roman": "lowerRoman", "Roman": "upperRoman"}
LEVEL_NAMES = ("enumi", "enumii", "enumiii", "enumiv", "enumv", "enumvi", "enumvii", "enumviii", "enumix")


def label_format(label: Column) -> Column:
    """Number format of a list label: by its last counter; a label without one is a bullet, an empty one none."""
    names = F.create_map(*[F.lit(x) for pair in COUNTERS.items() for x in pair])
    found = F.regexp_extract_all(label, F.lit(r"\\(arabic|alph|Alph|roman|Roman)(?:\*|\{enum[ivx]+\})"), F.lit(1))
    return F.when(F.coalesce(label, F.lit("")) != "", F.coalesce(F.try_element_at(names, F.try_element_at(found, F.lit(-1))), F.lit("bullet")))


def word_label(label: Column, level: Column) -> Column:
    """A list label with Word's level places: counters of a named level by its number, others by level (from 0)."""
    out = label
    for k, name in enumerate(LEVEL_NAMES):
        out = F.regexp_replace(out, rf"\\(?:arabic|alph|Alph|roman|Roman)\{{{name}\}}", f"%{k + 1}")
    return F.regexp_replace(out, F.lit(r"\\(?:arabic|alph|Alph|roman|Roman)\*"), F.concat(F.lit("%"), (level + 1).cast("string")))


def latex_label(format_: Column, template: Column) -> Column:
    """The label of a Word level: its template with the places of levels as counters; a bullet's sign as it is. The first place has the level's own format, as have all."""
    names = F.create_map(*[F.lit(x) for c, f in COUNTERS.items() for x in (f, c)])
    counter = F.coalesce(F.try_element_at(names, format_), F.lit("arabic"))
    out = template
    for k, name in reversed(list(enumerate(LEVEL_NAMES))):
        out = F.replace(out, F.lit(f"%{k + 1}"), F.concat(F.lit("\\"), counter, F.lit(f"{{{name}}}")))
    return F.when(format_ == "bullet", template).otherwise(out)


def field_parts(code: Column) -> tuple[Column, Column]:
    """Kind and target of a field code: REF, PAGEREF and SEQ have a word, HYPERLINK a quoted URL whose quotes are doubled."""
    kind = F.regexp_extract(code, r"^\s*(REF|PAGEREF|HYPERLINK|SEQ)\b", 1)
    word = F.regexp_extract(code, r"^\s*[A-Z]+\s+([^\s]+)", 1)
    url = F.replace(F.regexp_extract(code, r'^\s*HYPERLINK\s+"((?:[^"]|"")*)"', 1), F.lit('""'), F.lit('"'))
    target = F.when(kind == "HYPERLINK", url).otherwise(word)
    return F.when(kind != "", kind), F.when((kind != "") & (target != ""), target)


#: Names of bookmarks that are made by programs.
INTERNAL_BOOKMARK = r"^(_GoBack|_Toc[0-9]+|_Hlk[0-9]+|X[0-9a-f]{20,})$"


def authored_bookmark(name: Column) -> Column:
    return ~name.rlike(INTERNAL_BOOKMARK)


def plain_style(name: Column) -> Column:
    """Whether a style's display name is that of ordinary text."""
    return F.lower(F.trim(name)).isin("normal", "body text", "default paragraph style", "no spacing")
