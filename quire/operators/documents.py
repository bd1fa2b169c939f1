"""Documents and mathematics zones to tables: row-expanding parsers over Arrow batches.

Each function takes a DataFrame, its key columns and a text column, and gives the key columns
with typed rows. Parsers hold no state between rows and never raise on content: failures are
rows or columns (ok, error, offset, token).
"""

from __future__ import annotations

import difflib
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import doctex, inlines, mathtex, omml

#: Output rows that are gathered before a batch is passed on.
BATCH = 5000


def _run(batches, expand: Callable[..., Iterable[tuple]], names: list[str], kinds: list[pa.DataType], keys: int, most: int = BATCH):
    rows: list[tuple] = []

    def out():
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    for whole in batches:
        for batch in (whole.slice(k, most) for k in range(0, whole.num_rows, most)):
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for made in expand(*values[keys:]):
                    rows.append((*values[:keys], *made))
                    if len(rows) >= most:
                        yield out()
                        rows.clear()
    if rows:
        yield out()


def expanded(df: DataFrame, keys: list[str], inputs: list[str], expand: Callable[..., Iterable[tuple]], schema: str, most: int = BATCH) -> DataFrame:
    """keys and the rows that expand(*inputs) yields, typed by schema. most: rows that are held at once."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    made = _parse_datatype_string(schema)
    fields = [*[df.schema[k] for k in keys], *made.fields]
    kinds = [to_arrow_type(f.dataType) for f in fields]
    full = ", ".join([*[f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys], schema])
    work = partial(_run, expand=expand, names=[f.name for f in fields], kinds=kinds, keys=len(keys), most=most)
    return df.select(*keys, *inputs).mapInArrow(work, full)


def _zones(text):
    for k, z in enumerate(doctex.zones(text or "")):
        yield k, z.start, z.end, z.display, z.tex


def math_zones(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """zone_no, start, end, display, tex of all mathematics in a text."""
    return expanded(df, keys, [text], _zones, "zone_no int, start int, end int, display boolean, tex string")


def _canonical(tex):
    try:
        node, warnings = mathtex.parse(tex or "")
        yield True, mathtex.spell(node), None, None, None, warnings
    except mathtex.MathError as e:
        yield False, None, e.kind, e.pos, e.token, []
    except RecursionError:
        yield False, None, "too_deep", 0, "", []


def canonical_math(df: DataFrame, keys: list[str], tex: str) -> DataFrame:
    """ok, canonical, error, offset, token, warnings of every zone."""
    return expanded(df, keys, [tex], _canonical, "ok boolean, canonical string, error string, offset int, token string, warnings array<string>")


def _tokens(tex):
    try:
        for t in mathtex.tokenize(tex or ""):
            yield t.pos, t.kind, t.text
    except mathtex.MathError as e:
        yield e.pos, "error", e.kind


def math_tokens(df: DataFrame, keys: list[str], tex: str) -> DataFrame:
    """pos, kind, token of every zone; one row of kind error where it can't be read."""
    return expanded(df, keys, [tex], _tokens, "pos int, kind string, token string")


def _nodes(tex):
    try:
        rows = list(mathtex.flat(mathtex.parse(tex or "")[0]))
    except (mathtex.MathError, RecursionError):
        return
    ends = list(range(1, len(rows) + 1))
    for k in range(len(rows) - 1, 0, -1):
        up = rows[k][1]
        if up is not None:
            ends[up] = max(ends[up], ends[k])
    shown = ["" if r[4] == "space" else r[5] or "" for r in rows]
    for r, end in zip(rows, ends, strict=True):
        yield *r[:6], list(r[6].items()), end, "".join(shown[r[0] : end])


NODE = "node_id int, parent_id int, slot string, ord int, type string, value string, props map<string,string>, end_id int, span string"


def math_nodes(df: DataFrame, keys: list[str], tex: str) -> DataFrame:
    """The tree of every zone that parses, as rows: a subtree is the node_ids from its root's to before end_id, span what it shows without spaces."""
    return expanded(df, keys, [tex], _nodes, NODE)


def _omml(tex):
    try:
        yield omml.to_xml(mathtex.parse(tex or "")[0]), None
    except (mathtex.MathError, RecursionError) as e:
        yield None, getattr(e, "kind", "too_deep")


def math_omml(df: DataFrame, keys: list[str], tex: str) -> DataFrame:
    """omml: the equation's XML, or null and error."""
    return expanded(df, keys, [tex], _omml, "omml string, error string")


def _latex(xml):
    try:
        yield mathtex.spell(omml.from_xml(xml)), None
    except Exception as e:
        yield None, type(e).__name__


def omml_latex(df: DataFrame, keys: list[str], xml: str) -> DataFrame:
    """latex: the canonical spelling of an equation's XML, or null and error."""
    return expanded(df, keys, [xml], _latex, "latex string, error string")


def _blocks(text):
    try:
        for k, b in enumerate(doctex.blocks(text or "")):
            yield k, b.kind, b.level, b.label, b.text, b.start, b.end, b.warning
    except doctex.LabelError as e:
        yield None, "error", None, None, None, None, None, str(e)


def latex_blocks(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """block_no, kind, level, label, latex, start, end, warning; one row of kind error where labels are wrong."""
    return expanded(df, keys, [text], _blocks, "block_no int, kind string, level int, label int, latex string, start int, end int, warning string")


RUN = "run_no int, kind string, text string, bold boolean, italic boolean, underline boolean, strike boolean, small_caps boolean, mono boolean, superscript boolean, subscript boolean, color string, highlight string, link string"


def _runs(text):
    for k, r in enumerate(inlines.runs(text or "")):
        f = r.format
        yield k, r.kind, r.text, f.bold, f.italic, f.underline, f.strike, f.small_caps, f.mono, f.superscript, f.subscript, f.color, f.highlight, f.link


def latex_runs(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Formatted runs of a block's text (RUN): neighbours of one format are one row."""
    return expanded(df, keys, [text], _runs, RUN)


def _respelled(text):
    yield (inlines.spell(inlines.runs(text or "")),)


def canonical_prose(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """latex: a block's text parsed and spelled again, wrappers in a fixed order."""
    return expanded(df, keys, [text], _respelled, "latex string")


def _items(text):
    for i in inlines.items(text or ""):
        yield i.number, i.label, i.text


def list_items(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """item_no, item_label, item of a list environment's own items."""
    return expanded(df, keys, [text], _items, "item_no int, item_label string, item string")


def _cells(text):
    for c in inlines.cells(text or ""):
        yield c.row, c.number, c.grid_col, c.col_span, c.row_span, c.shading, c.text


def table_cells(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """row_no, cell_no, grid_col, col_span, row_span, shading, cell of a tabular."""
    return expanded(df, keys, [text], _cells, "row_no int, cell_no int, grid_col int, col_span int, row_span int, shading string, cell string")


def _findings(text, fragment):
    found = doctex.findings(text or "", fragment or "block")
    for d, at in zip(found, doctex.line_column(text or "", [d.offset for d in found]), strict=True):
        yield d.code, d.subject, d.offset, *at


def validate(df: DataFrame, keys: list[str], text: str, fragment: str) -> DataFrame:
    """code, subject, offset, line, col of everything that breaks the profile."""
    return expanded(df, keys, [text, fragment], _findings, "code string, subject string, offset int, line int, col int")


def _with_resources(text, fragment, resources):
    found = doctex.findings(text or "", fragment or "block", set(resources or ()))
    for d, at in zip(found, doctex.line_column(text or "", [d.offset for d in found]), strict=True):
        yield d.code, d.subject, d.offset, *at


def validate_resources(df: DataFrame, keys: list[str], text: str, fragment: str, resources: str) -> DataFrame:
    """The same, and images that are not among the array of paths resources."""
    return expanded(df, keys, [text, fragment, resources], _with_resources, "code string, subject string, offset int, line int, col int")


def check_files(df: DataFrame, keys: list[str], text: str, fragment: str) -> DataFrame:
    """(keys, n_findings, ok, first_code, first_line): the verdict on each text, clean ones too."""
    found = validate(df, keys, text, fragment).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_findings"), F.min(F.struct("offset", "code", "line")).alias("f"))
    out = df.select(*keys).join(found, keys, "left")
    return out.select(*keys, F.coalesce("n_findings", F.lit(0)).alias("n_findings"), F.col("f").isNull().alias("ok"), F.col("f.code").alias("first_code"), F.col("f.line").alias("first_line"))


def _marks(text):
    for m in doctex.marks(text or ""):
        yield m.kind, m.name, m.start, m.end


def latex_marks(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """kind, name, start, end of every mark in a text: commands, edges of environments, braces, dollars, comments, verbatim parts, blank lines."""
    return expanded(df, keys, [text], _marks, "kind string, name string, start int, end int")


def _tokenize(text):
    text, at = text or "", 0
    for m in doctex.marks(text):
        if m.start > at:
            yield at, "text", text[at : m.start]
        yield m.start, m.kind, text[m.start : m.end]
        at = m.end
    if at < len(text):
        yield at, "text", text[at:]


def latex_tokens(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """pos, kind, token of a whole text, nothing left out: joined in order the tokens give it again."""
    return expanded(df, keys, [text], _tokenize, "pos int, kind string, token string")


def object_census(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """n of every node type in every zone."""
    return nodes.groupBy(*keys, "type").agg(F.count(F.lit(1)).alias("n"))


def _increasing(places: list[int]) -> list[int]:
    """Indexes of a longest increasing subsequence."""
    tops, held, before = [], [], [-1] * len(places)
    for k, x in enumerate(places):
        i = bisect_left(tops, x)
        before[k] = held[i - 1] if i else -1
        if i == len(tops):
            tops.append(x)
            held.append(k)
        else:
            tops[i], held[i] = x, k
    out, k = [], held[-1] if held else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def anchors(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of places of values that occur once on both sides, in an order that both sides have; and, beside each, the equal values that go on from it."""
    once = lambda x: {v: k for k, v in enumerate(x) if n[v] == 1} if (n := Counter(x)) else {}
    x, y = once(a), once(b)
    pairs = sorted((x[v], y[v]) for v in x.keys() & y.keys())
    pairs = [pairs[k] for k in _increasing([j for _, j in pairs])]
    out, last = [], (-1, -1)
    for k, (i, j) in enumerate(pairs):
        if i <= last[0] or j <= last[1]:
            continue
        back = 0
        while i - back - 1 > last[0] and j - back - 1 > last[1] and a[i - back - 1] == b[j - back - 1]:
            back += 1
        limit = pairs[k + 1] if k + 1 < len(pairs) else (len(a), len(b))
        more = 0
        while i + more + 1 < limit[0] and j + more + 1 < limit[1] and a[i + more + 1] == b[j + more + 1]:
            more += 1
        out += [(i + d, j + d) for d in range(-back, more + 1)]
        last = out[-1]
    return out


#: Cells of a gap between anchors up to which it is aligned in full; a larger one is replaced as a whole.
GAP = 1_000_000


def alignment(a: list, b: list) -> list[tuple[str, int | None, int | None]]:
    """(op, place in a, place in b): equal, replace, delete or insert, in order. Gaps between anchors are aligned by their longest common blocks."""
    out, last = [], (0, 0)
    for i, j in [*anchors(a, b), (len(a), len(b))]:
        x, y = a[last[0] : i], b[last[1] : j]
        codes = difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes() if len(x) * len(y) <= GAP else [("replace", 0, len(x), 0, len(y))]
        for tag, i1, i2, j1, j2 in codes if x or y else ():
            both = min(i2 - i1, j2 - j1)
            out += [(tag, last[0] + i1 + k, last[1] + j1 + k) for k in range(both)]
            out += [("delete", last[0] + k, None) for k in range(i1 + both, i2)] + [("insert", None, last[1] + k) for k in range(j1 + both, j2)]
        if i < len(a) and j < len(b):
            out.append(("equal", i, j))
        last = i + 1, j + 1
    return out


def _align(doc: list[str], key: str, order: str):
    def work(frame):
        import pandas as pd

        frame = frame.sort_values(order)
        a, b = (frame[frame["is_old"] == side][key].tolist() for side in (True, False))
        out = alignment(a, b)
        return pd.DataFrame({d: [frame[d].iloc[0]] * len(out) for d in doc} | {"op": [x[0] for x in out], "old_no": pd.array([x[1] for x in out], "Int64"), "new_no": pd.array([x[2] for x in out], "Int64")})

    return work


def aligned(old: DataFrame, new: DataFrame, doc: list[str], key: str, order: str) -> DataFrame:
    """(doc, op, old_no, new_no): both versions of a document aligned by content, not by number: on values that are unique on both sides, then within the gaps. Both have doc, key and order."""
    both = old.select(*doc, key, order, F.lit(True).alias("is_old")).unionByName(new.select(*doc, key, order, F.lit(False).alias("is_old")))
    kinds = ", ".join(f"`{d}` {old.schema[d].dataType.simpleString()}" for d in doc)
    return both.groupBy(*doc).applyInPandas(_align(doc, key, order), f"{kinds}, op string, old_no long, new_no long")
