"""Queries of the document and mathematics operators, over LaTeX derived from the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import doctex, mathsigns
from quire.operators import aggregates as A
from quire.operators import documents as D
from quire.operators import joins as J
from quire.operators import packages as P
from quire.operators import verdicts as V
from quire.operators import workspace
from quire.sources import files, word

from . import expected

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Zones by the remainder of the part's key: {a} and {b} are numbers of the row.
_ZONES = [
    r"\sum_{{i={a}}}^n a_i = x^{b}", r"\frac{{{a}}}{{{b}}} + \sqrt{{x}}", r"\int_0^{a} f(x)\,dx + {b}", r"\left( \begin{{matrix}} {a} & {b} \\ c & d \end{{matrix}} \right)",
    r"\ln \tan x_{{{a}}} \le {b}", r"\mathbf{{AB}} \cdot \vec{{v}}_{b}", r"x^{a}^{b}", r"\nosuch{{{a}}} + {b}", r"( a + {b}", r"\newcommand{{\R}}{{\mathbb{{R}}}} x_{a} \in \R",
]


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(zone_id, source, tex): one zone per part."""
    number = lambda c: F.col(c).cast("string")
    made = None
    for k, z in enumerate(_ZONES):
        one = F.lit(z.replace("{{", "{").replace("}}", "}") if "{a}" not in z and "{b}" not in z else z.replace("{{", "\x01").replace("}}", "\x02").replace("{a}", "\x03").replace("{b}", "\x04").replace("\x01", "{").replace("\x02", "}"))
        one = F.replace(F.replace(one, F.lit("\x03"), number("a")), F.lit("\x04"), number("b"))
        made = F.when(F.col("k") == k, one) if made is None else made.when(F.col("k") == k, one)
    part = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("zone_id"), F.col("p_brand").alias("source"), (F.col("p_partkey") % len(_ZONES)).alias("k"), (F.col("p_size") % 7 + 1).alias("a"), (F.col("p_size") % 5 + 2).alias("b"))
    return part.select("zone_id", "source", made.alias("tex"))


def documents(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """(doc_id, text): one LaTeX document per customer with orders: headings, labelled paragraphs, a list, a table, mathematics, and planted faults. spread: over all cores however few bytes there are, for what takes long on a document."""
    lines = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), "o_orderkey", "o_orderstatus", F.round("o_totalprice", 0).cast("long").alias("price"))
    lines = lines.repartition(2 * spark.sparkContext.defaultParallelism, "doc_id") if spread else lines
    s = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    key, price = F.col("o_orderkey").cast("string"), F.col("price").cast("string")
    block = (
        F.when(F.col("o_orderkey") % 7 == 0, s("\\section{Order ", key, "}"))
        .when(F.col("o_orderkey") % 7 == 1, s("%lw:p:", key, "\nPaid $", price, " + x_1$ by \\textbf{card}."))
        .when(F.col("o_orderkey") % 7 == 2, s("\\begin{itemize}\n\\item ", key, "\n\\item ", price, "\n\\end{itemize}"))
        .when(F.col("o_orderkey") % 7 == 3, s("\\begin{tabular}{lc}\n", key, " & ", price, " \\\\\n\\end{tabular}"))
        .when(F.col("o_orderkey") % 7 == 4, s("\\[ \\frac{", price, "}{", key, "} = y \\]"))
        .when(F.col("o_orderkey") % 7 == 5, s("\\unknown{", key, "} and \\begin{theorem} no end"))
        .otherwise(s("Plain words of order ", key, " with 50\\% off. % a comment $z$"))
    )
    rows = lines.withColumn("s", F.struct("o_orderkey", block.alias("b"))).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["b"]), "\n\n").alias("body"))
    return rows.select("doc_id", s("\\documentclass{article}\n\\usepackage{amsmath,enumitem}\n\\begin{document}\n", F.col("body"), "\n\\end{document}\n").alias("text"))


#: The zones in SQL, and in e the expected rows of a parser for each.
_Z = "z AS (SELECT p_partkey AS zone_id, p_brand AS source, p_partkey % 10 AS k, CAST(p_size % 7 + 1 AS VARCHAR) AS a, CAST(p_size % 5 + 2 AS VARCHAR) AS b FROM part)"
_OWN = lambda x: f"replace(replace({x}, '<a>', a), '<b>', b)"
_CANON = f"WITH {_Z}, e(k, ok, canonical, error, pos, token) AS (VALUES {expected.CANONICAL}), c AS (SELECT zone_id, source, k, ok, {_OWN('canonical')} AS canonical, error, CAST(pos AS INT) AS \"offset\", token FROM z JOIN e USING (k))"
_TOKEN = f"WITH {_Z}, e(k, pos, kind, token) AS (VALUES {expected.TOKENS}), t AS (SELECT zone_id, pos, kind, {_OWN('token')} AS token FROM z JOIN e USING (k))"
_NODE = f"WITH {_Z}, e(k, node_id, parent_id, slot, ord, type, value, props, end_id, span) AS (VALUES {expected.NODES}), n AS (SELECT zone_id, k, node_id, parent_id, slot, ord, type, {_OWN('value')} AS value, props, end_id, {_OWN('span')} AS span FROM z JOIN e USING (k))"

#: The documents in SQL: t, an order's text, begin_at, where it begins, and last, whether it ends its document.
_D = """o AS (SELECT o_custkey AS doc_id, o_orderkey AS k, o_orderkey % 7 AS m, CAST(o_orderkey AS VARCHAR) AS s, CAST(CAST(round(o_totalprice, 0) AS BIGINT) AS VARCHAR) AS price FROM orders),
x AS (SELECT *, CASE m WHEN 0 THEN '\\section{Order ' || s || '}' WHEN 1 THEN '%lw:p:' || s || chr(10) || 'Paid $' || price || ' + x_1$ by \\textbf{card}.'
 WHEN 2 THEN '\\begin{itemize}' || chr(10) || '\\item ' || s || chr(10) || '\\item ' || price || chr(10) || '\\end{itemize}' WHEN 3 THEN '\\begin{tabular}{lc}' || chr(10) || s || ' & ' || price || ' \\\\' || chr(10) || '\\end{tabular}'
 WHEN 4 THEN '\\[ \\frac{' || price || '}{' || s || '} = y \\]' WHEN 5 THEN '\\unknown{' || s || '} and \\begin{theorem} no end' ELSE 'Plain words of order ' || s || ' with 50\\% off. % a comment $z$' END AS t FROM o),
d AS (SELECT *, {head} + coalesce(sum(length(t) + 2) OVER w, 0) AS begin_at, {lines} + coalesce(sum(length(t) - length(replace(t, chr(10), '')) + 2) OVER w, 0) AS line, k = max(k) OVER (PARTITION BY doc_id) AS last FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b0 AS (SELECT doc_id, k, m, s, price, 0 AS part, CASE m WHEN 0 THEN 'heading' WHEN 2 THEN 'list' WHEN 3 THEN 'table' WHEN 4 THEN 'equation' ELSE 'p' END AS kind, CASE m WHEN 0 THEN 1 END AS level, CASE m WHEN 1 THEN k END AS label,
 CASE m WHEN 1 THEN substr(t, 8 + length(s)) WHEN 5 THEN '\\unknown{' || s || '} and' ELSE t END AS latex, begin_at + CASE m WHEN 1 THEN 7 + length(s) ELSE 0 END AS a,
 CASE WHEN m = 5 THEN begin_at + 15 + length(s) WHEN m IN (1, 6) AND last THEN begin_at + length(t) + 1 ELSE begin_at + length(t) END AS e, NULL AS warning FROM d
 UNION ALL SELECT doc_id, k, m, s, price, 1, 'p', NULL, NULL, '\\begin{theorem} no end', begin_at + 15 + length(s), begin_at + length(t) + 1, 'unterminated theorem' FROM d WHERE m = 5),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k, part) - 1 AS block_no FROM b0)""".replace("{head}", str(len("\\documentclass{article}\n\\usepackage{amsmath,enumitem}\n\\begin{document}\n"))).replace("{lines}", "4")


@query(f"{_CANON} SELECT source, count(*) AS n_zones, count(DISTINCT canonical) AS n_forms, " + ", ".join(f"count(*) FILTER (error = '{k}') AS n_{k}" for k in ("unknown_macro", "unsupported", "unbalanced", "malformed", "unexpected", "definition")) + " FROM c GROUP BY source")
def math_report(spark, sf_dir):
    """Per source: zones, distinct canonical forms, failures by class."""
    got = D.canonical_math(zones(spark, sf_dir), ["zone_id", "source"], "tex")
    kinds = ("unknown_macro", "unsupported", "unbalanced", "malformed", "unexpected", "definition")
    return got.groupBy("source").agg(F.count(F.lit(1)).alias("n_zones"), F.count_distinct("canonical").alias("n_forms"), *[F.count_if(F.col("error") == k).alias(f"n_{k}") for k in kinds])


@query(f'{_CANON} SELECT zone_id, ok, canonical, error, "offset", token FROM c')
def canonicalize_math(spark, sf_dir):
    return D.canonical_math(zones(spark, sf_dir), ["zone_id"], "tex").select("zone_id", "ok", "canonical", "error", "offset", "token")


@query(f"{_TOKEN} SELECT * FROM t")
def math_tokens(spark, sf_dir):
    return D.math_tokens(zones(spark, sf_dir), ["zone_id"], "tex")


@query(f"{_NODE} SELECT zone_id, node_id, parent_id, slot, ord, type, value, props, end_id, span FROM n")
def math_nodes(spark, sf_dir):
    return D.math_nodes(zones(spark, sf_dir), ["zone_id"], "tex").withColumn("props", F.to_json("props"))


@query(f"{_CANON} SELECT zone_id, canonical AS latex, canonical, true AS same FROM c WHERE ok")
def math_omml_round_trip(spark, sf_dir):
    """The canonical form, and what it is after the way through equation XML."""
    x = D.math_omml(zones(spark, sf_dir), ["zone_id"], "tex").filter("omml is not null")
    back = D.omml_latex(x, ["zone_id"], "omml").select("zone_id", "latex")
    return back.join(D.canonical_math(zones(spark, sf_dir), ["zone_id"], "tex").select("zone_id", "canonical"), "zone_id").withColumn("same", F.col("latex") == F.col("canonical"))


@query(f"{_NODE} SELECT zone_id, type, count(*) AS n FROM n GROUP BY ALL")
def math_object_census(spark, sf_dir):
    return D.object_census(D.math_nodes(zones(spark, sf_dir), ["zone_id"], "tex"), ["zone_id"])


@query(f"{_NODE} SELECT zone_id, type, span, count(*) AS n FROM n GROUP BY ALL")
def math_scope_census(spark, sf_dir):
    """How often a node type covers which text."""
    nodes = D.math_nodes(zones(spark, sf_dir), ["zone_id"], "tex")
    return V.scope_census(nodes, "zone_id").groupBy("zone_id", "type", "span").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{_TOKEN} SELECT CASE WHEN token IN ('\\nosuch', '\\R') THEN 'unknown' ELSE 'handled' END AS bucket, count(*) AS n, count(DISTINCT token) AS kinds FROM t WHERE kind = 'macro' GROUP BY 1""")
def symbol_coverage(spark, sf_dir):
    """Macro uses by whether the vocabulary knows them."""
    uses = D.math_tokens(zones(spark, sf_dir), ["zone_id"], "tex").filter("kind = 'macro'").select(F.expr("substring(token, 2)").alias("macro"))
    names = set(mathsigns.SYMBOLS) | set(mathsigns.NARY) | set(mathsigns.FONTS) | set(mathsigns.FRACTIONS) | set(mathsigns.ACCENTS) | mathsigns.NAMES | set(mathsigns.ALIASES) | {"sqrt", "left", "right", ","}
    known = spark.createDataFrame([(n, "handled") for n in sorted(names)] + [(n, "deferred") for n in sorted(mathsigns.TOLERATED)], "macro string, bucket string")
    return A.coverage(uses, known, "macro")


@query(f"""WITH {_D}, n AS (SELECT doc_id, k, m, CASE m WHEN 1 THEN begin_at + 12 + length(s) ELSE begin_at END AS a, CASE m WHEN 1 THEN price || ' + x_1' ELSE '\\frac{{' || price || '}}{{' || s || '}} = y' END AS tex FROM d WHERE m IN (1, 4))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS zone_no, a AS start, a + length(tex) + CASE m WHEN 1 THEN 2 ELSE 6 END AS "end", m = 4 AS display, tex FROM n""")
def zone_extract(spark, sf_dir):
    return D.math_zones(documents(spark, sf_dir), ["doc_id"], "text")


@query(f'WITH {_D} SELECT doc_id, block_no, kind, level, label, latex, a AS start, e AS "end", warning FROM b')
def latex_blocks(spark, sf_dir):
    return D.latex_blocks(documents(spark, sf_dir), ["doc_id"], "text")


@query(f"WITH {_D} SELECT kind, count(*) AS n, count(warning) AS n_warnings FROM b GROUP BY kind")
def block_kinds(spark, sf_dir):
    return D.latex_blocks(documents(spark, sf_dir), ["doc_id"], "text").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("warning").alias("n_warnings"))


@query(f"WITH {_D} SELECT doc_id, label, kind, latex FROM b WHERE label IS NOT NULL")
def shadow_blocks(spark, sf_dir):
    return D.latex_blocks(documents(spark, sf_dir), ["doc_id"], "text").filter("label is not null").select("doc_id", "label", "kind", "latex")


@query(f"""WITH {_D}, f AS (SELECT doc_id, 'unknown-command' AS code, 'unknown' AS subject, begin_at AS o, line, 1 AS col FROM d WHERE m = 5 UNION ALL SELECT doc_id, code, subject, begin_at + 15 + length(s), line, 16 + length(s) FROM d, (VALUES ('custom-environment', 'theorem'), ('broken-environment', 'theorem: ended as document')) v(code, subject) WHERE m = 5)
SELECT doc_id, code, subject, o AS "offset", line, col FROM f""")
def validate_shadow(spark, sf_dir):
    return D.validate(documents(spark, sf_dir).withColumn("fragment", F.lit("document")), ["doc_id"], "text", "fragment")


@query("SELECT o_custkey AS doc_id, CASE WHEN bool_or(o_orderkey % 7 = 2) THEN 'enumitem' ELSE '' END AS packages FROM orders GROUP BY 1")
def package_requirements(spark, sf_dir):
    """Packages that the environments and commands of a document need."""
    names = F.regexp_extract_all("text", F.lit(r"\\(?:begin\{)?([A-Za-z]+)"), F.lit(1))
    uses = documents(spark, sf_dir).select("doc_id", F.explode(names).alias("feature")).distinct()
    needs = spark.createDataFrame(sorted(doctex.REQUIRES.items()), "feature string, package string")
    return A.required(uses, needs, ["doc_id"], sorted(doctex.PACKAGES)).select("doc_id", F.array_join("packages", ",").alias("packages"))


@query(f"""WITH {_D} SELECT doc_id, CAST(block_no AS BIGINT) AS seq_key, 0 AS part, CASE WHEN (block_no + doc_id) % 5 = 0 THEN 'replace' ELSE 'reuse' END AS action, block_no AS label, NULL AS before_label, NULL AS after_label FROM b WHERE (block_no + doc_id) % 11 <> 3
UNION ALL SELECT doc_id, 1099511627776 + block_no, 0, 'delete', block_no, NULL, NULL FROM b WHERE (block_no + doc_id) % 11 = 3""")
def block_edit_diff(spark, sf_dir):
    """Blocks of every document against an edited version: one block in five rewritten, one in eleven gone."""
    blocks = D.latex_blocks(documents(spark, sf_dir), ["doc_id"], "text").filter("kind <> 'error'").select("doc_id", F.col("block_no").alias("label"), "latex", F.col("block_no").alias("source_order"))
    edited = blocks.filter("(label + doc_id) % 11 <> 3").select("doc_id", F.col("source_order").alias("seq"), "label", F.when((F.col("label") + F.col("doc_id")) % 5 == 0, F.concat("latex", F.lit("!"))).otherwise(F.col("latex")).alias("latex"))
    return J.block_actions(blocks, edited, ["doc_id"])


@query()
def sequence_alignment(spark, sf_dir):
    """Both versions aligned by content."""
    blocks = D.latex_blocks(documents(spark, sf_dir), ["doc_id"], "text").filter("kind <> 'error'").select("doc_id", "block_no", "latex")
    new = blocks.filter("block_no % 4 <> 1").withColumn("latex", F.when(F.col("block_no") % 6 == 2, F.concat("latex", F.lit("?"))).otherwise(F.col("latex")))
    return D.aligned(blocks, new, ["doc_id"], "latex", "block_no")


def _blocks_of(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return D.latex_blocks(documents(spark, sf_dir), ["doc_id"], "text").filter(F.col("kind") == kind).select("doc_id", "block_no", "latex")


@query(f"""WITH {_D}, r AS (SELECT doc_id, block_no, unnest(CASE WHEN m = 1 THEN [{{'k': 'text', 't': 'Paid ', 'b': false}}, {{'k': 'math', 't': price || ' + x_1', 'b': false}}, {{'k': 'text', 't': ' by ', 'b': false}}, {{'k': 'text', 't': 'card', 'b': true}}, {{'k': 'text', 't': '.', 'b': false}}]
 WHEN m = 5 AND part = 0 THEN [{{'k': 'text', 't': s || ' and', 'b': false}}] WHEN m = 5 THEN [{{'k': 'text', 't': 'theorem no end', 'b': false}}] ELSE [{{'k': 'text', 't': 'Plain words of order ' || s || ' with 50% off. ', 'b': false}}] END) AS x, unnest(range(0, CASE WHEN m = 1 THEN 5 ELSE 1 END)) AS run_no FROM b WHERE kind = 'p')
SELECT doc_id, block_no, run_no, x.k AS kind, x.t AS text, x.b AS bold, false AS italic, false AS underline, false AS strike, false AS small_caps, false AS mono, false AS superscript, false AS subscript, NULL AS color, NULL AS highlight, NULL AS link FROM r""")
def latex_inlines(spark, sf_dir):
    return D.latex_runs(_blocks_of(spark, sf_dir, "p"), ["doc_id", "block_no"], "latex")


@query(f"""WITH {_D}, p AS (SELECT doc_id, block_no, CASE WHEN m = 1 THEN latex WHEN m = 5 AND part = 0 THEN s || ' and' WHEN m = 5 THEN 'theorem no end' ELSE 'Plain words of order ' || s || ' with 50\\% off. ' END AS t FROM b WHERE kind = 'p') SELECT doc_id, block_no, t AS latex, t AS again, true AS stable FROM p""")
def prose_canonical(spark, sf_dir):
    """A block's text spelled again, and again: the second pass changes nothing."""
    once = D.canonical_prose(_blocks_of(spark, sf_dir, "p"), ["doc_id", "block_no"], "latex")
    twice = D.canonical_prose(once, ["doc_id", "block_no"], "latex").withColumnRenamed("latex", "again")
    return once.join(twice, ["doc_id", "block_no"]).withColumn("stable", F.col("latex") == F.col("again"))


@query(f"WITH {_D} SELECT doc_id, block_no, n AS item_no, NULL AS item_label, CASE n WHEN 1 THEN s ELSE price END AS item FROM b, (VALUES (1), (2)) v(n) WHERE kind = 'list'")
def list_items(spark, sf_dir):
    return D.list_items(_blocks_of(spark, sf_dir, "list"), ["doc_id", "block_no"], "latex")


@query(f"WITH {_D} SELECT doc_id, block_no, 0 AS row_no, n AS cell_no, n AS grid_col, 1 AS col_span, 1 AS row_span, NULL AS shading, CASE n WHEN 0 THEN s ELSE price END AS cell FROM b, (VALUES (0), (1)) v(n) WHERE kind = 'table'")
def table_cells(spark, sf_dir):
    return D.table_cells(_blocks_of(spark, sf_dir, "table"), ["doc_id", "block_no"], "latex")


#: Every block's canonical LaTeX.
_CANONICAL_BLOCKS = """c AS (SELECT doc_id, k, part, block_no, kind, s, price, m, CASE WHEN m = 1 THEN 'Paid $' || price || '+x_{1}$ by \\textbf{card}.' WHEN m = 4 THEN '\\[ \\frac{' || price || '}{' || s || '}=y \\]' WHEN m = 5 AND part = 0 THEN s || ' and' WHEN m = 5 THEN 'theorem no end'
 WHEN m = 6 THEN 'Plain words of order ' || s || ' with 50\\% off.' ELSE latex END AS latex FROM b)"""


@query(f"WITH {_D}, {_CANONICAL_BLOCKS} SELECT doc_id, string_agg(latex, chr(10) || chr(10) ORDER BY block_no) AS latex FROM c GROUP BY doc_id")
def word_round_trip(spark, sf_dir):
    """Every document written as a Word package, read back and spelled as LaTeX: its canonical form."""
    made = word.word_documents(documents(spark, sf_dir), ["doc_id"], "text")
    return word.word_latex(made, ["doc_id"], "content").select("doc_id", "latex")


@query(f"WITH {_D}, {_CANONICAL_BLOCKS} SELECT doc_id, string_agg(latex, chr(10) || chr(10) ORDER BY block_no) AS latex FROM c GROUP BY doc_id")
def document_canonical(spark, sf_dir):
    """The canonical spelling of every document's content."""
    return word.canonical_documents(documents(spark, sf_dir), ["doc_id"], "text").select("doc_id", "latex")


@query(f"""WITH {_D}, {_CANONICAL_BLOCKS} SELECT doc_id, CAST(block_no AS BIGINT) AS block_no, CAST(coalesce(sum(length(latex) + 2) OVER w, 0) AS BIGINT) AS start, CAST(coalesce(sum(length(latex) + 2) OVER w, 0) + length(latex) AS BIGINT) AS "end", sha256(latex) AS sha256 FROM c
WINDOW w AS (PARTITION BY doc_id ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def serializer_spans(spark, sf_dir):
    """Where every block stands in the canonical spelling."""
    out = word.serialized_spans(documents(spark, sf_dir), ["doc_id"], "text")
    return out.select("doc_id", F.col("block_no").cast("long").alias("block_no"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "sha256")


@query(f"WITH {_D} SELECT doc_id, '\\documentclass{{article}}' || chr(10) || '\\usepackage{{amsmath,enumitem}}' || chr(10) || '\\begin{{document}}' || chr(10) || string_agg(t, chr(10) || chr(10) ORDER BY k) || chr(10) || '\\end{{document}}' || chr(10) AS text FROM d GROUP BY doc_id")
def document_tokens(spark, sf_dir):
    """Tokens of every document, joined again: nothing is lost."""
    rows = D.latex_tokens(documents(spark, sf_dir), ["doc_id"], "text")
    each = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("t"))
    return each.select("doc_id", F.array_join(F.transform("t", lambda x: x["token"]), "").alias("text"))


@query(f"""WITH {_D} SELECT doc_id, count(*) FILTER (m = 5) * 3 AS n_findings, count(*) FILTER (m = 5) = 0 AS ok, CASE WHEN count(*) FILTER (m = 5) > 0 THEN 'unknown-command' END AS first_code, min(line) FILTER (m = 5) AS first_line FROM d GROUP BY doc_id""")
def file_check(spark, sf_dir):
    """The verdict on every document."""
    docs = documents(spark, sf_dir).withColumn("fragment", F.lit("document"))
    return D.check_files(docs, ["doc_id"], "text", "fragment")


def _word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word.word_documents(documents(spark, sf_dir, spread=True), ["doc_id"], "text").select("doc_id", "content")


@query(f"WITH {_D}, {_CANONICAL_BLOCKS} SELECT doc_id, block_no + 1 AS label, CASE kind WHEN 'equation' THEN 'math' ELSE kind END AS kind, latex, sha256(latex) AS sha256, block_no AS source_order FROM c")
def block_map(spark, sf_dir):
    """Block maps of the Word documents, through JSON."""
    maps = workspace.to_json(workspace.block_map(_word(spark, sf_dir), ["doc_id"]), ["doc_id"], generation=1)
    return workspace.from_json(maps, ["doc_id"]).select("doc_id", "label", "kind", "latex", "sha256", "source_order")


@query(f"""WITH {_D}, {_CANONICAL_BLOCKS}, n AS (SELECT *, block_no + 1 AS label FROM c),
e AS (SELECT doc_id, label, CASE WHEN kind = 'p' AND label % 4 = 0 THEN 'Rewritten ' || label ELSE latex END AS latex FROM n WHERE label % 6 <> 5)
SELECT doc_id, string_agg(latex, chr(10) || chr(10) ORDER BY label) || chr(10) || chr(10) || 'A new end.' AS latex FROM e GROUP BY doc_id""")
def block_edit_apply(spark, sf_dir):
    """Word documents with one paragraph in four rewritten, one block in six gone and a new one at the end, read back."""
    docs = word.word_maps(_word(spark, sf_dir), ["doc_id"], "content").filter("error is null")
    kept = docs.withColumn("kept", F.filter("blocks", lambda b: b["label"] % 6 != 5)).filter("size(kept) > 0")
    rewritten = lambda b: F.when((b["kind"] == "p") & (b["label"] % 4 == 0), F.concat(F.lit("Rewritten "), b["label"].cast("string"))).otherwise(b["latex"])
    edited = workspace.shadow_text(F.transform("kept", lambda b: b.withField("latex", rewritten(b))))
    held = F.transform("blocks", lambda b: F.struct(b["elements"].alias("elements"), b["latex"].alias("latex")))
    texts = kept.select("doc_id", "content", F.concat(edited, F.lit("\n\nA new end.")).alias("text"), held.alias("blocks"))
    made = word.patched_documents(texts, ["doc_id"], "content", "text", "blocks")
    return word.word_latex(made.filter("error is null"), ["doc_id"], "content").select("doc_id", "latex")


@query("SELECT o_custkey AS doc_id, code FROM (SELECT DISTINCT o_custkey FROM orders) JOIN (VALUES (0, 'other-source'), (1, 'changed-block'), (1, 'label-order')) v(r, code) ON o_custkey % 3 = r")
def map_integrity(spark, sf_dir):
    """Block maps against their documents, two in three of them spoilt."""
    docs = _word(spark, sf_dir)
    rows, third = workspace.block_map(docs, ["doc_id"]), F.col("doc_id") % 3
    rows = rows.withColumns({"source_sha256": F.when(third == 0, F.lit("x")).otherwise(F.col("source_sha256")), "latex": F.when(third == 1, F.concat("latex", F.lit("?"))).otherwise(F.col("latex")), "label": F.when(third == 1, F.col("label") + 1).otherwise(F.col("label"))})
    return workspace.integrity(rows, docs, ["doc_id"])


@query("""WITH d AS (SELECT o_custkey AS doc_id, bool_or(o_orderkey % 7 = 2) AS lists FROM orders GROUP BY 1 HAVING o_custkey % 3 = 0),
i(part, code, detail, lists) AS (VALUES ('[Content_Types].xml', 'missing-part', 'word/document.xml', false), ('_rels/.rels', 'missing-target', 'word/document.xml', false), ('word/_rels/document.xml.rels', 'missing-source', 'word/document.xml', true))
SELECT doc_id, part, code, detail FROM d, i WHERE d.lists OR NOT i.lists""")
def package_issues(spark, sf_dir):
    """Integrity of the written packages, one in three of them without its document part's entry."""
    parts = files.parts(_word(spark, sf_dir), ["doc_id"]).filter("not (doc_id % 3 = 0 and part = 'word/document.xml')")
    return P.package_issues(files.facts(parts, ["doc_id"]), ["doc_id"])


@query(f"""{_CANON}, v AS (SELECT CASE WHEN k = 1 THEN 'degradation' ELSE 'identical' END AS verdict FROM c WHERE ok) SELECT verdict, count(*) AS n FROM v GROUP BY verdict""")
def math_verdicts(spark, sf_dir):
    """Zones against a version with every fraction made a binomial."""
    z = zones(spark, sf_dir)
    new = z.withColumn("tex", F.replace(F.col("tex"), F.lit("\\frac"), F.lit("\\binom")))
    return V.compare(D.math_nodes(z, ["zone_id"], "tex"), D.math_nodes(new, ["zone_id"], "tex"), "zone_id").groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))
