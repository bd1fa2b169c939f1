"""Verdicts over censuses, and numbering of Word paragraphs."""

from quire.operators import documents as D
from quire.operators import verdicts as V
from quire.sources import files, word

from .test_documents import W, package


def test_compare(spark):
    pairs = [(1, "a+b", "a+b"), (2, "a+b", "a"), (3, "a", "a+b"), (4, r"\sqrt{ab}", r"\sqrt{a}b"), (5, r"a\,b", r"a\:b"), (6, r"\sum\limits_a b", r"\sum\nolimits_a b"), (7, r"\frac{a}{b}", "ab")]
    df = spark.createDataFrame(pairs, "zone_id int, old string, new string")
    old, new = (D.math_nodes(df, ["zone_id"], c) for c in ("old", "new"))
    got = {r["zone_id"]: r["verdict"] for r in V.compare(old, new.filter("zone_id <> 99"), "zone_id").collect()}
    assert got == {1: "identical", 2: "degradation", 3: "improvement", 4: "degradation", 5: "neutral", 6: "degradation", 7: "degradation"}


def test_list_info(spark):
    extra = {
        "word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:numPr><w:ilvl w:val="1"/><w:numId w:val="5"/></w:numPr></w:pPr><w:r><w:t>a</w:t></w:r></w:p><w:p><w:pPr><w:pStyle w:val="L"/></w:pPr><w:r><w:t>b</w:t></w:r></w:p><w:p><w:r><w:t>c</w:t></w:r></w:p></w:body></w:document>',
        "word/numbering.xml": f'<w:numbering {W}><w:abstractNum w:abstractNumId="3"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/><w:lvlText w:val="%1."/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="bullet"/><w:lvlText w:val="-"/></w:lvl></w:abstractNum><w:num w:numId="5"><w:abstractNumId w:val="3"/></w:num></w:numbering>',
        "word/styles.xml": f'<w:styles {W}><w:style w:styleId="L"><w:pPr><w:numPr><w:numId w:val="5"/></w:numPr></w:pPr></w:style></w:styles>',
    }
    parts = files.parts(spark.createDataFrame([(1, package(extra))], "doc_id long, content binary"), ["doc_id"])
    rows = word.list_info(word.body_rows(parts, ["doc_id"]), word.numbering(parts, ["doc_id"]), word.style_numbers(parts, ["doc_id"]), ["doc_id"])
    assert {(r["text"], r["list_format"], r["list_template"]) for r in rows.collect()} == {("a", "bullet", "-"), ("b", "decimal", "%1."), ("c", None, None)}
