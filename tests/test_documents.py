"""Document LaTeX, equation XML and packages."""

import io
import zipfile

import pytest

from quire.functions import doctex, mathtex, omml
from quire.operators import packages as P
from quire.plans import documents
from quire.sources import files

from .test_mathtex import SPELLINGS


@pytest.mark.parametrize("tex", sorted(SPELLINGS))
def test_equation_xml_round_trip(tex):
    want = mathtex.canonical(tex)
    back = mathtex.spell(omml.from_xml(omml.to_xml(mathtex.parse(tex)[0])))
    assert mathtex.canonical(back) == mathtex.canonical(want)


def test_zones():
    text = "a $x$ \\(y\\) $$z$$ \\[w\\] % $no$\n\\begin{verbatim}$no$\\end{verbatim}\\begin{align*}a&=b\\end{align*}\\begin{equation}q\\end{equation} 5\\$ and 6\\$"
    got = doctex.zones(text)
    assert [z.tex for z in got] == ["x", "y", "z", "w", "\\begin{align*}a&=b\\end{align*}", "q"]
    assert [z.display for z in got] == [False, False, True, True, True, True]
    assert all(text[z.start : z.end].strip("$\\()[]") for z in got)


def test_blocks():
    text = "\\documentclass{a}\\begin{document}\n\\section{A {b}}\n%lw:p:3\nfirst {x\n\ny} line\n\nsecond\n\\begin{itemize}\\item a\\end{itemize}\n\\[x\\]\n\\begin{figure}\n\nrest\\end{document}"
    got = doctex.blocks(text)
    assert [(b.kind, b.label) for b in got] == [("heading", None), ("p", 3), ("p", None), ("list", None), ("equation", None), ("figure", None), ("p", None)]
    assert got[0].level == 1 and got[5].warning.startswith("unterminated") and got[1].text == "first {x\n\ny} line"
    assert all(text[b.start : b.end].strip() == b.text for b in got)
    for bad in ("%lw:p:1\na\n\n%lw:p:1\nb", "%lw:p:1\n"):
        with pytest.raises(doctex.LabelError):
            doctex.blocks(bad)
    assert doctex.blocks("") == [] and doctex.blocks("  \n ") == []


def test_findings():
    codes = lambda *a: {d.code for d in doctex.findings(*a)}
    good = "\\documentclass{a}\\usepackage{amsmath}\\begin{document}\\begin{equation}x\\end{equation}\\end{document}"
    assert doctex.findings(good) == []
    assert codes("x", "nothing") == {"invalid-fragment-kind"}
    assert codes("\\newcommand{\\a}{b} \\usepackage{tikz} \\begin{foo}\\end{foo} \\bar \\begin{quote}", "block") == {"macro-definition", "unapproved-package", "custom-environment", "unknown-command", "broken-environment"}
    assert codes("\\begin{itemize}" * 5 + "\\end{itemize}" * 5, "block") == {"invalid-nesting"}
    assert codes("\\includegraphics{../x.png}\\includegraphics{a.png}", "block", {"a.png"}) == {"new-resource"}
    assert codes("$\\nosuch$", "math") == {"unknown-math-command"} and codes("text", "math") == {"invalid-nesting"}
    assert codes("\\begin{enumerate}[start=x,foo]\\end{enumerate}", "block") == {"unknown-command"}


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def package(extra=None, drop=()):
    entries = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="a"/><Default Extension="rels" ContentType="r"/><Default Extension="png" ContentType="image/png"/><Override PartName="/word/document.xml" ContentType="doc"/></Types>',
        "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="t" Target="word/document.xml"/></Relationships>',
        "word/document.xml": f'<w:document {W}><w:bookmarkStart w:id="1"/><w:bookmarkEnd w:id="1"/><w:footnoteReference w:id="2"/><a r:embed="rId1"/></w:document>',
        "word/_rels/document.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="image" Target="media/a.png"/><Relationship Id="rId2" Type="link" Target="http://x" TargetMode="External"/></Relationships>',
        "word/media/a.png": "x", "word/footnotes.xml": f'<w:footnotes {W}><w:footnote w:id="2"/><w:footnote w:id="0" w:type="separator"/></w:footnotes>',
    }
    entries |= extra or {}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in entries.items():
            if name not in drop:
                z.writestr(name, body)
    return bytearray(out.getvalue())


def test_packages(spark, tmp_path):
    broken = {"word/document.xml": f'<w:document {W}><w:bookmarkStart w:id="1"/><w:footnoteReference w:id="9"/><a r:id="gone"/></w:document>', "word/odd.bin": "x", "word/bad.xml": "<a"}
    rows = [("good", package()), ("bad", package(broken, ["word/media/a.png"])), ("none", bytearray(b"not a zip"))]
    table = files.parts(spark.createDataFrame(rows, "path string, content binary"), ["path"])
    types, rels, marks = files.content_types(table, ["path"]), files.relationships(table, ["path"]), files.marks(table, ["path"])
    got = {(r["path"], r["part"], r["code"], r["detail"]) for r in P.issues(table, types, rels, marks, ["path"]).collect()}
    assert not [g for g in got if g[0] == "good"]
    codes = {(g[0], g[2]) for g in got}
    assert codes == {("bad", c) for c in ("missing-target", "missing-content-type", "missing-relationship-reference", "missing-footnote", "unbalanced-bookmark", "invalid-xml")} | {("none", "broken"), ("none", "missing")}
    assert {(r["path"], r["part"]) for r in P.reachable_parts(rels, "path", "").collect()} == {(p, x) for p in ("good", "bad") for x in ("", "word/document.xml", "word/media/a.png")}
    assert {tuple(r) for r in P.note_texts(marks, "footnote", ["path"]).collect()} == {("good", "2", "word/document.xml", True), ("bad", "9", "word/document.xml", False)}
    typed = {r["part"]: r["content_type"] for r in P.part_types(table.filter("path = 'good'"), types, ["path"]).collect()}
    assert typed["word/document.xml"] == "doc" and typed["word/media/a.png"] == "image/png"
    (tmp_path / "a.docx").write_bytes(rows[0][1])
    (tmp_path / "~$a.docx").write_bytes(b"")
    (tmp_path / "b.tex").write_text("x\ny")
    assert files.package_files(spark, str(tmp_path)).count() == 1 and files.latex_files(spark, str(tmp_path)).first()["text"] == "x\ny"


def test_issues_read_every_package_once(spark, sf_dir):
    from quire.plans import documents as plans

    plan = plans.QUERIES["package_issues"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 3 and plan.count("Exchange") == 2  # written, unpacked, facts; orders and facts by document


def test_issues_of_odd_packages(spark):
    """Issues come as often as their references, those about a name once; the same from facts and from tables."""
    rels = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'
    types = '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="XML" ContentType="a"/><Default Extension="xml" ContentType="b"/><Default Extension="rels" ContentType="r"/><Override PartName="/x.xml" ContentType="c"/><Override PartName="/x.xml" ContentType="d"/><Override PartName="/y.bin" ContentType=""/></Types>'
    notes = f'<w:footnotes {W}><w:footnote w:id="2"/><w:footnote w:id="2"/><w:footnoteReference w:id="9"/><w:footnoteReference w:id="9"/><w:numId w:val="0"/><w:numId/><w:bookmarkStart w:id="1"/><w:bookmarkStart w:id="1"/><w:bookmarkEnd w:id="1"/></w:footnotes>'
    extra = {"[Content_Types].xml": types, "y.bin": "", "z.bin": "", "_rels/.rels": rels.format('<Relationship Id="" Target="q"/><Relationship Id="a" Target="q"/><Relationship Id="a" Target="../up"/>'), "v/_rels/d.xml.rels": rels.format('<Relationship Id="a" Target="d.xml"/><Relationship Id="b" Target="d.xml"/>'), "word/footnotes.xml": notes}
    table = files.parts(spark.createDataFrame([("p", package(extra, ["word/media/a.png"])), ("q", package(drop=["[Content_Types].xml"]))], "path string, content binary"), ["path"])
    got = [tuple(r)[1:] for r in P.package_issues(files.facts(table, ["path"]), ["path"]).filter("path = 'p'").collect()]
    typed = "[Content_Types].xml"
    assert sorted(got) == sorted([
        *[(typed, "missing-part", "x.xml")] * 2, (typed, "duplicate-override", "x.xml"), (typed, "duplicate-default", "xml"), ("z.bin", "missing-content-type", "bin"),
        ("_rels/.rels", "relationship-id", "empty"), ("_rels/.rels", "duplicate-relationship-id", "a"), *[("_rels/.rels", "missing-target", "q")] * 2, ("_rels/.rels", "invalid-target", "../up"),
        ("v/_rels/d.xml.rels", "missing-source", "v/d.xml"), *[("v/_rels/d.xml.rels", "missing-target", "v/d.xml")] * 2, ("word/_rels/document.xml.rels", "missing-target", "word/media/a.png"),
        ("word/footnotes.xml", "duplicate-footnote-id", "2"), *[("word/footnotes.xml", "missing-footnote", "9")] * 2, ("word/footnotes.xml", "unbalanced-bookmark", "1"),
    ])
    assert [tuple(r) for r in P.package_issues(files.facts(table, ["path"]), ["path"]).filter("path = 'q'").collect()] == [("q", typed, "missing", "content types")]
    again = P.issues(table, files.content_types(table, ["path"]), files.relationships(table, ["path"]), files.marks(table, ["path"]), ["path"]).filter("path = 'p'").collect()
    assert sorted(tuple(r)[1:] for r in again) == sorted(got)


def test_alignment():
    """Operations give back both sides; what is equal is equal; unique values in order are all found."""
    import random

    from quire.operators import documents as D

    rnd = random.Random(8)
    for _ in range(200):
        a = [rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(30))]
        b = [x for x in a if rnd.random() > 0.2] + [rnd.choice("xyzäöü") for _ in range(rnd.randrange(4))]
        ops = D.alignment(a, b)
        assert [i for _, i, _ in ops if i is not None] == list(range(len(a))) and [j for _, _, j in ops if j is not None] == list(range(len(b)))
        assert all(a[i] == b[j] for op, i, j in ops if op == "equal")
    a = list(range(50_000))
    b = [x for x in a if x % 7]
    assert sum(op == "equal" for op, _, _ in D.alignment(a, b)) == len(b)


def test_sequence_alignment_finds_what_stayed(spark, sf_dir):
    rows = documents.QUERIES["sequence_alignment"](spark, sf_dir).collect()
    kept = {(r["old_no"], r["new_no"] is not None) for r in rows if r["op"] == "equal"}
    assert rows and kept and all(n % 4 != 1 for n, _ in kept)


def test_closures_have_no_depth_limit(spark):
    from quire.operators import joins as J

    edges = [(k, k + 1) for k in range(70)] + [(70, 3), (100, 101)]
    df = spark.createDataFrame(edges, "source long, target long")
    roots = spark.createDataFrame([(0,), (100,)], "root long")
    got = {tuple(r) for r in J.closure(df, roots).collect()}
    assert got == {(0, k, k) for k in range(71)} | {(100, 100, 0), (100, 101, 1)}
    nodes = spark.createDataFrame([(k, k - 1 if k else None, "v" if k == 0 else None) for k in range(300)] + [(900, 901, None), (901, 900, None), (902, 5555, None)], "id long, up long, value string")
    got = {tuple(r) for r in J.inherited(nodes, "id", "up", "value").collect()}
    assert got == {(k, "v") for k in range(300)} | {(900, None), (901, None), (902, None)}


def test_nearest_across_ranges(spark):
    """Neighbours in other ranges, ties of one and of several payloads, owners first."""
    from quire.operators import joins as J

    rows = spark.createDataFrame([("a", 10_000, 1), ("a", 3, 2), ("a", 20, 3), ("b", 5, 4), ("a", 99_000, 5)], "t string, o long, own long")
    held = spark.createDataFrame([("a", 0, 77, "x"), ("a", 40, 77, "y"), ("a", 90_000, 1, "z"), ("a", 90_000, 8, "z")], "t string, a_ordinal long, a_owner long, p string")
    got = {(r["t"], r["o"]): (r["distance"], r["p"], r["n_payloads"]) for r in J.nearest(rows, held, ["t"], "o", "own", "p").collect()}
    assert got == {("a", 10_000): (-1, "z", 1), ("a", 3): (3, "x", 1), ("a", 20): (20, None, 2), ("a", 99_000): (9000, "z", 1)}


def test_damaged_members(spark):
    import zlib

    whole = bytearray(package())
    at = whole.index(zlib.compress(b"x")[2:-4]) if zlib.compress(b"x")[2:-4] in whole else len(whole) // 3
    whole[at] ^= 0xFF
    broken = io.BytesIO()
    with zipfile.ZipFile(broken, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.xml", "<a/>" * 500)
        z.writestr("b.xml", "<b/>")
    raw = bytearray(broken.getvalue())
    raw[40] ^= 0x55
    rows = files.parts(spark.createDataFrame([("w", whole), ("r", raw), ("n", None)], "path string, content binary"), ["path"]).collect()
    assert any(r["error"] and r["error"].startswith("bad-member") for r in rows if r["path"] == "r")
    assert any(r["part"] == "b.xml" and r["error"] is None for r in rows) and any(r["path"] == "n" and r["error"] for r in rows)


@pytest.mark.parametrize("name", sorted(documents.QUERIES))
def test_query_runs(spark, sf_dir, name):
    rows = documents.QUERIES[name](spark, sf_dir).collect()
    assert rows
    if name == "math_omml_round_trip":
        assert all(r["same"] for r in rows), [r for r in rows if not r["same"]][:3]
    if name == "math_report":
        assert sum(r["n_zones"] for r in rows) == 200 and sum(r["n_unknown_macro"] for r in rows) == 20 and sum(r["n_malformed"] for r in rows) == 20
    if name == "math_scope_census":
        assert all(r["span"] for r in rows if r["type"] in ("num", "ident"))
