"""The command line, from a LaTeX file to a published edit and back."""

import json

import pytest

from quire import cli
from quire.sources import word, wordxml

TEX = "\\documentclass{article}\n\\begin{document}\n\\section{One}\n\nFirst paragraph.\n\nSecond with $x^2$.\n\\end{document}\n"


def run(spark, capsys, *argv):
    status = cli.main(["--json", "--quiet", *map(str, argv)], spark)
    return status, json.loads(capsys.readouterr().out.strip().splitlines()[-1])


def test_edit_of_a_document(spark, tmp_path, capsys):
    (tmp_path / "a.tex").write_text(TEX)
    docx, ws = tmp_path / "a.docx", tmp_path / "ws"
    assert run(spark, capsys, "to-word", tmp_path / "a.tex", docx)[1]["result"]["failed"] == 0
    assert run(spark, capsys, "workspace-create", docx, ws)[1]["result"]["blocks"] == 3
    assert run(spark, capsys, "workspace-create", docx, ws)[1]["error"]["category"] == "exists"
    texts = spark.read.parquet(f"{ws}/turn=1/texts").toPandas()
    assert "First paragraph." in texts.text[0]
    texts["text"] = texts.text.str.replace("First paragraph.", "Another one.")
    spark.createDataFrame(texts).write.parquet(f"{tmp_path}/edited")
    told = run(spark, capsys, "diff", ws, tmp_path / "edited")[1]["result"]
    assert told["label_errors"] == 0 and sum(told["actions"].values()) >= 1
    assert run(spark, capsys, "apply", ws, tmp_path / "edited")[1]["result"]["generation"] == 2
    status, again = run(spark, capsys, "apply", ws, tmp_path / "edited")
    assert status == 2 and again["error"]["category"] == "no-turn"
    assert spark.read.json(f"{ws}/log").select("command").first()[0] in ("apply", "workspace-create")
    for generation, words in ((2, "Another one."), (1, "First paragraph.")):
        out = tmp_path / f"out{generation}"
        assert run(spark, capsys, "publish", ws, f"{out}.docx")[0] == 0
        assert run(spark, capsys, "to-latex", f"{out}.docx", f"{out}.tex")[0] == 0
        latex = open(f"{out}.tex").read()
        assert words in latex and "x^{2}" in latex and "\\begin{document}" in latex
        status, told = run(spark, capsys, "undo", ws)
        assert status == (0 if generation == 2 else 2), told


def test_wrong_labels_publish_nothing(spark, tmp_path, capsys):
    (tmp_path / "a.tex").write_text(TEX)
    ws = tmp_path / "ws"
    run(spark, capsys, "to-word", tmp_path / "a.tex", tmp_path / "a.docx")
    run(spark, capsys, "workspace-create", tmp_path / "a.docx", ws)
    texts = spark.read.parquet(f"{ws}/turn=1/texts").toPandas()
    texts["text"] += "\n\n%lw:p:99\nNew."
    spark.createDataFrame(texts).write.parquet(f"{tmp_path}/edited")
    status, told = run(spark, capsys, "apply", ws, tmp_path / "edited")
    assert status == 2 and told["error"]["category"] == "labels"
    assert cli.W.generations(spark, f"{ws}/documents") == [1]


def test_folders_give_tables(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.tex").write_text(TEX)
    (tmp_path / "in" / "bad.tex").write_text("\\begin{document}\\unknowncommand{x}\\end{document}")
    status, told = run(spark, capsys, "to-word", tmp_path / "in", tmp_path / "out")
    assert told["result"]["documents"] == 4 and status == (1 if told["result"]["failed"] else 0)
    status, told = run(spark, capsys, "check", tmp_path / "in")
    assert status == 1 and told["result"]["files"] == 4 and any("bad.tex" in f["path"] for f in told["result"]["first"])


@pytest.mark.parametrize("argv", [("to-word", "{t}/none", "{t}/x"), ("turn-start", "{t}/none"), ("undo", "{t}/none"), ("to-word", "{t}", "{t}/x.docx")])
def test_failures_have_a_code(spark, tmp_path, capsys, argv):
    status, told = run(spark, capsys, *(a.format(t=tmp_path) for a in argv))
    assert status == 2 and told["ok"] is False and told["error"]["category"]


def test_template_formats_and_its_text_goes(spark, tmp_path, capsys):
    look = wordxml.parts_of(word.package("Old text.\\footnote{Old note.}"))
    look["word/styles.xml"] = b'<w:styles xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:style w:styleId="Own"/></w:styles>'
    kind = wordxml.KINDS + "styles"
    look[wordxml.RELS] = look[wordxml.RELS].replace(b"</", f'<Relationship xmlns="{wordxml.REL.strip("{}")}" Id="rId90" Type="{kind}" Target="styles.xml"/></'.encode(), 1)
    look[wordxml.MAIN] = look[wordxml.MAIN].replace(b"</w:body>", b'<w:sectPr><w:cols w:num="2"/></w:sectPr></w:body>') if b"</w:body>" in look[wordxml.MAIN] else look[wordxml.MAIN].replace(b"</ns0:body>", b'<ns0:sectPr><ns0:cols ns0:num="2"/></ns0:sectPr></ns0:body>')
    (tmp_path / "look.docx").write_bytes(wordxml.zipped(look))
    (tmp_path / "a.tex").write_text(TEX.replace("First paragraph.", "First.\\footnote{New note.}"))
    assert run(spark, capsys, "to-word", tmp_path / "a.tex", tmp_path / "a.docx", "--template", tmp_path / "look.docx")[0] == 0
    made = wordxml.parts_of((tmp_path / "a.docx").read_bytes())
    assert b"Own" in made["word/styles.xml"] and b"cols" in made[wordxml.MAIN] and b"Old" not in b"".join(made.values())
    assert b"New note" in made["word/footnotes.xml"] and all(f"/{t.get('PartName')}".lstrip("/") in made for t in wordxml._tree(made, "[Content_Types].xml") if t.get("PartName"))
    plain = "".join(r.latex for r in word.word_latex(spark.createDataFrame([(1, bytearray((tmp_path / "a.docx").read_bytes()))], "k int, c binary"), ["k"], "c").collect())
    assert "New note." in plain and "x^{2}" in plain
    (tmp_path / "look.docx").write_bytes(b"no package")
    assert run(spark, capsys, "to-word", tmp_path / "a.tex", tmp_path / "b.docx", "--template", tmp_path / "look.docx")[1]["error"]["category"] == "template"
