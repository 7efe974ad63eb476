import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark.sources import docx, files, pdf
from quillspark.sources.rules import load_rules, rules_table

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def p(text, style=""):
    s = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{s}<w:r><w:t>{text}</w:t></w:r></w:p>"


def tc(text, extra=""):
    return f"<w:tc><w:tcPr>{extra}</w:tcPr>{''.join(map(p, text.split(chr(10))))}</w:tc>"


def make(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {W}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="H2"><w:name w:val="heading 2"/></w:style></w:styles>')
    return out.getvalue()


TABLE = f"<w:tbl><w:tr>{tc('Rope')}{tc('$20')}</w:tr><w:tr>{tc('Rope')}{tc('$20')}</w:tr><w:tr>{tc('Hook')}{tc('$2')}</w:tr></w:tbl>"
DOC = make(p("Intro") + p("Part", "H1") + p("Body one") + p("Body two") + p("Sub", "H2") + TABLE + p("End") + p("Next", "H1") + p("Last"))


def test_docx(spark):
    df = spark.createDataFrame([(docx.elements(DOC),)], f"e {docx.ELEMENTS}")
    got = df.select(docx.plain_text(F.col("e")).alias("text"), docx.sections(F.col("e")).alias("chunks")).first()
    assert got.text == "Intro\nPart\nBody one\nBody two\nSub\nEnd\nNext\nLast\nRope | $20\nHook | $2"
    assert [(c["text"], c["heading_context"], c["chunk_type"]) for c in got.chunks] == [("Intro", "", "text"), ("Body one\nBody two", "Part", "text"), ("Rope: $20. Hook: $2.", "Part > Sub", "table"), ("End", "Part > Sub", "text"), ("Last", "Next", "text")]


def test_merged_cells():
    table = f"<w:tbl><w:tr>{tc('wide', '<w:gridSpan w:val=%s2%s/>' % (chr(34), chr(34)))}{tc('x', '<w:vMerge w:val=%srestart%s/>' % (chr(34), chr(34)))}</w:tr><w:tr>{tc('a')}{tc('b')}{tc('', '<w:vMerge/>')}</w:tr></w:tbl>"
    assert [w for k, _, w in docx.body(make(table)) if k == "table"] == [[["wide", "wide", "x"], ["a", "b", "x"]]]


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.docx").write_bytes(DOC)
    (tmp_path / "in/broken.docx").write_bytes(b"no zip")
    (tmp_path / "in/b.doc").write_bytes(b"old")
    rows = {r.file_name: r for r in files.extracted(files.read_files(spark, str(tmp_path / "in"))).collect()}
    assert rows["a.docx"].text.startswith("Intro") and len(rows["a.docx"].chunks) == 5 and rows["a.docx"].error is None
    assert rows["broken.docx"].text == "" and rows["broken.docx"].error_kind == "failed" and rows["b.doc"].error_kind == "unsupported"
    with pytest.raises(Exception, match="unsupported file type"):
        files.extracted(files.read_files(spark, str(tmp_path / "in")), strict=True).collect()


def test_pdf_layout():
    pages = [
        pdf.Page(1000, [(0, 10, 9, 30, "Running head"), (0, 100, 9, 110, "Company"), (0, 200, 9, 210, "First li-\nne"), (0, 215, 9, 225, "goes on"), (0, 260, 9, 270, "Second"), (0, 500, 9, 520, "in table"), (0, 900, 9, 910, "Page 1"), (0, 960, 9, 990, "foot")], [((0, 490, 100, 530), [["a", "b"]])]),
        pdf.Page(1000, [(0, 102, 9, 110, "Company"), (0, 300, 9, 310, "Third")]),
    ]
    assert pdf.plain_text(pages) == "First line\ngoes on\nSecond\nin table\n\nThird"
    assert [(c["text"], c["chunk_type"]) for c in pdf.sections(pages)] == [("First line goes on", "text"), ("Second", "text"), ("a: b.", "table"), ("Third", "text")]
    assert pdf.repeated(pages[:1]) == set() and pdf.plain_text([]) == ""


@pytest.mark.skipif(pdf.available(), reason="PyMuPDF is installed")
def test_pdf_needs_a_library():
    with pytest.raises(RuntimeError):
        pdf.pages(b"")


def test_rules(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text(json.dumps({"B": {"keywords": ["x"], "filename_patterns": ["(", "ok"]}, "A": {"sentences": ["y z"]}}))
    rules = load_rules(spark, str(path))
    assert list(rules.categories) == ["B", "A"] and rules.categories["B"]["filename_patterns"] == ("ok",)
    assert sorted(map(tuple, rules_table(spark, rules).collect())) == [("A", 1, "sentences", "y z"), ("B", 0, "filename_patterns", "ok"), ("B", 0, "keywords", "x")]
