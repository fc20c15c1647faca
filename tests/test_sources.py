from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quarry.sources import files as S
from quarry.sources import html as H


def archive(**parts: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), text)
    return out.getvalue()


def workbook() -> bytes:
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} {rel}><sheets><sheet name="One" sheetId="1" r:id="r1"/><sheet name="Two" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/a.xml"/><Relationship Id="r2" Target="/xl/worksheets/b.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><r><t>ap</t></r><r><t>ple</t></r></si></sst>")
        rows = '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2" t="inlineStr"><is><t>price</t></is></c></row><row r="4"><c r="A4" t="s"><v>1</v></c><c r="B4"><v>7</v></c><c r="C4"><v>2.5</v></c></row>'
        z.writestr("xl/worksheets/a.xml", f"<worksheet {ns}><sheetData>{rows}</sheetData></worksheet>")
        z.writestr("xl/worksheets/b.xml", f"<worksheet {ns}><sheetData/></worksheet>")
    return out.getvalue()


def test_csv():
    data = b'name,age\n"Ada, L.",36\nBob,7\n'
    p = S.CsvParser()
    assert p.text(data) == "CSV Headers: name | age\n\nRow 1: name: Ada, L. | age: 36\nRow 2: name: Bob | age: 7\n"
    got = [c for c, _ in p.chunks(data)]
    assert [(c.text, c.kind) for c in got] == [("CSV Document Headers: name | age", "csv_header"), ("Row 1: name: Ada, L. | age: 36\nRow 2: name: Bob | age: 7\n", "csv_rows")]
    assert p.text(b"") == "" and p.chunks(b"") == []
    with pytest.raises(ValueError):
        p.text(b"a,b\n1\n")


def test_csv_rows_are_packed():
    data = ("h\n" + "\n".join("w " * 60 for _ in range(7))).encode()
    sizes = [c.token_count for c, _ in S.CsvParser().chunks(data)][1:]
    assert sizes == [189, 189, 63]


def test_html():
    page = "<html><head><title>T &amp; U</title><style>p{}</style></head><body><h1>Head</h1><p>One<p>Two <b>bold</b></p><ul><li>x</li><li> <li>y</ul><script>var a</script>loose</body></html>"
    root = H.parse(page)
    assert H.title(root) == "T & U"
    assert H.sections(root) == ["## Head\n\nOne\n\nTwo bold\n\n• x\n• y\n\n"]
    assert H.to_text(page) == "Title: T & U T & U Head One Two bold x y loose"
    kinds = [(c.kind, c.text) for c, _ in S.HtmlParser().chunks(page.encode())]
    assert kinds[0] == ("html_title", "Document Title: T & U") and kinds[1][0] == "html_section"


def test_html_without_sections_falls_back_to_text():
    got = [(c.kind, c.text) for c, _ in S.HtmlParser().chunks(b"<table><tr><td>only</td><td>cells</td></tr></table>")]
    assert got == [("html_content", "only cells")]


def test_html_blocks_do_not_break_sections_inside_them():
    root = H.parse("<article><h2>Inner</h2><p>text</p></article><h2>Next</h2>")
    assert H.sections(root) == ["Innertext\n\n", "## Next\n\n"]


def test_xlsx():
    p = S.XlsxParser()
    assert p.text(workbook()) == "Sheet: One\n==========\n\nRow 2: A: name | C: price\nRow 4: A: apple | B: 7 | C: 2.5\n\nSheet: Two\n==========\n\n\n"
    got = [(c.kind, c.text) for c, _ in p.chunks(workbook())]
    assert got == [
        ("xlsx_sheet_header", "Excel Sheet: One"),
        ("xlsx_headers", "Sheet One Headers: name |  | price"),
        ("xlsx_data", "Row 4: name: apple | B: 7 | price: 2.5\n"),
        ("xlsx_sheet_header", "Excel Sheet: Two"),
    ]


@pytest.mark.parametrize("i, name", [(0, "A"), (25, "Z"), (26, "AA"), (701, "ZZ"), (702, "AAA")])
def test_excel_column(i, name):
    assert S.excel_column(i) == name


def docx(*lines: str) -> bytes:
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in lines)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def test_docx():
    p = S.DocxParser()
    assert p.text(docx("one", "two")) == "one\ntwo"
    got = [(c.kind, c.text) for c, _ in p.chunks(docx("# A", "- x", "- y", "", "# B", "- z"))]
    assert got == [("docx_structured", "# A\n- x\n- y"), ("docx_structured", "# B\n- z")]
    assert [c.kind for c, _ in p.chunks(docx("just a line"))] == ["docx_prose"]
    assert p.chunks(docx()) == []


def test_pages_take_context_from_the_page_before():
    got = S.page_chunks([(1, "First. Second. Third"), (2, "Next page"), (3, " ")])
    assert [(c.text, n) for c, n in got] == [("First. Second. Third", 1), ("(Previous context: Second. Third) Next page", 2)]


def test_large_pages_are_split():
    text = ". ".join(f"sentence {i} has six words here" for i in range(400)) + "."
    got = S.page_chunks([(7, text)])
    assert len(got) > 1 and all(c.text.startswith("Page 7: ") and c.kind == "pdf_page_section" and n == 7 for c, n in got)


def test_parse_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.md").write_text("plain text")
    (tmp_path / "bad.xlsx").write_bytes(b"no archive")
    (tmp_path / "c.xlsx").write_bytes(workbook())
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    parsers = {**S.PARSERS, "pdf": S.PdfParser(lambda data: [(1, "page one"), (2, "page two")])}
    got = {r.path.rsplit("/", 1)[1]: r for r in S.parse_files(S.read_files(spark, str(tmp_path)), parsers=parsers).collect()}
    assert got["b.md"].text == "plain text" and got["b.md"].chunks[0].chunk_type == "text"
    assert got["bad.xlsx"].error.startswith("BadZipFile") and got["bad.xlsx"].chunks == []
    assert [c.chunk_type for c in got["a.csv"].chunks] == ["csv_header", "csv_rows"]
    assert [c.page_number for c in got["d.pdf"].chunks] == [1, 2]


def test_registry():
    assert S.supported_formats()["html"] == [".html", ".htm"]
    S.register("odt", S.TextParser())
    try:
        assert "odt" in S.supported_formats()
    finally:
        del S.PARSERS["odt"]


def test_render_rows(spark):
    table = spark.range(0, 50, 1, 3).selectExpr("id", "id * 2 as d")
    got = S.render_rows(table, "id", ["id", "d"]).orderBy("row_number").collect()
    assert [r.row_text for r in got] == [f"Row {i + 1}: id: {i} | d: {2 * i}\n" for i in range(50)]


def test_page_overview(spark):
    rows = spark.createDataFrame([("d", 1, 2, "second"), ("d", 0, 1, "first page"), ("e", 0, None, "only")], "document_id string, chunk_index int, page_number int, chunk_text string")
    got = {r.document_id: r.text for r in S.page_overview(rows, 5).collect()}
    assert got == {"d": "[Page 1] first\n\n[Page 2] secon", "e": "[Page 1] only"}


def test_fit_image(spark):
    sizes = [(800, 600), (2240, 1120), (100, 2000), (1500, 1500)]
    got = spark.createDataFrame(sizes, "w int, h int").select(S.fit_image(F.col("w"), F.col("h")).alias("s")).collect()
    assert [tuple(r.s) for r in got] == [(800, 600), (1120, 560), (56, 1120), (1120, 1120)]


def test_gzip(spark):
    from quarry.functions.compression import compress, decompress

    rows = spark.createDataFrame([("some text " * 50,), ("é",), ("",), (None,)], "t string").withColumn("z", compress(F.col("t"), spark))
    got = rows.select("t", "z", decompress(F.col("z"), spark).alias("u")).collect()
    assert all(r.u == (r.t or "") and (r.z is None) == (not r.t) for r in got) and len(got[0].z) < 100
    with pytest.raises(Exception):
        spark.createDataFrame([(b"junk",)], "z binary").select(decompress(F.col("z"), spark)).collect()


def test_stages_can_be_cleared(spark):
    from quarry.session import clear_stages, stage

    clear_stages(spark)
    staged = stage(spark.range(3))
    assert staged.count() == 3 and clear_stages(spark) == 1 and clear_stages(spark) == 0
    with pytest.raises(Exception):
        spark.read.parquet(staged._staged_at)


def test_deep_html():
    from quarry.sources import html

    deep = "<title>t</title>" + "<div>" * 10_000 + "in <b>the</b> depth" + "</div>" * 10_000 + "<span>" * 10_000 + "<h2>head</h2><ul><li>one</li></ul>"
    assert html.to_text(deep) == "Title: t t in the depth head one"
    assert html.sections(html.parse(deep)) == ["in the depth\n\n", "## head\n\n• one\n\n"]


def test_readable_html_against_recursion():
    import random

    from quarry.sources import html

    def readable(node):
        if node.tag in ("script", "style"):
            return ""
        return "".join(p + " " for p in (x if isinstance(x, str) else readable(x) for x in node.inside) if p.strip())

    for seed in range(60):
        rng = random.Random(seed)
        made = "".join(rng.choice(["<p>", "</p>", "<div>", "</div>", "<b>", "</b>", "<script>", "</script>", "<br>", " ", "word ", "x", "\n"]) for _ in range(60))
        root = html.parse(made)
        assert root.readable() == readable(root)
