"""Slides with notes and tables, Word tables, flashcards anywhere in a line."""

import zipfile

from lectern.operators import verify
from lectern.sources import readers

from .conftest import rows

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
NS = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'


def blocks(spark, path):
    return rows(readers.office_blocks(readers.read_files(spark, str(path))).orderBy("ord").select("page", "kind", "level", "text"))


def test_slides(spark, tmp_path):
    sp = lambda kind, *lines: f'<p:sp><p:nvSpPr><p:nvPr>{kind and f"<p:ph type={chr(34)}{kind}{chr(34)}/>"}</p:nvPr></p:nvSpPr><p:txBody>' + "".join(f"<a:p><a:r><a:t>{x}</a:t></a:r></a:p>" for x in lines) + "</p:txBody></p:sp>"
    cell = lambda x: f"<a:tc><a:txBody><a:p><a:r><a:t>{x}</a:t></a:r></a:p></a:txBody></a:tc>"
    table = f"<p:graphicFrame><a:graphic><a:graphicData><a:tbl><a:tr>{cell('a')}{cell('b')}</a:tr><a:tr>{cell('1')}{cell('2')}</a:tr></a:tbl></a:graphicData></a:graphic></p:graphicFrame>"
    slide = lambda *shapes: f"<p:sld {NS}><p:cSld><p:spTree>{''.join(shapes)}</p:spTree></p:cSld></p:sld>"
    with zipfile.ZipFile(tmp_path / "a.pptx", "w") as z:
        z.writestr("ppt/slides/slide1.xml", slide(sp("", "first", "second"), sp("title", "Ohm"), table))
        z.writestr("ppt/slides/slide2.xml", slide(sp("", "alone")))
        z.writestr("ppt/slides/_rels/slide1.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/notesSlide" Target="../notesSlides/notesSlide1.xml"/></Relationships>')
        z.writestr("ppt/notesSlides/notesSlide1.xml", slide(sp("sldNum", "1"), sp("body", "say it slowly")))
    assert blocks(spark, tmp_path) == [(1, "heading", 1, "Ohm"), (1, "paragraph", None, "first\nsecond"), (1, "table", None, "a | b\n1 | 2"), (1, "notes", None, "say it slowly"), (2, "heading", 1, "Slide 2"), (2, "paragraph", None, "alone")]


def test_word_tables(spark, tmp_path):
    p = lambda x: f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>"
    cell = lambda x, pr="": f"<w:tc><w:tcPr>{pr}</w:tcPr>{p(x)}</w:tc>"
    table = f"<w:tbl><w:tr>{cell('a', '<w:gridSpan w:val=\"2\"/>')}{cell('v', '<w:vMerge w:val=\"restart\"/>')}</w:tr><w:tr>{cell('1')}{cell('2')}{cell('', '<w:vMerge/>')}</w:tr></w:tbl>"
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{p("before")}{table}<w:sdt><w:sdtContent>{p("after")}</w:sdtContent></w:sdt></w:body></w:document>')
    assert blocks(spark, tmp_path) == [(None, "paragraph", None, "before"), (None, "table", None, "a | a | v\n1 | 2 | v"), (None, "paragraph", None, "after")]


def test_flashcards_anywhere(spark):
    md = "1. **Ohm**: unit of resistance\n| see **Volt** (V) - " + "x" * 400 + "\n**Amp**: **bold** is no definition\n**amp:** - unit of current"
    got = sorted(rows(verify.flashcards(spark.createDataFrame([(1, md)], "id int, markdown string"))))
    assert got == [(1, "Ohm", "unit of resistance"), (1, "Volt", "x" * 300), (1, "amp", "unit of current")]
