"""DOCX: headings, lists, nested tables and broken files, against texts written by hand."""

import io
import zipfile

from loomstone.operators import upkeep
from loomstone.sources import docx, readers

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
STYLES = f'<w:styles {NS}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="Sub"><w:name w:val="Own"/><w:pPr><w:outlineLvl w:val="2"/></w:pPr></w:style><w:style w:styleId="LB"><w:name w:val="List"/><w:pPr><w:numPr><w:numId w:val="1"/></w:numPr></w:pPr></w:style></w:styles>'
NUMBERS = f'<w:numbering {NS}><w:abstractNum w:abstractNumId="5"><w:lvl w:ilvl="0"><w:numFmt w:val="bullet"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="5"/></w:num></w:numbering>'


def p(said, style="", level=None):
    number = "" if level is None else f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="1"/></w:numPr>'
    runs = said if said.startswith("<") else f"<w:r><w:t>{said}</w:t></w:r>"
    return f'<w:p><w:pPr>{f"<w:pStyle w:val=\"{style}\"/>" if style else ""}{number}</w:pPr>{runs}</w:p>'


def table(*rows):
    return f"<w:tbl>{''.join('<w:tr>' + ''.join(f'<w:tc>{c}</w:tc>' for c in r) + '</w:tr>' for r in rows)}</w:tbl>"


def file(body, **parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>")
        for name, said in parts.items():
            z.writestr(f"word/{name}.xml", said)
    return out.getvalue()


BODY = "".join([
    p("The title &amp; more", "H1"),
    p("<w:r><w:rPr><w:b/></w:rPr><w:t>Bold</w:t></w:r><w:r><w:t xml:space='preserve'> and </w:t></w:r><w:hyperlink><w:r><w:rPr><w:i/><w:b w:val='0'/></w:rPr><w:t>link</w:t></w:r></w:hyperlink><w:del><w:r><w:delText>gone</w:delText></w:r></w:del><w:r><w:br/><w:t>a &lt; b</w:t><w:tab/><w:t>c</w:t></w:r>"),
    p(""),
    p("Part", "Sub"),
    p("one", level=0), p("one a", level=1), p("one b", level=1), p("two", "LB"),
    table([p("x|y"), "<w:tcPr><w:gridSpan w:val='2'/></w:tcPr>" + p("wide")], [p("1"), p("2") + p("more"), table([p("in"), p("ner")])]),
    f"<w:sdt><w:sdtContent>{p('kept')}</w:sdtContent></w:sdt>",
    p("again", level=1),
])
TEXT = """# The title & more

Bold and link
a < b\tc

### Part

- one
  1. one a
  2. one b
- two

| x\\|y | wide |  |
| --- | --- | --- |
| 1 | 2 more | \\| in \\| ner \\| \\| --- \\| --- \\| |

kept

  1. again"""
HTML = (
    "<h1>The title &amp; more</h1><p><strong>Bold</strong> and <em>link</em><br />a &lt; b\tc</p><h3>Part</h3>"
    "<ul><li>one<ol><li>one a</li><li>one b</li></ol></li><li>two</li></ul>"
    '<table><tr><td><p>x|y</p></td><td colspan="2"><p>wide</p></td></tr><tr><td><p>1</p></td><td><p>2</p><p>more</p></td><td><table><tr><td><p>in</p></td><td><p>ner</p></td></tr></table></td></tr></table>'
    "<p>kept</p><ul><li><ol><li>again</li></ol></li></ul>"
)


def test_shapes():
    raw = file(BODY, styles=STYLES, numbering=NUMBERS)
    assert docx.markdown(raw) == TEXT and docx.html(raw) == HTML
    assert docx.markdown(file("")) == "" and docx.markdown(file(p("plain"))) == "plain"


def test_broken_files():
    bomb = f'<!DOCTYPE w [<!ENTITY a "aaaa">]><w:document {NS}><w:body>{p("&a;")}</w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", bomb)
    assert [docx.markdown(x) for x in (b"", b"no zip", None, out.getvalue(), file(BODY)[:200])] == [None] * 5
    empty = io.BytesIO()
    zipfile.ZipFile(empty, "w").close()
    assert docx.markdown(empty.getvalue()) == ""


def test_files_of_all_kinds(spark, tmp_path):
    (tmp_path / "raw/sub").mkdir(parents=True)
    (tmp_path / "raw/sub/a.docx").write_bytes(file(BODY, styles=STYLES, numbering=NUMBERS))
    (tmp_path / "raw/broken.docx").write_bytes(b"PK")
    (tmp_path / "raw/b.html").write_bytes("<p>é &amp; b</p>".encode())
    (tmp_path / "raw/c.md").write_bytes(b"c\r\n")
    (tmp_path / "raw/d.exe").write_bytes(b"d")
    files = readers.raw_files(spark, str(tmp_path / "raw"))
    got = {r["source_path"]: (r["parser"], r["text"]) for r in readers.parsed(files).collect()}
    assert got == {"raw/sub/a.docx": ("docx", TEXT), "raw/broken.docx": ("docx", None), "raw/b.html": ("html", "é & b"), "raw/c.md": ("text", "c")}
    shown = {r["path"]: (r["kind"], r["data"]) for r in upkeep.preview(files.withColumnRenamed("source_path", "path")).collect()}
    assert shown["raw/sub/a.docx"] == ("html", HTML) and shown["raw/broken.docx"] == ("error", None) and shown["raw/d.exe"] == ("error", None)
