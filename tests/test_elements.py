"""Boxes from elements by DataFrame steps equal those of the readers that parse a document at once."""

import io
import random
import zipfile
from collections import Counter

from boxframe.operators import containers
from boxframe.sources import documents, elements, readers

HTML = [
    "<html><body><h1>T</h1><p>a <b>b</b>\n c</p><p> </p><div>bare<p>x</div><ul><li>1<li>2</ul><table><caption>cap</caption><tr><th colspan=2>h<th>i<tr><td>1<td rowspan=2>2<td>3</table><p>after</p></body></html>",
    "<table><tr><td>a<table><tr><td>in</table></td><td>b</td></tr><p>stray</p><tr></tr><tr><td></td></tr></table><p>x</p><table><td>no row<td>2</table><p>y",
    "<table><tr><td>1</td></tr><table><tr><td>n1<td colspan='x'>n2</tr><tr><td>n3</tr></table><tr><td>2</table><h2>é&amp;</h2><script>var p='<p>'</script><dl><dt>t<dd>d</dl>",
    "<p>only", "", "plain text", "<html>", "<table></table><p>a<table><tr></table><p>b",
]


def compare(spark, data, fmt, take, boxes):
    df = spark.createDataFrame([(i, bytearray(x) if x is not None else None) for i, x in enumerate(data)], "doc_id long, content binary")
    found = take(df).cache()
    want = documents.table(documents.parse(df, fmt=fmt), "bboxes").select(*elements.BOX)
    got = boxes(found)
    assert got.columns == want.columns
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect())) and want.count() > 0
    return found


def test_html(spark):
    r = random.Random(1)
    tags = ["p", "div", "table", "tr", "td", "/td", "/tr", "/table", "li", "ul", "/ul", "h2", "/h2", "/p", "caption", "th colspan=2"]
    mixed = ["".join(f"<{r.choice(tags)}>w{k}" for k in range(60)) for _ in range(40)]
    compare(spark, [x.encode() for x in HTML + mixed] + [None], "html", elements.html, elements.html_boxes)


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return out.getvalue()


def test_docx(spark):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    t = lambda x: f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>"
    cell = lambda x, pr="": f"<w:tc><w:tcPr>{pr}</w:tcPr>{x}</w:tc>"
    body = t("head") + "<w:p/>" + f"<w:tbl><w:tr>{cell(t('a') + t('b'), '<w:gridSpan w:val=' + chr(34) + '2' + chr(34) + '/>')}{cell(t('c'))}</w:tr><w:tr>{cell('<w:p/>')}{cell(t('m'), '<w:vMerge/>')}{cell(t('z'))}</w:tr></w:tbl>" + t("tail")
    compare(spark, [zipped({"word/document.xml": f"<w:document {w}><w:body>{body}</w:body></w:document>"}), b"PK\x03\x04broken", b"no zip", None], "docx", elements.docx, elements.docx_boxes)


def test_xlsx(spark):
    m, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    book = f'<workbook xmlns="{m}" xmlns:r="{rel}"><sheets><sheet name="one" r:id="a"/><sheet name="gone" r:id="b"/><sheet name="two" r:id="c"/></sheets></workbook>'
    rels = '<Relationships><Relationship Id="a" Target="worksheets/s1.xml"/><Relationship Id="b" Target="worksheets/none.xml"/><Relationship Id="c" Target="/xl/worksheets/s2.xml"/></Relationships>'
    c = lambda ref, body="", attrs="": f'<c r="{ref}" {attrs}>{body}</c>'
    one = c("A1", "<v>0</v>", 't="s"') + c("B1", "<v>9</v>") + c("C1", "<v>7</v>", 't="s"') + c("A2", "<v>1e2</v>", 's="3"') + c("B2", "<v></v>") + c("C2") + c("D2", "<v>1</v>", 't="b"') + c("E2", "<v>#REF!</v>", 't="e"')
    one += c("A3", "<f t='array' ref='A3:B4'>SUM(x)</f><v>5</v>") + c("B3", "<v>hidden</v>") + c("A4", "<f>q</f>") + c("C4", "<is><t>in_x0041_</t></is>", 't="inlineStr"') + c("D4", "<f t='shared' ref='D4:D9' si='0'>D1</f>") + c("D5", "<f t='shared' si='0'/>") + c("AA10", "<v>x1</v>") + c("Z11", "<v>str_x0042_</v>", 't="str"')
    sheet = lambda cells, merges="": f'<worksheet xmlns="{m}"><sheetData><row>{cells}</row></sheetData><mergeCells>{merges}</mergeCells></worksheet>'
    parts = {"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": rels, "xl/sharedStrings.xml": f'<sst xmlns="{m}"><si><t>s_x0043_0</t></si><si><r><t>r</t></r><r><t>un</t></r></si></sst>', "xl/worksheets/s1.xml": sheet(one, '<mergeCell ref="A1:B1"/><mergeCell ref="Z11:AB12"/>'), "xl/worksheets/s2.xml": sheet(c("B2", "<v>1</v>", 't="s"'))}
    found = compare(spark, [zipped(parts), zipped({"xl/workbook.xml": book}), b"PK\x03\x04broken", b"x", None], "xlsx", elements.xlsx, elements.xlsx_boxes)
    pages = {(x.page_id, x.name, x.width, x.height) for x in elements.xlsx_pages(found).where("doc_id = 0").collect()}
    assert pages == {(0, "one", 27.0, 11.0), (2, "two", 2.0, 2.0)}
    df = spark.createDataFrame([(0, bytearray(zipped(parts)))], "doc_id long, content binary")
    kept = lambda *a: {x.page_id for x in elements.xlsx_pages(elements.xlsx(df, "content", *a)).collect()}
    assert (kept(0, 0), kept(2, 9), kept(1, 1), kept(-3, 2), kept(4, 0)) == ({0, 2}, {2}, {0}, {0}, set())
    assert readers.read_xlsx(zipped(parts)).pages == [(0, 27.0, 11.0), (2, 2.0, 2.0)]


def test_containers_level_by_level(spark):
    inner = zipped({"a.txt": "x", "b.pdf": b"%PDF-1.4", "d/": ""})
    deep = b"bottom"
    for i in range(4):
        deep = zipped({f"l{i}.zip" if i else "l.txt": deep})
    data = [zipped({"in.zip": inner, "o.docx": zipped({"[Content_Types].xml": "<x/>", "word/document.xml": "<x/>"}), "x.xml": "\n<?xml?>", "bad.zip": b"PK\x03\x04no"}), deep, b"plain", b"", None]
    df = spark.createDataFrame([(i, bytearray(x) if x is not None else None) for i, x in enumerate(data)], "doc_id long, content binary")
    got = {(x.doc_id, x.path): x for x in containers.walk(df, max_depth=2).collect()}
    assert {k: v.dialect for k, v in got.items() if k[0] == 0} == {(0, ""): "zip", (0, "/in.zip"): "zip", (0, "/in.zip/a.txt"): "other", (0, "/in.zip/b.pdf"): "pdf", (0, "/o.docx"): "docx", (0, "/x.xml"): "xml", (0, "/bad.zip"): "zip"}
    assert (got[0, ""].member_count, got[0, "/in.zip"].member_count, got[0, "/bad.zip"].member_count, got[0, "/bad.zip"].truncated) == (4, 3, None, None)
    assert {k: (v.depth, v.truncated) for k, v in got.items() if k[0] == 1} == {(1, ""): (0, None), (1, "/l3.zip"): (1, None), (1, "/l3.zip/l2.zip"): (2, "max depth")}
    assert got[0, "/in.zip/a.txt"].size == 1 and got[2, ""].dialect == "other" and len([k for k in got if k[0] > 2]) == 0
    assert containers.walk(df.where("false")).count() == 0
