"""Known answers of the byte readers."""

import io
import zipfile

import pytest

from boxframe.functions import casts, registry
from boxframe.operators import metadata
from boxframe.sources import detect, documents, readers

M = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def zipped(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return out.getvalue()


def workbook(*sheets: str) -> bytes:
    r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    names = "".join(f'<sheet name="S{i}" sheetId="{i}" r:id="r{i}"/>' for i, _ in enumerate(sheets))
    rels = "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i, _ in enumerate(sheets))
    parts = {"xl/workbook.xml": f'<workbook {M} xmlns:r="{r}"><sheets>{names}</sheets><definedNames><definedName name="N">S0!$A$1</definedName></definedNames></workbook>', "xl/_rels/workbook.xml.rels": f"<Relationships>{rels}</Relationships>", "xl/sharedStrings.xml": f"<sst {M}><si><t>sha</t></si><si><r><t>a</t></r><r><t>_x0041_</t></r></si></sst>"}
    return zipped(parts | {f"xl/worksheets/s{i}.xml": f"<worksheet {M}>{s}</worksheet>" for i, s in enumerate(sheets) if s})


def boxes(p):
    return [(int(b[2]), int(b[3]), int(b[4]), int(b[5]), b[9]) for b in p.boxes]


@pytest.mark.parametrize(
    ("body", "expected", "page"),
    [("a\nbb\n", [(1, 1, 1, 1, "a"), (1, 2, 2, 1, "bb")], (2, 3)), ("a\n\nb", [(1, 1, 1, 1, "a"), (1, 3, 1, 1, "b")], (1, 3)), ("é", [(1, 1, 2, 1, "é")], (2, 1)), ("a\r\nb", [(1, 1, 2, 1, "a\r"), (1, 2, 1, 1, "b")], (2, 2)), ("  ", [(1, 1, 2, 1, "  ")], (2, 1)), ("", [], (0, 1))],
)
def test_text(body, expected, page):
    p = readers.read_text(body.encode())
    assert boxes(p) == expected and p.pages == [(0, *map(float, page))]


@pytest.mark.parametrize(
    ("body", "expected"),
    [
        ("<p>A  b</p>", [(0, 0, 3, 1, "A b")]), ("<div><p>A</p>x</div>", [(1, 0, 1, 1, "A")]), ("<p>A</p><table><tr><td colspan=2>B<td>C</table><p>D</p>", [(0, 0, 1, 1, "A"), (0, 1, 2, 1, "B"), (2, 1, 1, 1, "C"), (0, 2, 1, 1, "D")]),
        ("<table><caption>T</caption><tr><td>B</td></tr></table>", [(1, 0, 1, 1, "T"), (0, 0, 1, 1, "B")]), ("<ul><li>A</li></ul><script>x</script>", [(1, 0, 1, 1, "A")]), ("<table><tr><td></td></tr></table>", [(0, 0, 1, 1, "")]), ("<p> </p>", []),
        ("<p>a<p>b<div>c<p>d</div>", [(0, 0, 1, 1, "a"), (0, 1, 1, 1, "b"), (1, 2, 1, 1, "d")]), ("<ul><li>a<li>b</ul><dl><dt>c<dd>d</dl>", [(1, 0, 1, 1, "a"), (1, 1, 1, 1, "b"), (1, 2, 1, 1, "c"), (1, 3, 1, 1, "d")]),
        ("<table><tr><td>a<table><tr><td>in</table></td><td rowspan=3>b</td></tr><tr><td>c</table><h1>t &amp; u</h1>", [(0, 0, 1, 1, "ain"), (1, 0, 1, 3, "b"), (0, 1, 1, 1, "c"), (0, 2, 5, 1, "t & u")]),
    ],
)
def test_html(body, expected):
    assert boxes(readers.read_html(f"<!DOCTYPE html><html><head><title>x</title></head><body>{body}</body></html>".encode())) == expected


def test_docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t, pr="": f"<w:tc><w:tcPr>{pr}</w:tcPr>{p(t)}</w:tc>"
    span, cont = '<w:gridSpan w:val="2"/>', "<w:vMerge/>"
    xml = f"<w:document {w}><w:body>{p('one')}<w:p/>{p('é')}<w:tbl><w:tr>{cell('a', span)}{cell('b')}</w:tr><w:tr>{cell('x', cont)}{cell('c')}</w:tr></w:tbl>{p('end')}<w:sectPr/></w:body></w:document>"
    d = readers.read_docx(zipped({"word/document.xml": xml}))
    assert boxes(d) == [(1, 1, 3, 1, "one"), (1, 2, 2, 1, "é"), (1, 3, 2, 1, "a"), (3, 3, 1, 1, "b"), (2, 4, 1, 1, "c"), (1, 5, 3, 1, "end")]
    assert readers.read_docx(b"PK\x03\x04broken") is None


def test_xlsx():
    rows = '<c r="B2"><v>1.5</v></c><c r="A3" t="s"><v>0</v></c><c r="B3" t="s"><v>1</v></c><c r="C3" t="b"><v>1</v></c><c r="D3" t="e"><v>#REF!</v></c><c r="E3"><f>B1+1</f></c><c r="F9" s="3"/><c r="A5"><v>7</v></c><c r="B5"><v>8</v></c><c r="C6"><f t="shared" ref="C6:C8" si="0">A1*2</f><v>2</v></c><c r="C7"><f t="shared" si="0"/><v>3</v></c><c r="G1" t="inlineStr"><is><t>in</t></is></c>'
    data = workbook(f'<dimension ref="A1:G9"/><sheetData><row>{rows}</row></sheetData><mergeCells><mergeCell ref="A5:B6"/></mergeCells>', "", "<sheetData/>")
    p = readers.read(data)
    got = {(int(b[2]), int(b[3])): (b[4:6], *b[6:]) for b in p.boxes}
    assert got == {
        (2, 2): ((1, 1), "number", 1.5, None, "1.5", None), (1, 3): ((1, 1), "string", None, None, "sha", None), (2, 3): ((1, 1), "string", None, None, "aA", None), (3, 3): ((1, 1), "bool", None, True, "1", None), (4, 3): ((1, 1), "error", None, None, "#REF!", None),
        (5, 3): ((1, 1), "number", 0.0, None, "", "=B1+1"), (1, 5): ((2, 2), "number", 7.0, None, "7", None), (3, 6): ((1, 3), "number", 2.0, None, "2", "=A1*2"), (7, 1): ((1, 1), "string", None, None, "in", None),
    }
    assert [x[0] for x in p.pages] == [0, 2] and p.pages[0][1:] == (7.0, 9.0) and p.page_count == 3
    meta = metadata.xlsx_metadata(data)
    assert meta["workbook"]["sheet_count"] == 3 and meta["names"] == [{"name": "N", "target": "S0!$A$1"}] and meta["worksheet_parts"][0]["merges"] == ["A5:B6"]
    assert metadata.xlsx_manifest(data)["worksheets"] == 2 and metadata.header(data)["page_count"] == 3


CASES = {b"%PDF-1.7": "pdf", b"PK\x03\x04....xl/workbook": "xlsx", b"PK\x03\x04....word/document": "docx", b"PK\x03\x04": "xlsx", bytes.fromhex("d0cf11e0a1b11ae1"): "xls", b"\xef\xbb\xbf \n<!DocType  HTML>": "html", b"<html>": "html", b"<html": "html", b"<htmlx>": "text", b"<?xml?><html>": "text", b"x<html>": "text", b"": "text", b"%PD": "text"}


def test_detect_in_both_forms(spark):
    df = spark.createDataFrame([(bytearray(k), v) for k, v in CASES.items()], "content binary, kind string")
    for x in df.select("content", "kind", detect.detect(df.content).alias("d")).collect():
        assert x.d == x.kind == readers.detect(bytes(x.content))


def test_five_tables_and_functions(spark):
    data = [(1, b"<html><body><p>a</p></body></html>"), (2, b"x\ny"), (3, None), (4, b""), (5, b"%PDF-1.4"), (6, b"PK\x03\x04junk")]
    p = documents.parse(spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in data], "doc_id long, content binary"))
    assert {x.doc_id: x.source_type for x in documents.table(p, "doc").collect()} == {1: "html", 2: "text"}
    assert [documents.table(p, t).count() for t in documents.TABLES] == [2, 2, 2, 2, 3]
    names = documents.register(spark)
    assert len(names) == 30 and spark.sql("select * from bb_text(cast('a\nb' as binary))").count() == spark.sql("select * from bb_blob(cast('a\nb' as binary))").count() == 2
    assert spark.sql("select source_type from bb_doc(cast('<html>' as binary))").first()[0] == "html"


def test_container_walk():
    inner = zipped({"a.txt": "x", "b.pdf": b"%PDF-1.4"})
    tree = metadata.container_walk(zipped({"in.zip": inner, "o.docx": zipped({"[Content_Types].xml": "<x/>"})}))
    assert [(t["path"], t["depth"], t["dialect"]) for t in tree] == [("", 0, "zip"), ("/in.zip", 1, "zip"), ("/in.zip/a.txt", 2, "other"), ("/in.zip/b.pdf", 2, "pdf"), ("/o.docx", 1, "ooxml")]


def test_scalars(spark):
    from pyspark.sql import functions as F

    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert [one(casts.fnv1a(F.lit(x))) for x in ("", "a", "foobar")] == [2166136261, 3826002220, 3214735720]
    assert [one(casts.column_letters(F.lit(n))) for n in (1, 26, 27, 702, 703)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert [one(casts.letters_column(F.lit(x))) for x in ("A", "Z", "AA", "XFD")] == [1, 26, 27, 16384]
    assert one(casts.pdf_date(F.lit("D:20240115103000+01'00'"))) == "2024-01-15T10:30:00+01:00" and one(casts.pdf_date(F.lit("D:2024"))) == "2024-01-01T00:00:00" and one(casts.pdf_date(F.lit("x"))) == "x"
    assert [one(casts.try_number(F.lit(x))) for x in ("1_000", "1e3", "1d", " -.5 ", "")] == [1000.0, 1000.0, None, -0.5, None]
    assert [str(one(casts.try_day(F.lit(x)))) for x in ("2024-01-15", "24/01/15", "2024", "today", "2024-13-01")] == ["2024-01-15", "0024-01-15", "None", "None", "None"]


def test_sql_functions(spark):
    names = registry.register(spark)
    assert {"bb_provenance", "bb_sheets", "bb_info"} <= set(names)
    meta = '{"core": {"creator": "a", "lastModifiedBy": "b", "created": "2024-01-02", "modified": "2024-01-01"}, "workbook": {"sheet_count": 2}, "sheets": [{"name": "x", "rows": 3}, {"name": "y"}]}'
    df = spark.createDataFrame([(meta,), ("{}",), ("not json",), (None,)], "meta string")
    got = [tuple(x) for x in df.selectExpr("bb_provenance(meta)", "bb_temporal(meta)", "bb_consistency(meta)", "bb_corroboration(meta, meta)").collect()]
    assert got[0] == ("several_authors", "inverted", "consistent", "corroborated") and set(got[1:]) == {("anonymous", "unknown", "inconsistent", "corroborated")}
    assert [tuple(x) for x in spark.sql("select t.* from {d} d, lateral bb_sheets(d.meta) t order by pos", d=df).collect()] == [(0, "x", 3), (1, "y", None)]
    assert spark.sql("select t.* from {d} d, lateral bb_properties(d.meta) t", d=df).count() == 4
    for data in CASES:
        kind = spark.createDataFrame([(bytearray(data),)], "c binary").selectExpr("get_json_object(bb_info(c), '$.source_type') AS k").first().k
        assert kind == CASES[data]
