"""Queries without SQL read whole tables."""

import io
import os
import zipfile

import pytest
from conftest import SMALL

from weftline.plans import registry
from weftline.plans.views import view
from weftline.sources import files

if not os.path.isdir(SMALL):
    pytest.skip("no test tables", allow_module_level=True)

QUERIES = registry.queries()


def test_every_issue_is_answered(spark):
    claims = view(spark, SMALL, "claims")
    got = QUERIES["m11_tiered_answer"](spark, SMALL)
    assert got.select("issue_id").exceptAll(claims.select("issue_id").distinct()).isEmpty()
    assert got.count() == claims.select("issue_id").distinct().count() > claims.where("issue_id % 50 = 1").select("issue_id").distinct().count()


def test_every_document_is_compared(spark):
    docs = view(spark, SMALL, "documents_")
    got = QUERIES["n07_compare_attachments"](spark, SMALL)
    assert got.select("id").distinct().count() == docs.select("id").distinct().count() > docs.where("id < 100").count()


def test_files_hold_whole_tables(spark):
    items = view(spark, SMALL, "raw_items")
    drops = {r["source"]: r["count"] for r in QUERIES["s01_process_drops"](spark, SMALL).groupBy("source").count().collect()}
    assert drops == {"calendar": items.where("id % 10 in (0, 3, 6)").count(), "teams_chat": items.where("id % 10 in (1, 7) and k % 4 <> 0").count(), "sharepoint": items.where("id % 10 in (2, 5, 8)").count()}
    assert QUERIES["s04_chat_messages"](spark, SMALL).count() == drops["teams_chat"]
    blocks = items.selectExpr("id div 200").distinct().count()
    assert QUERIES["s06_content_but_empty"](spark, SMALL).count() == 2 * blocks > 2
    assert QUERIES["s12_extract_text"](spark, SMALL).count() == items.count() > 300
    assert QUERIES["s13_docx_text"](spark, SMALL).count() == items.where("id % 9 <> 0").count()
    assert QUERIES["s20_report_sheet"](spark, SMALL).count() == view(spark, SMALL, "issues").count()


def test_logs_hold_whole_messages(spark):
    messages = view(spark, SMALL, "messages").selectExpr("'m' || conv_id || '.' || turn as message_id", "text", "conv_id")
    got = QUERIES["s17_parse_blocks"](spark, SMALL).join(messages, "message_id")
    assert got.count() == messages.count() and got.where("btrim(body, '\\n ') <> btrim(text, '\\n ')").isEmpty()
    assert QUERIES["s18_list_messages"](spark, SMALL).count() == messages.where("conv_id % 4 >= 2").count()


def test_text_by_ending(spark):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="b" r:id="r2"/><sheet name="a" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>one</t></si><si><r><t>t</t></r><r><t>wo</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><row><c t="s"><v>1</v></c><c><v>2.5</v></c><c/></row></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {main}><row><c t="s"><v>0</v></c><c><v>7</v></c><c t="b"><v>1</v></c><c t="inlineStr"><is><t>in</t></is></c></row></worksheet>')
    book, doc = out.getvalue(), files.plain_docx(["a & b", "c"])
    rows = [("/a/x.xlsx", book), ("/a/x.XLSM", book), ("/a/x.docx", doc), ("/a/bad.xlsx", b"no"), ("/a/x.pdf", b"%PDF-1.4 junk"), ("/a.d/none", b"text")]
    got = {r["path"]: r["text"] for r in files.extract_text(spark.createDataFrame(rows, "path string, content binary")).collect()}
    sheet = "one 7 True in two 2.5"
    assert got == {"/a/x.xlsx": sheet, "/a/x.XLSM": sheet, "/a/x.docx": "a & b\nc", "/a/bad.xlsx": "", "/a/x.pdf": "", "/a.d/none": ""}
