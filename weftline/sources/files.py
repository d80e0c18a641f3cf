"""File sources and sinks: staged drops, chat logs, attachments, reports, event logs; and the connectors' common core."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from itertools import chain, islice
from xml.sax.saxutils import escape

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.plans.registry import frames, query
from weftline.plans.surrogates import NOW_EVENTS
from weftline.plans.views import view, work_dir
from weftline.sources.tables import stored

def drop_files(spark: SparkSession, sf_dir: str) -> str:
    """Staged drops made from all raw items, one to a line: ten drops of each 200 ids, chats in each of their three shapes."""
    items = view(spark, sf_dir, "raw_items")
    event = F.struct(F.col("id").cast("string").alias("id"), F.date_format("occurred_at", "yyyy-MM-dd").alias("start"), F.when(F.col("k") % 3 == 0, "weekly").alias("recurrence"), "subject")
    html, short = F.concat(F.lit("<p>"), "body_preview", F.lit("</p>")), F.col("id") % 20 < 10
    message = F.struct(
        F.when(~short, F.col("id").cast("string")).alias("messageId"), F.when(short, F.col("id").cast("string")).alias("id"), F.when(F.col("k") % 4 == 0, "system").otherwise("message").alias("messageType"),
        F.when(short, html).alias("bodyPreview"), F.when(~short, F.struct(html.alias("content"))).alias("body"),
    )
    doc = F.struct((F.col("id") % 4).cast("string").alias("driveId"), F.col("id").cast("string").alias("id"), F.col("subject").alias("name"))
    grouped = items.groupBy(F.expr("id div 200").alias("block"), (F.col("id") % 10).alias("g")).agg(F.collect_list(event).alias("events"), F.collect_list(message).alias("messages"), F.collect_list(doc).alias("results"))
    kind, said = F.col("g") % 3, F.to_json("messages")
    shape = F.when(F.col("g") == 1, said).when(F.col("block") % 2 == 0, F.concat(F.lit('{"value":'), said, F.lit("}"))).otherwise(F.concat(F.lit('{"count":1,"messages":'), said, F.lit("}")))
    body = F.to_json(F.struct(
        F.when(kind == 0, "calendar").otherwise("sharepoint").alias("source"), F.when((kind == 0) & (F.col("g") != 9), F.col("events")).alias("events"), F.when(kind == 2, F.col("results")).alias("results"), F.when(kind == 0, F.size("events")).alias("events_count"),
    ))
    folder = work_dir(spark)
    chat = F.concat(F.lit('{"source":"teams_chat","messages_raw":'), shape, F.lit("}"))
    grouped.select(F.when(F.col("g") == 4, F.lit("{broken")).when(kind == 1, chat).otherwise(body).alias("value")).write.option("maxRecordsPerFile", 1000).text(folder)
    return folder


def parsed(drops: DataFrame) -> DataFrame:
    """The lines with `v`, their JSON as a variant (null where a line isn't JSON), and `source`."""
    v = F.try_parse_json("value")
    return drops.withColumn("v", v).withColumn("source", F.try_variant_get("v", "$.source", "string"))


def read_drops(spark: SparkSession, folder: str) -> DataFrame:
    """Staged JSON drops, one to a line."""
    return parsed(spark.read.text(folder))


def _list(v: str, path: str) -> F.Column:
    """The list at a path, of whatever elements; null where it isn't one."""
    return F.try_variant_get(v, path, "array<variant>")


def _text(v: str, path: str) -> F.Column:
    return F.try_variant_get(v, path, "string")


def _chat_messages() -> F.Column:
    """The messages of a chat drop, which are a list or under `value` or `messages`; an empty list gives way to the next."""
    found = [_list("v", f"$.messages_raw{p}") for p in ("", ".value", ".messages")]
    return F.coalesce(*(F.when(F.size(m) > 0, m) for m in found))


#: The items of the staged drops, straight from the raw items: every tenth drop is corrupt, another claims content and is empty.
DROPPED = """
    select 'calendar' as source, case when k % 3 = 0 then TEXT(id) || ':' || DAY(occurred_at) else TEXT(id) end as stable_key, subject from raw_items where id % 10 in (0, 3, 6)
    union all select 'teams_chat', TEXT(id), body_preview from raw_items where id % 10 in (1, 7) and (k is null or k % 4 <> 0)
    union all select 'sharepoint', TEXT(id % 4) || ':' || TEXT(id), subject from raw_items where id % 10 in (2, 5, 8)"""


def flatten_drops(drops: DataFrame) -> DataFrame:
    """source, stable_key, subject of every item of parsed drops, and the drops' other columns; what isn't as it should be gives none.

    A message's sender and body may be texts or objects; system messages and those without an id are left out.
    """
    more = [c for c in drops.columns if c not in ("value", "v", "source")]

    def of(source: str, items: F.Column) -> DataFrame:
        return drops.where(F.col("source") == source).select("source", *more, F.explode(items).alias("e"))

    calendar = of("calendar", _list("v", "$.events")).select("source", *more, F.when(_text("e", "$.recurrence").isNotNull(), F.concat_ws(":", _text("e", "$.id"), _text("e", "$.start"))).otherwise(_text("e", "$.id")).alias("stable_key"), _text("e", "$.subject").alias("subject"))
    body = F.coalesce(F.nullif(_text("e", "$.bodyPreview"), F.lit("")), F.nullif(_text("e", "$.body.content"), F.lit("")), _text("e", "$.body"))
    key = F.coalesce(F.nullif(_text("e", "$.id"), F.lit("")), F.nullif(_text("e", "$.messageId"), F.lit("")))
    chat = of("teams_chat", _chat_messages()).where((_text("e", "$.messageType") == "message") & key.isNotNull()).select("source", *more, key.alias("stable_key"), F.trim(F.regexp_replace(body, "<[^>]*>", "")).alias("subject"))
    files = of("sharepoint", _list("v", "$.results")).select("source", *more, F.concat_ws(":", _text("e", "$.driveId"), _text("e", "$.id")).alias("stable_key"), _text("e", "$.name").alias("subject"))
    return calendar.unionByName(chat).unionByName(files)


def refusal() -> F.Column:
    """Why a parsed drop is set aside, or null: it isn't JSON, its source is unknown, or it tells of content and holds none.

    What tells of content is a count over 0 (`count` beside the messages, or any name that ends in `_count`) or prose where a list
    should be. An empty list is no refusal.
    """
    there = F.coalesce(F.size(F.coalesce(_list("v", "$.events"), _chat_messages(), _list("v", "$.results"))), F.lit(0)) > 0
    counts = F.map_filter(F.try_variant_get("v", "$", "map<string,variant>"), lambda k, x: k.endswith("_count") & (F.coalesce(F.try_variant_get(x, "$", "long"), F.lit(0)) > 0))
    told = (F.size(counts) > 0) | (F.coalesce(F.try_variant_get("v", "$.messages_raw.count", "long"), F.lit(0)) > 0)
    prose = F.exists(F.array(*(F.schema_of_variant(F.try_variant_get("v", p, "variant")) for p in ("$.messages_raw", "$.events", "$.results"))), lambda t: t == "STRING")
    return (
        F.when(F.col("v").isNull(), "corrupt").when(F.col("source").isNull() | ~F.col("source").isin("calendar", "teams_chat", "sharepoint"), "unknown source")
        .when(~F.coalesce(there, F.lit(False)) & (F.coalesce(told, F.lit(False)) | F.coalesce(prose, F.lit(False))), "claims content but empty")
    )


@query("s01_process_drops", DROPPED)
def process_drops(spark, sf_dir):
    return flatten_drops(read_drops(spark, drop_files(spark, sf_dir)))


@query("s04_chat_messages", f"select * from ({DROPPED}) x where source = 'teams_chat'")
def chat_messages(spark, sf_dir):
    return flatten_drops(read_drops(spark, drop_files(spark, sf_dir))).where("source = 'teams_chat'")


@query("s06_content_but_empty", """
    select case id % 10 when 9 then 'calendar' end as source, case id % 10 when 9 then cast(count(*) as int) end as events_count, case id % 10 when 9 then 'claims content but empty' else 'corrupt' end as reason
    from raw_items where id % 10 in (4, 9) group by id // 200, id % 10""")
def content_but_empty(spark, sf_dir):
    """Drops to set aside: corrupt ones, and those that claim a count and hold nothing."""
    drops = read_drops(spark, drop_files(spark, sf_dir))
    return drops.select("source", F.try_variant_get("v", "$.events_count", "int").alias("events_count"), refusal().alias("reason")).where("reason is not null")


@query("s10_filename_index")
def filename_index(spark, sf_dir):
    """Lower-case file name -> paths, of every file under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(drop_files(spark, sf_dir)).select("path")
    name = F.lower(F.regexp_replace(F.element_at(F.split("path", "/"), -1), "-[0-9a-f-]{30,}-", "-"))
    return files.groupBy(name.alias("name")).agg(F.count("*").alias("n_paths"))


def docx_text(content: bytes) -> str:
    """Paragraph texts of a docx file, one to a line; empty where it can't be read."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            root = ET.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ET.ParseError):
        return ""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    lines = ("".join(t.text or "" for t in p.iter(f"{w}t")) for p in root.iter(f"{w}p"))
    return "\n".join(x for x in lines if x.strip())


def xlsx_text(content: bytes) -> str:
    """Cell values of all sheets of a workbook, in order, with spaces between; empty where it can't be read."""
    main, rel = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}", "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            target = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
            shared = []
            if "xl/sharedStrings.xml" in z.namelist():
                shared = [_rich_text(s, main) for s in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{main}si")]
            out = []
            for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{main}sheet"):
                at = target[sheet.get(f"{rel}id")]
                root = ET.fromstring(z.read(at.lstrip("/") if at.startswith("/") else f"xl/{at}"))
                out += [v for v in (_cell_text(c, main, shared) for c in root.iter(f"{main}c")) if v is not None]
    except (zipfile.BadZipFile, KeyError, IndexError, ValueError, ET.ParseError):
        return ""
    return " ".join(out)


def _rich_text(node: ET.Element, main: str) -> str:
    """The text of a string item: its own or its runs', without phonetic readings."""
    return "".join(t.text or "" for part in [node, *node.findall(f"{main}r")] for t in part.findall(f"{main}t"))


def _cell_text(cell: ET.Element, main: str, shared: list[str]) -> str | None:
    kind, value = cell.get("t", "n"), cell.findtext(f"{main}v")
    if kind == "inlineStr":
        inline = cell.find(f"{main}is")
        return None if inline is None else _rich_text(inline, main)
    if not value:
        return None
    if kind == "s":
        return shared[int(value)]
    if kind == "b":
        return str(bool(int(value)))
    if kind == "n":
        return str(float(value) if any(x in value for x in ".eE") else int(value))
    return value


#: By ending; any other has no text.
EXTRACTORS = {".docx": docx_text, ".xlsx": xlsx_text, ".xlsm": xlsx_text}


def file_text(path: str, content: bytes) -> str:
    name = path.rsplit("/", 1)[-1]
    extract = EXTRACTORS.get("." + name.rsplit(".", 1)[-1].lower() if "." in name else "")
    return extract(content) if extract else ""


def plain_docx(paragraphs: list[str]) -> bytes:
    body = "".join(f"<w:p><w:r><w:t>{escape(p)}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def extract_text(files: DataFrame) -> DataFrame:
    """path, text of binary files (path, content), by the ending; empty for other types (pdf among them) and those that can't be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "text": [file_text(p, c) for p, c in zip(b["path"], b["content"], strict=True)]})

    return files.select("path", "content").mapInPandas(run, "path string, text string")


def _attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    make = F.udf(lambda a, b, ok: plain_docx([a, b]) if ok else b"not a zip", T.BinaryType())
    items = view(spark, sf_dir, "raw_items")
    return items.select(F.concat(F.lit("/a/"), "id", F.lit(".docx")).alias("path"), make("subject", "signal_type", F.col("id") % 9 != 0).alias("content"))


_WRITTEN = "select '/a/' || id || '.docx' as path, case when id % 9 = 0 then '' else concat_ws(chr(10), nullif(trim(subject), ''), nullif(trim(signal_type), '')) end as text from raw_items"


@query("s12_extract_text", _WRITTEN)
def extracted_text(spark, sf_dir):
    return extract_text(_attachments(spark, sf_dir))


@query("s13_docx_text", f"select * from ({_WRITTEN}) x where text <> ''")
def extracted_docx(spark, sf_dir):
    return extract_text(_attachments(spark, sf_dir)).where("text <> ''")


def parse_blocks(logs: DataFrame) -> DataFrame:
    """month, text of logs of `---` blocks with from / ts / message_id headers -> one row per message."""
    block = logs.select("month", F.explode(F.split("text", "(?m)^---$")).alias("b")).where("trim(b) <> ''")

    def header(name):
        return F.nullif(F.trim(F.regexp_extract("b", rf"(?m)^{name}: (.*)$", 1)), F.lit(""))

    return block.select("month", header("from").alias("sender"), header("ts").cast("double").alias("ts"), header("message_id").alias("message_id"), F.regexp_replace(F.regexp_replace("b", r"(?m)^(from|ts|message_id): .*$", ""), r"^\s+|\s+$", "").alias("body")).where("message_id is not null")


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = view(spark, sf_dir, "messages")
    one = F.concat(F.lit("from: "), "role", F.lit("\nts: "), "ts", F.lit("\nmessage_id: m"), "conv_id", F.lit("."), "turn", F.lit("\n"), "text")
    return m.groupBy("conv_id", F.concat(F.lit("2024-0"), F.col("conv_id") % 4 + 1).alias("month")).agg(F.array_join(F.array_sort(F.collect_list(one)), "\n---\n").alias("text")).drop("conv_id")


_PARSED = r"select '2024-0' || TEXT(conv_id % 4 + 1) as month, role as sender, ts, 'm' || TEXT(conv_id) || '.' || TEXT(turn) as message_id, regexp_replace(text, '^\s+|\s+$', '', 'g') as body from messages where text is not null"


@query("s17_parse_blocks", _PARSED)
def parsed_blocks(spark, sf_dir):
    return parse_blocks(_logs(spark, sf_dir))


@query("s18_list_messages", f"""
    with parsed as ({_PARSED}), reactions as (select 'm' || TEXT(conv_id) || '.' || TEXT(turn) as message_id, count_if(turn % 2 = 0) as reactions from messages group by 1)
    select p.*, r.reactions from parsed p left join reactions r on r.message_id = p.message_id where p.month >= '2024-03'""")
def list_messages(spark, sf_dir):
    """The last two months' messages, from files partitioned by month, with their reactions."""
    folder = work_dir(spark)
    _logs(spark, sf_dir).write.partitionBy("month").parquet(folder)
    months = spark.read.parquet(folder).where("month >= '2024-03'").select(F.col("month").cast("string").alias("month"), "text")
    reactions = view(spark, sf_dir, "messages").groupBy(F.concat(F.lit("m"), "conv_id", F.lit("."), "turn").alias("message_id")).agg(F.count_if(F.expr("turn % 2 = 0")).alias("reactions"))
    return parse_blocks(months).join(reactions, "message_id", "left")


_RELATIONS = "http://schemas.openxmlformats.org/package/2006/relationships"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
#: What each file of a workbook with one sheet holds, but for the sheet itself.
_WORKBOOK = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
    '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": f'<Relationships xmlns="{_RELATIONS}"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": f'<workbook xmlns="{_SHEET}" xmlns:r="{_OFFICE}"><sheets><sheet name="Report" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_RELATIONS}"><Relationship Id="rId1" Type="{_OFFICE}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}


def _column(k: int) -> str:
    name = ""
    while k >= 0:
        name, k = chr(65 + k % 26) + name, k // 26 - 1
    return name


def _cell(place: str, v) -> str:
    if v is None or v != v:
        return ""
    if isinstance(v, str):
        return f'<c r="{place}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'
    return f'<c r="{place}"><v>{v!r}</v></c>'


def workbook(headers: list[str], rows) -> bytes:
    """An xlsx file of one sheet: the headers, then the rows of texts and numbers, as they come; a null is an empty cell."""
    lines = (f'<row r="{y}">{"".join(_cell(f"{_column(x)}{y}", v) for x, v in enumerate(row))}</row>' for y, row in enumerate(chain([headers], rows), 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in _WORKBOOK.items():
            z.writestr(name, content)
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(f'<worksheet xmlns="{_SHEET}"><sheetData>'.encode())
            while some := "".join(islice(lines, 1000)):
                f.write(some.encode())
            f.write(b"</sheetData></worksheet>")
    return out.getvalue()


def workbooks(sheet: DataFrame, most: int = 50_000) -> DataFrame:
    """name, content: workbooks of at most `most` rows of a table of texts and numbers, as each task comes to them."""
    headers, whole = sheet.columns, [isinstance(f.dataType, T.IntegralType) for f in sheet.schema]
    sheet = sheet.select(*[F.col(h).cast("string").alias(h) if w else F.col(h) for h, w in zip(headers, whole, strict=True)])  # pandas has no whole numbers with nulls

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        rows = (row for b in batches for row in b.astype(object).where(b.notna(), None).values.tolist())
        rows = ([int(v) if w and v is not None else v for v, w in zip(row, whole, strict=True)] for row in rows)
        for n, first in enumerate(rows):  # each turn takes the rows of a workbook
            yield pd.DataFrame({"name": [f"report-{part}-{n}.xlsx"], "content": [workbook(headers, chain([first], islice(rows, most - 1)))]})

    return sheet.mapInPandas(run, "name string, content binary")


def sheet_rows(content: bytes) -> Iterator[dict[str, str]]:
    """The rows of a workbook's first sheet after its headers, by header, as they are read; empty cells are left out."""
    main, headers = f"{{{_SHEET}}}", None
    with zipfile.ZipFile(io.BytesIO(content)) as z, z.open("xl/worksheets/sheet1.xml") as f:
        for event, node in ET.iterparse(f, ("start", "end")):
            if event == "start":
                if node.tag == f"{main}sheetData":
                    data = node
                continue
            if node.tag != f"{main}row":
                continue
            line = {c.get("r").rstrip("0123456789"): _cell_text(c, main, []) if c.get("t") else c.findtext(f"{main}v") for c in node}
            data.clear()  # what is read goes
            if headers is None:
                headers = line
            else:
                yield {headers[k]: v for k, v in line.items()}


def read_workbooks(files: DataFrame, schema: T.StructType, some: int = 5000) -> DataFrame:
    """The rows of the workbooks that `workbooks` made, with the types of `schema`; a Python worker holds a few workbooks and `some` rows."""
    names = schema.fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                rows = ([line.get(n) for n in names] for line in sheet_rows(content))
                while part := list(islice(rows, some)):
                    yield pd.DataFrame(part, columns=names, dtype=object)

    texts = files.select("content").mapInPandas(run, ", ".join(f"`{n}` string" for n in names))
    return texts.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


@query("s20_report_sheet", "select id as Issue, title as Title, category as Category, state as State, owner as Owner, value_amount as Value, opened_at as Opened, updated_at as Updated, due as Due from issues")
def report_sheet(spark, sf_dir):
    """The status report written as workbooks with nine fixed headers, stored, and read back."""
    issues = view(spark, sf_dir, "issues")
    sheet = issues.select(F.col("id").alias("Issue"), F.col("title").alias("Title"), F.col("category").alias("Category"), F.col("state").alias("State"), F.col("owner").alias("Owner"), F.col("value_amount").alias("Value"), F.col("opened_at").alias("Opened"), F.col("updated_at").alias("Updated"), F.col("due").alias("Due"))
    folder = work_dir(spark)
    workbooks(sheet).write.parquet(folder)
    return stored(read_workbooks(spark.read.schema("name string, content binary").parquet(folder), sheet.schema), "report", batch=4)


@query("s21_emit_events", "select id, occurred_ts, signal_type as kind, from_actor as actor from raw_items")
def emit_events(spark, sf_dir):
    """Two appends to an event log, which only grows."""
    folder, items = work_dir(spark), view(spark, sf_dir, "raw_items").select("id", "occurred_ts", F.col("signal_type").alias("kind"), F.col("from_actor").alias("actor"))
    items.where("id % 2 = 0").write.mode("append").parquet(folder)
    items.where("id % 2 = 1").write.mode("append").parquet(folder)
    return spark.read.schema(items.schema).parquet(folder)


@query("s22_snapshot", "select id, state, updated_at, '2001-08-02' as snapshot from issues")
def snapshot(spark, sf_dir):
    folder = work_dir(spark)
    issues = view(spark, sf_dir, "issues").select("id", "state", "updated_at")
    issues.write.parquet(f"{folder}/snapshot=2001-08-02")
    return spark.read.parquet(folder).withColumn("snapshot", F.col("snapshot").cast("string"))


@query("s24_chat_records", "select conv_id, turn, role, substr(text, 1, 2000) as text, cast(length(text) as int) + 3 as tokens from messages where role in ('user', 'assistant')")
def chat_records(spark, sf_dir):
    """JSON chat records whose content is a text or a list of blocks: kept roles, joined text cut to 2,000, token sums."""
    m = view(spark, sf_dir, "messages")
    usage = F.struct(F.length("text").alias("input"), F.lit(3).alias("output")).alias("usage")
    blocks = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))
    line = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct("role", blocks.alias("content"), usage))).otherwise(F.to_json(F.struct("role", F.col("text").alias("content"), usage)))
    parsed = m.select("conv_id", "turn", F.from_json(line, "role string, content string, usage struct<input:int,output:int>").alias("r")).where("r.role in ('user', 'assistant')")
    listed = F.array_join(F.transform(F.from_json("r.content", "array<struct<type:string,text:string>>"), lambda b: b["text"]), "\n")
    text = F.coalesce(F.when(F.col("r.content").startswith("[{"), listed), F.col("r.content"))
    return parsed.select("conv_id", "turn", F.col("r.role").alias("role"), F.substring(text, 1, 2000).alias("text"), (F.col("r.usage.input") + F.col("r.usage.output")).alias("tokens"))


@query("s25_expert_directory", "select n_name as expert, 'e' || n_nationkey || '@x.example' as email, unnest(['a' || n_nationkey, 'b']) as trigger, cast(n_nationkey as bigint) * 100 as threshold from nation")
def expert_directory(spark, sf_dir):
    """Markdown sections (Email, Triggers, Threshold) to rows, one per trigger."""
    nation = frames(spark, sf_dir, ["nation"])["nation"]
    md = nation.agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("## "), "n_name", F.lit("\nEmail: e"), "n_nationkey", F.lit("@x.example\nTriggers: a"), "n_nationkey", F.lit(", b\nThreshold: "), F.col("n_nationkey") * 100))), "\n").alias("text"))
    section = md.select(F.explode(F.split("text", "(?m)^## ")).alias("s")).where("trim(s) <> ''")
    return section.select(F.regexp_extract("s", r"^([^\n]*)", 1).alias("expert"), F.regexp_extract("s", r"Email: ([^\n]*)", 1).alias("email"), F.explode(F.split(F.regexp_extract("s", r"Triggers: ([^\n]*)", 1), ", *")).alias("trigger"), F.regexp_extract("s", "Threshold: ([0-9]+)", 1).cast("long").alias("threshold"))


@query("a48_disk_usage")
def disk_usage(spark, sf_dir):
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(drop_files(spark, sf_dir)).select("path", "length")
    return files.groupBy(F.regexp_extract("path", r"\.([a-z]+)$", 1).alias("kind")).agg(F.count("*").alias("n"), F.min(F.col("length") > 0).alias("all_filled"))


def scan_since(items: DataFrame, seen: DataFrame, cursor: float, limit: int, **fixed: str) -> DataFrame:
    """A mail scan: items after the cursor, at most `limit`, oldest first; known keys don't come again but move the cursor."""
    window = items.where(F.col("occurred_ts") > cursor).orderBy("occurred_ts", "id").limit(limit)
    fresh = window.join(seen, "id", "left_anti")
    return fresh.crossJoin(F.broadcast(window.agg(F.max("occurred_ts").alias("cursor_ts")))).withColumns({k: F.lit(v) for k, v in fixed.items()})


def _scan(source: str, name: str, **fixed: str):
    extra = "".join(f", '{v}' as {k}" for k, v in fixed.items())

    @query(name, f"""
        with seen_window as (select id, occurred_ts, subject from raw_items where source = '{source}' and occurred_ts > :now_events - 864000 order by occurred_ts, id limit 100)
        select id, occurred_ts, subject, (select max(occurred_ts) from seen_window) as cursor_ts{extra} from seen_window where id % 5 <> 0""")
    def run(spark, sf_dir):
        items = view(spark, sf_dir, "raw_items").where(F.col("source") == source).select("id", "occurred_ts", "subject")
        return scan_since(items, items.where("id % 5 = 0").select("id"), float(NOW_EVENTS[:-2]) - 864000, 100, **fixed)

    return run


_scan("outlook_mail", "s07_mail_scan")
_scan("outlook_mail", "s08_sent_scan", confirmed_direction="outbound")
_scan("calendar", "s09_calendar_scan")
