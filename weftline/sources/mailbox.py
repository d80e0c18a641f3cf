"""Mail scans as a streaming source, and the connector that takes them in.

A mailbox is a folder of scans: `scans/slice=<n>/*`, one JSON object a line, and `bodies/slice=<n>` (Parquet: entry_id,
body). A slice is put in place whole, under a number above all before it; a later slice may scan old mail again. The
source's offset is the cursor, the last slice's number, so it moves over mail that is known or unreadable too.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from weftline.plans.registry import query
from weftline.plans.views import view, work_dir
from weftline.sources.tables import ship

#: Bytes of a scan that one task reads.
RANGE = 64 << 20


@dataclass
class Piece(InputPartition):
    """The lines of a file that begin in a range of its bytes."""

    slice: int
    path: str
    begin: int
    end: int


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.partition("/")[0] else (fs.LocalFileSystem(), path)


def lines_of(stream, begin: int, end: int) -> Iterator[str]:
    """The lines that begin at `begin` or after and before `end`; bytes that aren't UTF-8 are replaced."""
    if begin:
        stream.seek(begin - 1)
        stream.readline()
    while stream.tell() < end and (line := stream.readline()):
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text.strip():
            yield text


class MailboxReader(DataSourceStreamReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path.rstrip("/"), size

    def initialOffset(self) -> dict:
        return {"cursor": -1}

    def latestOffset(self) -> dict:
        return {"cursor": max((n for n, _ in self._slices()), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        out = []
        for n, folder in self._slices():
            if start["cursor"] < n <= end["cursor"]:
                for f in _opened(self.path)[0].get_file_info(fs.FileSelector(folder)):
                    if f.is_file and not f.base_name.startswith(("_", ".")):
                        out += [Piece(n, f.path, at, min(at + self.size, f.size)) for at in range(0, f.size, self.size)]
        return out

    def read(self, partition: Piece) -> Iterator[tuple[int, str]]:
        with io.BufferedReader(_opened(self.path)[0].open_input_file(partition.path), 1 << 20) as stream:
            for text in lines_of(stream, partition.begin, partition.end):
                yield partition.slice, text

    def _slices(self) -> list[tuple[int, str]]:
        """Number and folder of every slice: names alone, nothing is opened."""
        system, top = _opened(self.path)
        found = system.get_file_info(fs.FileSelector(f"{top}/scans", allow_not_found=True))
        return [(int(f.base_name[6:]), f.path) for f in found if f.base_name.startswith("slice=") and f.base_name[6:].isdigit()]


class Mailbox(DataSource):
    """Format `mailbox`: options `path` and `range` (bytes a task reads)."""

    @classmethod
    def name(cls) -> str:
        return "mailbox"

    def schema(self) -> str:
        return "slice long, value string"

    def streamReader(self, schema) -> MailboxReader:
        return MailboxReader(self.options["path"], int(self.options.get("range", RANGE)))


class MailScan:
    """Mail of a mailbox taken in once each: items, their bodies, lines that can't be read, and a log of the batches.

    An item's stable key is its conversation, else its entry; its dedupe key is a hash of day, participants and entry.
    Items are kept by the day they came, so a batch looks for its keys among items of its own days only, and bodies are
    read from slices that hold new items only. Of lines with one key in a batch the first slice's counts, ties to the
    smaller text. A batch that is tried again writes over what it left. Participants may be a list or one text; what
    isn't a JSON object is a bad line; a missing time counts as 0. `sender` and `direction` are set for sent mail.
    """

    KEY = ("day", "stable_key", "dedupe_key")
    TABLES = {
        "items": "stable_key string, dedupe_key string, entry_id string, occurred_ts double, subject string, from_actor string, participants array<string>, direction string, slice long, day date, batch long",
        "bodies": "stable_key string, dedupe_key string, body string, batch long", "failed": "slice long, value string, batch long",
        "log": "lines long, inserted long, duplicates long, bad long, cursor_ts double, batch long",
    }

    def __init__(self, spark: SparkSession, mailbox: str, home: str, time: str = "received_epoch", sender: str | None = None, direction: str | None = None, read_bytes: int = RANGE):
        self.spark, self.mailbox, self.home, self.time, self.sender, self.direction, self.read_bytes = spark, mailbox, home, time, sender, direction, read_bytes

    def items_of(self, lines: DataFrame) -> DataFrame:
        """The items of readable lines, `v` being the line as a variant."""
        def get(field, kind="string"):
            return F.try_variant_get("v", f"$.{field}", kind)

        entry, conversation = F.nullif(get("entry_id"), F.lit("")), F.nullif(get("conversation_id"), F.lit(""))
        parties = F.coalesce(get("participants", "array<string>"), F.when(F.schema_of_variant(F.try_variant_get("v", "$.participants", "variant")) == "STRING", F.array(get("participants"))), F.array().cast("array<string>"))
        items = lines.select(
            "slice", "value", F.coalesce(conversation, entry, F.lit("")).alias("stable_key"), entry.alias("entry_id"), F.coalesce(get(self.time, "double"), F.lit(0.0)).alias("occurred_ts"),
            get("subject").alias("subject"), (F.lit(self.sender) if self.sender else get("sender")).alias("from_actor"), parties.alias("participants"), F.lit(self.direction).cast("string").alias("direction"),
        )
        named = F.array_sort(F.filter(F.transform("participants", lambda p: F.lower(F.trim(p))), lambda p: p != ""))
        day = F.date_from_unix_date(F.floor(F.col("occurred_ts") / 86400).cast("int"))
        ref = F.lower(F.trim(F.coalesce("entry_id", "stable_key")))
        return items.withColumn("day", day).withColumn("dedupe_key", F.substring(F.sha2(F.concat_ws("|", F.col("day").cast("string"), F.array_join(named, ","), ref), 256), 1, 16))

    def _take(self, lines: DataFrame, batch: int) -> None:
        lines = lines.withColumn("v", F.try_parse_json("value")).withColumn("good", F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))).persist()  # read from the scans once; a lost block is read again
        items = self.items_of(lines.where("good"))
        rest = [c for c in items.columns if c not in (*self.KEY, "value")]
        first = items.groupBy(*self.KEY).agg(F.min_by(F.struct(*rest), F.struct("slice", "value")).alias("i")).select(*self.KEY, "i.*")
        days = [r["day"] for r in first.select("day").distinct().collect()]  # one row a calendar day
        known = self.table("items").where((F.col("batch") < batch) & F.col("day").isin(days)).select(*self.KEY)
        fresh = first.join(known, list(self.KEY), "left_anti").withColumn("batch", F.lit(batch).cast("long"))
        fresh.select(*[c.split()[0] for c in self.TABLES["items"].split(", ")]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(f"{self.home}/items")
        new = self.table("items").where((F.col("batch") == batch) & F.col("day").isin(days))
        slices = [r["slice"] for r in new.select("slice").distinct().collect()]  # as many as the source has listed at most
        bodies = self._read(f"{self.mailbox}/bodies", "entry_id string, body string, slice long").where(F.col("slice").isin(slices))
        wanted = new.select("slice", "entry_id", "stable_key", "dedupe_key").where("entry_id is not null")
        bodies = bodies.join(wanted, ["slice", "entry_id"]).groupBy("stable_key", "dedupe_key").agg(F.min("body").alias("body"))
        self._write(bodies, "bodies", batch)
        self._write(lines.where("not good").select("slice", "value"), "failed", batch)
        seen = items.agg(F.count("*").alias("n"), F.max("occurred_ts").alias("ts"))
        counts = lines.agg(F.count("*").alias("lines"), F.count_if(~F.col("good")).alias("bad")).crossJoin(new.agg(F.count("*").alias("inserted"))).crossJoin(seen)  # one row each
        before = self.table("log").where(F.col("batch") < batch).agg(F.max("cursor_ts").alias("before"))
        counts = counts.crossJoin(before).select("lines", "inserted", (F.col("n") - F.col("inserted")).alias("duplicates"), "bad", F.greatest("ts", "before").alias("cursor_ts"))
        self._write(counts.coalesce(1), "log", batch)
        lines.unpersist()

    def _write(self, df: DataFrame, name: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.home}/{name}/batch={batch}")

    def table(self, name: str) -> DataFrame:
        """One of TABLES; without rows where no batch has been taken in."""
        return self._read(f"{self.home}/{name}", self.TABLES[name])

    def _read(self, path: str, schema: str) -> DataFrame:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        there = place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(place)
        return self.spark.read.schema(schema).parquet(path) if there else self.spark.createDataFrame([], schema)

    def run(self) -> None:
        """Take in the slices after the cursor, which the checkpoint holds."""
        ship(self.spark)
        self.spark.dataSource.register(Mailbox)
        lines = self.spark.readStream.format("mailbox").option("path", self.mailbox).option("range", self.read_bytes).load()
        lines.writeStream.foreachBatch(self._take).option("checkpointLocation", f"{self.home}/check").trigger(availableNow=True).start().awaitTermination()


def write_slices(scans: DataFrame, folder: str) -> None:
    """Slices of a mailbox from scans (slice, entry_id, body, value)."""
    scans.select("slice", "value").write.mode("append").partitionBy("slice").text(f"{folder}/scans")
    scans.select("slice", "entry_id", "body").write.mode("append").partitionBy("slice").parquet(f"{folder}/bodies")


def _scans(spark: SparkSession, sf_dir: str, time: str) -> DataFrame:
    """The mail among the items as scans, a slice a day: every seventh comes again a day later, some lines are cut short."""
    def line(participants):
        return f"to_json(named_struct('conversation_id', thread_key, 'entry_id', 'E' || id, '{time}', occurred_ts, 'sender', from_actor, 'subject', subject, 'participants', {participants}))"

    items = view(spark, sf_dir, "raw_items").where("source = 'outlook_mail'").withColumn("again", F.expr("explode(if(id % 7 = 0, array(0, 1), array(0)))"))
    items = items.withColumn("line", F.expr(f"if(id % 3 = 0, {line('array(from_actor)')}, {line('from_actor')})"))
    return items.selectExpr("cast(floor(occurred_ts / 86400) as bigint) + again as slice", "'E' || id as entry_id", "body_preview as body", "if(id % 40 = 12 and again = 0, substr(line, 1, 20), line) as value")


def _connector(name: str, time: str, **fixed: str):
    sender, direction = (f"'{fixed[k]}'" if k in fixed else other for k, other in (("sender", "from_actor"), ("direction", "cast(null as varchar)")))

    @query(name, f"""
        select 'E' || TEXT(id) as entry_id, substr(SHA256(DAY(occurred_at) || '|' || lower(from_actor) || '|e' || TEXT(id)), 1, 16) as dedupe_key, occurred_ts, subject, {sender} as from_actor, {direction} as direction, body_preview as body
        from raw_items where source = 'outlook_mail' and not (id % 40 = 12 and id % 7 <> 0)""")
    def run(spark, sf_dir):
        """Two runs of the connector, the second from the first's checkpoint with the later half of the slices."""
        folder = work_dir(spark)
        scans = _scans(spark, sf_dir, time)
        middle = scans.agg(F.avg("slice")).first()[0] or 0.0
        for part in (F.col("slice") <= middle, F.col("slice") > middle):
            write_slices(scans.where(part), f"{folder}/mailbox")
            scan = MailScan(spark, f"{folder}/mailbox", f"{folder}/mail", time, **fixed)
            scan.run()
        return scan.table("items").join(scan.table("bodies"), ["stable_key", "dedupe_key"], "left").select("entry_id", "dedupe_key", "occurred_ts", "subject", "from_actor", "direction", "body")


_connector("s07b_mail_connector", "received_epoch")
_connector("s08b_sent_connector", "sent_epoch", sender="manager", direction="outbound")
