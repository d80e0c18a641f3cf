"""Structured Streaming forms of the incremental operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.plans.registry import query
from weftline.plans.views import view, work_dir
from weftline.sources.files import DROPPED, drop_files, flatten_drops, parsed, refusal

def stream_to_table(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all that is there, into Parquet, and read the result."""
    folder = work_dir(spark)
    stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/check").option("path", f"{folder}/{name}").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/{name}")


class Inbox:
    """A folder's drops taken in once: items, refused lines and alerts as tables, files that are done in an archive.

    Each micro-batch writes its items, refused lines (`failed`, under the name of their file) and alerts in folders of its
    number, over what a failed try left there, so a drop counts once whatever fails. A file is moved to `archive` when the
    batch after it is committed, at the next run at the latest. An item whose key an earlier batch has is a duplicate.
    """

    TABLES = {"items": "source string, stable_key string, subject string, file string", "failed": "file string, reason string, value string", "alerts": "kind string, severity string, summary string, source_ref string"}

    def __init__(self, spark: SparkSession, inbox: str, home: str):
        self.spark, self.inbox, self.home = spark, inbox, home

    def _take(self, lines: DataFrame, batch: int) -> None:
        drops = parsed(lines).withColumn("reason", refusal())
        items = flatten_drops(drops.where("reason is null").drop("reason")).dropDuplicates(["source", "stable_key"])
        if batch:
            items = items.join(self.table("items", batch).select("source", "stable_key"), ["source", "stable_key"], "left_anti")
        failed = drops.where("reason is not null").select("file", "reason", "value")
        told = failed.select(F.lit("anomaly").alias("kind"), F.lit("warn").alias("severity"), F.concat(F.lit("ingest dead-letter: "), "file", F.lit(": "), "reason").alias("summary"), F.col("file").alias("source_ref"))
        for name, df in {"items": items, "failed": failed, "alerts": told}.items():
            df.write.mode("overwrite").parquet(f"{self.home}/{name}/batch={batch}")

    def table(self, name: str, before: int | None = None) -> DataFrame:
        found = self.spark.read.schema(self.TABLES[name] + ", batch long").parquet(f"{self.home}/{name}")
        return (found if before is None else found.where(F.col("batch") < before)).drop("batch")

    def run(self, files_a_batch: int = 1000) -> None:
        """Take in what is there."""
        lines = self.spark.readStream.schema("value string").option("maxFilesPerTrigger", files_a_batch).option("cleanSource", "archive").option("sourceArchiveDir", f"{self.home}/archive").text(self.inbox)
        lines = lines.select("value", F.col("_metadata.file_name").alias("file"))
        lines.writeStream.foreachBatch(self._take).option("checkpointLocation", f"{self.home}/check").trigger(availableNow=True).start().awaitTermination()


@query("s02_inbox_stream", DROPPED)
def inbox_stream(spark, sf_dir):
    inbox = Inbox(spark, drop_files(spark, sf_dir), work_dir(spark))
    inbox.run()
    return inbox.table("items").select("source", "stable_key", "subject")


@query("s23_tail_lines", "select concat_ws('|', conv_id, turn, role) as value from messages where conv_id % 2 = 1")
def tail_lines(spark, sf_dir):
    """Lines that arrive after the first sight of a text folder: what was there before is skipped by file time."""
    folder = work_dir(spark)
    m = view(spark, sf_dir, "messages").select(F.concat_ws("|", "conv_id", "turn", "role").alias("value"))
    m.where("conv_id % 2 = 0").repartition(1).write.mode("append").text(folder)
    seen = spark.read.format("binaryFile").load(folder).agg(F.max("modificationTime").alias("t")).first()["t"]
    m.where("conv_id % 2 = 1").repartition(1).write.mode("append").text(folder)
    stream = spark.readStream.schema("value string").text(folder).select("value", F.col("_metadata.file_modification_time").alias("t")).where(F.col("t") > F.lit(seen)).select("value")
    return stream_to_table(spark, stream, "lines")


def _events_folder(spark: SparkSession, sf_dir: str) -> tuple[str, T.StructType]:
    items = view(spark, sf_dir, "raw_items").select("id", "thread_key", "occurred_at", "signal_type", "subject", "from_actor", "issue_id")
    items = items.withColumn("occurred_at", F.col("occurred_at").cast("timestamp"))
    folder = work_dir(spark)
    items.repartition(4).write.parquet(folder)
    return folder, items.schema


@query("g01_classification_stream", "select id, case when contains(lower(subject), 'approve') then 'ask' when contains(lower(subject), 'status') then 'status' else 'other' end as item_class from raw_items")
def classification_stream(spark, sf_dir):
    """Files as they arrive, a bounded number to a micro-batch, classified and appended."""
    folder, schema = _events_folder(spark, sf_dir)
    low = F.lower("subject")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(folder)
    return stream_to_table(spark, stream.select("id", F.when(F.contains(low, F.lit("approve")), "ask").when(F.contains(low, F.lit("status")), "status").otherwise("other").alias("item_class")), "classified")


@query("g02_proactive_cursor", "select id, signal_type from raw_items where id > 5 and signal_type = 'error' and id % 2 = 0")
def proactive_cursor(spark, sf_dir):
    """Rows beyond a monotonic id, once each: the stream's checkpoint is the cursor."""
    folder, schema = _events_folder(spark, sf_dir)
    stream = spark.readStream.schema(schema).parquet(folder).where("id > 5 and signal_type = 'error' and id % 2 = 0")
    return stream_to_table(spark, stream.select("id", "signal_type"), "actions")


@query("g03b_observations_stream", "select signal_type, DAY(occurred_at) as day, count(*) as n from raw_items where occurred_at < cast('2024-01-28' as timestamp) group by 1, 2")
def observations_stream(spark, sf_dir):
    """Counts per signal and day with an event-time watermark; days that the watermark has passed are final."""
    folder, schema = _events_folder(spark, sf_dir)
    stream = spark.readStream.schema(schema).parquet(folder).withWatermark("occurred_at", "1 day")
    counted = stream.groupBy(F.window("occurred_at", "1 day"), "signal_type").agg(F.count("*").alias("n"))
    out = stream_to_table(spark, counted.select("signal_type", F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n"), "days")
    return out.where("day < '2024-01-28'")


@query("g04_exactly_once", "select id, issue_id from raw_items")
def exactly_once(spark, sf_dir):
    """The same files delivered twice: each (id, content hash) is materialised once, in idempotent micro-batches."""
    folder, schema = _events_folder(spark, sf_dir)
    spark.read.schema(schema).parquet(folder).write.mode("append").parquet(folder)
    target = work_dir(spark)

    def merge(batch: DataFrame, number: int) -> None:
        fresh = batch.select("id", "issue_id", F.sha2("subject", 256).alias("content_hash")).dropDuplicates(["id", "content_hash"])
        if number:
            past = [f"{target}/batch={n}" for n in range(number)]
            fresh = fresh.join(batch.sparkSession.read.parquet(*past), ["id", "content_hash"], "left_anti")
        fresh.select("id", "issue_id", "content_hash").write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(folder)
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{target}-check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(target).select("id", "issue_id")


@query("g05b_dormant_stream", "select issue_id, count(*) as n_items, case when max(EPOCH(occurred_at)) < 1706572800e0 - 2 * 86400 then 'dormant' else 'active' end as state from raw_items group by issue_id")
def dormant_stream(spark, sf_dir):
    """Per issue the last evidence and a state, kept by a stateful operator; late evidence makes it active again."""
    folder, schema = _events_folder(spark, sf_dir)
    limit = 1706572800.0 - 2 * 86400

    def update(key, batches, state):
        n, last = state.get if state.exists else (0, 0.0)
        for b in batches:
            n += len(b)
            last = max(last, float((b["occurred_at"].astype("int64") / 1e9).max()) if str(b["occurred_at"].dtype).endswith("[ns]") else float(b["occurred_at"].map(lambda t: t.timestamp()).max()))
        state.update((n, last))
        yield pd.DataFrame({"issue_id": [key[0]], "n_items": [n], "state": ["dormant" if last < limit else "active"]})

    stream = spark.readStream.schema(schema).parquet(folder).select("issue_id", "occurred_at")
    out = "issue_id long, n_items long, state string"
    kept = stream.groupBy("issue_id").applyInPandasWithState(update, out, "n long, last double", "update", "NoTimeout")
    target = work_dir(spark)
    kept.writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{target}/batch={n}")).option("checkpointLocation", f"{target}-check").trigger(availableNow=True).start().awaitTermination()
    seen = spark.read.parquet(target)
    return seen.groupBy("issue_id").agg(F.max(F.struct("batch", "n_items", "state")).alias("s")).select("issue_id", "s.n_items", "s.state")


@query("g09_tail_scan", "select id, occurred_ts from raw_items where signal_type = 'purchase' order by id desc limit 20")
def tail_scan(spark, sf_dir):
    """The newest matching rows: a descending top-k, which reads statistics first and keeps 20 rows to a task."""
    return view(spark, sf_dir, "raw_items").where("signal_type = 'purchase'").orderBy(F.desc("id")).limit(20).select("id", "occurred_ts")
