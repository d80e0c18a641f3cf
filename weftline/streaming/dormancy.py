"""Dormancy by timers: an issue without new evidence turns dormant when event time has passed, without being looked at.

A key's state is the time of its last evidence and what the issue is; a timer in event time fires when the watermark
has gone the given time beyond the last evidence. New evidence takes the timer away, sets another and wakes the issue up.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from weftline.plans.registry import query
from weftline.plans.views import work_dir

SECOND, DAY = 1000, 86_400_000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "issue_id long, state string, last_ms long"


class Dormancy(StatefulProcessor):
    """Gives a row whenever an issue's state changes: at its first evidence, by its timer, and when it wakes up."""

    def __init__(self, quiet_ms: int, forget_ms: int | None):
        self.quiet, self.forget = quiet_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "last_ms long, state string", self.forget)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, state = self.held.get() if self.held.exists() else (0, None)
        last = max(last, *(int(r["ms"].max()) for r in rows))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        due, watermark = last + self.quiet, timerValues.getCurrentWatermarkInMs()
        now = "active" if due > watermark else "dormant"
        if now == "active":
            self.handle.registerTimer(due)
        self.held.update((last, now))
        if now != state:
            yield pd.DataFrame({"issue_id": [key[0]], "state": [now], "last_ms": [last]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, _ = self.held.get()
        self.held.update((last, "dormant"))
        yield pd.DataFrame({"issue_id": [key[0]], "state": ["dormant"], "last_ms": [last]})

    def close(self) -> None:
        pass


def with_timers(spark: SparkSession) -> SparkSession:
    """A session of its own whose streams keep state in RocksDB, which timers need."""
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return session


def changes(evidence: DataFrame, quiet_ms: int, late: str = "0 seconds", forget_ms: int | None = None) -> DataFrame:
    """issue_id, state, last_ms of every change, from a stream of (issue_id, ts) in a session with timers.

    `late` is how long evidence may be behind the newest; `forget_ms` how long (of processing time) a key's state is kept.
    """
    watched = evidence.withWatermark("ts", late).select("issue_id", "ts", F.unix_millis("ts").alias("ms"))
    return watched.groupBy("issue_id").transformWithStateInPandas(statefulProcessor=Dormancy(quiet_ms, forget_ms), outputStructType=CHANGES, outputMode="Update", timeMode="EventTime")


def run_changes(evidence: DataFrame, home: str, quiet_ms: int) -> None:
    """Take in what is there; the changes of each micro-batch go to a folder of its number."""
    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{home}/changes/batch={number}")

    changes(evidence, quiet_ms).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{home}/check").trigger(availableNow=True).start().awaitTermination()


def states(spark: SparkSession, home: str) -> DataFrame:
    """issue_id, state, changes: what each issue is now, and how often it changed."""
    seen = spark.read.schema(CHANGES + ", batch long").parquet(f"{home}/changes")
    order = F.struct("batch", "last_ms", F.when(F.col("state") == "dormant", 1).otherwise(0))
    return seen.groupBy("issue_id").agg(F.max_by("state", order).alias("state"), F.count("*").alias("changes"))


@query("g05c_dormant_timers", """
    with lasts as (select issue_id, max(occurred_ts) as last_ts from raw_items group by issue_id), newest as (select max(occurred_ts) as ts from raw_items)
    select issue_id, case when floor(last_ts * 1000) + 432000000 <= floor(ts * 1000) then 'dormant' else 'active' end as state from lasts cross join newest""")
def dormant_timers(spark, sf_dir):
    """Issues after five quiet days, by the timers of a stream of all items."""
    from weftline.plans.views import view

    home = work_dir(spark)
    view(spark, sf_dir, "raw_items").select("issue_id", F.col("occurred_at").cast("timestamp").alias("ts")).write.parquet(f"{home}/in")
    session = with_timers(spark)
    run_changes(session.readStream.schema("issue_id long, ts timestamp").parquet(f"{home}/in"), home, 5 * DAY)
    return states(spark, home).select("issue_id", "state")
