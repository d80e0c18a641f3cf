"""Linking items to issues in their order, where a link changes what later items find.

An item takes the first that fits: its container's issue, a tag that names an open issue, an open issue with its
reference, an FYI's subject, a chat's sender, or a new cluster. A link sets the container's issue (unless it's by subject)
and makes the item's reference one of the issue's, for all later items. Instead of a loop over items, the links of all are
computed at once from what earlier items have set, as far as that is known, until nothing changes: the first item is right
from the start, and each round puts right what depends on items that are. A round is two small aggregates (the first item
that sets a container, the first that has a reference) and two joins, so a container of very many items costs no more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.joins import LINKABLE
from weftline.operators.lookups import hot_keys, look_up
from weftline.plans.registry import frames, query
from weftline.sources.tables import shared_dir, stored

#: Rules by which an item's container gets its issue.
SETTING = ("tag", "reference", "sender", "new")
STATE = {"containers": "thread_key string, issue_id long, open boolean", "references": "reference string, issue_id long"}


def _round(items: DataFrame, links: DataFrame | None, hot: DataFrame | None = None) -> DataFrame:
    """Every item's rule and issue, given the links of the round before; hot are the frequent among containers and references."""
    if links is None:
        items = items.withColumns({"setter": F.lit(None).cast("long"), "holder": F.lit(None).cast("long")})
    else:
        first = F.min(F.struct("id", "issue_id"))
        setters = links.where(F.col("rule").isin(*SETTING) & F.col("thread_key").isNotNull()).groupBy("thread_key").agg(first.alias("by"))
        holders = links.where("reference is not null and issue_id is not null and open").groupBy("reference").agg(first.alias("of"))
        items = look_up(look_up(items, setters, ["thread_key"], hot), holders, ["reference"], hot)
        items = items.withColumns({"setter": F.when(F.col("by.id") < F.col("id"), F.col("by.issue_id")), "holder": F.when(F.col("of.id") < F.col("id"), F.col("of.issue_id"))})
    items = items.withColumns({"container": F.coalesce("by_container", "setter"), "referred": F.coalesce("by_reference", "holder")})
    rule = (
        F.when(F.col("item_class") == "NOISE", "noise").when(F.col("container").isNotNull(), "container").when(F.col("by_tag").isNotNull(), "tag").when(F.col("referred").isNotNull(), "reference")
        .when(F.col("by_subject").isNotNull(), "subject").when((F.col("item_class") == "FYI-EVIDENCE") & ~F.col("real_signal"), "fyi_standalone").when(F.col("by_sender").isNotNull(), "sender")
        .when(F.col("asks_in_chat"), "chat_standalone").otherwise("new")
    )
    issue = F.when(F.col("rule") == "container", F.col("container")).when(F.col("rule") == "tag", F.col("by_tag")).when(F.col("rule") == "reference", F.col("referred"))
    issue = issue.when(F.col("rule") == "subject", F.col("by_subject")).when(F.col("rule") == "sender", F.col("by_sender")).when(F.col("rule") == "new", -F.col("id"))
    still_open = ~((F.col("rule") == "container") & F.col("by_container").isNotNull() & ~F.col("container_open"))
    return items.withColumn("rule", rule).select("id", "thread_key", "reference", "rule", issue.alias("issue_id"), still_open.alias("open"))


def link_in_order(items: DataFrame) -> DataFrame:
    """id, thread_key, reference, rule, issue_id, open of linkable items (see joins.LINKABLE), linked in the order of their ids.

    An item of a new cluster has minus the id of the item that opened it. Ids are unique; an item without container or
    reference sets none. No items, no links.
    """
    items = stored(items, "linkable")
    hot = hot_keys(items, ["thread_key"], ["reference"])
    links = None
    while True:
        now = stored(_round(items, links, hot), "links")
        if links is not None:
            before = links.select("id", F.col("rule").alias("old_rule"), F.col("issue_id").alias("old_issue"))
            if now.join(before, "id").where(~F.col("rule").eqNullSafe(F.col("old_rule")) | ~F.col("issue_id").eqNullSafe(F.col("old_issue"))).isEmpty():
                return now
        links = now


def _new_state(links: DataFrame) -> dict[str, DataFrame]:
    """What the links add for later items: containers with an issue, references with one."""
    first = F.min_by(F.struct("issue_id", "open"), "id").alias("first")
    containers = links.where(F.col("rule").isin(*SETTING) & F.col("thread_key").isNotNull()).groupBy("thread_key").agg(first).select("thread_key", "first.issue_id", "first.open")
    holders = links.where("reference is not null and issue_id is not null and open").groupBy("reference").agg(F.min_by("issue_id", "id").alias("issue_id"))
    return {"containers": containers, "references": holders}


class OrderedLinks:
    """Links items batch by batch, as `foreachBatch` of a stream whose items come in the order of their ids.

    Each batch writes its links and what it adds to the state in a folder of its number, over what a failed try left
    there, and reads the state of the batches before it, so a batch that runs again gives the same.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        import uuid

        self.spark, self.path = spark, path or f"{shared_dir(spark)}/ordered-links-{uuid.uuid4().hex}"

    def _before(self, name: str, batch: int) -> DataFrame:
        out = self.spark.createDataFrame([], STATE[name])
        return out if batch == 0 else self.spark.read.schema(STATE[name] + ", batch long").parquet(f"{self.path}/{name}").where(F.col("batch") < batch).drop("batch")

    def __call__(self, items: DataFrame, batch: int) -> None:
        containers = self._before("containers", batch).groupBy("thread_key").agg(F.first("issue_id").alias("set_issue"), F.first("open").alias("set_open"))
        references = self._before("references", batch).groupBy("reference").agg(F.first("issue_id").alias("set_reference"))
        hot = hot_keys(items, ["thread_key"], ["reference"])
        items = look_up(look_up(items, containers, ["thread_key"], hot), references, ["reference"], hot)
        items = items.withColumns({"container_open": F.when(F.col("by_container").isNull(), F.coalesce("set_open", F.lit(False))).otherwise(F.col("container_open")), "by_container": F.coalesce("by_container", "set_issue"), "by_reference": F.coalesce("by_reference", "set_reference")})
        links = link_in_order(items.drop("set_issue", "set_open", "set_reference"))
        state = _new_state(links)
        known = self._before("references", batch).select("reference")
        state["references"] = state["references"].join(known, "reference", "left_anti")
        for name, df in {"links": links, **state}.items():
            df.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")

    def links(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/links").select("id", "rule", "issue_id")


@query("j15b_link_in_order")
def linked_in_order(spark, sf_dir):
    """All items, linked in their order; a new cluster's references and containers are there for later items."""
    return link_in_order(LINKABLE(spark, **frames(spark, sf_dir, LINKABLE.inputs))).select("id", "rule", "issue_id")
