"""Looking up items' keys where many items have no key, or one key has very many items.

A join deals items to tasks by their key, so all items without one come to one task, and so do all of a frequent key.
Here an item without a key lies anywhere, and a key of more than DEALT_ROWS items is dealt to as many tasks as that takes, with its rows of the
table in each.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.plans import registry


def _known(keys: list[str]) -> Column:
    return reduce(and_, (F.col(k).isNotNull() for k in keys))


def hot_keys(items: DataFrame, *keys: list[str]) -> DataFrame | None:
    """The frequent among keys of one or more columns, by their hash, with how many tasks each is dealt to. There is at most one for DEALT_ROWS rows and key."""
    rows = registry.DEALT_ROWS
    hashes = F.array(*(F.when(_known(k), F.xxhash64(*k)) for k in keys))
    counts = items.select(F.explode(F.array_compact(hashes)).alias("hot")).groupBy("hot").count().where(F.col("count") > rows)
    found = [(r["hot"], -(-r["count"] // rows)) for r in counts.collect()]
    return items.sparkSession.createDataFrame(found, "hot long, parts long") if found else None


def look_up(items: DataFrame, table: DataFrame, keys: list[str], hot: DataFrame | None = None) -> DataFrame:
    """A left join of items (with an id) to the table by its keys; `hot` is what hot_keys gives for these items."""
    table = table.withColumn("slot", F.xxhash64(*keys))
    part = F.lit(0)
    if hot is not None:
        table = table.join(F.broadcast(hot), F.col("slot") == F.col("hot"), "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        table = table.withColumn("slot", F.col("slot") + F.col("part")).drop("hot", "parts", "part")
        items = items.join(F.broadcast(hot), F.xxhash64(*keys) == F.col("hot"), "left")
        part = F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1)))
    items = items.withColumn("slot", F.when(_known(keys), F.xxhash64(*keys) + part).otherwise(F.xxhash64("id")))
    return items.drop("hot", "parts").join(table, [*keys, "slot"], "left").drop("slot")
