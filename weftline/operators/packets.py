"""Identity packets: what of an issue's evidence fits a budget of characters, from both ends.

Where all of it fits, it's all of it, oldest first, then the attachments. Else the attachments (up to a budget of their own)
and the earliest item come first, and the newest items fill what is left, backwards, up to the first that doesn't fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.plans.registry import query
from weftline.plans.views import view

SEPARATOR = "\n\n---\n\n"
#: Lists in which the newest items of an issue are first looked for, so that one of very many items is no single task.
HEAPS = 32


def _first(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of each issue, by lists of a part of its rows."""
    heap = F.pmod(F.xxhash64("id"), F.lit(HEAPS))
    some = rows.withColumn("place", F.row_number().over(Window.partitionBy("issue_id", heap).orderBy(*order))).where(F.col("place") <= most)
    return some.withColumn("place", F.row_number().over(Window.partitionBy("issue_id").orderBy(*order))).where(F.col("place") <= most)


def _joined(of: str, order: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, of))), lambda s: s[of]), SEPARATOR)


def identity_packets(items: DataFrame, attachments: DataFrame, budget: int = 12_000, attached: int = 2_000) -> DataFrame:
    """issue_id, packet, n_items, whole: (issue_id, id, ts, subject, body) items and (issue_id, id, filename, text) attachments.

    n_items items are in the packet; `whole` says that everything is. Ties of ts go by id; null texts are empty, an attachment
    without text is none. An issue with attachments alone has a packet of those; one with neither has none.
    """
    said = items.select("issue_id", "id", "ts", F.concat(F.lit("Subject: "), F.coalesce("subject", F.lit("")), F.lit("\n"), F.coalesce("body", F.lit(""))).alias("part"))
    said = said.withColumn("chars", F.length("part").cast("long"))
    files = attachments.where("text is not null and text <> ''").select("issue_id", "id", F.concat(F.lit("Attachment ("), F.coalesce(F.nullif("filename", F.lit("")), F.lit("unnamed")), F.lit("):\n"), F.col("text")).alias("part"))
    gap = len(SEPARATOR)
    # each part has a separator and a heading, so no more of them than this can have room
    block = _first(files, [F.col("id")], attached // (gap + len("Attachment ():\n")) + 2).groupBy("issue_id").agg(F.substring(_joined("part", "place"), 1, attached).alias("block"))
    earliest = F.min_by(F.struct("id", "ts", "part", "chars"), F.struct("ts", "id"))
    sizes = said.groupBy("issue_id").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), earliest.alias("earliest"))
    sizes = sizes.join(block, "issue_id", "full").withColumns({"n": F.coalesce("n", F.lit(0)), "extra": F.length(F.coalesce("block", F.lit(""))).cast("long")})
    sizes = sizes.withColumn("total", F.coalesce("chars", F.lit(0)) + F.col("extra") + F.greatest(F.col("n") + F.when(F.col("extra") > 0, 1).otherwise(0) - 1, F.lit(0)) * gap)
    sizes = sizes.withColumns({"whole": F.col("total") <= budget, "left": budget - F.col("extra") - F.coalesce("earliest.chars", F.lit(0))}).drop("chars")

    newest = _first(said, [F.col("ts").desc(), F.col("id").desc()], budget // (gap + len("Subject: \n")) + 2)
    rest = newest.join(sizes.select("issue_id", "whole", "left", F.col("earliest.id").alias("first_id"), F.col("earliest.ts").alias("first_ts")), "issue_id")
    rest = rest.where(~(F.col("id").eqNullSafe(F.col("first_id")) & F.col("ts").eqNullSafe(F.col("first_ts"))))
    spent = F.sum(F.col("chars") + gap).over(Window.partitionBy("issue_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    kept = rest.withColumn("spent", spent).where(F.col("whole") | (F.col("spent") <= F.col("left")))
    recent = kept.withColumn("turn", -F.col("place")).groupBy("issue_id").agg(_joined("part", "turn").alias("recent"), F.count("*").alias("n_recent"))

    out = sizes.join(recent, "issue_id", "left")
    first, block = F.col("earliest.part"), F.when(F.col("extra") > 0, F.col("block"))
    packet = F.when(F.col("whole"), F.concat_ws(SEPARATOR, first, "recent", block)).otherwise(F.concat_ws(SEPARATOR, first, block, "recent"))
    n_items = F.coalesce("n_recent", F.lit(0)) + F.when(F.col("n") > 0, 1).otherwise(0)
    return out.select("issue_id", packet.alias("packet"), n_items.alias("n_items"), "whole").where("n_items > 0 or packet <> ''")


@query("l04_identity_packet", """
    with items as (select issue_id, id, first_seen_ts as ts, 'Subject: ' || claim_type || chr(10) || text as part from claims where claim_type <> 'date'),
    files as (select issue_id, JOINED(MAP_EACH(LIST(id || '|' || text), x, 'Attachment (' || split_part(x, '|', 1) || '):' || chr(10) || split_part(x, '|', 2)), chr(10) || chr(10) || '---' || chr(10) || chr(10)) as joined from claims where claim_type = 'date' group by issue_id),
    numbered as (select *, row_number() over (partition by issue_id order by ts, id) as up, row_number() over (partition by issue_id order by ts desc, id desc) as down from items),
    issue as (select coalesce(n.issue_id, f.issue_id) as issue_id, substr(coalesce(f.joined, ''), 1, 60) as block, n.n, n.chars, n.head from (select issue_id, count(*) as n, sum(length(part)) as chars, max(case when up = 1 then part end) as head from numbered group by issue_id) n full join files f on f.issue_id = n.issue_id),
    sized as (select *, coalesce(chars, 0) + length(block) + 7 * greatest(coalesce(n, 0) + case when block <> '' then 1 else 0 end - 1, 0) <= 200 as whole, 200 - length(block) - length(coalesce(head, '')) as remaining from issue),
    spent as (select n.issue_id, n.up, n.part, sum(length(n.part) + 7) over (partition by n.issue_id order by n.down) as spent from numbered n where n.up > 1),
    kept as (select s.issue_id, s.up, s.part from spent s join sized z on z.issue_id = s.issue_id where z.whole or s.spent <= z.remaining),
    recent as (select issue_id, string_agg(part, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by up) as recent, count(*) as n_recent from kept group by issue_id)
    select z.issue_id, SHA256(case when z.whole then concat_ws(chr(10) || chr(10) || '---' || chr(10) || chr(10), z.head, r.recent, nullif(z.block, '')) else concat_ws(chr(10) || chr(10) || '---' || chr(10) || chr(10), z.head, nullif(z.block, ''), r.recent) end) as packet_sha256,
      LONG(coalesce(r.n_recent, 0) + case when z.n > 0 then 1 else 0 end) as n_items, z.whole from sized z left join recent r on r.issue_id = z.issue_id""")
def _l04(spark, sf_dir):
    """Claims as items, those of dates as attachments, in a budget that the longer issues pass."""
    claims = view(spark, sf_dir, "claims")
    items = claims.where("claim_type <> 'date'").select("issue_id", "id", F.col("first_seen_ts").alias("ts"), F.col("claim_type").alias("subject"), F.col("text").alias("body"))
    files = claims.where("claim_type = 'date'").select("issue_id", "id", F.col("id").cast("string").alias("filename"), "text")
    return identity_packets(items, files, 200, 60).select("issue_id", F.sha2("packet", 256).alias("packet_sha256"), "n_items", "whole")
