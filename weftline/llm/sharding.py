"""Hierarchical weighted hash tree: region, rack and shard levels, each by weighted hash draws."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import stored


@dataclass(frozen=True)
class Shard:
    """A leaf of the tree. weight is relative to the other shards."""

    region: str
    rack: str
    number: int
    weight: float = 1.0


def layout(shards: int, regions: int = 5, racks: int = 2, per_rack: int = 4) -> list[Shard]:
    """The tree for a shard count: full regions of racks x per_rack, then one region for every added shard.

    A shard added beyond the full regions opens a subtree of its own, so no weight elsewhere changes and rows
    can only move into it. Below the full regions' size the first `shards` leaves of the grid are used.
    """
    size = racks * per_rack
    out = []
    for n in range(shards):
        if n < regions * size:
            out.append(Shard(f"r{n // size}", f"r{n // size}.k{n % size // per_rack}", n))
        else:
            out.append(Shard(f"x{n}", f"x{n}.k0", n))
    return out


def _draw(key: Column, node: str, weight: float) -> Column:
    """An exponential draw with rate `weight` from the hash of (key, node); 52 bits, never 0."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(node)), 12).cast("double")
    return -F.log((bits + F.lit(1.0)) / F.lit(float(1 << 52) + 1.0)) / F.lit(float(weight))


def _first(draws: list[tuple[Column, str]]) -> Column:
    if len(draws) == 1:
        return F.lit(draws[0][1])
    return F.least(*(F.struct(d.alias("d"), F.lit(n).alias("n")) for d, n in draws))["n"]


def assign(key: Column, tree: list[Shard]) -> Column:
    """The shard number of a text key.

    At each level the child with the smallest draw wins; draws have the weight of the child's leaves as rate.
    Raising one subtree's weight lowers only that subtree's draws, so rows move into it or stay inside it.
    """
    def weight(leaves):
        return sum(x.weight for x in leaves)

    def groups(leaves, name):
        out: dict = {}
        for x in leaves:
            if x.weight > 0:
                out.setdefault(getattr(x, name), []).append(x)
        return out

    def leaf(leaves):
        return _first([(_draw(key, f"{x.rack}/{x.number}", x.weight), str(x.number)) for x in leaves])

    def choose(pick: Column, branches: dict[str, Column]) -> Column:
        names = list(branches)
        out = branches[names[-1]]
        for n in reversed(names[:-1]):
            out = F.when(pick == n, branches[n]).otherwise(out)
        return out

    regions = groups(tree, "region")
    inside = {}
    for r, leaves in regions.items():
        racks = groups(leaves, "rack")
        rack = _first([(_draw(key, k, weight(v)), k) for k, v in racks.items()])
        inside[r] = choose(rack, {k: leaf(v) for k, v in racks.items()})
    region = _first([(_draw(key, r, weight(v)), r) for r, v in regions.items()])
    return choose(region, inside).cast("int")


#: Rows of a shard that are ranked together, about.
TOGETHER = 1_000_000


def shard_documents(docs: DataFrame, shards: int = 40, grown: int = 41) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of (doc_id, text).

    Law `key`: doc_id and the shard count decide. Null text counts as no bytes, a null doc_id as the empty
    key; rows with equal doc_id land together, each with a slot of its own. Rows of
    a shard are dealt to 64 classes or more, with TOGETHER rows each at most on average, by row number, so that not
    even one repeated doc_id fills a class; they are ranked inside a class and the classes' counts give the offsets. The
    placement is stored once, so both reads of it agree. Other columns are ignored, whatever their names; an empty table
    has an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    placed = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + F.lit(16)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        assign(key, layout(shards)).alias("shard"),
        assign(key, layout(grown)).alias("grown_shard"),
        F.monotonically_increasing_id().alias("row"),
    )
    placed = stored(placed, "shards")
    chunks = max(64, -(-placed.count() // (shards * TOGETHER)))
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int"))
    sql = """
      select doc_id, size, text_crc32, law, shard, grown_shard, chunk,
             row_number() over (partition by shard, chunk order by doc_id, text_crc32) - 1 as r
      from {placed}"""
    ranked = docs.sparkSession.sql(sql, placed=placed)
    counts = ranked.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    starts = docs.sparkSession.sql(
        "select shard, chunk, coalesce(sum(n) over (partition by shard order by chunk "
        "rows between unbounded preceding and 1 preceding), 0) as start from {counts}", counts=counts
    )  # a row for each shard and class: a millionth of the rows, or 64 a shard
    return ranked.join(F.broadcast(starts), ["shard", "chunk"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", (F.col("start") + F.col("r")).cast("long").alias("slot"), "grown_shard"
    )
