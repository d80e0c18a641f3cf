"""Links in order against a loop over the items, whole and in batches."""

import collections
import random

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from weftline.operators import linking
from weftline.operators.joins import LINKABLE
from weftline.plans.registry import frames

SCHEMA = "id long, thread_key string, item_class string, asks_in_chat boolean, real_signal boolean, by_container long, by_tag long, by_reference long, by_subject long, by_sender long, reference string, container_open boolean"


def items_of(seed, n):
    rng = random.Random(seed)
    containers = {f"t{k}": (k, rng.random() < 0.6) for k in range(6)}
    references = {f"R{k}": 100 + k for k in range(4)}
    out = []
    for i in range(1, n + 1):
        kind = rng.choice(["NOISE", "FYI-EVIDENCE", "FYI-EVIDENCE", "ACTIONABLE-ASK", "WAITING-ON-OTHERS"])
        thread, reference = rng.choice([None, *(f"t{k}" for k in range(25))]), rng.choice([None, *(f"R{k}" for k in range(20))])
        chat = kind in ("ACTIONABLE-ASK", "WAITING-ON-OTHERS") and rng.random() < 0.5
        issue, is_open = containers.get(thread, (None, False))
        out.append((i, thread, kind, chat, rng.random() < 0.5, issue, rng.choice([None] * 7 + [200]), references.get(reference), rng.choice([None, None, 300]) if kind == "FYI-EVIDENCE" else None,
                    rng.choice([None, 400]) if chat else None, reference, is_open))
    return out


def one_by_one(items):
    containers, references, out = {}, {}, {}
    for i, thread, kind, chat, real, c, tag, ref_issue, subject, sender, reference, is_open in items:
        rule, issue, still_open = None, None, True
        c_issue, c_open = (c, is_open) if c is not None else containers.get(thread, (None, True)) if thread else (None, True)
        held = ref_issue if ref_issue is not None else references.get(reference)
        if kind == "NOISE":
            rule = "noise"
        elif c_issue is not None:
            rule, issue, still_open = "container", c_issue, c_open
        elif tag is not None:
            rule, issue = "tag", tag
        elif held is not None:
            rule, issue = "reference", held
        elif subject is not None:
            rule, issue = "subject", subject
        elif kind == "FYI-EVIDENCE" and not real:
            rule = "fyi_standalone"
        elif sender is not None:
            rule, issue = "sender", sender
        elif chat:
            rule = "chat_standalone"
        else:
            rule, issue = "new", -i
        if rule in linking.SETTING and thread:
            containers[thread] = (issue, True)
        if issue is not None and still_open and reference:
            references.setdefault(reference, issue)
        out[i] = (rule, issue)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_links_equal_a_loop_whichever_way_items_are_cut(spark, seed):
    items = items_of(seed, 260)
    expected = one_by_one(items)
    assert {r for r, _ in expected.values()} >= {"container", "tag", "reference", "subject", "sender", "new"}
    df = spark.createDataFrame(items, SCHEMA).repartition(3)
    assert {r["id"]: (r["rule"], r["issue_id"]) for r in linking.link_in_order(df).collect()} == expected
    if seed == 0:
        batches = linking.OrderedLinks(spark)
        for n, (a, b) in enumerate([(0, 1), (1, 90), (90, 260)]):
            part = df.where((F.col("id") > a) & (F.col("id") <= b))
            batches(part, n)
            batches(part, n)  # a batch that runs again
        assert {r["id"]: (r["rule"], r["issue_id"]) for r in batches.links().collect()} == expected


def test_a_chain_of_dependent_links(spark):
    """Each item has the reference of the one before and the container of the one after."""
    items = [(i, f"t{i // 2}", "ACTIONABLE-ASK", False, True, None, None, None, None, None, f"R{(i + 1) // 2}", False) for i in range(1, 13)]
    got = {r["id"]: (r["rule"], r["issue_id"]) for r in linking.link_in_order(spark.createDataFrame(items, SCHEMA)).collect()}
    assert got == one_by_one(items) and {issue for _, issue in got.values()} == {-1}


def test_no_items(spark):
    assert linking.link_in_order(spark.createDataFrame([], SCHEMA)).count() == 0


def test_the_whole_table_as_a_stream(spark, tmp_path):
    linkable = LINKABLE(spark, **frames(spark, SMALL, LINKABLE.inputs))
    expected = one_by_one([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in linkable.orderBy("id").collect()])
    middle = linkable.agg(F.median("id")).first()[0]
    for half in (F.col("id") <= middle, F.col("id") > middle):  # two files, in order
        linkable.where(half).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batches = linking.OrderedLinks(spark, str(tmp_path / "out"))
    stream = spark.readStream.schema(linkable.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.writeStream.foreachBatch(batches).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    assert {r["id"]: (r["rule"], r["issue_id"]) for r in batches.links().collect()} == expected


def _largest_part(df):
    """The share of rows in the largest part; all columns are read, so that no join is left out."""
    parts = collections.Counter(r["part"] for r in df.withColumn("part", F.spark_partition_id()).collect())
    return max(parts.values()) / sum(parts.values())


@pytest.fixture
def by_shuffles(spark):
    """Joins by shuffles alone, in 16 parts that stay as they are dealt."""
    own = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_items_without_a_key_are_dealt_to_all_tasks(by_shuffles):
    """Four of five items have no reference, nine of ten no sender to look up."""
    spark = by_shuffles
    given = frames(spark, SMALL, LINKABLE.inputs)
    linkable = LINKABLE(spark, **given)
    assert linkable.count() == given["raw_items"].count() > 900 and linkable.where("reference is null").count() > 0.7 * linkable.count()
    assert _largest_part(linkable) < 0.3
    items = linkable.localCheckpoint()
    links = linking._round(items, None).localCheckpoint()
    assert _largest_part(linking._round(items, links)) < 0.3


def test_a_frequent_key_is_dealt_to_tasks_with_the_same_rows(by_shuffles, monkeypatch):
    spark = by_shuffles
    items = items_of(7, 260)
    items = [(*i[:1], "t9" if i[0] % 4 else i[1], *i[2:10], "R9" if i[0] % 3 else i[10], i[11]) for i in items]
    items = [i if i[1] != "t9" else (*i[:5], None, *i[6:11], False) for i in items]
    expected = one_by_one(items)
    monkeypatch.setattr("weftline.plans.registry.DEALT_ROWS", 20)
    df = spark.createDataFrame(items, SCHEMA)
    assert {r["id"]: (r["rule"], r["issue_id"]) for r in linking.link_in_order(df).collect()} == expected
    assert _largest_part(linking._round(df, linking._round(df, None).localCheckpoint(), linking.hot_keys(df, ["thread_key"], ["reference"]))) < 0.3
    batches = linking.OrderedLinks(spark)
    batches(df.where("id <= 120"), 0)
    batches(df.where("id > 120"), 1)
    assert {r["id"]: (r["rule"], r["issue_id"]) for r in batches.links().collect()} == expected
