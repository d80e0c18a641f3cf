"""The mail connector on invented scans: restarts, bad lines, mail that is scanned again, ranges of bytes."""

import io
import json
import os
import random

import pytest

from weftline.sources.mailbox import MailboxReader, MailScan, lines_of

DAY = 86400.0


def mail(k, at=0.0, **other):
    return json.dumps({"conversation_id": f"c{k % 2}", "entry_id": f"E{k}", "received_epoch": at, "sender": f"u{k}@x.example", "participants": [f" B{k}@x.example", "a@x.example"], "subject": f"s{k}"} | other)


def put(spark, box, n, lines, bodies=()):
    os.makedirs(f"{box}/scans/slice={n}")
    with open(f"{box}/scans/slice={n}/a.jsonl", "wb") as f:
        f.write(b"\n".join(x if isinstance(x, bytes) else x.encode() for x in lines))
    spark.createDataFrame([*bodies], "entry_id string, body string").write.parquet(f"{box}/bodies/slice={n}")


def rows(scan, name, *columns):
    return sorted(tuple(r) for r in scan.table(name).select(*columns).collect())


def test_each_mail_comes_once_whatever_is_scanned_again(spark, tmp_path):
    box, home = f"{tmp_path}/box", f"{tmp_path}/home"
    put(spark, box, 1, [mail(1, 5.0), mail(2, DAY), "{cut", "", "[1, 2]", '"prose"', b"\xff\xfe", mail(1, 5.0)], [("E1", "one"), ("E2", "two")])
    put(spark, box, 3, [mail(3, 2 * DAY, participants="Solo@x.example")], [("E3", "three")])
    MailScan(spark, box, home).run()
    scan = MailScan(spark, box, home)
    assert rows(scan, "items", "entry_id", "slice") == [("E1", 1), ("E2", 1), ("E3", 3)]
    assert rows(scan, "failed", "value") == [('"prose"',), ("[1, 2]",), ("{cut",), ("��",)]
    assert rows(scan, "log", "lines", "inserted", "duplicates", "bad", "cursor_ts") == [(8, 3, 1, 4, 2 * DAY)]

    scan.run()  # nothing new
    assert scan.table("items").count() == 3 and scan.table("log").count() == 1

    # mail that is known, and old mail that wasn't: the cursor of the source moves, that of the times doesn't go back
    put(spark, box, 4, [mail(2, DAY), mail(3, 2 * DAY, participants=["solo@X.example "])], [("E2", "changed")])
    scan.run()
    assert scan.table("items").count() == 3 and rows(scan, "bodies", "body") == [("one",), ("three",), ("two",)]
    put(spark, box, 5, [mail(9, 1.0), mail(2, DAY)], [("E9", "nine"), ("E2", "changed again")])
    scan.run()
    assert rows(scan, "items", "entry_id") == [("E1",), ("E2",), ("E3",), ("E9",)]
    assert rows(scan, "bodies", "body") == [("nine",), ("one",), ("three",), ("two",)]
    assert rows(scan, "log", "batch", "inserted", "duplicates", "cursor_ts") == [(0, 3, 1, 2 * DAY), (1, 0, 2, 2 * DAY), (2, 1, 1, 2 * DAY)]


def test_a_batch_that_is_tried_again_counts_once(spark, tmp_path):
    box, home = f"{tmp_path}/box", f"{tmp_path}/home"
    put(spark, box, 1, [mail(1), mail(2), "{cut"], [("E1", "one")])
    scan = MailScan(spark, box, home)
    lines = spark.createDataFrame([(1, mail(1)), (1, mail(2)), (1, "{cut")], "slice long, value string")
    scan._take(lines, 0)
    scan._take(lines, 0)
    assert rows(scan, "items", "entry_id") == [("E1",), ("E2",)] and rows(scan, "bodies", "body") == [("one",)]
    assert rows(scan, "log", "lines", "inserted", "duplicates", "bad") == [(3, 2, 0, 1)] and scan.table("failed").count() == 1


def test_odd_fields(spark, tmp_path):
    box = f"{tmp_path}/box"
    odd = ['{"entry_id": "only"}', "{}", mail(5, conversation_id="", participants=None), mail(6, entry_id=None), mail(7, participants={"a": 1}), mail(8, received_epoch="12", subject="x" * 300_000)]
    put(spark, box, 1, odd)
    scan = MailScan(spark, box, f"{tmp_path}/home", sender="me", direction="outbound", read_bytes=1000)
    scan.run()
    got = {(r["stable_key"], r["entry_id"]): (r["participants"], r["occurred_ts"], r["from_actor"], r["direction"]) for r in scan.table("items").collect()}
    pair = [" B6@x.example", "a@x.example"]
    fixed = ("me", "outbound")
    assert got == {("only", "only"): ([], 0.0, *fixed), ("", None): ([], 0.0, *fixed), ("E5", "E5"): ([], 0.0, *fixed), ("c0", None): (pair, 0.0, *fixed), ("c1", "E7"): ([], 0.0, *fixed), ("c0", "E8"): ([" B8@x.example", "a@x.example"], 12.0, *fixed)}
    assert scan.table("bodies").isEmpty() and scan.table("items").where("length(subject) = 300000").count() == 1


def test_an_empty_mailbox(spark, tmp_path):
    os.makedirs(f"{tmp_path}/box")
    scan = MailScan(spark, f"{tmp_path}/box", f"{tmp_path}/home")
    scan.run()
    assert scan.table("items").isEmpty() and rows(scan, "log", "lines", "inserted", "duplicates", "bad", "cursor_ts") == [(0, 0, 0, 0, None)]


@pytest.mark.parametrize("seed", range(5))
def test_each_line_is_in_one_range(seed, tmp_path):
    rng = random.Random(seed)
    lines = ["é" * rng.randint(0, 30) for _ in range(50)]
    data = rng.choice(["\n", "\r\n"]).join(lines).encode() + rng.choice([b"", b"\n"])
    size = rng.randint(1, 40)
    got = [x for at in range(0, len(data), size) for x in lines_of(io.BytesIO(data), at, min(at + size, len(data)))]
    assert got == [x for x in lines if x]
    os.makedirs(f"{tmp_path}/scans/slice=7")
    with open(f"{tmp_path}/scans/slice=7/f", "wb") as f:
        f.write(data)
    reader = MailboxReader(str(tmp_path), size)
    pieces = reader.partitions({"cursor": 6}, reader.latestOffset())
    assert [x for p in pieces for x in reader.read(p)] == [(7, x) for x in got] and reader.partitions({"cursor": 7}, {"cursor": 7}) == []
