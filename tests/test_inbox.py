"""The inbox: shapes of drops, what is refused, files that come later, batches that run again."""

import json
import os

from weftline.sources import files
from weftline.streaming.incremental import Inbox

MESSAGE = {"id": "1", "messageType": "message", "bodyPreview": "<p>hello</p>"}


def drops():
    other = [{"messageId": "2", "messageType": "message", "body": {"content": "in <b>parts</b>"}}, {"id": "3", "messageType": "message", "body": "plain"}, {"id": "4", "messageType": "joined"}, {"messageType": "message"}, "no object"]
    return [
        {"source": "teams_chat", "messages_raw": [MESSAGE]}, {"source": "teams_chat", "messages_raw": {"value": [], "messages": other}}, {"source": "teams_chat", "messages_raw": {"value": [MESSAGE | {"id": "5"}]}},
        {"source": "calendar", "events": [{"id": "e", "recurrence": "weekly", "start": "2024-01-02", "subject": "standup"}, {"id": "f", "subject": None}]}, {"source": "sharepoint", "results": [{"driveId": "d", "id": "x", "name": "n"}]},
        {"source": "calendar", "events": []}, {"source": "teams_chat"},
    ]


REFUSED = [
    ("{broken", "corrupt"), ('{"source": "mail"}', "unknown source"), ("[1]", "unknown source"), ('{"source": "teams_chat", "messages_raw": {"count": 21, "note": "fetched"}}', "claims content but empty"),
    ('{"source": "teams_chat", "messages_raw": "21 messages fetched"}', "claims content but empty"), ('{"source": "calendar", "events_catchup_count": 25}', "claims content but empty"),
]
EXPECTED = {("teams_chat", "1", "hello"), ("teams_chat", "2", "in parts"), ("teams_chat", "3", "plain"), ("teams_chat", "5", "hello"), ("calendar", "e:2024-01-02", "standup"), ("calendar", "f", None), ("sharepoint", "d:x", "n")}


def test_every_shape_of_a_drop(spark):
    lines = spark.createDataFrame([(json.dumps(d),) for d in drops()] + [(line,) for line, _ in REFUSED], "value string")
    parsed = files.parsed(lines)
    assert {tuple(r) for r in files.flatten_drops(parsed).collect()} == EXPECTED
    found = {r["value"]: r["reason"] for r in parsed.select("value", files.refusal().alias("reason")).collect()}
    assert {v: r for v, r in found.items() if r} == dict(REFUSED)


def test_files_are_taken_once_and_put_away(spark, tmp_path):
    box, home = tmp_path / "in", tmp_path / "home"
    box.mkdir()

    def put(name, lines):
        (box / f".{name}").write_text("\n".join(lines))
        os.rename(box / f".{name}", box / name)

    inbox = Inbox(spark, str(box), str(home))
    put("a.json", [json.dumps(d) for d in drops()[:3]])
    put("b.json", ["{broken", json.dumps(drops()[3])])
    inbox.run(1)
    first = {tuple(r) for r in inbox.table("items").select("source", "stable_key", "subject").collect()}
    assert first == {r for r in EXPECTED if r[0] != "sharepoint"} and inbox.table("failed").count() == 1
    assert [tuple(r) for r in inbox.table("failed").collect()] == [("b.json", "corrupt", "{broken")]
    assert [r["source_ref"] for r in inbox.table("alerts").collect()] == ["b.json"]
    inbox.run(1)  # nothing new
    assert inbox.table("items").count() == len(first) and inbox.table("alerts").count() == 1
    put("c.json", [json.dumps(drops()[0]), json.dumps(drops()[4])])  # an item that is known, and a new one
    put("d.json", [json.dumps(drops()[5])])
    inbox.run(1)
    inbox.run(1)
    rows = [tuple(r) for r in inbox.table("items").select("source", "stable_key", "subject").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == EXPECTED
    archived = {f for _, _, names in os.walk(home / "archive") for f in names}
    assert {"a.json", "b.json"} <= archived and not {"a.json", "b.json"} & set(os.listdir(box))
    # a batch that runs again gives the same
    lines = spark.createDataFrame([(json.dumps(drops()[0]), "c.json")], "value string, file string")
    before = inbox.table("items").count()
    inbox._take(lines, 99)
    inbox._take(lines, 99)
    assert inbox.table("items").count() == before
