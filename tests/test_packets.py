"""Identity packets and the daily focus on invented rows."""

import random

import pytest

from weftline.operators import packets, windows

ITEM, FILE = "issue_id long, id long, ts double, subject string, body string", "issue_id long, id long, filename string, text string"


def plain(items, files, budget, attached):
    out = {}
    for issue in {r[0] for r in items} | {r[0] for r in files if r[3]}:
        own = [f"Subject: {r[3] or ''}\n{r[4] or ''}" for r in sorted((r for r in items if r[0] == issue), key=lambda r: (r[2], r[1]))]
        block = packets.SEPARATOR.join(f"Attachment ({r[2] or 'unnamed'}):\n{r[3]}" for r in sorted((r for r in files if r[0] == issue and r[3]), key=lambda r: r[1]))[:attached]
        whole = packets.SEPARATOR.join(own + ([block] if block else []))
        if len(whole) <= budget:
            out[issue] = (whole, len(own), True)
            continue
        left, recent = budget - len(block) - len(own[0] if own else ""), []
        for part in reversed(own[1:]):
            if sum(len(p) + len(packets.SEPARATOR) for p in [*recent, part]) > left:
                break
            recent.append(part)
        out[issue] = (packets.SEPARATOR.join(own[:1] + ([block] if block else []) + recent[::-1]), len(recent) + len(own[:1]), False)
    return out


@pytest.mark.parametrize("seed,budget,attached", [(0, 200, 60), (1, 500, 100), (2, 90, 20), (3, 12_000, 2_000)])
def test_packets_equal_a_plain_fill(spark, seed, budget, attached):
    rng = random.Random(seed)
    items = [(rng.randrange(40), i, float(rng.randrange(30)), rng.choice([None, "", "offer"]), rng.choice([None, "", "é" * rng.randrange(60), "x" * rng.randrange(400)])) for i in range(400)]
    items += [(99, 1000 + i, float(i), "", "") for i in range(900)]  # very many very short ones
    files = [(rng.randrange(45), i, rng.choice([None, "", "a.pdf"]), rng.choice([None, "", "scan " * rng.randrange(1, 20)])) for i in range(60)]
    got = packets.identity_packets(spark.createDataFrame(items, ITEM).repartition(3), spark.createDataFrame(files, FILE), budget, attached).collect()
    assert {r["issue_id"]: (r["packet"], r["n_items"], r["whole"]) for r in got} == plain(items, files, budget, attached)


def test_the_focus_has_every_deliverable_and_few_actions(spark):
    day, now = 86400.0, 1000 * 86400.0
    issues = [(k, "active" if k % 7 else "done", now + (k - 10) * day, 1) for k in range(1, 31)]
    claims = [(k, k, "ask", "open", "kim", "a@x.example", now - k * day, now - k * day, 1000.0 * k, None, False) for k in range(1, 31)]
    items = [(k, 1 + k % 3, "calendar", now + k * 3600.0) for k in range(-3, 30)]
    got = windows.FOCUS(
        spark, {"now": f"{now}e0", "now_events": f"{now + 604800}e0", "owner": "'kim'"},
        issues=spark.createDataFrame(issues, "id long, state string, due double, project_id long"), raw_items=spark.createDataFrame(items, "id long, issue_id long, source string, occurred_ts double"),
        claims=spark.createDataFrame(claims, "id long, issue_id long, claim_type string, status string, owner string, author string, first_seen_ts double, last_seen_ts double, amount double, date_kind string, escalated boolean"),
    ).collect()
    by = {k: {(r["issue_id"], r["item_id"]): r["measure"] for r in got if r["kind"] == k} for k in ("action", "meeting", "deliverable")}
    assert by["deliverable"] == {(k, k): float(k - 10) for k in range(1, 18) if k % 7}
    assert by["meeting"] == {(2, 1): 1.0, (3, 2): 2.0, (1, 3): 3.0}
    assert len(by["action"]) == 8 and not any(issue % 7 == 0 for issue, _ in by["action"])
