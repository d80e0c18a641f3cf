"""Claims of extraction results of odd shapes, against a plain loop."""

import json
import random

import pytest

from weftline.operators.claimspecs import claim_specs

OTHER = {"manager": "counterparty", "counterparty": "manager"}


def plain(key, author, value):
    try:
        blob = json.loads(value)
    except (TypeError, ValueError):
        return set()
    if not isinstance(blob, dict):
        return set()
    author, out = author if author in OTHER else "unknown", set()
    for field, kind, owner in (("asks", "ask", OTHER.get(author, "unknown")), ("decisions", "decision", None), ("commitments", "commitment", author)):
        found = blob.get(field)
        out |= {(key, kind, at, x.strip(), owner, None) for at, x in enumerate(found if isinstance(found, list) else []) if isinstance(x, str) and x.strip()}
    found = blob.get("dates_mentioned")
    for at, x in enumerate(found if isinstance(found, list) else []):
        if isinstance(x, dict) and isinstance(x.get("text"), str) and x["text"].strip():
            kind, whose = x.get("kind"), x.get("whose")
            out.add((key, "date", at, x["text"].strip(), whose if whose in [*OTHER] else "unknown", kind if kind in ("hard", "soft") else None))
    return out


def odd(rng, deep=2):
    kinds = ["", " \n", " send it ", "true", "[]", 0, 1.5, None, True, "é x", "a" * 20_000]
    if deep and rng.random() < 0.5:
        return [odd(rng, deep - 1) for _ in range(rng.randint(0, 4))] if rng.random() < 0.6 else {k: odd(rng, deep - 1) for k in rng.sample(["text", "kind", "whose", "x"], rng.randint(0, 4))}
    return rng.choice(kinds)


@pytest.mark.parametrize("seed", [0, 1])
def test_claims_by_a_plain_loop(spark, seed):
    rng, rows = random.Random(seed), []
    for k in range(150):
        blob = {f: odd(rng) for f in rng.sample(["asks", "decisions", "commitments", "dates_mentioned", "key_facts"], rng.randint(0, 5))}
        if k % 2:
            blob["dates_mentioned"] = [{"text": f" by {k} ", "kind": rng.choice(["hard", "soft", "other", 3]), "whose": rng.choice(["manager", "counterparty", "shared", None])}, odd(rng)]
        rows.append((k, rng.choice(["manager", "counterparty", "x", None]), None, json.dumps(blob)))
    rows += [(200 + i, "manager", None, v) for i, v in enumerate([None, "", "{", "[]", '["asks"]', '"asks"', "7", "null", '{"asks": {"asks": ["x"]}}'])]
    got = claim_specs(spark.createDataFrame(rows, "id long, author string, reference_base string, value string")).collect()
    expected = set().union(*(plain(k, a, v) for k, a, _, v in rows))
    assert {(r["id"], r["claim_type"], r["place"], r["text"], r["owner"], r["date_kind"]) for r in got} == expected and len(got) == len(expected) > 75


def test_keys(spark):
    rows = [(1, "manager", "R1", '{"asks": ["Please approve it", "Nothing else"], "decisions": ["Approve it"]}'), (2, "manager", "", '{"asks": ["Hm.", "The second quarter!"]}')]
    got = claim_specs(spark.createDataFrame(rows, "id long, author string, reference_base string, value string")).collect()
    assert {(r["id"], r["claim_type"], r["place"]): r["canonical_key"] for r in got} == {
        (1, "ask", 0): "ask|approve|R1|counterparty", (1, "ask", 1): "ask|generic|R1|counterparty", (1, "decision", 0): "decision|approve|R1|unknown", (2, "ask", 0): None, (2, "ask", 1): "ask|text:the second quarter",
    }
