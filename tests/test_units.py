"""Numeric examples of single operators, on invented rows."""

import random

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from weftline.functions import text as t
from weftline.operators import imperative, joins, windows
from weftline.plans.dialect import render
from weftline.plans.views import view
from weftline.sources import files


def value(spark, expression, **columns):
    df = spark.createDataFrame([tuple(columns.values())], list(columns))
    return df.select(F.expr(render(expression, True)).alias("v")).first()["v"]


@pytest.mark.parametrize("name,key", [("The Acme Corp.", "acme"), ("Acme (Holdings)", "acme"), ("ACME, Inc.", "acme")])
def test_entity_key(spark, name, key):
    assert value(spark, t.entity_key("x"), x=name) == key


def test_company_names_lose_one_suffix(spark):
    assert value(spark, t.normalize_company_name("x"), x="Acme Co., Inc.") == "acme co"


@pytest.mark.parametrize("subject", ["Re: FW: re: Budget", "fwd: Budget", "Budget"])
def test_subject_prefixes(spark, subject):
    assert value(spark, t.normalize_subject("x"), x=subject) == "budget"


def test_dollar_amounts(spark):
    assert value(spark, t.dollar_amounts("x"), x="from $1,500 to $2.5m, or $3k") == [1500.0, 2500000.0, 3000.0]


def test_value_urgency(spark):
    assert value(spark, t.value_urgency("x"), x=999.0) == 0 and abs(value(spark, t.value_urgency("x"), x=1e6) - 0.6) < 1e-9


def _sessions(spark, rows, gap="72"):
    from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

    schema = StructType([StructField("id", LongType()), StructField("thread_key", StringType()), StructField("occurred_ts", DoubleType()), StructField("pr_number_base", StringType())])
    df = spark.createDataFrame([(i, "t", h * 3600.0, r) for i, (h, r) in enumerate(rows)], schema)
    found = windows.SESSIONIZE(spark, {"gap_hours": gap} if gap else {}, raw_items=df)
    return [r["session"] for r in found.orderBy("id").collect()]


def test_sessions_split_on_a_long_gap_without_reference(spark):
    assert _sessions(spark, [(0, None), (80, None)]) == [0, 1]


def test_sessions_keep_a_reference_over_a_gap_and_split_on_another(spark):
    assert _sessions(spark, [(0, "R1"), (200, "R1"), (201, "R2"), (202, None)]) == [0, 0, 1, 1]


def test_greedy_budget_skips_and_goes_on(spark):
    df = spark.createDataFrame([("g", 9.0, 0.0, 1, 50), ("g", 8.0, 0.0, 2, 40), ("g", 7.0, 0.0, 3, 5), ("h", 1.0, 0.0, 4, 999)], "g string, score double, ts double, id long, cost int")
    got = imperative.greedy_budget(df, "g", "score", "ts", "id", "cost", 60).collect()
    assert sorted((r["g"], r["id"]) for r in got) == [("g", 1), ("g", 3), ("h", 4)]


def test_greedy_budget_equals_a_plain_pass(spark):
    rng = random.Random(3)
    items = [(g, float(rng.randrange(6)), float(rng.randrange(3)), g * 1000 + k, rng.choice([1, 1, 2, 3, 7, 9, 30, 31, 500])) for g in range(12) for k in range(90)]
    got = imperative.greedy_budget(spark.createDataFrame(items, "g long, score double, ts double, id long, cost int"), "g", "score", "ts", "id", "cost", 30).collect()
    expected = []
    for g in range(12):
        used, taken = 0, []
        for _, _, _, key, cost in sorted((x for x in items if x[0] == g), key=lambda x: (-x[1], -x[2], x[3])):
            if not taken or used + cost <= 30:
                used, taken = used + cost, [*taken, key]
        expected += [(g, place, key) for place, key in enumerate(taken)]
    assert sorted((r["g"], r["place"], r["id"]) for r in got) == expected


@pytest.mark.parametrize("block", [2, 7, 4096])
def test_clamped_fold_equals_a_plain_loop(spark, block):
    rng = random.Random(block)
    steps = [(g, at, rng.choice([10, 10, -15])) for g in "abc" for at in sorted(rng.sample(range(400), 150))]
    steps += [("one", 5, -15), ("ties", 1, 10), ("ties", 1, -15), ("ties", 1, 10)]
    got = imperative.clamped_fold(spark.createDataFrame(steps, "g string, at long, d int"), "g", "at", "d", 10, 90, 50, block)
    expected = {}
    for g, _, d in sorted(steps):
        v, n = expected.get(g, (50, 0))
        expected[g] = (min(90, v + d) if d > 0 else max(10, v + d), n + 1)
    assert {r["g"]: (r["value"], r["n"]) for r in got.collect()} == expected


def test_aliases_are_longer_names_that_begin_alike(spark):
    companies = spark.createDataFrame([(1, "Acme"), (2, "Acme Tools"), (3, "Acm"), (4, "Acme Tools Nord"), (5, "Other"), (6, "acme")], "id long, name string")
    got = joins.ALIASES(spark, companies=companies).collect()
    assert sorted((r["short_name"], r["long_name"]) for r in got) == [("acme", "acme tools"), ("acme", "acme tools nord"), ("acme tools", "acme tools nord")]


def test_merged_groups(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8), (8, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in imperative.merged_groups(edges, spark).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 9: 7}


def test_docx_round_trip():
    assert files.docx_text(files.plain_docx(["one", "two"])) == "one\ntwo"
    assert files.docx_text(b"broken") == ""


def test_workbooks_round_trip(spark):
    rows = [(1, "a <b> & c", 1.5), (2, None, 1e-7), (3, " spaced ", None), (None, "", 12345678.25), (2**60 + 1, "q", 0.0)]
    df = spark.createDataFrame(rows, "Issue long, Title string, Value double")
    made = files.workbooks(df.coalesce(1), most=3)
    assert [(r["Issue"], r["Title"] or None, r["Value"]) for r in files.read_workbooks(made, df.schema).collect()] == [(a, b or None, c) for a, b, c in rows]
    assert files.xlsx_text(files.workbook(["One", "Two"], [(7, "x")])) == "One Two 7 x"


def test_macros_nest_and_leave_literals_alone():
    assert render("SIZE(SET(x)) || 'SIZE(y)'", True) == "size(array_sort(collect_set(x))) || 'SIZE(y)'"


@pytest.mark.parametrize("name,key", [("Dansk Felt A/S", "dansk felt"), ("Dansk Felt a / s.", "dansk felt"), ("Ohm & Öhm GmbH", "ohm & öhm"), ("The Blue Co KG (EU)", "blue"), ("", ""), (None, "")])
def test_entity_key_of_other_forms(spark, name, key):
    df = spark.createDataFrame([(name,)], "x string")
    assert df.select(F.expr(render(t.entity_key("x"), True)).alias("v")).first()["v"] == key


@pytest.mark.parametrize("name,key", [("Moss, Inc", "moss"), ("moss,", "moss"), ("Moss GmbH", "moss gmbh"), ("Moss Company", "moss company"), ("Disco", "disco"), ("Reed & Reed", "reed & reed"), ("Moss L.L.C.", "moss")])
def test_company_names(spark, name, key):
    assert value(spark, t.normalize_company_name("x"), x=name) == key


def test_sessions_by_default_keep_a_gap_of_thirty_hours(spark):
    assert _sessions(spark, [(0, None), (30, None), (60, None)], None) == [0, 0, 0]


def test_a_promoted_signal_that_names_the_owner_is_actionable(spark):
    rules = [("handed_on", "desk.example", "handed on to", "fyi")]
    expression = t.signal_treatment("subject", "sender", "owner", ("handed_on",), rules)
    assert value(spark, expression, subject="Handed on to Kim", sender="a@desk.example", owner="kim") == "actionable"
    assert value(spark, expression, subject="Handed on to Lee", sender="a@x.desk.example", owner="kim") == "fyi"
    assert value(spark, expression, subject="Handed on to Kim", sender="a@other.example", owner="kim") is None


@pytest.mark.parametrize("scores,verdict,passes", [
    ([0.5, 0.6], "surface_conflict", None), ([0.5, 0.5], "spend", None), ([0.5, 0.5, 0.5], "spinning", None), ([0.8, 0.4], "spend", 2), ([0.4], "no_history", None), ([0.2, 0.1], "spend", None),
])
def test_forecast(spark, scores, verdict, passes):
    df = spark.createDataFrame([(1, k, s, float(k)) for k, s in enumerate(scores, 1)], "id long, seq int, score double, ts double")
    r = windows.FORECAST(spark, scores=df).first()
    assert (r["verdict"], r["passes"]) == (verdict, passes)


def test_issues_with_a_shared_reference_are_one_group(spark):
    links = view(spark, SMALL, "links").collect()
    root = {r["issue_id"]: r["issue_id"] for r in links}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    first = {}
    for r in links:
        a, b = find(r["issue_id"]), find(first.setdefault(r["reference"], r["issue_id"]))
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in imperative.merge_issues(spark, SMALL).collect()}
    expected = {i: find(i) for i in root}
    alone = {i for i in root if sum(find(j) == find(i) for j in root) == 1}
    assert got == {i: r for i, r in expected.items() if i not in alone}


def test_the_link_cascade_takes_the_first_rule_that_fits(spark):
    def item(key, thread, kind="ACTIONABLE-ASK", reference=None, subject="x", actor="q@far.example", source="outlook_mail", body=""):
        return (key, thread, reference, kind, subject, actor, source, body)

    fyi, chat = "FYI-EVIDENCE", "teams_chat"
    items = [
        item(1, "t0"), item(2, "t1", "NOISE", "R1"), item(3, "t1", reference="R1"), item(4, "t1", fyi), item(5, "t2", reference="R2"), item(6, "t2", fyi),
        item(7, "t3", fyi, subject="RE: Weekly sync", actor="a@mail.x.example"), item(8, "t3", fyi), item(9, "t4", fyi, subject="Weekly sync"),
        item(10, "t5", actor="zoe@home.example", source=chat), item(11, "t6", source=chat), item(12, "t7", body="signed copy by Friday? About $10k."), item(13, "t8", body="signed copy by Friday? About $11k."),
        item(14, None, reference="R1"),
    ]
    got = joins.CASCADE(
        spark, raw_items=spark.createDataFrame(items, "id long, thread_key string, pr_number_base string, item_class string, subject string, from_actor string, source string, body_preview string"),
        issues=spark.createDataFrame([(10, 1, "active"), (11, 1, "done"), (12, 2, "waiting")], "id long, project_id long, state string"), links=spark.createDataFrame([(10, "R1"), (11, "R2")], "issue_id long, reference string"),
        containers=spark.createDataFrame([("t0", 11)], "thread_key string, issue_id long"), issue_evidence=spark.createDataFrame([(12, "Weekly sync", "mail.x.example")], "issue_id long, subject string, domain string"),
        parties=spark.createDataFrame([(2, "zoe@home.example")], "id long, primary_email string"),
    ).collect()
    assert {r["id"]: (r["rule"], r["issue_id"]) for r in got} == {
        1: ("container", 11), 2: ("noise", None), 3: ("reference", 10), 4: ("container", 10), 5: ("new", -5), 6: ("container", -5), 7: ("subject", 12), 8: ("fyi_standalone", None),
        9: ("fyi_standalone", None), 10: ("sender", 12), 11: ("chat_standalone", None), 12: ("tag", 10), 13: ("new", -13), 14: ("reference", 10),
    }


@pytest.mark.parametrize("body,actor,target", [("please ask ab about it", None, "builder"), ("for cb and @ab", None, "builder"), ("for cb and @ab", "builder", "curator"), ("about cabs", None, None)])
def test_the_member_a_text_addresses(spark, body, actor, target):
    df = spark.createDataFrame([(body, actor)], "body string, actor string")
    assert df.select(F.expr(render(t.target_member("body", "actor", {"ab": "builder", "cb": "curator"}), True)).alias("v")).first()["v"] == target


def test_a_snippet_reaches_eighty_characters_around_the_match(spark):
    text = "a" * 100 + " we are\nblocked on you " + "b" * 100
    patterns = next(p for kind, _, p in t.INTENTS if kind == "blocked_on")
    snippet = value(spark, t.intent_around("body", patterns, "manager", {"ab": "builder"}), body=text)
    start, end = text.index("blocked on") - 80, text.index("blocked on") + len("blocked on") + 80
    assert snippet == "…" + text[start:end].replace("\n", " ").strip() + "…"
    assert value(spark, t.intent_around("body", patterns, "manager", {"ab": "builder"}), body="all is well") is None


def test_a_workbook_is_read_and_written_by_the_row():
    import tracemalloc

    rows = ([k, f"title {k}", "active", k / 7, "user"] for k in range(20_000))
    content = files.workbook(["A", "B", "C", "D", "E"], rows)
    tracemalloc.start()
    n = sum(1 for line in files.sheet_rows(content) if line["C"] == "active")
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 20_000 and most < 5e6


def test_merging_moves_less_each_round_on_long_paths(spark, monkeypatch, tmp_path):
    import random

    nodes = list(range(1500))
    random.Random(3).shuffle(nodes)
    edges = [*zip(nodes[:1000], nodes[1:1000]), *zip(nodes[1001:], nodes[1000:]), (5000, 5000)]
    monkeypatch.setattr(imperative, "work_dir", lambda spark: f"file://{tmp_path}/merge")
    got = {r["node"]: r["root"] for r in imperative.merged_groups(spark.createDataFrame(edges, "a long, b long"), spark).collect()}
    assert got == dict.fromkeys(nodes[:1000], min(nodes[:1000])) | dict.fromkeys(nodes[1000:], min(nodes[1000:])) | {5000: 5000}
    made = sum(spark.read.parquet(str(f)).count() for f in (tmp_path / "merge").iterdir())
    assert made < 8 * len(edges)


def test_severities_are_dealt_to_tasks_by_rows(spark, tmp_path):
    texts = spark.range(0, 100_000, 1, 1).selectExpr("id", "'abc' as subject", "'abd' as body_preview")
    assert imperative.spread(texts).rdd.getNumPartitions() == 4 and imperative.spread(texts.limit(3)).rdd.getNumPartitions() == 1
    got = texts.limit(3).select(imperative.rewrite_severity("subject", "body_preview").alias("s")).collect()
    assert [r["s"] for r in got] == [0.3333] * 3


def test_dealt_inputs_have_parts_of_a_size_and_the_same_rows(spark, monkeypatch):
    import __spark_entry__ as entry

    from tests.conftest import SMALL
    from weftline.plans import registry

    names = ["d09_self_audit", "j22_orphans", "d04_extraction_correction", "d08_alerts", "a34_context_accuracy", "a32_measure_project", "w05_forecast"]
    whole = {n: sorted(map(str, entry.queries()[n](spark, SMALL).collect())) for n in names}
    monkeypatch.setattr(registry, "DEALT_ROWS", 300)
    for n in names:
        df = entry.queries()[n](spark, SMALL)
        assert "REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString(), n
        assert sorted(map(str, df.collect())) == whole[n], n
    claims = registry.frames(spark, SMALL, ["claims"], {"claims": ("issue_id",)})["claims"]
    assert claims.rdd.getNumPartitions() == max(4, -(-claims.count() // 300))
