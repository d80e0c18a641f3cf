"""The pairs that the classes stand for can all be read from the results."""

from collections import Counter, defaultdict

from weftline.operators import matches

LINKS = [(1, "A"), (2, "A"), (3, "A"), (2, "B"), (1, "B"), (4, "C"), (5, "A"), (6, "D"), (7, "D")]
ISSUES = [(1, 10, "active"), (2, 20, "done"), (3, 10, "active"), (4, 30, "active"), (5, None, "active"), (6, 40, "done"), (7, 50, "active")]


def tables(spark):
    return spark.createDataFrame(LINKS, "issue_id long, reference string"), spark.createDataFrame(ISSUES, "id long, project_id long, state string")


def pairs(keep):
    state = {i: (p, s) for i, p, s in ISSUES}
    return Counter((a, b) for a, r in LINKS for b, q in LINKS if r == q and a != b and keep(*state[a], *state[b]))


def joined(rows, keep):
    by = defaultdict(list)
    for r in rows:
        by[r["reference"]].append(r)
    return Counter((a["issue_id"], b["issue_id"]) for held in by.values() for a in held for b in held if a["issue_id"] != b["issue_id"] and keep(a, b))


def apart(a, b):
    return a is None or b is None or a != b


def test_collisions_of_open_issues(spark):
    rows = matches.open_reference_classes(*tables(spark)).collect()
    assert joined(rows, lambda a, b: apart(a["project_id"], b["project_id"])) == pairs(lambda p, s, q, t: apart(p, q) and "done" not in (s, t))


def test_collisions_in_any_state(spark):
    rows = matches.collision_classes(*tables(spark)).collect()
    expected = pairs(lambda p, s, q, t: apart(p, q))
    assert joined(rows, lambda a, b: apart(a["project_id"], b["project_id"])) == expected
    assert {r["issue_id"]: r["n_links"] for r in rows} == Counter(a for a, _ in expected)
    assert sum(r["n_by_reference"] for r in rows) == sum(expected.values())


def test_related_open_issues(spark):
    rows = matches.related_classes(*tables(spark)).collect()
    expected = pairs(lambda p, s, q, t: t != "done")
    assert joined(rows, lambda a, b: b["is_open"]) == expected
    assert {r["issue_id"]: r["n_open"] for r in rows if r["n_open"]} == Counter(a for a, _ in expected)


def test_fragments_tell_projects_and_shared_substrings(spark):
    titles = [(1, 10, "the annual renewal of licences"), (2, 20, "our annual renewal of support"), (3, 20, "an annual renewal of licences"), (4, 10, "something else altogether")]
    grams = {i: {t[k : k + 15] for k in range(len(t) - 14)} for i, _, t in titles}
    project = {i: p for i, p, _ in titles}
    expected = Counter({(i, p): n for i in project for p in set(project.values()) if (n := len(grams[i] & set().union(*(grams[j] for j in project if j != i and project[j] == p))))})
    rows, got = matches.subject_fragments(spark.createDataFrame(titles, "id long, project_id long, title string")).collect(), Counter()
    for a in rows:
        for p in {b["project_id"] for b in rows if b["value"] == a["value"] and b["id"] != a["id"]}:
            got[a["id"], p] += a["n_values"]
    assert got == expected and len(expected) > 2


def test_scopes_list_their_members(spark):
    """Issue 4 looks through supplier 7, which issues of a project have too: they are among its rows."""
    issues = spark.createDataFrame([(1, 10), (2, 10), (3, 20), (4, None), (5, None), (6, 30)], "id long, project_id long")
    suppliers = spark.createDataFrame([(1, 7), (2, 6), (3, 7), (3, 7), (4, 8), (5, 8), (4, 7), (6, 9)], "id long, supplier long")
    rows = matches.scope_members(issues, suppliers).collect()
    related = {(a["id"], b["id"]) for a in rows for b in rows if a["asks"] and (a["via"], a["scope"]) == (b["via"], b["scope"]) and a["id"] != b["id"]}
    assert related == {(1, 2), (2, 1), (3, 1), (3, 4), (4, 1), (4, 3), (4, 5), (5, 4)}
    assert [tuple(r) for r in rows if not r["asks"]] == [(1, "supplier", "7", 2, False)]
