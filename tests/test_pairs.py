"""Classes with counts, mentions and fragments against plain loops over all pairs."""

import random
from collections import defaultdict
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from weftline.operators import matches, mentions, pairing

MEMBER = "id long, grp long, counts boolean, role int, point string, value string"


def fits(a, b):
    return bool((a & 1 and b & 2) or (a & 2 and b & 1))


def partner(a, b, items, barred):
    return a != b and items[b][1] and (items[a][0] is None or items[a][0] != items[b][0]) and (a, b) not in barred and (b, a) not in barred


def world(seed, n=90):
    """items id -> (group, counts, cents), values (id, point, value) -> role, vetoes."""
    rng = random.Random(seed)
    items = {i: (rng.choice([None, *range(25)]), rng.random() < 0.8, rng.choice([None, 0, rng.randrange(1, 300), rng.randrange(9_900, 10_200), rng.randrange(1, 10**8)])) for i in range(n)}
    values = {}
    for i in items:
        for _ in range(rng.randrange(7)):
            values[i, rng.choice("pqr"), rng.choice(["hot", "b", "c", f"rare{rng.randrange(40)}"])] = 3
        if rng.random() < 0.5:
            values[i, "s", rng.choice(["x", "y"])] = rng.choice([1, 2, 3])
    vetoes = {(rng.randrange(n), rng.randrange(n)) for _ in range(150)}
    return items, values, vetoes


def frames(spark, items, values, vetoes):
    v = spark.createDataFrame([(*k, r) for k, r in values.items()], "id long, point string, value string, role int")
    i = spark.createDataFrame([(k, *x) for k, x in items.items()], "id long, grp long, counts boolean, x long")
    return v.repartition(3), i, spark.createDataFrame(sorted(vetoes) or [(None, None)], "id_a long, id_b long")


def near(a, b, items):
    x, y = items[a][2], items[b][2]
    return bool(x and y) and abs(x - y) * 100 <= max(x, y)


@pytest.mark.parametrize("seed", range(4))
def test_matched_points_are_all_pairs_counted(spark, seed):
    items, values, vetoes = world(seed)
    expected = {}
    for (i, p, v), r in values.items():
        n = sum((q, w) == (p, v) and fits(r, s) and partner(i, j, items, vetoes) for (j, q, w), s in values.items())
        if n:
            expected[i, p, v] = (min(j for j, q, w in values if (q, w) == (p, v)), n)
    for i in items:
        n = sum(near(i, j, items) and partner(i, j, items, vetoes) for j in items)
        if n:
            expected[i, "amount", None] = (None, n)
    got = {(r["id"], r["point"], r["value"]): (r["class_id"], r["n_links"]) for r in pairing.matched(*frames(spark, items, values, vetoes)).collect()}
    assert got == expected


@pytest.mark.parametrize("seed", range(3))
def test_candidates_share_two_points(spark, seed):
    """The classes hold just the pairs that share two points, and each class's counts are right."""
    items, values, vetoes = world(seed)
    points = defaultdict(lambda: defaultdict(set))  # pair -> point -> values
    for (i, p, v), r in values.items():
        for (j, q, w), s in values.items():
            if (p, v) == (q, w) and fits(r, s) and partner(i, j, items, vetoes):
                points[i, j][p].add(v)
    expected = defaultdict(int)
    for (i, j), found in points.items():
        for p in found:
            for q in found:
                if p < q:
                    for v in found[p]:
                        for w in found[q]:
                            expected[i, f"{p} + {q}", f"{v} + {w}"] += 1
            if near(i, j, items):
                for v in found[p]:
                    expected[i, " + ".join(sorted([p, "amount"])), v] += 1
    got = {(r["id"], r["point"], r["value"]): r["n_links"] for r in pairing.candidates(*frames(spark, items, values, vetoes)).collect()}
    assert got == dict(expected)


@pytest.mark.parametrize("widest", [0, 2, 8])
def test_links_are_counted_once(spark, widest):
    items, values, _ = world(7)
    held = defaultdict(set)
    for i, p, v in values:
        held[i].add(p + v)
    rows = [(i, items[i][0], items[i][1], 3, "p", v) for i in held for v in held[i]]
    got = {r["id"]: r["n_links"] for r in pairing.linked(spark.createDataFrame(rows, MEMBER), widest).collect()}
    expected = {i: sum(bool(held[i] & held[j]) and partner(i, j, items, ()) for j in held) for i in held}
    assert got == {i: n for i, n in expected.items() if n}


def test_a_value_that_all_hold_costs_a_row_each(spark):
    """Rows of every step of the plan stay near the table's, with one value shared by all."""
    rows = spark.range(40_000).select("id", (F.col("id") % 3).alias("grp"), F.lit(True).alias("counts"), F.lit(3).alias("role"), F.lit("p").alias("point"), F.lit("same").alias("value"))
    out = pairing.classes(rows, ["point", "value"])
    assert out.groupBy().agg(F.count("*"), F.sum("n_links")).first() == (40_000, sum(40_000 - (40_000 - k + 2) // 3 for k in (k % 3 for k in range(40_000))))
    links, issues = rows.select(F.col("id").alias("issue_id"), F.col("value").alias("reference")), rows.select("id", F.col("grp").alias("project_id"), F.lit("active").alias("state"))
    assert matches.collisions_by_issue(links, issues).count() == 40_000
    priced = rows.withColumn("x", F.lit(500).cast("long"))
    assert pairing.near(priced, ["point"]).agg(F.min("n_links"), F.max("n_links")).first() == (26_666, 26_667)


def test_collisions_of_the_issue_on_show(spark):
    links = spark.createDataFrame([(1, "A"), (2, "A"), (3, "A"), (2, "B"), (1, "B"), (4, "C"), (5, "A")], "issue_id long, reference string")
    issues = spark.createDataFrame([(1, 10, "active"), (2, 20, "done"), (3, 10, "active"), (4, 30, "active"), (5, None, "active")], "id long, project_id long, state string")
    wanted = spark.createDataFrame([(1,), (4,)], "issue_id long")
    assert sorted(map(tuple, matches.collisions_of(wanted, links, issues).collect())) == [(1, 2, "A,B"), (1, 5, "A")]
    assert sorted(map(tuple, matches.collisions_by_issue(links, issues).collect())) == [(1, 2), (2, 3), (3, 2), (5, 3)]
    assert sorted(map(tuple, matches.related_open(links, issues).collect())) == [(1, 2), (2, 3), (3, 2), (5, 2)]
    assert sorted(map(tuple, matches.reference_collisions(links, issues).collect())) == [("A", 1, 1, 3, 1), ("A", 3, 1, 3, 1), ("A", 5, 1, 3, 2)]


# mentions


def plain_mentions(texts, names, keywords=mentions.RELATIONSHIP_WORDS, window=mentions.WINDOW):
    out = set()
    for i, text in texts:
        low = (text or "").lower()
        for name in {n.lower() for n in names if n and len(n) >= 3}:
            at = low.find(name)
            while at >= 0:
                around = low[max(0, at - window) : at + len(name) + window]
                k = next((k for k in keywords if k in around), None)
                if k:
                    out.add((i, name, k, at))
                    break
                at = low.find(name, at + 1)
    return out


def test_mentions_equal_a_look_at_every_place(spark):
    rng = random.Random(11)
    names = ["abc", "abc def", "def", "the abc def", "the", "x y z", "bcd", "aaa", "a  b", "ab", "", None, "flow", "Prime Moss", "moss & sons, gmbh", "日本 é", "contract xyz"]
    pieces = ["abc", "def", "the", "x", "y", "z", "aaaa", "a", "", "b", "prime", "moss", "moss & sons, gmbh!", "日本", "é", "xyz", "q\nabc", "-def", *mentions.RELATIONSHIP_WORDS, "filler" * 9, "w" * 130]
    texts = [(i, " ".join(rng.choice(pieces) for _ in range(rng.randrange(0, 60)))) for i in range(250)]
    texts += [(900, None), (901, ""), (902, "SubContract with ABC"), (903, "abc" + "z" * 197 + " subcontract"), (904, "abc" + " " * 189 + "subcontract"), (905, "abc" + " " * 190 + "subcontract"), (906, "w" * 5000 + "abc flowdown " + "w" * 5000)]
    got = mentions.find(spark.createDataFrame(texts, "id long, text string").repartition(4), spark.createDataFrame([(n,) for n in names], "name string"))
    assert {tuple(r) for r in got.collect()} == plain_mentions(texts, names)


def test_places_of_a_frequent_word_are_dealt_to_tasks_where_names_are_many(spark, monkeypatch):
    names = spark.createDataFrame([("abc",), ("abc def",)], "name string")
    texts = spark.createDataFrame([(i, "abc subcontract " + "filler " * 5 + "abc def") for i in range(200)], "id long, text string")
    few = sorted(map(tuple, mentions.find(texts, names).collect()))
    asked = []
    monkeypatch.setattr(mentions, "is_small", lambda df: asked.append(df.count()))
    assert sorted(map(tuple, mentions.find(texts, names).collect())) == few and len(few) == 400
    assert asked == [2]  # words that can't be a name's aren't among those that are joined


def test_mentions_of_no_names(spark):
    texts = spark.createDataFrame([(1, "abc subcontract")], "id long, text string")
    assert mentions.find(texts, spark.createDataFrame([], "name string")).count() == 0
    assert mentions.find(texts.where("false"), spark.createDataFrame([("abc",)], "name string")).count() == 0


# fragments


def test_fragments_equal_the_longest_common_substring(spark):
    """2,000 titles: an issue and a project share a class just where a title of the project shares 15 characters with the issue's."""
    rng = random.Random(3)
    words = ["renewal", "statement of work", "migration", "support", "annual", "licence", "phase", "network", "of", "the", "review"]
    titles = [(i, rng.randrange(600), f"{rng.choice(words)} {rng.choice(words)} {rng.randrange(99)} {rng.choice(words)}" + (" for the northern offices" if rng.random() < 0.3 else "")) for i in range(2000)]
    df = spark.createDataFrame(titles, "id long, project_id long, title string")
    found = matches.subject_fragments(df)
    rows = found.collect()
    of_project, of_id = defaultdict(set), defaultdict(set)
    for i, p, title in titles:
        for v in {title[k : k + 15] for k in range(len(title) - 14)}:
            of_project[v].add(p)
            of_id[v].add(i)
    project = {i: p for i, p, _ in titles}
    title = {i: x for i, _, x in titles}
    pairs = defaultdict(set)
    for r in rows:
        others = {project[j] for j in of_id[r["value"]] if j != r["id"]}
        assert (r["class_id"], r["n_projects"]) == (min(of_project[r["value"]]), len(others))
        pairs[r["id"]] |= others
    for i in rng.sample(range(2000), 60):
        expected = {project[j] for j in range(2000) if j != i and SequenceMatcher(None, title[i], title[j], autojunk=False).find_longest_match().size >= 15}
        assert pairs[i] == expected


def test_scopes(spark):
    issues = spark.createDataFrame([(1, 10), (2, 10), (3, 20), (4, None), (5, None), (6, 30)], "id long, project_id long")
    suppliers = spark.createDataFrame([(1, 7), (3, 7), (3, 7), (4, 8), (5, 8), (4, 7), (6, 9)], "id long, supplier long")
    got = sorted(map(tuple, matches.issues_to_check(issues, suppliers).collect()))
    assert got == [(1, "project", "10", 1), (2, "project", "10", 1), (3, "supplier", "7", 2), (4, "supplier", "7", 2), (4, "supplier", "8", 1), (5, "supplier", "8", 1), (6, "itself", "6", 0)]
