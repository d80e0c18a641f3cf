"""Recurring sequences and departures from them against plain loops on invented projects."""

import os
import random
import re

import pytest

from weftline.operators import sequences

HISTORY = "project long, category string, stages array<string>"


def holds(steps, stages):
    rest = iter(stages)
    return all(any(s == t for t in rest) for s in steps)


def plain(rows, least=2):
    out = {}
    for category in {c for _, c, _ in rows if c is not None}:
        own = [(p, s) for p, c, s in rows if c == category]
        if len(own) < least:
            continue
        windows = {tuple(s[i : i + k]) for _, s in own for k in (3, 4, 5) for i in range(len(s) - k + 1)}
        who = {w: frozenset(p for p, s in own if holds(w, s)) for w in windows}
        who = {w: ps for w, ps in who.items() if len(ps) >= least}
        for w, ps in who.items():
            if len(w) == max(len(v) for v, qs in who.items() if qs == ps):
                out[category, w] = (len(ps), len(own))
    return out


def found(spark, rows, **kw):
    got = sequences.patterns(spark.createDataFrame(rows, HISTORY), **kw).collect()
    assert len({(r["category"], tuple(r["steps"])) for r in got}) == len(got)
    return {(r["category"], tuple(r["steps"])): (r["support"], r["total"]) for r in got}


def random_rows(seed):
    rng = random.Random(seed)
    kinds, rows = "abcdefgh"[: 4 + seed % 5], []
    for p in range(60):
        stages = rng.sample(kinds, rng.randint(0, len(kinds)))
        rows.append((p, rng.choice(["x", "y", None]), list("abcd") if p % 3 == 0 else stages))
    return rows + [(100, "alone", list("abc"))]


@pytest.mark.parametrize("seed,least", [(0, 2), (3, 2), (4, 3), (9, 5)])
def test_patterns_by_a_plain_loop(spark, seed, least):
    rows = random_rows(seed)
    assert found(spark, rows, least=least) == plain(rows, least)


def test_longest_of_the_same_projects_stays(spark):
    chain = list("abcde")
    assert found(spark, [(1, "x", chain), (2, "x", ["a", "q", *chain[1:]])]) == {("x", tuple(chain)): (2, 2)}
    assert found(spark, [(1, "x", chain), (2, "x", chain[::-1])]) == {}
    assert found(spark, [(1, "x", chain), (2, None, chain), (3, "y", chain)]) == {}
    assert found(spark, []) == {}


def test_stages_by_first_occurrence(spark):
    items = [(1, "b", 2.0), (1, "a", 1.0), (1, "b", 0.5), (1, "d", 1.0), (1, None, 0.0), (1, "e", None), (9, "a", 1.0), (None, "a", 1.0)]
    got = sequences.histories(spark.createDataFrame([(1, "x"), (2, None)], "project long, category string"), spark.createDataFrame(items, "project long, signal_type string, occurred_ts double"))
    assert sorted((r["project"], r["category"], r["stages"]) for r in got.collect()) == [(1, "x", ["b", "a", "d"]), (2, None, [])]


@pytest.mark.parametrize("seed", [1, 7])
def test_departures_by_a_plain_loop(spark, seed):
    rows = random_rows(seed)
    mined, expected = plain(rows), {}
    opened = [(p + 1000, c, s[::-1] if p % 2 else s) for p, c, s in random_rows(seed + 50)]
    for p, c, stages in opened:
        best = min(((-n, -len(w), w, t) for (k, w), (n, t) in mined.items() if k == c), default=None)
        steps = best[2] if best else ()
        k = next((k for k in range(len(steps)) if not holds(steps[: k + 1], stages)), None)
        if k is not None:
            expected[p] = (steps[k], steps[k - 1] if k else None, steps[k + 1] if k + 1 < len(steps) else None, -best[0], best[3])
    got = sequences.deviations(spark.createDataFrame(opened, HISTORY), sequences.patterns(spark.createDataFrame(rows, HISTORY))).collect()
    assert {r["project"]: (r["missing_step"], r["preceding_step"], r["following_step"], r["support"], r["total"]) for r in got} == expected and len(got) == len(expected) > 0


def test_tables_on_the_way_go(spark):
    before = set(os.listdir(re.sub("^file:", "", sequences_dir(spark))))
    found(spark, random_rows(2))
    left = set(os.listdir(re.sub("^file:", "", sequences_dir(spark)))) - before
    assert {n.split("-")[0] for n in left} == {"sequences"}


def sequences_dir(spark):
    from weftline.sources.tables import shared_dir

    return shared_dir(spark)
