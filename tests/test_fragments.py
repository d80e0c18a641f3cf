"""Shared substrings against plain loops, with frequent parts counted either way."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_pairs_disk import exchanges

from weftline.operators import fragments, matches


def titles(seed):
    rng = random.Random(seed)
    words = ["renewal", "statement of work", "Größe 日本語", "𝔘nicode 😀", "licence", "phase", "of the", "aaaaaaaaaaaaaaaaaaaaaaaa", "review"]
    out = [(i, None if i % 11 == 0 else rng.randrange(40), " ".join(rng.choice(words) for _ in range(rng.randrange(5))) + f" {rng.randrange(30)}") for i in range(250)]
    return out + [(i, g, title + " once more, the same id") for i, g, title in out[:20]] + [(900, 3, None), (901, 3, ""), (902, 3, "only fourteen!")]


def plain(given, apart, projects):
    holders, grp = defaultdict(set), {}
    for i, g, title in given:
        grp[i] = g
        for p in range(len(title or "") - 14):
            holders[title[p : p + 15]].add(i)
    same, out = defaultdict(list), {}
    for v, ids in holders.items():
        if len(ids) > 1 and (not apart or len({grp[i] for i in ids}) > 1 or None in {grp[i] for i in ids}):
            same[frozenset(ids)].append(v)
    for ids, values in same.items():
        for i in ids:
            low = min((grp[j] for j in ids if grp[j] is not None), default=None)
            others = {grp[j] for j in ids if j != i and grp[j] is not None}
            out[i, min(values)] = (grp[i], len(values), *((low, len(others)) if projects else ()))
    return out


@pytest.mark.parametrize("hot", [0, 40, 100_000])
@pytest.mark.parametrize("apart,projects", [(False, False), (True, False), (False, True)])
def test_substrings_with_the_same_holders(spark, monkeypatch, hot, apart, projects):
    monkeypatch.setattr(fragments, "HOT", hot)
    given = titles(hot)
    rows = fragments.shared(spark.createDataFrame(given, "id long, grp long, title string").repartition(3), apart, projects).collect()
    names = ["grp", "n_values", *(["class_id", "n_projects"] if projects else [])]
    expected = plain(given, apart, projects)
    assert len(rows) == len(expected) > 100
    assert {(r["id"], r["value"]): tuple(r[n] for n in names) for r in rows} == expected


@pytest.mark.parametrize("size", [1, 20_000])
def test_parts_go_over_batches(monkeypatch, size):
    monkeypatch.setattr(fragments, "ROWS", size)
    pa = fragments.pa
    given = [t for t in titles(1) if len(t[2] or "") >= 15]
    batch = pa.RecordBatch.from_pylist([{"id": i, "grp": g, "title": t} for i, g, t in given], pa.schema([("id", pa.int64()), ("grp", pa.int64()), ("title", pa.string())]))
    runs = pa.Table.from_batches(fragments._cut(np.zeros(fragments.BUCKETS, np.uint64))(iter([batch])))
    runs = runs.sort_by("code").to_batches(max_chunksize=7)
    rows = [r for b in fragments._meet(False, False)(iter(runs)) for r in b.to_pylist()]
    got = {(r["id"], r["text"][p : p + 15]) for r in rows for p in r["at"]}
    held = defaultdict(set)
    for i, _, title in given:
        for p in range(len(title) - 14):
            held[title[p : p + 15]].add(i)
    assert got == {(i, v) for v, ids in held.items() for i in ids if len(ids) > 1}


def test_hashes_are_the_engine_s(spark):
    ids = [0, 1, -1, 7, 2**62, -(2**63), 123_456_789_012]
    expected = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "id long").select(F.xxhash64("id")).collect()]
    assert fragments._xxhash64(np.array(ids)).view(np.int64).tolist() == expected


def test_titles_move_in_runs(spark):
    """Runs to their parts' tasks, what they share to the ids; nothing is joined. 14 of 15 substrings don't move by themselves."""
    df = spark.createDataFrame([(i, i % 9, f"annual statement number {i % 50} for the offices") for i in range(500)], "id long, project_id long, title string")
    found = matches.subject_fragments(df)
    assert exchanges(found) == 2 and found.count() > 500
    cut = df.select("id", F.col("project_id").alias("grp"), "title").mapInArrow(fragments._cut(np.zeros(fragments.BUCKETS, np.uint64)), fragments._CUT)
    assert cut.count() < 500 * 15


@pytest.mark.parametrize("few", [0, 10_000])
def test_few_titles_of_many_ids(spark, monkeypatch, few):
    monkeypatch.setattr(fragments, "FEW", few)
    given = [(i, None, None if i % 13 == 0 else f"supply of {['small', 'polished', 'heavy duty'][i % 3]} fittings grade {i % 7}") for i in range(120)] + [(500, None, "held by one id alone"), (501, None, "short")]
    rows = fragments.shared_by_title(spark.createDataFrame([(i, t) for i, _, t in given], "id long, title string")).collect()
    assert {(r["id"], r["value"]): (None, r["n_values"]) for r in rows} == plain(given, False, False) and len(rows) > 200
