"""What moves for classes of points: exchanges of the plans, and both ways of counting."""

import re

import pytest
from test_pairs import frames, world

from weftline.operators import pairing


def exchanges(df):
    return len(re.findall(r"Exchange (?:hash|range)partitioning", df._jdf.queryExecution().executedPlan().toString()))


def test_one_exchange_counts_as_three_do(spark):
    items, values, vetoes = world(5)
    v, i, _ = frames(spark, items, values, vetoes)
    members = v.join(i.select("id", "grp", "counts"), "id").localCheckpoint()
    once, thrice = pairing.classes_once(members, ["point", "value"]), pairing.classes(members, ["point", "value"])
    assert exchanges(once) == 1 < exchanges(thrice)
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, thrice.collect()), key=str)


@pytest.mark.parametrize("hot", [0, 3])
def test_candidates_with_hot_classes(spark, monkeypatch, hot):
    world_ = world(2)
    expected = sorted(map(tuple, pairing.candidates(*frames(spark, *world_)).collect()), key=str)
    monkeypatch.setattr(pairing, "HOT", hot)
    assert sorted(map(tuple, pairing.candidates(*frames(spark, *world_)).collect()), key=str) == expected


def test_substrings_come_once_without_an_exchange_of_substrings(spark):
    titles = spark.createDataFrame([(1, "aaaaaaaaaaaaaaaaaaaa"), (1, "aaaaaaaaaaaaaaaaaaaa"), (1, "aaaaaaaaaaaaaaab"), (2, "short"), (3, None)], "id long, title string")
    got = pairing.grams(titles)
    assert exchanges(got) <= 1
    assert sorted(map(tuple, got.collect())) == [(1, "a" * 15), (1, "a" * 14 + "b")]
