"""Classes that come to one task whole: what moves for them, and classes that go over batches."""

import random

import pyarrow as pa
import pytest
from test_pairs import frames, world
from test_pairs_disk import exchanges

from weftline.operators import gathered, pairing

ROW = pa.schema([("id", pa.int64()), ("grp", pa.int64()), ("counts", pa.bool_()), ("x", pa.int64()), ("vetoed", pa.list_(pa.int64())), ("k", pa.int32()), ("value", pa.string()), ("role", pa.int32()), ("codes", pa.list_(pa.int32())), ("others", pa.list_(pa.string()))])


def rows(seed):
    rng, out = random.Random(seed), []
    for k, value in sorted({(rng.randrange(1, 4), rng.choice("abcdefgh")) for _ in range(14)}):
        for i in rng.sample(range(60), rng.randrange(1, 30)):
            beside = sorted({(rng.randrange(4, 7), rng.choice("uvw")) for _ in range(rng.randrange(4))})
            codes = [q * 4 + rng.choice([1, 2, 3, 3, 3]) for q, _ in beside]
            out.append((i, rng.choice([None, 1, 2, 3]), rng.random() < 0.8, rng.choice([None, 0, 500, 503, 506, 90_000]), rng.choice([None, sorted({rng.randrange(60), 7})]), k, value, rng.choice([1, 2, 3, 3]), codes, [v for _, v in beside]))
    return out


def fits(a, b):
    return bool((a & 1 and b & 2) or (a & 2 and b & 1))


def plain(given):
    """Every pair of rows of a class looked at."""
    single, both = {}, {}
    for a in given:
        one = [b for b in given if a[5:7] == b[5:7] and a[0] != b[0]]
        partners = [b for b in one if b[2] and (a[1] is None or a[1] != b[1]) and b[0] not in (a[4] or [])]
        single[a[0], *a[5:7]] = (min([a[0], *(b[0] for b in one)]), sum(fits(a[7], b[7]) for b in partners))
        both[a[0], *a[5:7], None, None] = (None, sum(fits(a[7], b[7]) and bool(a[3] and b[3]) and abs(a[3] - b[3]) * 100 <= max(a[3], b[3]) for b in partners))
        for code, v in zip(a[8], a[9], strict=True):
            role = lambda b, q=code >> 2, v=v: next((c & b[7] & 3 for c, w in zip(b[8], b[9], strict=True) if (c >> 2, w) == (q, v)), 0)
            holds = lambda b, q=code >> 2, v=v: any((c >> 2, w) == (q, v) for c, w in zip(b[8], b[9], strict=True))
            both[a[0], *a[5:7], code >> 2, v] = (min([a[0], *(b[0] for b in one if holds(b))]), sum(fits(role(a), role(b)) for b in partners))
    return {k: v for k, v in single.items() if v[1]}, {k: v for k, v in both.items() if v[1]}


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("size", [1, 1000])
def test_classes_over_batches(monkeypatch, seed, size):
    monkeypatch.setattr(gathered, "ROWS", size)
    given = rows(seed)
    batches = pa.Table.from_pylist([dict(zip(ROW.names, r, strict=True)) for r in given], ROW).to_batches(max_chunksize=max(3, size // 10))
    for single, expected in zip((True, False), plain(given), strict=True):
        got = [tuple(r.values()) for b in gathered.links(single)(iter(batches)) for r in b.to_pylist()]
        assert len(got) == len(expected)
        assert {(i, k, v) if single else (i, k, v, q, w): (low, n) for i, k, v, q, w, low, n in got} == expected


def test_points_move_twice_for_candidates(spark):
    """To their item, and from it to the classes; before, what was made of them was exchanged again for every count."""
    assert exchanges(pairing.candidates(*frames(spark, *world(1)))) <= 4
