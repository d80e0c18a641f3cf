"""Links of members whose classes come to one task whole, counted on arrays.

Rows arrive class by class (kind, value): id, grp, counts, role, x, vetoed (partners that are barred), and the other values of the item
that are looked at together with the class's, as codes (kind * 4 + role) and others (their values). Nothing is made for a
pair but for vetoed ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ALL, NAMES, OWNS = 3, 1, 2
#: Rows, and values beside them, from which on whole classes are counted.
ROWS, BESIDE = 50_000, 500_000
OUT = "id long, k int, value string, other_k int, other string, class_id long, n_links long"
_SCHEMA = pa.schema([("id", pa.int64()), ("k", pa.int32()), ("value", pa.string()), ("other_k", pa.int32()), ("other", pa.string()), ("class_id", pa.int64()), ("n_links", pa.int64())])


def _dense(*columns: np.ndarray) -> np.ndarray:
    """A number for each row, equal where all columns are."""
    out = np.unique(columns[0], return_inverse=True)[1].astype(np.int64)
    for c in columns[1:]:
        code = np.unique(c, return_inverse=True)[1].astype(np.int64)
        out = np.unique(out * (int(code.max(initial=0)) + 1) + code, return_inverse=True)[1].astype(np.int64)
    return out


def _weights(role: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """What a row counts for members of role ALL, NAMES and OWNS."""
    return [counts * (role > 0), counts * (role & OWNS > 0), counts * (role & NAMES > 0)]


def _of_role(role: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    return np.select([role == ALL, role == NAMES, role == OWNS], found, 0)


def _in_class(of: np.ndarray, role: np.ndarray, counts: np.ndarray) -> np.ndarray:
    n = int(of.max(initial=-1)) + 1
    return _of_role(role, [np.bincount(of, w, n).astype(np.int64)[of] for w in _weights(role, counts)])


def _in_reach(of: np.ndarray, x: np.ndarray, role: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """As `_in_class`, of those of the class whose x differs by 1 % of the larger or less."""
    known = np.unique(x)
    wide = len(known) + 1
    at = of * wide + np.searchsorted(known, x)
    order = np.argsort(at, kind="stable")
    low = np.searchsorted(at[order], of * wide + np.searchsorted(known, x - x // 100))
    high = np.searchsorted(at[order], of * wide + np.searchsorted(known, x * 100 // 99, side="right"))
    found = []
    for w in _weights(role, counts):
        run = np.concatenate([[0], np.cumsum(w[order])])
        found.append(run[high] - run[low])
    return _of_role(role, found)


def _fits(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    return ((one & NAMES > 0) & (other & OWNS > 0)) | ((one & OWNS > 0) & (other & NAMES > 0))


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Lengths and elements of a column of lists; null is empty."""
    column = column.combine_chunks()
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64), pc.list_flatten(column)


def _positions(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size tells."""
    return np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum()) if len(sizes) else np.zeros(0, np.int64)


def _found(sought: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each one sought its place among the keys, each there once, or -1."""
    if not len(keys):
        return np.full(len(sought), -1)
    order = np.argsort(keys)
    at = np.minimum(np.searchsorted(keys[order], sought), len(keys) - 1)
    return np.where(keys[order][at] == sought, order[at], -1)


def _column(table: pa.Table, name: str, null: int = 0) -> np.ndarray:
    return pc.fill_null(table[name].cast(pa.int64()), null).to_numpy()


def _classes(table: pa.Table) -> np.ndarray:
    """The number of each row's class; rows of a class are neighbours."""
    value = table["value"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    k = table["k"].to_numpy()
    return np.concatenate([[0], np.cumsum((value[1:] != value[:-1]) | (k[1:] != k[:-1]))]).astype(np.int64)


def _counted(table: pa.Table, single: bool) -> Iterator[pa.RecordBatch]:
    of, ids, role, counts, x = _classes(table), _column(table, "id"), _column(table, "role"), _column(table, "counts"), _column(table, "x")
    n, grp, alone = len(ids), _column(table, "grp"), table["grp"].is_null().to_numpy()
    group = np.where(alone, np.arange(n), n + np.unique(grp, return_inverse=True)[1])  # who has no group is one

    # pairs of rows of a class with a veto against them
    size, barred = _lists(table["vetoed"])
    one = np.repeat(np.arange(n), size)
    known = np.unique(ids)
    place = np.minimum(np.searchsorted(known, barred.to_numpy(zero_copy_only=False)), max(len(known) - 1, 0))
    there = known[place] == barred.to_numpy(zero_copy_only=False)
    one, place = one[there], place[there]
    other = _found(of[one] * len(known) + place, of * len(known) + np.searchsorted(known, ids))
    one, other = one[other >= 0], other[other >= 0]
    kept = (counts[other] > 0) & (group[one] != group[other])
    one, other = one[kept], other[kept]

    def out(rows: np.ndarray, links: np.ndarray, other_k=None, others=None, lowest=None) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(links > 0)
        if len(at):
            rows_ = pa.array(rows[at])
            nulls = lambda kind: pa.nulls(len(at), kind)
            yield pa.RecordBatch.from_arrays(
                [
                    table["id"].combine_chunks().take(rows_), table["k"].combine_chunks().take(rows_), table["value"].combine_chunks().take(rows_), nulls(pa.int32()) if other_k is None else pa.array(other_k[at].astype(np.int32)),
                    nulls(pa.string()) if others is None else others.take(pa.array(at)), nulls(pa.int64()) if lowest is None else pa.array(lowest[at]), pa.array(links[at].astype(np.int64)),
                ],
                schema=_SCHEMA,
            )

    def lows(of: np.ndarray, ids: np.ndarray) -> np.ndarray:
        low = np.full(int(of.max(initial=-1)) + 1, np.iinfo(np.int64).max)
        np.minimum.at(low, of, ids)
        return low[of]

    if single:
        lost = np.bincount(one[_fits(role[one], role[other])], minlength=n)
        yield from out(np.arange(n), _in_class(of, role, counts) - _in_class(_dense(of, group), role, counts) - lost, lowest=lows(of, ids))
        return

    # an amount beside the value
    priced = np.flatnonzero(x > 0)
    if len(priced):
        close = (x[one] > 0) & (x[other] > 0) & (np.abs(x[one] - x[other]) * 100 <= np.maximum(x[one], x[other])) & _fits(role[one], role[other])
        lost = np.bincount(one[close], minlength=n)[priced]
        p = (x[priced], role[priced], counts[priced])
        yield from out(priced, _in_reach(of[priced], *p) - _in_reach(_dense(of[priced], group[priced]), *p) - lost)

    # another value beside it
    size, codes = _lists(table["codes"])
    codes, values = codes.to_numpy(zero_copy_only=False).astype(np.int64), _lists(table["others"])[1]
    if len(codes):
        row = np.repeat(np.arange(n), size)
        both = role[row] & (codes & 3)
        what = _dense(codes >> 2, pc.fill_null(values.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64))
        pair = _dense(of[row], what)
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        mine = _positions(start[one], size[one])
        wide = int(what.max()) + 1
        theirs = _found(np.repeat(other, size[one]) * wide + what[mine], row * wide + what)
        mine, theirs = mine[theirs >= 0], theirs[theirs >= 0]
        lost = np.bincount(mine[_fits(both[mine], both[theirs])], minlength=len(row))
        links = _in_class(pair, both, counts[row]) - _in_class(_dense(pair, group[row]), both, counts[row]) - lost
        yield from out(row, links, codes >> 2, values, lows(pair, ids[row]))


def links(single: bool):
    """For mapInArrow over rows that come class by class: the class's own links (single), or those of the class and another value or an amount."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, beside = [], 0, 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            beside += 0 if single else len(batch["others"].flatten())
            if rows < ROWS and beside < BESIDE:
                continue
            table = pa.Table.from_batches(held)
            of = _classes(table)
            whole = int(np.searchsorted(of, of[-1]))  # the last class may go on
            if whole:
                yield from _counted(table.slice(0, whole), single)
                held = table.slice(whole).combine_chunks().to_batches()
            else:
                held = table.to_batches()
            rows = sum(b.num_rows for b in held)
            beside = 0 if single else sum(len(b["others"].flatten()) for b in held)
        if rows:
            yield from _counted(pa.Table.from_batches(held), single)

    return run
