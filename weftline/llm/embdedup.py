"""Near-duplicate embeddings by cross-polytope hashing.

A vector is rotated by three rounds of random signs and fast Hadamard transforms, and its hash is the axis it is
nearest to, with sign. A table joins three such axes to one bucket, whatever the number of vectors; a vector lives in
its home bucket and probes the PROBES - 1 next likely ones. Vectors of a bucket, of which one at least lives there, are compared in double
precision. A pair is counted in the first table and bucket where it meets, so no list of pairs is made: tasks give
each vector's number of links and, of the links, a spanning forest.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, connected_components
from weftline.llm.vectors import matrix, usable

PROBES, SEED = 4, 20240229
#: Entries of a bucket that are compared with each other at a time, and up to how many pair by pair.
BLOCK, SMALL = 512, 48


@dataclass(frozen=True)
class Plan:
    tables: int
    hashes: int


#: One plan for tables of every size, so that a row's links don't depend on how many other rows there are.
PLAN = Plan(12, 3)


def plan_of(rows: int) -> Plan:
    """The plan of a table in which a label has up to `rows` vectors of one size: the same for all."""
    return PLAN


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, orthonormal."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        h *= 2
    return x.reshape(n, d) / np.sqrt(d)


def codes(x: np.ndarray, plan: Plan) -> np.ndarray:
    """n x tables x PROBES bucket codes of unit rows, home first."""
    n, size = x.shape
    d = 1 << max(1, (size - 1).bit_length())
    padded = np.zeros((n, d))
    padded[:, :size] = x
    rng = np.random.default_rng(SEED)
    out = np.empty((n, plan.tables, PROBES), np.int64)
    width = min(PROBES, d)
    combos = list(product(range(width), repeat=plan.hashes))
    for t in range(plan.tables):
        axes, losses = [], []
        for _ in range(plan.hashes):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], size=d))
            top = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :width]
            value = np.take_along_axis(y, top, axis=1)
            axes.append(top * 2 + (value < 0))
            losses.append(np.abs(value[:, :1]) - np.abs(value))
        loss = np.stack([sum(losses[h][:, c[h]] for h in range(plan.hashes)) for c in combos], axis=1)
        code = np.stack([sum(axes[h][:, c[h]] * (2 * d) ** h for h in range(plan.hashes)) for c in combos], axis=1)
        take = np.argsort(loss, axis=1, kind="stable")[:, :PROBES]
        got = np.take_along_axis(code, take, axis=1)
        out[:, t, : got.shape[1]] = got
        out[:, t, got.shape[1] :] = got[:, -1:]
    return out


def _meets(home: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """Whether each home code is among the probes of the same row: (..., P) -> (...)."""
    return (home[..., None] == probes).any(axis=-1)


class Cells:
    """Compares the rows of whole cells (a bucket, or two blocks of one), laid end to end."""

    def __init__(self, rows: pd.DataFrame, least: float):
        self.least, self.t = least, rows["t"].to_numpy()
        self.rep, self.home, self.weight = rows["rep"].to_numpy(), rows["home"].to_numpy(), rows["weight"].to_numpy()
        self.x = matrix(rows["embedding"])
        self.x /= np.linalg.norm(self.x, axis=1, keepdims=True)
        self.code = np.frombuffer(b"".join(rows["codes"]), np.int64).reshape(len(rows), -1, PROBES)
        self.added, self.root = np.zeros(len(rows), np.int64), np.arange(len(rows))

    def take(self, p: np.ndarray, q: np.ndarray) -> None:
        """Count the pairs of rows, all of which link, that meet here first."""
        for at in range(0, len(p), 100_000):
            self._take(p[at : at + 100_000], q[at : at + 100_000])

    def _take(self, p, q):
        rep, home, cp, cq = self.rep, self.home, self.code[p], self.code[q]
        t = self.t[p]
        met = _meets(cp[:, :, 0], cq) | _meets(cq[:, :, 0], cp)
        first = met.argmax(axis=1) >= t
        # one lives here and the other probes; where that also holds the other way round, the smaller's probe counts
        prober, owner = np.where(home[p], q, p), np.where(home[p], p, q)
        twice = (home[p] != home[q]) & _meets(self.code[prober, t, 0], self.code[owner, t])
        first &= ~twice | (rep[prober] < rep[owner])
        p, q = p[first], q[first]
        np.add.at(self.added, p, self.weight[q])
        np.add.at(self.added, q, self.weight[p])
        root = self.root
        while True:  # the smallest row reachable
            low = np.minimum(root[p], root[q])
            if (root[p] == low).all() and (root[q] == low).all():
                break
            np.minimum.at(root, root[p], low)
            np.minimum.at(root, root[q], low)
            root[:] = root[root]

    def small(self, own: np.ndarray, end: np.ndarray) -> None:
        """All pairs within cells: rows `own`, the cell of each ending before `end`."""
        for d in range(1, int((end - own).max(initial=0))):
            p = own[own + d < end]
            p = p[(self.home[p] | self.home[p + d]) & (self.rep[p] != self.rep[p + d])]
            self.take(*(v[np.einsum("ij,ij->i", self.x[p], self.x[p + d]) >= self.least] for v in (p, p + d)))

    def large(self, rows: np.ndarray, columns: np.ndarray, same: bool) -> None:
        for at in range(0, len(rows), 256):
            part = rows[at : at + 256]
            ok = self.x[part] @ self.x[columns].T >= self.least
            ok &= (self.home[part][:, None] | self.home[columns][None, :]) & (self.rep[part][:, None] != self.rep[columns][None, :])
            if same:
                ok &= part[:, None] < columns[None, :]
            a, b = np.nonzero(ok)
            self.take(part[a], columns[b])

    def result(self) -> pd.DataFrame:
        while (self.root != self.root[self.root]).any():
            self.root = self.root[self.root]
        out = pd.DataFrame({"rep": self.rep, "added": self.added, "other": self.rep[self.root]})
        return out[(out["added"] > 0) | (out["rep"] != out["other"])]


CELL = ["label", "size", "t", "bucket", "i", "j"]


def _compare(least: float):
    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        cells, n = Cells(rows, least), len(rows)
        new = np.zeros(n, bool)
        new[0] = True
        for c in CELL:
            v = rows[c].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        start = np.flatnonzero(new)
        size = np.diff(np.concatenate((start, [n])))
        i, j, block = rows["i"].to_numpy(), rows["j"].to_numpy(), rows["block"].to_numpy()
        few = (size <= SMALL) & (i[start] == j[start])
        end = np.repeat(start + size, size)
        own = np.flatnonzero(np.repeat(few, size))
        cells.small(own, end[own])
        for k in np.flatnonzero(~few):
            own = np.arange(start[k], start[k] + size[k])
            a, b = i[start[k]], j[start[k]]
            cells.large(own[block[own] == a], own[block[own] == b], a == b)
        return cells.result()

    def of_one_size(rows: pd.DataFrame):
        for d in np.unique(rows["size"]):
            yield whole(rows[rows["size"] == d].reset_index(drop=True))

    def run(batches):
        held: list[pd.DataFrame] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= 20_000:
                rows = pd.concat(held, ignore_index=True)
                last = rows[CELL].iloc[-1]
                tail = (rows[CELL] == last).all(axis=1).to_numpy()
                if not tail.all():
                    yield from of_one_size(rows[~tail])
                held = [rows[tail]]
        if held and sum(map(len, held)):
            yield from of_one_size(pd.concat(held, ignore_index=True))

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding, label).

    Rows link where their labels are equal and not null, the vectors have equally many components and their cosine is
    `least` or more. Unusable vectors link with nothing. Equal vectors with equal labels are one class from the start,
    linked with each other; a repeated row counts as another vector. A null vec_id links with nothing and isn't kept.
    Other columns are ignored, whatever their names; an empty table has an empty result.
    """
    work = Scratch(vectors.sparkSession, "embdedup")
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    base = base.withColumn("ok", usable("embedding") & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    rows = base.where("ok").withColumns({"size": F.size("embedding"), "h1": F.xxhash64("embedding"), "h2": F.xxhash64("embedding", F.lit(1))})
    key = ["label", "size", "h1", "h2"]
    plan = PLAN

    def hashed(x: pd.Series) -> pd.Series:
        size, out = x.map(len).to_numpy(), pd.Series([b""] * len(x), dtype=object)
        for d in np.unique(size):
            at = np.flatnonzero(size == d)
            m = matrix(x.iloc[at])
            for i, c in zip(at, codes(m / np.linalg.norm(m, axis=1, keepdims=True), plan), strict=True):
                out[i] = c.tobytes()
        return out

    classes = rows.groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("embedding").alias("embedding"))
    classes = work.stored(classes.withColumn("codes", F.pandas_udf(hashed, "binary")("embedding")), "vectors")

    def entries(batches):
        for x in batches:
            n = len(x)
            code = np.frombuffer(b"".join(x["codes"]), np.int64)
            where = np.stack(np.meshgrid(np.arange(n), np.arange(plan.tables), np.arange(PROBES), indexing="ij"), axis=-1).reshape(-1, 3)
            yield pd.DataFrame({
                "label": x["label"].to_numpy()[where[:, 0]], "size": x["size"].to_numpy()[where[:, 0]], "rep": x["rep"].to_numpy()[where[:, 0]], "t": where[:, 1].astype(np.int32),
                "bucket": code, "home": where[:, 2] == 0,
            })

    schema = "label string, size int, rep long, t int, bucket long, home boolean"
    bucket = ["label", "size", "t", "bucket"]
    listed = work.stored(classes.select("label", "size", "rep", "codes").mapInPandas(entries, schema).dropDuplicates([*bucket, "rep"]), "entries")
    busy = listed.groupBy(*bucket).agg(F.count("*").alias("n"), F.count_if("home").alias("homes")).where("n > 1 and homes > 0")
    busy = busy.select(*bucket, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = listed.join(busy, bucket).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("block", "o"), "j": F.greatest("block", "o")})
    dealt = dealt.join(classes.select("label", "size", "rep", "weight", "embedding", "codes"), ["label", "size", "rep"]).drop("o", "blocks")
    dealt = dealt.repartition(*CELL).sortWithinPartitions(*CELL, "rep")
    found = work.stored(dealt.mapInPandas(_compare(least), "rep long, added long, other long"), "links")
    roots = connected_components(found.where("rep <> other").select(F.col("rep").alias("a"), F.col("other").alias("b")), store=work.stored)
    links = found.groupBy("rep").agg(F.sum("added").alias("added"))
    of_class = classes.select(*key, "rep", "weight").join(links, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left")
    of_class = of_class.select(*key, (F.coalesce("added", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    linked = rows.select("vec_id", *key).join(of_class, key).select("vec_id", "n_links", "component_id")
    alone = base.where(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return work.keep(linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))
