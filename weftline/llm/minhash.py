"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A sketch has T coordinates filled in rounds: in round r < T every shingle is hashed to one coordinate, in round
T + j all are hashed to coordinate j, and a coordinate keeps the smallest hash of the first round that reached
it. So each coordinate fills after 2 T rounds at the latest (a few, for all but short texts), and two sketches
agree in a share of coordinates that is concentrated around the Jaccard similarity.

Texts with equal sets are one class from the start, so copies cost nothing further. Bands of ROWS coordinates put
classes in buckets. First each class is compared with one other: of the smallest members of its buckets, the one
that it meets most often. Then every bucket whose members aren't all connected yet is gone through whole: members of
different components are compared, in blocks if the bucket is large; its largest component needs no comparison
within. Sets are compared in full where they meet, in the worker that holds the cell (a bucket, or two blocks of
one), and a cell gives no pairs but a spanning forest of the links between its components. So every two documents
that share a bucket are compared or connected by other links, and what leaves a cell is at most a row for each of
its members.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, connected_components
from weftline.llm.words import Words, grouped, mix

T, BANDS, ROWS = 128, 32, 4
#: Members of a bucket, and shingles of theirs, that make a block.
BLOCK, VALUES = 512, 400_000
#: Members of a cell up to which they are compared pair by pair with others, and shingles of cells that are worked on together.
SMALL, HELD = 48, 300_000
#: Buckets in which two classes meet from which they are compared at first; others wait for their buckets' turn.
OFTEN = 3
#: Ids up to which a set of ids is broadcast (16 bytes each); a larger one is joined by a shuffle.
FEW_IDS = 2_000_000


def sketch(shingles: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """One row of T 64-bit coordinates per text; a text without shingles has zeros."""
    sizes = np.diff(bound)
    n = len(sizes)
    out = np.zeros((n, T), np.uint64)
    left = np.flatnonzero(sizes)
    empty = np.ones((n, T), bool)
    for r in range(2 * T):
        if not len(left):
            break
        own = np.repeat(left, sizes[left])
        first = np.repeat(bound[left] - np.concatenate(([0], np.cumsum(sizes[left])[:-1])), sizes[left])
        h = mix(shingles[np.arange(len(own)) + first] ^ mix(np.uint64([r + 1])))
        column = (h >> np.uint64(65 - T.bit_length())).astype(np.int64) if r < T else np.full(len(own), r - T)
        at = own * T + column
        new = empty.ravel()[at]
        at, h = at[new], h[new]
        low = np.full(n * T, np.iinfo(np.uint64).max, np.uint64) if r == 0 else low
        np.minimum.at(low, at, h)
        out.ravel()[at] = mix(low[at] + np.uint64(r))
        empty.ravel()[at] = False
        left = left[empty[left].any(axis=1)]
    return out


def set_hashes(shingles: np.ndarray, bound: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of each set; 0 for an empty one."""
    has = np.flatnonzero(np.diff(bound))
    out = [np.zeros(len(bound) - 1, np.uint64) for _ in range(2)]
    for k, seed in enumerate((11, 12)):
        if len(has):
            out[k][has] = np.add.reduceat(mix(shingles ^ mix(np.uint64([seed]))), bound[has])
    return [k.view(np.int64) for k in out]


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, c1 and c2 (a hash of the set), bands (hashes of the sketch's bands)."""
    names = ["doc_id", "n_shingles", "c1", "c2", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, texts in grouped(batch.column(1).to_pylist()):
                shingles, bound = Words(texts).shingles()
                n = len(texts)
                used = sketch(shingles, bound)[:, : BANDS * ROWS].reshape(n, BANDS, ROWS)
                band = np.zeros((n, BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
                for r in range(ROWS):
                    band = mix(band * np.uint64(0x2545F4914F6CDD1D) + used[:, :, r])
                bands = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(band.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([ids.slice(first, n), pa.array(np.diff(bound)), *map(pa.array, set_hashes(shingles, bound)), bands], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, c1 long, c2 long, bands array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """c1, c2, shingles (sorted) of every row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in grouped(batch.column(0).to_pylist()):
                shingles, bound = Words(texts).shingles()
                lists = pa.ListArray.from_arrays(pa.array(bound.astype(np.int32)), pa.array(shingles.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*map(pa.array, set_hashes(shingles, bound)), lists], names=["c1", "c2", "shingles"])

    return docs.select("text").mapInArrow(run, "c1 long, c2 long, shingles array<long>")


def _entries(bound: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the values of these rows stand, and the place in `rows` each belongs to."""
    size = bound[rows + 1] - bound[rows]
    own = np.repeat(np.arange(len(rows)), size)
    return np.arange(len(own)) + np.repeat(bound[rows] - np.concatenate(([0], np.cumsum(size)[:-1])), size), own


class Cells:
    """Rows of whole cells, laid end to end: (h, i, j, block, major, label, bands, shingles).

    In a cell (i, j) the members of block j that aren't `major` are compared with those of block i, where labels differ.
    """

    def __init__(self, rows: pa.Table, percent: int, once: bool):
        self.percent, self.once = percent, once
        column = {c: rows.column(c).combine_chunks() for c in rows.column_names}
        self.h, self.i, self.j, self.block, self.label = (column[c].to_numpy() for c in ("h", "i", "j", "block", "label"))
        self.major = column["major"].to_numpy(zero_copy_only=False)
        self.bands = column["bands"].flatten().to_numpy().reshape(-1, BANDS) if once else None
        self.size = pc.list_value_length(column["shingles"]).to_numpy().astype(np.int64)
        values = column["shingles"].flatten().to_numpy()
        # only values that occur twice can be common ones, so only those are kept, as small numbers
        _, number, count = np.unique(values, return_inverse=True, return_counts=True)
        twice = count[number] > 1
        owner = np.repeat(np.arange(len(self.size)), self.size)[twice]
        self.value = (np.cumsum(count > 1) - 1)[number[twice]]
        self.shared = np.bincount(owner, minlength=len(self.size))
        self.bound = np.concatenate(([0], np.cumsum(self.shared)))
        self.links: list[np.ndarray] = []

    def can(self, p: np.ndarray, q: np.ndarray, common: np.ndarray) -> np.ndarray:
        """Whether so many common shingles make a link."""
        return (common > 0) & (100 * common >= self.percent * (self.size[p] + self.size[q] - common))

    def link(self, p: np.ndarray, q: np.ndarray) -> None:
        a, b = self.label[p], self.label[q]
        self.links.append(np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0))

    def small(self, own: np.ndarray, end: np.ndarray) -> None:
        """Rows `own` of cells without blocks, the cell of each ending before `end`."""
        found = []
        for d in range(1, int((end - own).max(initial=0))):
            p = own[own + d < end]
            q = p + d
            ok = (self.label[p] != self.label[q]) & ~(self.major[p] & self.major[q]) & self.can(p, q, np.minimum(self.shared[p], self.shared[q]))
            p, q = p[ok], q[ok]
            if self.once and len(p):  # a pair's turn is the first bucket where it meets
                same = self.bands[p] == self.bands[q]
                first = self.bands[p, same.argmax(axis=1)] == self.h[p]
                p, q = p[first], q[first]
            found.append((p, q))
        if not found:
            return
        p, q = (np.concatenate([f[k] for f in found]) for k in range(2))
        ends = np.cumsum(self.shared[p] + self.shared[q])
        at = 0
        while at < len(p):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HELD, "right")))
            keys = []
            for side in (p[at:to], q[at:to]):
                place, pair = _entries(self.bound, side)
                keys.append(pair << 32 | self.value[place])
            keys = np.sort(np.concatenate(keys), kind="stable")
            common = np.bincount(keys[:-1][keys[1:] == keys[:-1]] >> 32, minlength=to - at)
            ok = self.can(p[at:to], q[at:to], common)
            self.link(p[at:to][ok], q[at:to][ok])
            at = to

    def large(self, own: np.ndarray) -> None:
        """The rows of one cell: common values of all pairs by products of 0/1 matrices, some values at a time."""
        place, row = _entries(self.bound, own)
        _, value, count = np.unique(self.value[place], return_inverse=True, return_counts=True)
        twice = count[value] > 1
        value, row = (np.cumsum(count > 1) - 1)[value[twice]], row[twice]
        shared = np.bincount(row, minlength=len(own))
        hope = 100 * shared >= self.percent * self.size[own]
        left = np.flatnonzero(hope & (self.block[own] == self.j[own]) & ~self.major[own])
        right = np.flatnonzero(hope & (self.block[own] == self.i[own]))
        if not len(left) or not len(right):
            return
        order = np.argsort(value, kind="stable")
        value, row = value[order], row[order]
        common, width = np.zeros((len(left), len(right)), np.float32), 1024
        for first in range(0, int(value[-1]) + 1 if len(value) else 0, width):
            a, b = np.searchsorted(value, (first, first + width))
            one = np.zeros((len(own), width), np.float32)
            one[row[a:b], value[a:b] - first] = 1
            common += one[left] @ one[right].T
        p, q = np.nonzero(common)
        common = common[p, q].astype(np.int64)
        p, q = own[left[p]], own[right[q]]
        ok = self.can(p, q, common) & (self.label[p] != self.label[q])
        self.link(p[ok], q[ok])

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        """Of all links between labels, those that a spanning forest needs."""
        root: dict[int, int] = {}

        def find(x):
            while (up := root.get(x, x)) != x:
                root[x] = root.get(up, up)
                x = up
            return x

        kept = []
        for a, b in np.unique(np.concatenate(self.links), axis=0).tolist() if self.links else []:
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
                kept.append((a, b))
        out = np.array(kept, np.int64).reshape(-1, 2)
        return out[:, 0], out[:, 1]


CELL = ["h", "i", "j"]


def _changes(rows: pa.Table) -> np.ndarray:
    """Where each cell starts."""
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for c in CELL:
        v = rows.column(c).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def links(cells: DataFrame, sets: DataFrame, percent: int, once: bool) -> DataFrame:
    """(a, b): links between labels, of rows (h, i, j, block, major, label, c1, c2, bands). once: a pair may meet in many cells."""

    def of(rows: pa.Table) -> pa.RecordBatch:
        start = _changes(rows)
        size = np.diff(np.concatenate((start, [rows.num_rows])))
        work = Cells(rows, percent, once)
        few = (size <= SMALL) & (work.i[start] == work.j[start])
        own = np.flatnonzero(np.repeat(few, size))
        work.small(own, np.repeat(start + size, size)[own])
        for k in np.flatnonzero(~few):
            work.large(np.arange(start[k], start[k] + size[k]))
        return pa.RecordBatch.from_arrays([*map(pa.array, work.forest())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, values = [], 0
        for batch in batches:
            held.append(batch)
            values += len(batch.column("shingles").flatten())
            if values >= HELD:
                rows = pa.Table.from_batches(held)
                cut = int(_changes(rows)[-1])
                if cut:
                    yield of(rows.slice(0, cut))
                    held = rows.slice(cut).to_batches()
                    values = sum(len(b.column("shingles").flatten()) for b in held)
        if sum(b.num_rows for b in held):
            yield of(pa.Table.from_batches(held))

    rows = cells.join(sets, ["c1", "c2"]).select(*CELL, "block", "major", "label", *(["bands"] if once else []), "shingles")
    rows = rows.repartition(*CELL).sortWithinPartitions(*CELL)
    return rows.mapInArrow(run, "a long, b long").distinct()


def _blocks(rows: str, values: str):
    """How many blocks hold so many rows with so many values."""
    return F.ceil(F.greatest(F.col(rows) / BLOCK, F.col(values) / VALUES, F.lit(1))).cast("int")


def _dealt(blocks):
    return F.pmod(F.xxhash64("c1", "c2"), blocks).cast("int")


def first_cells(members: DataFrame) -> DataFrame:
    """Each class with the class it is compared with at first; the one that many have in common is with each block of them."""
    hub = members.groupBy("h").agg(F.min(F.struct("rep", "c1", "c2", "n_shingles")).alias("hub"))
    met = members.join(hub, "h").where("rep <> hub.rep").groupBy("rep", "c1", "c2", "n_shingles", "hub").agg(F.count("*").alias("times")).where(F.col("times") >= OFTEN)
    best = met.groupBy("rep", "c1", "c2", "n_shingles").agg(F.max(F.struct("times", (-F.col("hub.rep")).alias("low"), "hub")).alias("best"))
    best = best.select("rep", "c1", "c2", "n_shingles", "best.hub")
    sizes = best.groupBy("hub").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s")).select("hub", _blocks("n", "s").alias("blocks"))
    own = best.join(sizes, "hub").withColumn("i", _dealt(F.col("blocks"))).select(F.col("hub.c1").alias("h"), "i", F.lit(True).alias("major"), F.col("rep").alias("label"), "c1", "c2")
    hubs = sizes.select(F.col("hub.c1").alias("h"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.lit(False).alias("major"), F.col("hub.rep").alias("label"), "hub.c1", "hub.c2")
    return own.unionByName(hubs).withColumns({"j": F.col("i"), "block": F.col("i")})


def to_compare(members: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """h, band, c1, c2, n_shingles, label of the members that a bucket can still link to another component's.

    Sets that link are of one size class or of two that follow each other, so a member stays where such classes hold more
    than its own component. Of the buckets with the same members the one of the first band stays, where their pairs have their turn.
    """
    labelled = members.join(roots, members["rep"] == roots["node"], "left").select("h", "band", "c1", "c2", "n_shingles", F.coalesce("root", "rep").alias("label"))
    ends = [F.min("label").alias("low"), F.max("label").alias("high")]
    several = labelled.groupBy("h").agg(*ends).where("low < high").select("h")
    width = math.log(max(100 / max(percent, 1), 1.01)) * (1 + 1e-9)  # a little wider, as logarithms are rounded
    labelled = labelled.join(several, "h").withColumn("size", F.floor(F.log("n_shingles") / width))
    near = labelled.groupBy("h", "size").agg(*ends).withColumn("size", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)))
    near = near.groupBy("h", "size").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("h", "size")
    left = labelled.join(near, ["h", "size"]).drop("size")
    same = left.groupBy("h").agg(F.first("band").alias("band"), F.count("*").alias("n"), *(F.sum(F.pmod(F.xxhash64("c1", "c2", F.lit(seed)), F.lit(1 << 40))).alias(f"s{seed}") for seed in range(3)))
    same = same.groupBy("n", "s0", "s1", "s2").agg(F.min(F.struct("band", "h")).alias("first")).select("first.h")
    return left.join(same, "h")


def open_cells(labelled: DataFrame) -> DataFrame:
    """The members of buckets that hold several components, dealt to cells. `major` are those of a bucket's largest component."""
    parts = labelled.groupBy("h", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    whole = parts.groupBy("h").agg(F.count("*").alias("labels"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.max(F.struct("n", "s", "label")).alias("top")).where("labels > 1")
    whole = whole.select("h", F.col("top.label").alias("top"), F.col("top.n").alias("tn"), F.col("top.s").alias("ts"), (F.col("n") - F.col("top.n")).alias("fn"), (F.col("s") - F.col("top.s")).alias("fs"))
    split = (F.col("tn") + F.col("fn") > BLOCK) | (F.col("ts") + F.col("fs") > VALUES)
    whole = whole.select("h", "top", F.when(split, _blocks("tn", "ts")).otherwise(0).alias("big"), F.when(split, _blocks("fn", "fs")).otherwise(1).alias("few"))
    rows = labelled.join(whole, "h").withColumn("major", F.col("label") == F.col("top"))
    block = F.when(F.col("big") == 0, 0).when(F.col("major"), _dealt(F.col("big"))).otherwise(F.col("big") + _dealt(F.col("few")))
    rows = rows.withColumn("block", block)
    other = F.sequence(F.when(F.col("major"), F.col("big")).otherwise(0), F.col("big") + F.col("few") - 1)
    rows = rows.withColumn("other", F.explode(other))
    return rows.select("h", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "major", "label", "c1", "c2")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of (doc_id, text).

    Documents link where 100 * intersection >= percent * union of their distinct 5-word shingles, and a component
    has the smallest doc_id it reaches. Null, empty and blank texts have no shingles and link with nothing. A
    repeated doc_id is one node of the graph; a null one links with nothing, with a null component, and isn't kept.
    Other columns are ignored, whatever their names; an empty table has an empty result.
    """
    work = Scratch(docs.sparkSession, "near")
    all_rows = work.stored(sketched(docs), "sketches")
    rows = all_rows.where("n_shingles > 0 and doc_id is not null")
    classes = work.stored(rows.groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")), "classes")
    slim = classes.select("rep", F.posexplode("bands").alias("band", "h"))
    buckets = slim.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    members = work.stored(slim.join(buckets, "h").join(classes.select("rep", "c1", "c2", "n_shingles"), "rep"), "buckets")
    ids = work.stored(members.select(F.col("rep").alias("doc_id")).distinct(), "ids")
    banded = classes.select("rep", "c1", "c2", "bands")
    if ids.count() <= FEW_IDS:
        ids = F.broadcast(ids)
        banded = banded.join(ids, banded["rep"] == ids["doc_id"], "left_semi")
    met = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi")
    sets = work.stored(shingle_sets(met).dropDuplicates(["c1", "c2"]), "sets")

    first = work.stored(links(first_cells(members), sets, percent, False), "links")
    roots = connected_components(first, store=work.stored)
    left = work.stored(to_compare(members, roots, percent), "left")
    docs.sparkSession._jvm.System.gc()  # Spark removes the shuffle files of what is stored by now
    cells = open_cells(left).join(banded.drop("rep"), ["c1", "c2"])
    more = work.stored(links(cells, sets, percent, True), "links")
    if not more.isEmpty():
        roots = connected_components(more.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))), store=work.stored)

    of_class = classes.select("c1", "c2", "rep").join(roots, F.col("rep") == F.col("node"), "left").select("c1", "c2", F.coalesce("root", "rep").alias("component_id"))
    found = rows.select("doc_id", "n_shingles", "c1", "c2").join(of_class, ["c1", "c2"]).select("doc_id", "n_shingles", "component_id")
    rest = all_rows.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = found.unionByName(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    return work.keep(out)


def one_of_each(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of docs, with all their columns, that near_duplicates keeps.

    Of a group the rows with its smallest doc_id stay, all of them if that id is repeated; rows without words or
    without a doc_id all stay.
    """
    gone = near_duplicates(docs, percent).where("not kept and doc_id is not null").select(F.col("doc_id").alias("key")).distinct()
    keyed = docs.select(F.col("doc_id").cast("long").alias("key"), F.struct("*").alias("row"))
    return keyed.join(gone, "key", "left_anti").select("row.*")
