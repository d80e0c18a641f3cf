"""Vector code compression: parts of vectors as entries of codebooks, found through segment-mean lower bounds.

Components become integers, floor(1024 x), and all distances, sums and codebooks are exact. An entry's distance is at
least what the means and residual norms of the part's segments tell: for a segment of length s with means m and norms r
of what is left, s (m_x - m_c)^2 + (r_x - r_c)^2. Bounds go from one segment a part to many; entries whose bound passes
a distance already reached are out (with a slack for rounding), and the others get their exact integer distance.
Rows never move: each round, tasks add up the parts of each entry, and those sums, of a fixed number, meet.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Scratch

#: Rows that are compared with all entries at a time.
ROWS = 2048
#: Copies of a label's total, so that a label of very many rows is joined in as many tasks.
SALTS = 16
#: Components of this size and more are refused; their integers would leave 64 bits.
LARGEST = float(1 << 50)


def _levels(x: np.ndarray) -> list[np.ndarray]:
    """For 1, 2, 4, ... segments: scaled means and residual norms, side by side; squared differences add up to the bound."""
    n, w = x.shape
    out, s = [], 1
    while s <= max(1, w // 4):
        if w % s == 0:
            seg = x.reshape(n, s, w // s) if w else np.zeros((n, 1, 1))
            mean = seg.mean(axis=2)
            out.append(np.concatenate((mean * np.sqrt(seg.shape[2]), np.linalg.norm(seg - mean[:, :, None], axis=2)), axis=1))
        s *= 2
    return out


def _squares(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


class Book:
    """The entries of one part position, with their bounds."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        real = entries.astype(np.float64)
        self.levels, self.norm = _levels(real), _squares(real)
        self.top = max((abs(int(v)) for v in (entries.max(), entries.min())), default=0) if entries.size else 0

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row and its squared distance; of equally near ones the first."""
        n, w = x.shape
        top = max(self.top, max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0)
        largest = w * (2 * top) ** 2  # whole numbers of that size are exact as doubles, as 64-bit integers or only as Python's
        exact = np.float64 if largest < 1 << 53 else np.int64 if largest < 1 << 62 else object
        xs, cs = x.astype(exact), self.entries.astype(exact)

        def distance(row, entry):
            d = xs[row] - cs[entry]
            if exact is object:
                return (d * d).sum(axis=1) if w else np.zeros(len(row), object)
            return _squares(d).astype(np.int64)

        real = x.astype(np.float64)
        norm = _squares(real)
        slack = 1e-9 * (norm[:, None] + self.norm[None, :]) + 1
        mine = _levels(real)
        coarse = sum((a[:, None] - c[None, :]) ** 2 for a, c in zip(mine[0].T, self.levels[0].T, strict=True)) - slack
        rows = np.arange(n)
        reached = distance(rows, coarse.argmin(axis=1)).astype(np.float64) * (1 + 1e-9)
        row, entry = np.nonzero(coarse <= reached[:, None])
        for a, c in zip(mine[1:], self.levels[1:], strict=True):
            bound = _squares(a[row] - c[entry]) - slack[row, entry]
            start = np.searchsorted(row, rows)
            least = np.minimum.reduceat(bound, start)
            first = np.flatnonzero(bound == least[row])
            pick = first[np.searchsorted(row[first], rows)]
            reached = np.minimum(reached, distance(rows, entry[pick]).astype(np.float64) * (1 + 1e-9))
            stay = bound <= reached[row]
            row, entry = row[stay], entry[stay]
        found = distance(row, entry)
        best = np.minimum.reduceat(found, np.searchsorted(row, rows))
        first = np.flatnonzero(found == best[row])
        return entry[first[np.searchsorted(row[first], rows)]], best


def _whole(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return batch.column("whole").flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(batch), size)


def _assigned(x: np.ndarray, books: list[Book]) -> tuple[np.ndarray, list[np.ndarray]]:
    width = x.shape[1] // len(books)
    codes, errors = [], []
    for p, book in enumerate(books):
        part = np.ascontiguousarray(x[:, p * width : (p + 1) * width])
        done = [book.nearest(part[at : at + ROWS]) for at in range(0, len(part), ROWS)]
        codes.append(np.concatenate([c for c, _ in done]))
        errors.append(np.concatenate([e for _, e in done]))
    return np.stack(codes, axis=1), errors


def _sums(size: int, tables: list[np.ndarray]):
    """Tasks' sums of the parts of each entry: part, entry, place, total, n."""

    def run(batches):
        books = [Book(t) for t in tables]
        width, k = size // len(books), len(tables[0])
        total, n = np.zeros((len(books), k, width), object), np.zeros((len(books), k), np.int64)
        for batch in batches:
            if not len(batch):
                continue
            x = _whole(batch, size)
            # sums of a batch stay within 64 bits unless components are huge
            exact = np.int64 if len(x) * int(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))) < 1 << 62 else object
            codes, _ = _assigned(x, books)
            for p in range(len(books)):
                order = np.argsort(codes[:, p], kind="stable")
                used, start = np.unique(codes[order, p], return_index=True)
                n[p, used] += np.diff(np.append(start, len(order)))
                if width:
                    part = x[order, p * width : (p + 1) * width].astype(exact, copy=False)
                    total[p, used] += np.add.reduceat(part, start, axis=0).astype(object)
        p, e = np.nonzero(n)
        if width and len(p):
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(p, width).astype(np.int32)), pa.array(np.repeat(e, width).astype(np.int32)), pa.array(np.tile(np.arange(width, dtype=np.int32), len(p))),
                pa.array([Decimal(int(v)) for v in total[p, e].ravel()], pa.decimal128(38, 0)), pa.array(np.repeat(n[p, e], width)),
            ], ["part", "entry", "place", "total", "n"])

    return run


def _codes(size: int, tables: list[np.ndarray]):
    def run(batches):
        books = [Book(t) for t in tables]
        for batch in batches:
            if not len(batch):
                continue
            codes, errors = _assigned(_whole(batch, size), books)
            error = sum(e.astype(object) for e in errors)
            if max(error) >= 1 << 63:
                raise OverflowError("a squared distance doesn't fit 64 bits")
            hexes = codes.astype(np.uint8).tobytes().hex() if codes.max(initial=0) < 256 else "".join(f"{c:02x}" for c in codes.ravel())
            step = 2 * codes.shape[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array([hexes[i : i + step] for i in range(0, len(hexes), step)]), pa.array(error.astype(np.int64))], ["vec_id", "label", "code", "error"])

    return run


def digest(tables: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for t in tables for v in t.ravel()).encode()).hexdigest()


def learn(rows: DataFrame, size: int, parts: int, entries: int, rounds: int) -> list[np.ndarray]:
    """The codebooks of (vec_id, whole) rows of one size: seeds, then `rounds` of assigning and averaging."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "whole").select("whole").limit(entries).collect()
    seeds, width = np.array([r["whole"] for r in first], np.int64).reshape(len(first), size), size // parts
    tables = [seeds[:, p * width : (p + 1) * width].copy() for p in range(parts)]
    for _ in range(rounds):
        sums = rows.select("whole").mapInArrow(_sums(size, tables), "part int, entry int, place int, total decimal(38,0), n long")
        for r in sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            tables[r["part"]][r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return tables


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """vec_id, code, error long, label_error long, codebooks_sha256 for the usable rows of (vec_id, embedding, label).

    Rows whose vector is null or holds null or non-finite components go. Seeds are the parts of the `entries` smallest
    vec_ids (fewer rows: as many entries; a null id comes last, ties go by the vector). A repeated row counts as often
    as it is there. Vectors of different sizes have codebooks of their own; one whose size isn't a multiple of `parts`
    has null code, error and codebooks and adds nothing to its label's error. Empty vectors have code 0 and error 0.
    Components of 2^50 and more and distances beyond 64 bits are an error. Other columns are ignored, whatever their
    names; an empty table has an empty result. At most 256 entries.
    """
    if not 0 < entries <= 256:
        raise ValueError("entries have two hex digits")
    work = Scratch(vectors.sparkSession, "vectorcodes")
    x = F.col("embedding").cast("array<double>")
    finite = F.forall("x", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False)))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), x.alias("x")).where(F.col("x").isNotNull() & finite)
    whole = F.transform("x", lambda v: F.when(F.abs(v) < LARGEST, F.floor(v * 1024.0)).otherwise(F.raise_error(F.lit("a component of 2^50 or more")).cast("long")))
    kept = work.stored(kept.select("vec_id", "label", F.size("x").alias("size"), whole.alias("whole")), "whole")
    coded = None
    for size in sorted(r["size"] for r in kept.select("size").distinct().collect()):
        own = kept.where(F.col("size") == size)
        if size % parts:
            out = own.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"), F.lit(None).cast("string").alias("codebooks_sha256"))
        else:
            tables = learn(own, size, parts, entries, rounds)
            out = own.select("vec_id", "label", "whole").mapInArrow(_codes(size, tables), "vec_id long, label string, code string, error long").withColumn("codebooks_sha256", F.lit(digest(tables)))
        coded = out if coded is None else coded.unionByName(out)
    if coded is None:
        coded = kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit("").alias("codebooks_sha256"))
    coded = work.stored(coded, "codes")
    totals = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"))
    totals = totals.select(F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("copy"))
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    joined = salted.join(totals, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("copy")))
    return work.keep(joined.select("vec_id", "code", "error", "label_error", "codebooks_sha256"))

