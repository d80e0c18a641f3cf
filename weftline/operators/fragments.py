"""Substrings that titles share, of one length, found where they meet without moving each substring by itself.

A substring of GRAM characters is known by one of its parts of PART characters, the one that the fewest titles have (by
counts of hashed parts, which only settle the order). Neighbouring substrings of a title mostly have the same one, so a title is cut into
a few runs, and a run goes to its part's task as one text. All holders of a substring meet there, since equal substrings have equal parts.
What they have in common is told to each title in one row a run. Parts of very many runs are left to aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.sources.tables import stored

#: Length of a substring that two titles must share.
GRAM = 15
PART = 5
#: Runs of a part up to which one task may take them whole.
HOT = 100_000
#: Buckets of hashed parts, and of runs.
BUCKETS = 1 << 16
#: A part is frequent from so many times the mean of all buckets on.
USUAL = 8
#: Runs that are counted together at least, and that a task gets.
ROWS, TASK_ROWS = 20_000, 400_000
_CUT = "id long, grp long, code long, text string"
_MET = "id long, grp long, text string, at array<int>, h array<long>, class_id array<long>, n_projects array<long>"
_MET_ARROW = pa.schema([("id", pa.int64()), ("grp", pa.int64()), ("text", pa.string()), ("at", pa.list_(pa.int32())), ("h", pa.list_(pa.int64())), ("class_id", pa.list_(pa.int64())), ("n_projects", pa.list_(pa.int64()))])
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def _xxhash64(ids: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of a long."""
    turned = lambda v, n: (v << np.uint64(n)) | (v >> np.uint64(64 - n))
    h = (np.uint64(42) + _P5 + np.uint64(8)) ^ (turned(ids.astype(np.uint64) * _P2, 31) * _P1)
    return _mixed(turned(h, 27) * _P1 + _P4)


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and where each starts and ends."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), ends - sizes, ends


def _hashes(letters: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` letters from each place on; of no use at a text's end."""
    out = np.zeros(max(len(letters) - size + 1, 0), np.uint64)
    for k in range(size):
        out = out * _P1 + letters[k : k + len(out)]
    return _mixed(out)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from each start on, as many as its size tells, and whose each is."""
    whose = np.repeat(np.arange(len(sizes)), sizes)
    return starts[whose] + np.arange(len(whose)) - (np.cumsum(sizes) - sizes)[whose], whose


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many parts fall into each bucket."""
    n = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        letters, starts, ends = _letters(batch["title"].to_pylist())
        h = _hashes(letters, PART)
        at = _spread(starts, ends - starts - PART + 1)[0]
        n += np.bincount((h[at] % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
    found = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(n[found])], names=["bucket", "n"])


def _cut(order: np.ndarray):
    """Titles cut into runs; `order` has the rank of each bucket of parts, rare ones first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["title"].to_pylist()
            if not texts:
                continue
            letters, starts, ends = _letters(texts)
            h = _hashes(letters, PART)
            score = (order[(h % np.uint64(BUCKETS)).astype(np.int64)] << np.uint64(56)) | (h >> np.uint64(8))
            n = len(letters) - GRAM + 1
            code = score[:n].copy()
            for k in range(1, GRAM - PART + 1):
                np.minimum(code, score[k : k + n], out=code)
            at, whose = _spread(starts, ends - starts - GRAM + 1)
            code = code[at]
            first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (whose[1:] != whose[:-1])]))
            last = np.concatenate([first[1:], [len(at)]]) - 1
            begin = (at - starts[whose])[first].tolist()
            end = ((at - starts[whose])[last] + GRAM).tolist()
            of = whose[first]
            cut = [texts[t][a:b] for t, a, b in zip(of.tolist(), begin, end, strict=True)]
            row = pa.array(of)
            yield pa.RecordBatch.from_arrays([batch["id"].take(row), batch["grp"].take(row), pa.array(code[first].view(np.int64)), pa.array(cut, pa.string())], names=["id", "grp", "code", "text"])

    return run


def _grams(letters: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A number for each substring, equal where they are. They are told by their hashes, and compared if those might deceive."""
    _, first, of = np.unique(_hashes(letters, GRAM)[at], return_index=True, return_inverse=True)
    if all(np.array_equal(letters[at + k], letters[at[first][of] + k]) for k in range(GRAM)):
        return of
    return np.unique(np.stack([letters[at + k] for k in range(GRAM)], axis=1), axis=0, return_inverse=True)[1].ravel()


def _met(table: pa.Table, apart: bool, projects: bool) -> Iterator[pa.RecordBatch]:
    ids, alone = table["id"].to_numpy(), table["grp"].is_null().to_numpy()
    grp = pc.fill_null(table["grp"], 0).to_numpy()
    texts = table["text"].combine_chunks()
    letters, starts, ends = _letters(texts.to_pylist())
    at, run = _spread(starts, ends - starts - GRAM + 1)
    of = _grams(letters, at)
    order = np.lexsort((run, ids[run], of))  # of an id's equal substrings the first one counts
    order = order[np.concatenate([[True], (of[order][1:] != of[order][:-1]) | (ids[run[order]][1:] != ids[run[order]][:-1])])]
    n = np.bincount(of)
    n[:] = np.bincount(of[order], minlength=len(n))
    order = order[n[of[order]] > 1]
    if not len(order):
        return
    of, run, at = np.unique(of[order], return_inverse=True)[1], run[order], at[order]
    begins = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    h = np.bitwise_xor.reduceat(_xxhash64(ids[run]), begins)[of].view(np.int64)
    known, group = np.unique(grp[run], return_inverse=True)
    group = np.where(alone[run], len(known), group).astype(np.int64)
    pair, mine, held = np.unique(of * (len(known) + 1) + group, return_inverse=True, return_counts=True)
    groups, several = (np.bincount(pair[p] // (len(known) + 1), minlength=int(of[-1]) + 1)[of] for p in (slice(None), pair % (len(known) + 1) < len(known)))
    kept = (groups > 1) | alone[run] if apart else np.ones(len(of), bool)  # who has no group is apart from all
    low = np.where(alone[run], np.iinfo(np.int64).max, grp[run])
    low = np.minimum.reduceat(low, begins)[of]
    partners = several - ((held[mine] == 1) & ~alone[run])
    at, run, h, low, partners = (v[kept] for v in (at, run, h, low, partners))
    order = np.lexsort((at, run))
    at, run, h, low, partners = (v[order] for v in (at, run, h, low, partners))
    there, sizes = np.unique(run, return_counts=True)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    lists = lambda v: pa.ListArray.from_arrays(offsets, v)
    rows = pa.array(there)
    none = pa.nulls(len(there), pa.list_(pa.int64()))
    yield pa.RecordBatch.from_arrays(
        [
            table["id"].combine_chunks().take(rows), table["grp"].combine_chunks().take(rows), texts.take(rows), lists(pa.array((at - starts[run]).astype(np.int32))), lists(pa.array(h)),
            lists(pa.array(low, mask=low == np.iinfo(np.int64).max)) if projects else none, lists(pa.array(partners.astype(np.int64))) if projects else none,
        ],
        schema=_MET_ARROW,
    )


def _meet(apart: bool, projects: bool):
    """For mapInArrow over runs that come part by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < ROWS:
                continue
            table = pa.Table.from_batches(held)
            code = table["code"].to_numpy()
            whole = int(np.searchsorted(code, code[-1]))  # the last part may go on
            if whole:
                yield from _met(table.slice(0, whole), apart, projects)
            held = table.slice(whole).combine_chunks().to_batches()
            rows = table.num_rows - whole
        if rows:
            yield from _met(pa.Table.from_batches(held), apart, projects)

    return run


def _of_hot(runs: DataFrame, apart: bool, projects: bool) -> DataFrame:
    """As `_meet`, by aggregates, a row a substring."""
    parts = F.transform(F.sequence(F.lit(1), F.length("text") - (GRAM - 1)), lambda p: F.substring("text", p, F.lit(GRAM)))
    values = runs.select("id", "grp", F.explode(F.array_distinct(parts)).alias("value")).distinct()
    hashed = F.bit_xor(F.xxhash64("id"))
    if projects:
        own = values.groupBy("value", "grp").agg(F.count("*").alias("n"), hashed.alias("h"))
        whole = own.groupBy("value").agg(F.sum("n").alias("n"), F.bit_xor("h").alias("h"), F.min("grp").alias("class_id"), F.count("grp").alias("several")).where("n > 1")
        own = own.select("value", F.col("grp").alias("own"), ((F.col("n") == 1) & F.col("grp").isNotNull()).cast("long").alias("only"))
        both = values.join(whole, "value").join(own.withColumnRenamed("value", "of"), (F.col("value") == F.col("of")) & F.col("grp").eqNullSafe(F.col("own")))
        return both.select("id", "grp", F.col("value").alias("text"), F.array(F.lit(0)).alias("at"), F.array("h").alias("h"), F.array("class_id").alias("class_id"), F.array(F.col("several") - F.col("only")).alias("n_projects"))
    whole = values.groupBy("value").agg(F.count("*").alias("n"), hashed.alias("h"), F.min("grp").alias("low"), F.max("grp").alias("high"), F.max(F.col("grp").isNull()).alias("free")).where("n > 1")
    whole = whole.where("low < high or free") if apart else whole
    none = F.lit(None).cast("array<long>")
    return values.join(whole, "value").select("id", "grp", F.col("value").alias("text"), F.array(F.lit(0)).alias("at"), F.array("h").alias("h"), none.alias("class_id"), none.alias("n_projects"))


def shared(titles: DataFrame, apart: bool = False, projects: bool = False) -> DataFrame:
    """id, grp, value, n_values, class_id, n_projects of (id, grp, title): the substrings that another id has too; of those with the same holders the first one.

    n_values is how many have those holders, who are told by a hash. An id may have several titles of one grp. With `apart`, only substrings
    that two groups have, or an id without a group; with `projects`, class_id is the smallest grp that has it and n_projects how many do by another id.
    """
    spark = titles.sparkSession
    titles = titles.where(F.length("title") >= GRAM).select("id", "grp", "title")
    counts = titles.mapInArrow(_parts, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    order, usual = np.zeros(BUCKETS, np.uint64), USUAL * sum(n for _, n in counts) // BUCKETS
    for bucket, n in counts:
        order[bucket] = (n // max(usual, 1)).bit_length()
    runs = titles.mapInArrow(_cut(order), _CUT)
    bucket = F.pmod("code", F.lit(BUCKETS)).cast("int")
    sizes = stored(runs.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")), "runs")
    busy = sizes.where(F.col("n") > HOT).select("bucket")
    hot = None
    if busy.limit(1).count():
        inside = runs.withColumn("bucket", bucket).join(F.broadcast(busy), "bucket", "left_semi").groupBy("code").agg(F.count("*").alias("n"))
        hot = stored(inside.where(F.col("n") > HOT).select("code"), "hot-parts")
    tasks = max(spark.sparkContext.defaultParallelism, -(-(sizes.agg(F.sum("n")).first()[0] or 0) // TASK_ROWS))
    rare = runs if hot is None else runs.join(F.broadcast(hot), "code", "left_anti")
    told = rare.repartition(tasks, "code").sortWithinPartitions("code").mapInArrow(_meet(apart, projects), _MET)
    if hot is not None:
        told = told.unionByName(_of_hot(runs.join(F.broadcast(hot), "code", "left_semi"), apart, projects))
    names = ["at", "h", *(["class_id", "n_projects"] if projects else [])]
    each = told.repartition(tasks, "id").select("id", "grp", "text", F.explode(F.arrays_zip(*names)).alias("g"))
    each = each.select("id", "grp", F.col("text").substr(F.col("g.at") + 1, F.lit(GRAM)).alias("value"), *(f"g.{n}" for n in names[1:]))
    return each.groupBy("id", "grp", *names[1:]).agg(F.min("value").alias("value"), F.count("*").alias("n_values"))


#: Different titles up to which they are told what they share, and it goes to all tasks.
FEW = 10_000


def shared_by_title(titles: DataFrame) -> DataFrame:
    """id, value, n_values as `shared` has them, of (id, title) with one title an id: of few different titles no id moves.

    Two substrings have the same holders just where the same titles have them. A title that several ids have comes twice, so that
    its substrings are shared.
    """
    if titles.agg(F.approx_count_distinct("title")).first()[0] > FEW:
        return shared(titles.select("id", F.lit(None).cast("long").alias("grp"), "title")).select("id", "value", "n_values")
    counts = titles.where("title is not null").groupBy("title").agg(F.count("*").alias("n"))
    few = stored(counts.select("title", "n", (2 * F.row_number().over(Window.orderBy("title"))).cast("long").alias("t")), "titles")
    both = few.select(F.explode(F.when(F.col("n") > 1, F.array("t", F.col("t") + 1)).otherwise(F.array("t"))).alias("id"), F.lit(None).cast("long").alias("grp"), "title")
    told = shared(both).join(few.select(F.col("t").alias("id"), "title"), "id").select("title", "value", "n_values")
    return titles.join(F.broadcast(told), "title").select("id", "value", "n_values")
