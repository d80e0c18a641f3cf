"""Bulk-synchronous best-fit packing of token sequences.

Classes of lengths are placed from the longest down. A superstep range-sorts the documents of a class together with
the gaps of the open sequences, a gap that holds several of the class as so many slots, and sweeps the sorted rows: a
document waits on a stack, and a slot takes the last one, which is the longest that fits it, so the slot is that
document's nearest free successor. Each task sweeps its range; what it leaves over, first slots without a document and
then documents without a slot, is matched between ranges by rank, for which the driver needs two counts a task. Then
the gaps are updated and the superstep is repeated, until hardly a document finds a gap. Those left open new sequences.
"""

from __future__ import annotations

import json
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.chunks import cut
from weftline.llm.common import Scratch, read_bytes

#: Rows that a task sweeps, about.
RANGE = 25_000
#: Documents without a gap open sequences once fewer than one in so many of them found one in the last sweep.
FEW = 10
#: Pieces kept by a worker's cache; it starts anew beyond that.
CACHE = 600_000
#: The tokenizers library's pattern of matches of byte-level BPE, as it is and with possessive repeats.
BYTE_LEVEL = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
    r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s""",
)
PROBES = ["", "It's  we'll\n\n 12345 x_y?!\t end ", "naïve façade 東京 \u00a0\u2003x", "aaaaaaaaaaaaaaaa" * 9, "\r\n\x00 \U0001f600\u200d"]
_ENCODERS: dict[int, object] = {}  # of this worker, by the vocabulary's checksum


def cached_encoder(spec: bytes):
    key = zlib.crc32(spec)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = encoder(spec)
    return _ENCODERS[key]


def encoder(spec: bytes):
    """text list -> list of id bytes (little-endian uint32), by a tokenizers file of byte-level BPE.

    Where the file's merges are in the order of the ids of what they make, nothing else changes the text or the merging,
    and the pattern of matches is the library's own, ids are ranks and the faster tiktoken engine gives the same ids, which
    a few probes confirm; otherwise the tokenizers library encodes.
    """
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(spec.decode())
    j = json.loads(spec)
    pre = j.get("pre_tokenizer") or {}
    made = [j["model"]["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in j["model"].get("merges", [])]
    plain = (
        pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        and not j.get("normalizer") and made == sorted(made) and j["model"].get("type", "BPE") == "BPE"
        and not any(j["model"].get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    )
    specials = [t["content"] for t in j.get("added_tokens", [])]

    def slow(texts):
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in tok.encode_batch(texts, add_special_tokens=False)]

    import public_tokenizers
    import tiktoken

    if not plain or sys.byteorder != "little" or array("I").itemsize != 4 or public_tokenizers.PATTERN not in BYTE_LEVEL:
        return slow

    units = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the bytes that stand for themselves
    rest = [b for b in range(256) if b not in units]
    byte = {chr(u): u for u in units} | {chr(256 + n): b for n, b in enumerate(rest)}
    ranks = {bytes(byte[c] for c in t): i for t, i in j["model"]["vocab"].items() if t not in specials}
    enc = tiktoken.Encoding("from_json", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    cache: dict[str, bytes] = {}

    def fast(texts):
        out = []
        for t in texts:
            if any(s in t for s in specials):  # such a string is one id, as the library has it
                out += slow([t])
                continue
            pieces = cut(t)
            for p in set(pieces).difference(cache):
                cache[p] = array("I", enc.encode_ordinary(p)).tobytes()
            out.append(b"".join([cache[p] for p in pieces]))
            if len(cache) > CACHE:
                cache.clear()
        return out

    return fast if fast(PROBES) == slow(PROBES) else slow


def tokenized_pieces(docs: DataFrame, spec: bytes, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, text -> doc_id, piece, start, length, ids_crc32: each document's ids plus the end id, cut if over capacity.

    A longer document has full pieces at its end; the first piece takes what is left over.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = cached_encoder(shipped.value), np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = encode([text if isinstance(text, str) else ""])[0] + end
                n, at, piece = len(ids) // 4, 0, 0
                first = (n - 1) % capacity + 1
                while at < n:
                    size = first if at == 0 else capacity
                    rows.append((doc, piece, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])))
                    at, piece = at + size, piece + 1
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def bounds(capacity: int) -> list[tuple[int, int]]:
    """Classes (over, up to) of lengths, the longest first: about so many of a class fill a sequence."""
    cuts, n = [capacity], 2
    while cuts[-1] > 1:
        cuts.append(min(cuts[-1] - 1, capacity // n))
        n += max(1, n // 2) if n < 16 else n
    return list(zip([*cuts[1:], 0], cuts, strict=True))


def nested(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of documents (0) and slots (1) in order: matched documents, their slots, slots left over, documents left over.

    A slot takes the last document that waits, as a bracket closes the last one open.
    """
    depth = np.cumsum(np.where(kind == 0, 1, -1))
    low = np.minimum(np.minimum.accumulate(depth), 0) if len(depth) else depth
    spare = (kind == 1) & (low < np.concatenate(([0], low[:-1])))
    depth = depth - low
    level = np.where(kind == 0, depth, depth + 1)
    at = np.flatnonzero(~spare)
    order = at[np.argsort(level[at], kind="stable")]  # each level holds documents and slots in turn
    pair = np.flatnonzero((kind[order[:-1]] == 0) & (kind[order[1:]] == 1) & (level[order[:-1]] == level[order[1:]]))
    docs, slots = order[pair], order[pair + 1]
    waiting = kind == 0
    waiting[docs] = False
    return docs, slots, np.flatnonzero(spare), np.flatnonzero(waiting)


SWEPT = "p int, kind int, rank long, row long, length long, seq long, slot long, gap long"


def swept(items: DataFrame, tasks: int) -> DataFrame:
    """One superstep's sweep of (size, kind, row, seq, slot, gap): matched rows (kind 2), and with their rank in task p documents (0) and slots (1) left over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if rows is None or not rows.num_rows:
            return
        size, kind, row, seq, slot, gap = (rows.column(c).to_numpy() for c in ("size", "kind", "row", "seq", "slot", "gap"))
        docs, slots, spare, waiting = nested(kind)
        p = TaskContext.get().partitionId()
        for k, d, s in ((2, docs, slots), (1, spare, spare), (0, waiting, waiting)):
            columns = (np.full(len(d), p, np.int32), np.full(len(d), k, np.int32), np.arange(len(d)), row[d], size[d], seq[s], slot[s], gap[s])
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["p", "kind", "rank", "row", "length", "seq", "slot", "gap"])

    key = ["size", "kind", "salt"]
    salted = items.withColumn("salt", F.xxhash64("row", "seq", "slot"))
    ranged = salted.repartitionByRange(tasks, *key) if tasks > 1 else salted.repartition(1)
    return ranged.sortWithinPartitions(*key).drop("salt").mapInArrow(run, SWEPT)


def between(left: dict[int, tuple[int, int]]) -> tuple[list[tuple[int, int, int, int]], dict[int, int]]:
    """{task: (slots, documents) left over} -> matches between tasks as (task, kind, first rank, how many, first number), and the documents of each that stay.

    The same stack over the tasks in order: a task's slots take documents of the nearest task before it that has some.
    The documents that stay are those of the lowest ranks.
    """
    out, stack, number = [], [], 0
    for p in sorted(left):
        slots, docs = left[p]
        at = 0
        while at < slots and stack:
            q, free = stack[-1]
            n = min(free, slots - at)
            out += [(q, 0, free - n, n, number), (p, 1, at, n, number)]
            number, at = number + n, at + n
            stack[-1] = (q, free - n)
            if free == n:
                stack.pop()
        if docs:
            stack.append((p, docs))
    return out, dict(stack)


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to rows with a `length` of 1 to capacity."""
    spark = pieces.sparkSession
    work = Scratch(spark, "pack")
    rows = work.stored(pieces.select(F.monotonically_increasing_id().alias("row"), F.col("length").cast("long").alias("n"), F.struct("*").alias("piece")), "pieces")
    classes = bounds(capacity)
    of_class = F.lit(len(classes) - 1)
    for k in range(len(classes) - 2, -1, -1):
        of_class = F.when(F.col("n") > classes[k][0], k).otherwise(of_class)
    counts = {r["c"]: r["count"] for r in rows.groupBy(of_class.alias("c")).count().collect()}  # a row a class
    gaps, opened, placed = spark.createDataFrame([], "seq long, gap long"), 0, []
    for k in sorted(counts):
        over, upto = classes[k]
        docs, left = rows.where((F.col("n") > over) & (F.col("n") <= upto)).select("row", F.col("n").alias("length")), counts[k]
        while left:
            slots = gaps.where(F.col("gap") > over).withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(1), F.floor(F.col("gap") / upto)) - 1)))
            slots = slots.select(F.least("gap", F.lit(upto).cast("long")).alias("size"), F.lit(1).alias("kind"), F.lit(-1).cast("long").alias("row"), "seq", "slot", "gap")
            none = F.lit(-1).cast("long")
            items = docs.select(F.col("length").alias("size"), F.lit(0).alias("kind"), "row", none.alias("seq"), none.alias("slot"), none.alias("gap"))
            sweep = work.stored(swept(items.unionByName(slots), max(1, -(-(left + opened) // RANGE))), "swept")
            found = sweep.groupBy("p", "kind").agg(F.count("*").alias("n"), F.max("length").alias("top")).collect()  # three rows a task
            count = {(r["p"], r["kind"]): r["n"] for r in found}
            crossing, stay = between({p: (count.get((p, 1), 0), count.get((p, 0), 0)) for p, _ in count})
            matched = sum(n for (_, kind), n in count.items() if kind == 2) + sum(c[3] for c in crossing if c[1] == 0)
            left = sum(stay.values())
            own = sweep.where("kind = 2").select("row", "length", "seq", "slot", "gap")
            ranks = spark.createDataFrame(crossing, "p int, kind int, first long, many long, number long") if crossing else None
            if ranks is not None:  # at most four rows a task
                met = sweep.join(F.broadcast(ranks), ["p", "kind"]).where("rank >= first and rank < first + many").withColumn("number", F.col("number") + F.col("rank") - F.col("first"))
                own = own.unionByName(met.where("kind = 0").select("number", "row", "length").join(met.where("kind = 1").select("number", "seq", "slot", "gap"), "number").drop("number"))
            fresh = 0
            if left:
                start, total = [], 0
                for p in sorted(stay, reverse=True):
                    start.append((p, stay[p], total))
                    total += stay[p]
                rest = sweep.where("kind = 0").join(F.broadcast(spark.createDataFrame(start, "p int, stays long, start long")), "p").where("rank < stays")  # a row a task
                if matched * FEW < left:
                    each = capacity // max(r["top"] for r in found if r["kind"] == 0)
                    fresh, left = -(-left // each), 0
                    place = F.col("start") + F.col("stays") - 1 - F.col("rank")
                    own = own.unionByName(rest.select("row", "length", (F.lit(opened) + F.floor(place / each)).alias("seq"), (place % each).alias("slot"), F.lit(capacity).cast("long").alias("gap")))
            step = work.stored(spark.sql("select row, length, seq, :capacity - gap + sum(length) over (partition by seq order by slot) - length as offset from {own}", args={"capacity": capacity}, own=own), "placed")
            placed.append(step)
            if fresh:
                gaps = gaps.unionByName(spark.range(opened, opened + fresh).select(F.col("id").alias("seq"), F.lit(capacity).cast("long").alias("gap")))
                opened += fresh
            taken = step.groupBy("seq").agg(F.sum("length").alias("taken"))
            gaps = work.stored(gaps.join(taken, "seq", "left").select("seq", (F.col("gap") - F.coalesce("taken", F.lit(0))).alias("gap")).where("gap > 0"), "gaps")
            docs = rest.select("row", "length") if left else None
    if not placed:
        return pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    at = placed[0]
    for x in placed[1:]:
        at = at.unionByName(x)
    out = rows.join(at.select("row", F.col("seq").alias("sequence_id"), "offset"), "row").select("piece.*", "sequence_id", "offset")
    return work.keep(out)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece of every (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the end id alone. Repeated rows are packed as often as they occur, ties in any
    order; an empty table packs into nothing. Other columns are ignored, whatever their names.
    """
    return pack(tokenized_pieces(docs, read_bytes(docs.sparkSession, tokenizer_path), capacity, end_id), capacity)
