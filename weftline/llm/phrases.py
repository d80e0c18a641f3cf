"""Phrase collocations by contiguous pattern growth.

Every occurrence of a prefix word is a pointer to what stands right of it. A first pass over the texts counts pairs of
neighbours by hash and makes a sieve of the frequent ones; a phrase is frequent only if all its pairs are, so a second
pass cuts each pointer's words before the first pair that the sieve holds back, and equal pointers are counted together
before and after they move. A prefix's pointers, sorted, meet in one task (very frequent prefixes in several, by the
next word), which extends the prefix to the right depth first: what a branch holds is known when the sweep leaves it, so
a task keeps one path of the tree and no list of pointers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import Scratch
from weftline.llm.words import _power, mix

#: Bytes of text that are worked on together.
GROUP = 3_000_000
#: Tasks that a prefix's pointers are dealt to, by the next word.
BLOCKS = 64
#: The sieve has up to 2^28 bits (32 MB), whatever the table's size; where it gets full, more pointers pass and the counts stay exact.
SIEVE_BITS = 28
#: Lists that a ranking is first made in, for each lang.
HEAPS = 64
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_BREAKS = bytes(np.flatnonzero(_KIND == 2).astype(np.uint8))
_TO_NEWLINE = bytes.maketrans(_BREAKS, b"\n" * len(_BREAKS))


class Occurrences:
    """All word occurrences of some texts: where they are, 64-bit hashes (with the lang), and whether the next one is a neighbour.

    `langs` are the texts' langs as places in `salts`, which has a hash for each.
    """

    def __init__(self, texts: list[bytes], langs: np.ndarray, salts: np.ndarray):
        self.buf = np.frombuffer((b"\n".join(texts) + b"\n").lower(), np.uint8)
        kind = _KIND[self.buf]
        gap = kind > 0
        before = np.concatenate(([True], gap[:-1]))
        self.start, self.end = np.flatnonzero(~gap & before), np.flatnonzero(gap & ~before)
        n = len(self.start)
        power, inverse = _power(len(self.buf))
        total = np.zeros(len(self.buf) + 1, np.uint64)
        np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * power, out=total[1:])
        text_end = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        self.lang = langs[np.searchsorted(text_end, self.start, side="right")]
        self.hash = mix((total[self.end] - total[self.start]) * inverse[self.start] + (self.end - self.start).astype(np.uint64))
        self.hash = mix(self.hash ^ salts[self.lang])
        piece = np.cumsum(kind == 2)[self.start]
        self.joined = np.zeros(n, bool)
        self.joined[:-1] = piece[1:] == piece[:-1]

    def pair(self) -> np.ndarray:
        """A hash of each occurrence and the next one."""
        after = np.concatenate((self.hash[1:], np.zeros(1, np.uint64))) if len(self.hash) else self.hash
        return mix(self.hash * np.uint64(0x9FB21C651E98DF25) + after)

    def spelled(self, first: np.ndarray, words: int) -> pa.Array:
        """The words at `first` and after, `words` of each, with single spaces between."""
        at = (first[:, None] + np.arange(words)).ravel()
        size = self.end[at] - self.start[at]
        size[np.arange(len(at)) % words < words - 1] += 1  # with the space after it
        ends = np.cumsum(size)
        take = np.repeat(self.start[at] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        data = self.buf[take]
        if words > 1:
            data[ends[np.arange(len(at)) % words < words - 1] - 1] = 0x20
        offsets = np.concatenate(([0], ends[words - 1 :: words])).astype(np.int32)
        return pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _parts(text: bytes) -> Iterator[bytes]:
    """A long text in parts that end where a piece ends."""
    at = 0
    breaks = text.translate(_TO_NEWLINE) if len(text) > GROUP else b""
    while len(text) - at > GROUP:
        end = breaks.rfind(b"\n", at, at + GROUP)
        if end < 0 and (end := breaks.find(b"\n", at)) < 0:
            break
        yield text[at:end]
        at = end + 1
    yield text[at:]


def _grouped(batches, number: dict[str, int]) -> Iterator[Occurrences]:
    """The occurrences of GROUP bytes of texts at a time; `number` gets the langs met."""
    texts, langs, size = [], [], 0

    def group():
        salts = [int.from_bytes(hashlib.blake2b(k.encode(), digest_size=8).digest(), "little") for k in number]
        return Occurrences(texts, np.array(langs), np.array(salts, np.uint64))

    for batch in batches:
        for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist(), strict=True):
            b = text.as_buffer().to_pybytes() if text.is_valid else b""
            code = number.setdefault(lang, len(number))
            for part in _parts(b):
                if texts and size + len(part) > GROUP:
                    yield group()
                    texts, langs, size = [], [], 0
                texts.append(part)
                langs.append(code)
                size += len(part)
    if texts:
        yield group()


def _pairs(batches):
    """pair, n: how often each pair of neighbours occurs, by hash."""
    number: dict[str, int] = {}
    for o in _grouped(batches, number):
        pair = o.pair()[o.joined]
        value, n = np.unique(pair, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n)], ["pair", "n"])


class Sieve:
    """One bit for each hash; those of frequent pairs are set."""

    def __init__(self, bits: int, data: bytes | None = None):
        self.shift = np.uint64(64 - bits)
        self.bits = np.frombuffer(data, np.uint8) if data is not None else np.zeros(1 << bits >> 3, np.uint8)

    def passes(self, pair: np.ndarray) -> np.ndarray:
        slot = pair >> self.shift
        return (self.bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def sieve_of(frequent: DataFrame) -> tuple[int, bytes]:
    """The bits of all frequent pairs, made in slices by the tasks: at most 2^SIEVE_BITS of them reach the driver."""
    bits = min(SIEVE_BITS, max(13, (16 * frequent.count()).bit_length()))
    slices = min(1 << 8, 1 << (bits - 13))
    size = (1 << bits) // slices // 8

    def fill(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            slot = b.column("pair").to_numpy().view(np.uint64) >> np.uint64(64 - bits)
            for k in np.unique(slot // np.uint64(size * 8)).tolist():
                own = (slot[slot // np.uint64(size * 8) == k] - np.uint64(k * size * 8)).astype(np.int64)
                np.bitwise_or.at(held.setdefault(k, np.zeros(size, np.uint8)), own >> 3, (1 << (own & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["slice", "bits"])

    slot = F.shiftrightunsigned("pair", 64 - (slices.bit_length() - 1)) if slices > 1 else F.lit(0)
    dealt = frequent.select("pair").withColumn("slice", slot).repartition("slice").drop("slice")
    out = np.zeros(slices * size, np.uint8)
    for r in dealt.mapInArrow(fill, "slice int, bits binary").collect():
        out[r["slice"] * size : (r["slice"] + 1) * size] |= np.frombuffer(bytes(r["bits"]), np.uint8)
    return bits, out.tobytes()


def _pointers(sieve, longest: int):
    """lang, phrase, n: each word alone, and with each run of words right of it that the sieve lets through."""

    def run(batches):
        bits, data = sieve.value
        known, number = Sieve(bits, data), {}
        for o in _grouped(batches, number):
            n = len(o.start)
            if not n:
                continue
            names = pa.array(list(number))
            go = o.joined & known.passes(o.pair())
            reach = np.zeros(n, np.int64)
            for _ in range(longest - 1):  # one more where the next word follows and reaches as far as so far
                reach[:-1] = np.where(go[:-1], np.minimum(reach[1:] + 1, longest - 1), 0)
                reach[-1] = 0
            _, first, word, count = np.unique(o.hash, return_index=True, return_inverse=True, return_counts=True)

            def rows(first, count, words):
                return pa.RecordBatch.from_arrays([names.take(pa.array(o.lang[first])), o.spelled(first, words), pa.array(count.astype(np.int64))], ["lang", "phrase", "n"])

            yield rows(first, count, 1)
            for words in range(1, longest):
                at = np.flatnonzero(reach == words)
                if not len(at):
                    continue
                key = word[at]
                for j in range(1, words + 1):  # a number for each different run of words
                    _, key = np.unique(key * (int(word.max()) + 1) + word[at + j], return_inverse=True)
                _, which, count = np.unique(key, return_index=True, return_counts=True)
                yield rows(at[which], count, words + 1)

    return run


def _grow(least: int):
    """lang, phrase, words, a: the frequent phrases of two words and more in sorted pointers."""

    def extend(phrase: list[bytes], pointers, depth: int, out: list) -> int:
        """Grow `phrase` by each next word of its pointers, depth first; gives how often it occurs."""
        total = 0
        for word, run in groupby(pointers, key=lambda p: p[0][depth] if depth < len(p[0]) else None):
            if word is None:
                total += sum(n for _, n in run)
                continue
            longer = [*phrase, word]
            a = extend(longer, run, depth + 1, out)
            if a >= least:
                out.append((b" ".join(longer), len(longer), a))
            total += a
        return total

    def rows(batches):
        for b in batches:
            for lang, phrase, n in zip(b.column("lang").to_pylist(), b.column("phrase").to_pylist(), b.column("n").to_pylist(), strict=True):
                told = phrase.split(b" ")
                yield (lang, told[0]), (told, n)

    def run(batches):
        langs, found = [], []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array([p for p, _, _ in found], pa.binary()), pa.array([k for _, k, _ in found], pa.int32()), pa.array([a for _, _, a in found], pa.int64())], ["lang", "phrase", "words", "a"])

        for (lang, head), group in groupby(rows(batches), key=lambda r: r[0]):
            before = len(found)
            extend([head], (p for _, p in group), 1, found)
            langs.extend([lang] * (len(found) - before))
            if len(found) > 10_000:
                yield batch()
                langs, found = [], []
        yield batch()

    return run


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, inside: int = 50, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of 2 to `longest` words of each lang of (lang, text).

    Words, pieces, counts, cuts, scores and ties are those of the operator's contract; `inside` is the share (per cent) at
    which a longer candidate takes out the candidates in it. A null lang is `und`, together with rows that say so; null
    and empty texts have no words; a repeated row counts as often as it is there. Other columns are ignored, whatever
    their names; an empty table, or a lang without candidates, has no rows. Words that share a 64-bit hash within
    GROUP bytes of text would be counted as one, with a probability of about 1e-9 for each group.
    """
    spark = docs.sparkSession
    work = Scratch(spark, "phrases")
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    pairs = texts.mapInArrow(_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    sieve = spark.sparkContext.broadcast(sieve_of(work.stored(pairs.select("pair"), "pairs")))
    del pairs
    spark._jvm.System.gc()  # Spark removes the pairs' shuffle files once the driver has let go of them
    pointers = texts.mapInArrow(_pointers(sieve, longest), "lang string, phrase string, n long")
    pointers = work.stored(pointers.groupBy("lang", "phrase").agg(F.sum("n").alias("n")), "pointers")

    block = F.pmod(F.xxhash64(F.substring_index("phrase", " ", 2)), F.lit(BLOCKS))
    tails = pointers.where(F.instr("phrase", " ") > 0).repartition("lang", F.substring_index("phrase", " ", 1), block)
    tails = tails.select("lang", F.col("phrase").cast("binary").alias("phrase"), "n")
    tails = tails.sortWithinPartitions("lang", F.concat("phrase", F.lit(b" ")))  # words end in a space, so that equal ones stay together
    grown = tails.mapInArrow(_grow(least), "lang string, phrase binary, words int, a long")
    phrases = work.stored(grown.withColumn("phrase", F.col("phrase").cast("string")), "phrases")
    words = pointers.where(F.instr("phrase", " ") == 0).select("lang", "phrase", F.col("n").alias("a"))
    totals = words.groupBy("lang").agg(F.sum("a").alias("n"))
    counts = words.where(F.col("a") >= least).unionByName(phrases.select("lang", "phrase", "a"))

    told = F.split("phrase", " ")
    longer = phrases.where("words > 2").select("lang", "a", "words", told.alias("told"))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("words") - k + 1), lambda s: F.array_join(F.slice("told", s, k), " "))))
    around = longer.select("lang", "a", F.explode(spans).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    kept = phrases.join(around, ["lang", "phrase"], "left").where(F.col("around").isNull() | (F.col("around") * 100 < F.col("a") * inside))

    def side(k, n):
        return F.array_join(F.slice("told", k, n), " ")

    cuts = kept.select("lang", "phrase", "words", "a", told.alias("told")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", side(F.lit(1), F.col("k")).alias("first"), side(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l")), ["lang", "first"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"])
    score = F.expr("(1000000BD * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    scored = cuts.select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut"))
    scored = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("heap", F.pmod(F.xxhash64("phrase"), F.lit(HEAPS)))
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    some = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "heap").orderBy(*best))).where(F.col("rank") <= top).drop("heap")
    first = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return work.keep(first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
