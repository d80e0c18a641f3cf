"""Context-tree weighting over bytes, next to a smoothed unigram base.

A text is the bytes of its lower-cased words, joined by single spaces, and an end byte, so that its probability is
that of its token sequence. Each byte is eight binary decisions; every decision (node of the byte's bit tree) has
a context tree over the DEPTH bytes before it. A context's block probability is half its Krichevsky-Trofimov
estimate and half the product of its longer contexts' block probabilities; from those follow the weight `beta`
that its own estimate has against the longer contexts, and the coded probability of a bit.

The corpus is counted as byte strings of DEPTH + 1 and as words, all of them. Strings that share their SHARED nearest
context bytes share all nodes from that level down, so these are computed together, and the few nodes above them
level by level. A context that isn't there ends the mixture at the one before it. Every string of the texts to score
is coded once, with every node. The most frequent strings' scores are sent to the executors, at most 2 ** BITS; the
other strings, and the words that the (equally bounded) table of word counts lacks, are looked up by a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, fold, stored
from weftline.llm.words import Words, grouped

DEPTH, SHARED, BITS, WORD_BITS = 6, 3, 22, 20
END, SPACE = 0x0A, 0x20
#: The key of the end token among word hashes.
END_KEY = 0
#: Distinct counts a task holds before it hands them on.
HELD = 2_000_000
#: Counts it hands on at a time.
HANDED = 1 << 17


def stream(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The coded bytes of all texts, end to end, and the texts' bounds in them."""
    buf = words.buf.copy()
    keep = np.zeros(len(buf), bool)
    inside = np.zeros(len(buf) + 1, np.int8)
    inside[words.start] += 1
    inside[words.end] -= 1
    keep[:] = np.cumsum(inside[:-1]) > 0
    last = np.zeros(len(words.end), bool)
    nonempty = np.flatnonzero(np.diff(words.bound))
    last[words.bound[1:][nonempty] - 1] = True
    gaps = words.end[~last]
    keep[gaps], buf[gaps] = True, SPACE
    ends = words.text_end - 1
    keep[ends], buf[ends] = True, END
    return buf[keep], np.concatenate(([0], np.cumsum(keep)[ends]))


def codes(data: np.ndarray, bound: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Each byte with the `depth` bytes before it, the nearest lowest; END stands before a text's start."""
    padded = np.full(len(data) + depth * (len(bound) - 1) + 8, END, np.uint8)
    at = np.arange(len(data)) + np.repeat(depth * np.arange(1, len(bound)), np.diff(bound))
    padded[at + 7] = data  # so that the eight bytes from `at` on end with it
    windows = np.ndarray(len(padded) - 7, ">u8", padded, strides=(1,))
    return (windows[at] & np.uint64((1 << 8 * (depth + 1)) - 1)).astype(np.int64)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k)
    k, n = k[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.empty(0, np.int64)
    return k[first], np.add.reduceat(n, first) if len(first) else n


def corpus_counts(docs: DataFrame) -> DataFrame:
    """kind (0: byte strings, 1: words, 2: byte strings of texts that are held_out, if there is such a column), key, n over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = (([], []), ([], []), ([], []))

        def out(kind, keys, counts):
            for at in range(0, len(keys), HANDED):
                k, n = keys[at : at + HANDED], counts[at : at + HANDED]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(n)], names=["kind", "key", "n"])

        for batch in batches:
            for out_of_fold in (False, True):
                mine = batch.column(0).filter(pc.equal(batch.column(1), out_of_fold)).to_pylist()
                for _, texts in grouped(mine):
                    words = Words(texts)
                    found = [(2 if out_of_fold else 0, codes(*stream(words)))]
                    if not out_of_fold:
                        found.append((1, words.hash.view(np.int64)))
                        held[1][0].append(np.array([END_KEY], np.int64))
                        held[1][1].append(np.array([len(texts)], np.int64))
                    for kind, x in found:
                        x = np.sort(x)
                        first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.empty(0, np.int64)
                        keys, counts = held[kind]
                        keys.append(x[first])
                        counts.append(np.diff(np.concatenate((first, [len(x)]))).astype(np.int64))
                        if sum(map(len, keys)) > HELD:
                            keys[:], counts[:] = ([v] for v in _summed(keys, counts))
                            if len(keys[0]) > HELD // 2:
                                yield from out(kind, keys.pop(), counts.pop())
        for kind, (keys, counts) in enumerate(held):
            if keys:
                yield from out(kind, *_summed(keys, counts))

    texts = docs.select("text", F.col("held_out") if "held_out" in docs.columns else F.lit(False).alias("held_out"))
    return texts.mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x of one half and more."""
    y = x + 8.0
    shift = np.ones_like(y)
    for k in range(8):
        shift = shift * (x + k)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log block probability of so many zeros and ones by the Krichevsky-Trofimov estimator."""
    a, b = zeros.astype(float), ones.astype(float)
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1) - math.log(math.pi)


def weigh(zeros, ones, below) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log block probability, beta, probability of a one); below: the sum over longer contexts, nan for none."""
    own = log_kt(zeros, ones)
    leaf = np.isnan(below)
    mixed = np.logaddexp(own, np.where(leaf, own, below)) - math.log(2)
    total = np.where(leaf, own, mixed)
    beta = np.where(leaf, 1.0, np.exp(np.minimum(own - math.log(2) - total, 0)))
    return total, beta, (ones + 0.5) / (zeros + ones + 1.0)


def _nodes_of(group: np.ndarray, inverse: np.ndarray, zeros, ones, below=None):
    n = len(group)
    z, o = (np.bincount(inverse, v, minlength=n) for v in (zeros, ones))
    return (z, o, *weigh(z, o, np.full(n, np.nan) if below is None else np.bincount(inverse, below, minlength=n)))


NODE = "depth int, key long, zeros double, ones double, total double, beta double, p double"


def _deep_nodes(code: np.ndarray, n: np.ndarray, depth: int, top: int) -> list[pd.DataFrame]:
    """The nodes of levels `depth` to `top`, from all strings that share the nearest `top` bytes of their contexts."""
    symbol, context = code & 0xFF, code >> 8
    node, bit, weight, at = [], [], [], []
    for k in range(8):
        node.append((1 << k) | (symbol >> (8 - k)))
        bit.append((symbol >> (7 - k)) & 1)
        weight.append(n)
        at.append(context)
    bit, weight = np.concatenate(bit), np.concatenate(weight).astype(float)
    key = np.concatenate(at) << 8 | np.concatenate(node)
    out, zeros, ones, below = [], weight * (1 - bit), weight * bit, None
    for d in range(depth, top - 1, -1):
        group, inverse = np.unique(key, return_inverse=True)
        z, o, total, beta, p = _nodes_of(group, inverse, zeros, ones, below)
        out.append(pd.DataFrame({"depth": np.int32(d), "key": group, "zeros": z, "ones": o, "total": total, "beta": beta, "p": p}))
        zeros, ones, below = z, o, total
        key = (group >> 8 & ((1 << 8 * max(d - 1, 0)) - 1)) << 8 | (group & 0xFF)
    return out


def _together(strings: DataFrame) -> DataFrame:
    """Counts of strings, those that share their nearest context bytes one after the other in a partition."""
    shared = F.shiftright("key", 8).bitwiseAND((1 << 8 * SHARED) - 1).alias("shared")
    return strings.select(shared, "kind", "key", "n").repartition("shared").sortWithinPartitions("shared")


def _whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of whole values of `shared`."""
    held = None
    for batch in batches:
        held = batch if held is None else pd.concat([held, batch], ignore_index=True)
        whole = int(np.searchsorted(held["shared"], held["shared"].iloc[-1])) if len(held) else 0
        if whole > 50_000:
            yield held.iloc[:whole]
            held = held.iloc[whole:]
    if held is not None and len(held):
        yield held


def tree(counts: DataFrame, depth: int = DEPTH, upper: bool = False, store=stored) -> DataFrame:
    """The nodes of the weighted tree: depth, key (context << 8 | node of the bit tree), zeros, ones, total, beta, p.

    All of them, or with `upper` those of contexts shorter than SHARED.
    """

    def deep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in _whole(batches):
            yield from _deep_nodes(x["key"].to_numpy(), x["n"].to_numpy(), depth, SHARED)[-1 if upper else 0 :]

    levels = [store(_together(counts.where("kind = 0")).mapInPandas(deep, NODE), "nodes")]

    def shallow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            total, beta, p = weigh(x["zeros"].to_numpy(), x["ones"].to_numpy(), x["below"].to_numpy())
            yield x[["depth", "key", "zeros", "ones"]].assign(total=total, beta=beta, p=p)

    last = levels[0].where(F.col("depth") == SHARED)
    for d in range(SHARED - 1, -1, -1):
        parent = (F.shiftright("key", 8).bitwiseAND((1 << 8 * d) - 1) * 256 + F.col("key").bitwiseAND(255)).alias("key")
        up = last.groupBy(parent).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("total").alias("below"))
        last = store(up.select(F.lit(d).alias("depth"), "key", "zeros", "ones", "below").mapInPandas(shallow, NODE), "nodes")
        levels.append(last)
    out, *rest = levels[1:] if upper else levels
    for x in rest:
        out = out.unionByName(x)
    return out


Level = tuple[np.ndarray, np.ndarray, np.ndarray]


def _level(key: np.ndarray, p: np.ndarray, beta: np.ndarray) -> Level:
    order = np.argsort(key)
    return key[order], p[order], beta[order]


def slot_table(nodes: DataFrame) -> list[Level]:
    """Sorted keys, p and beta of each level of these nodes, in one place: of the upper ones at most 255 for each byte pair."""
    x = nodes.select("depth", "key", "p", "beta").toArrow()
    depth, key, p, beta = (x.column(c).to_numpy() for c in ("depth", "key", "p", "beta"))
    return [_level(key[depth == d], p[depth == d], beta[depth == d]) for d in range(DEPTH + 1)]


def log10_of(code: np.ndarray, model: list[Level], depth: int = DEPTH) -> np.ndarray:
    """Log10 of the probability of each string's last byte after the bytes before it."""
    symbol, context = code & 0xFF, code >> 8
    out = np.zeros(len(code))
    for k in range(8):
        node = (1 << k) | (symbol >> (8 - k))
        bit = (symbol >> (7 - k)) & 1
        p, rest = np.full(len(code), 0.5), np.ones(len(code))
        mixed = np.zeros(len(code))
        on = np.arange(len(code))
        for d, (keys, p_of, beta_of) in enumerate(model[: depth + 1]):
            want = ((context[on] & ((1 << 8 * d) - 1)) << 8) | node[on]
            at = np.searchsorted(keys, want)
            hit = at < len(keys)
            hit[hit] = keys[at[hit]] == want[hit]
            on, at = on[hit], at[hit]
            if not len(on):
                break
            p[on] = p_of[at]  # where the next context is missing, this estimate takes all the rest
            mixed[on] += rest[on] * beta_of[at] * p[on]
            rest[on] *= 1 - beta_of[at]
        one = mixed + rest * p
        out += np.log10(np.where(bit == 1, one, 1 - one))
    return out


def string_scores(counts: DataFrame, store=stored) -> DataFrame:
    """key, seen, score: log10 of the probability of each string in the texts, and how often it stands there."""
    upper = counts.sparkSession.sparkContext.broadcast(slot_table(tree(counts, upper=True, store=store)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in _whole(batches):
            code, inverse = np.unique(x["key"], return_inverse=True)
            seen = np.bincount(inverse, x["n"]).astype(np.int64)
            n = np.bincount(inverse, x["n"].where(x["kind"] == 0, 0)).astype(np.int64)
            deep = _deep_nodes(code[n > 0], n[n > 0], DEPTH, SHARED)[::-1]
            model = upper.value[:SHARED] + [(g["key"].to_numpy(), g["p"].to_numpy(), g["beta"].to_numpy()) for g in deep]
            yield pd.DataFrame({"key": code, "seen": seen, "score": log10_of(code, model)})

    return store(_together(counts.where("kind <> 1")).mapInPandas(run, "key long, seen long, score double"), "strings")


def string_table(scores: DataFrame, most: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The count from which strings are in the table, with at most `most` of them; their sorted keys and scores."""
    sizes = scores.groupBy("seen").count().toArrow()
    seen, count = sizes.column("seen").to_numpy(), sizes.column("count").to_numpy()
    order = np.argsort(-seen)
    fit = int(np.searchsorted(np.cumsum(count[order]), most, "right"))
    least = int(seen[order][fit - 1]) if fit else 1 << 62
    found = scores.where(F.col("seen") >= least).select("key", "score").toArrow()
    key, score = found.column("key").to_numpy(), found.column("score").to_numpy()
    order = np.argsort(key)
    return least, key[order], score[order]


def word_table(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """key and count of the most frequent word in each of 2 ** WORD_BITS slots; count 0 for none."""
    slot = F.col("key").bitwiseAND((1 << WORD_BITS) - 1).cast("int")
    best = counts.where("kind = 1").groupBy(slot.alias("slot")).agg(F.max(F.struct("n", "key")).alias("b")).select("slot", "b.key", "b.n").toArrow()
    key, n = np.zeros(1 << WORD_BITS, np.int64), np.zeros(1 << WORD_BITS, np.int64)
    at = best.column("slot").to_numpy()
    key[at], n[at] = best.column("key").to_numpy(), best.column("n").to_numpy()
    return key, n


def score_documents(docs: DataFrame, modulus: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of (doc_id, text).

    Learns from the rows whose crc32(doc_id) mod `modulus` isn't 0. Null and empty texts are the end token alone;
    repeated rows count and are scored each. Without training rows every bit has probability one half and the
    base is 0. Other columns are ignored, whatever their names; an empty table has an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (fold("doc_id", modulus) == 0).alias("held_out"))
    work = Scratch(spark, "ctw")
    counts = work.stored(corpus_counts(docs), "counts")
    sums = counts.where("kind = 1").agg(F.sum("n"), F.count("*")).first()
    total, distinct = int(sums[0] or 0), int(sums[1])
    below = total + 0.1 * (distinct + 1)
    strings = string_scores(counts, work.stored)
    least, *table = string_table(strings, 1 << BITS)
    shipped = spark.sparkContext.broadcast((*table, *word_table(counts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        string_key, string_score, word_key, word_n = shipped.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for first, texts in grouped(batch.column(1).to_pylist()):
                words, m = Words(texts), len(texts)
                data, bound = stream(words)
                code, inverse = np.unique(codes(data, bound), return_inverse=True)
                at = np.searchsorted(string_key, code)
                there = at < len(string_key)
                there[there] = string_key[at[there]] == code[there]
                value = np.zeros(len(code))
                value[there] = string_score[at[there]]
                score = np.add.reduceat(value[inverse], bound[:-1])
                lost = np.flatnonzero(~there[inverse])
                lost_end = np.searchsorted(lost, bound[1:])
                key = words.hash.view(np.int64)
                # the end token as one more word of each text
                key = np.insert(key, words.bound[1:], END_KEY)
                ends = words.bound[1:] + np.arange(1, m + 1)
                starts = np.concatenate(([0], ends[:-1]))
                slot = key & ((1 << WORD_BITS) - 1)
                hit = (word_key[slot] == key) & (word_n[slot] > 0)
                logs = np.where(hit, np.log10((np.where(hit, word_n[slot], 0) + 0.1) / below), 0.0)
                rare = np.flatnonzero(~hit)
                rare_end = np.searchsorted(rare, ends)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + m)), batch.column(0).slice(first, m), batch.column(2).slice(first, m),
                        pa.array((ends - starts).astype(np.int64)), pa.array(np.add.reduceat(hit.astype(np.int64), starts)),
                        pa.array(np.add.reduceat(logs, starts)), pa.array(score),
                        pa.ListArray.from_arrays(pa.array(np.concatenate(([0], rare_end)).astype(np.int32)), pa.array(key[rare])),
                        pa.ListArray.from_arrays(pa.array(np.concatenate(([0], lost_end)).astype(np.int32)), pa.array(code[inverse[lost]])),
                    ],
                    names=["row", "doc_id", "held_out", "n_tokens", "hits", "base", "score", "rare", "lost"],
                )
                row += m

    schema = "row long, doc_id long, held_out boolean, n_tokens long, hits long, base double, score double, rare array<long>, lost array<long>"
    scored = work.stored(docs.select("doc_id", "text", "held_out").mapInArrow(run, schema), "scored")
    rare = scored.select("row", F.lit(1).alias("kind"), F.explode("rare").alias("key")).unionByName(scored.select("row", F.lit(0).alias("kind"), F.explode("lost").alias("key")))
    rare = rare.groupBy("row", "kind", "key").agg(F.count("*").alias("tf"))
    values = counts.where("kind = 1").select("kind", "key", F.log10((F.col("n") + F.lit(0.1)) / F.lit(below)).alias("value"))
    values = values.unionByName(strings.where(F.col("seen") < least).select(F.lit(0).alias("kind"), "key", F.col("score").alias("value")))
    word = F.col("kind") == 1
    per_row = rare.join(values, ["kind", "key"], "left").groupBy("row").agg(
        F.sum(F.when(word & F.col("value").isNotNull(), F.col("tf"))).alias("more"),
        F.sum(F.when(word, F.col("tf") * F.coalesce("value", F.log10(F.lit(0.1) / F.lit(below))))).alias("rest"),
        F.sum(F.when(~word, F.col("tf") * F.col("value"))).alias("tail"),
    )
    out = scored.drop("rare", "lost").join(per_row, "row", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("hits") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("tail", F.lit(0.0))).alias("score"),
    )
