"""Text quality by a byte-level convolutional network, in numpy.

A document's UTF-8 bytes are embedded and convolved by learned filters of WIDTH bytes. Each filter is max-pooled in
chunks of two BLOCKs that overlap by one and cover the whole document; a small dense layer reads each chunk, its
units are max-pooled over the chunks and combined into one probability. Fitted by gradient descent on documents'
labels; the maxima pass a gradient only to the windows that reached them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import fold
from weftline.llm.labelled import labelled_sample

DEPTH, WIDTH, STRIDE, FILTERS, UNITS, BLOCK = 6, 8, 2, 24, 16, 64
SLOTS = BLOCK // STRIDE
#: Bytes that are worked on together; a longer document is worked on alone, piece by piece of as many bytes.
GROUP = 200_000


@dataclass
class Net:
    embed: np.ndarray  # 256 x DEPTH
    filters: np.ndarray  # WIDTH * DEPTH x FILTERS
    filter_bias: np.ndarray
    dense: np.ndarray  # FILTERS x UNITS
    dense_bias: np.ndarray
    out: np.ndarray  # UNITS
    out_bias: np.ndarray  # 1
    constant: float | None = None  # the probability of a net without labels of both kinds

    def parts(self):
        return [self.embed, self.filters, self.filter_bias, self.dense, self.dense_bias, self.out, self.out_bias]


def new_net(seed: int = 3) -> Net:
    r = np.random.default_rng(seed)

    def normal(*shape, scale):
        return (r.normal(size=shape) * scale).astype(np.float32)

    return Net(
        normal(256, DEPTH, scale=1.0), normal(WIDTH * DEPTH, FILTERS, scale=(WIDTH * DEPTH) ** -0.5), np.zeros(FILTERS, np.float32),
        normal(FILTERS, UNITS, scale=FILTERS**-0.5), np.zeros(UNITS, np.float32), normal(UNITS, scale=UNITS**-0.5), np.zeros(1, np.float32),
    )


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts end to end, each with zeros up to whole blocks (two at least, and WIDTH zeros), and block bounds."""
    blocks = [max(2, -(-(len(t) + WIDTH) // BLOCK)) for t in texts]
    joined = b"".join(t.ljust(n * BLOCK, b"\0") for t, n in zip(texts, blocks, strict=True))
    return np.frombuffer(joined + b"\0" * WIDTH, np.uint8), np.concatenate(([0], np.cumsum(blocks)))


def convolved(net: Net, buf: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows, and each filter at each slot of each block; `last` are the blocks whose end no window may cross."""
    x = net.embed[buf]
    n = (len(buf) - WIDTH) // STRIDE
    windows = np.lib.stride_tricks.as_strided(x, (n, WIDTH * DEPTH), (STRIDE * DEPTH * 4, 4))
    conv = (np.ascontiguousarray(windows) @ net.filters).reshape(-1, SLOTS, FILTERS)
    conv[last, SLOTS - WIDTH // STRIDE + 1 :] = -np.inf
    return windows, conv


def block_maxima(net: Net, buf: np.ndarray, last: np.ndarray) -> np.ndarray:
    return convolved(net, buf, last)[1].max(axis=1)


def chunk_units(net: Net, maxima: np.ndarray) -> np.ndarray:
    """Dense units of each block and its successor."""
    pooled = np.maximum(np.maximum(maxima[:-1], maxima[1:]) + net.filter_bias, 0)
    return np.maximum(pooled @ net.dense + net.dense_bias, 0)


def probabilities(net: Net, texts: list[str | None]) -> np.ndarray:
    raw = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]
    if net.constant is not None:
        return np.full(len(raw), net.constant)
    top = np.zeros((len(raw), UNITS), np.float32)
    k = 0
    while k < len(raw):
        if len(raw[k]) > GROUP:  # in pieces of whole blocks that share one block
            step = GROUP // BLOCK * BLOCK
            for at in range(0, len(raw[k]), step):
                part = raw[k][at : at + step + BLOCK + WIDTH]
                more = at + step + BLOCK + WIDTH < len(raw[k])
                buf, bound = (np.frombuffer(part, np.uint8), np.zeros(1, int)) if more else laid_out([part])
                top[k] = np.maximum(top[k], chunk_units(net, block_maxima(net, buf, bound[1:] - 1)).max(axis=0))
                if not more:
                    break
            k += 1
            continue
        first, size = k, 0
        while k < len(raw) and len(raw[k]) <= GROUP and (k == first or size + len(raw[k]) <= GROUP):
            size += len(raw[k])
            k += 1
        buf, bound = laid_out(raw[first:k])
        units = chunk_units(net, block_maxima(net, buf, bound[1:] - 1))  # one fewer than blocks; those across texts are left out
        units[bound[1:-1] - 1] = 0
        top[first:k] = np.maximum.reduceat(units, bound[:-1])
    return 1 / (1 + np.exp(-(top.astype(np.float64) @ net.out + net.out_bias[0])))


def _gradients(net: Net, texts: list[bytes], label: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    buf, bound = laid_out(texts)
    windows, conv = convolved(net, buf, bound[1:] - 1)
    maxima = conv.max(axis=1)
    units = chunk_units(net, maxima)
    units[bound[1:-1] - 1] = -1
    starts, ends = bound[:-1], bound[1:] - 1
    best = np.stack([a + units[a:b].argmax(axis=0) for a, b in zip(starts, ends, strict=True)])  # text x unit -> chunk
    top = np.maximum(np.take_along_axis(units, best, axis=0), 0)
    p = 1 / (1 + np.exp(-(top @ net.out + net.out_bias[0])))
    d = ((p - label) * weight / len(texts)).astype(np.float32)
    g_out, g_out_bias = top.T @ d, d.sum(keepdims=True)
    g_unit = d[:, None] * net.out * (top > 0)  # of the pooled unit, at the chunk that reached it
    chunk, unit = best.ravel(), np.tile(np.arange(UNITS), len(texts))
    g = g_unit.ravel()
    on = np.flatnonzero(g)
    chunk, unit, g = chunk[on], unit[on], g[on]
    a, b = maxima[chunk], maxima[chunk + 1]
    pooled = np.maximum(np.maximum(a, b) + net.filter_bias, 0)
    g_dense, g_dense_bias = np.zeros_like(net.dense), np.zeros_like(net.dense_bias)
    np.add.at(g_dense.T, unit, pooled * g[:, None])
    np.add.at(g_dense_bias, unit, g)
    g_pool = g[:, None] * net.dense.T[unit] * (pooled > 0)
    g_filter_bias = g_pool.sum(axis=0)
    block = chunk[:, None] + (b > a)
    r, f = np.nonzero(g_pool)
    at_block = block[r, f]
    slot = conv[at_block, :, f].argmax(axis=1)
    w = at_block * SLOTS + slot
    gv = g_pool[r, f]
    g_filters = np.zeros_like(net.filters)
    order = np.argsort(f, kind="stable")
    cuts = np.searchsorted(f[order], np.arange(FILTERS + 1))
    g_embed = np.zeros_like(net.embed)
    for k in range(FILTERS):
        o = order[cuts[k] : cuts[k + 1]]
        if len(o):
            g_filters[:, k] = gv[o] @ windows[w[o]]
            places = (w[o] * STRIDE)[:, None] + np.arange(WIDTH)
            back = gv[o][:, None, None] * net.filters[:, k].reshape(WIDTH, DEPTH)
            for c in range(DEPTH):
                g_embed[:, c] += np.bincount(buf[places].ravel(), back[:, :, c].ravel(), minlength=256)
    return [g_embed, g_filters, g_filter_bias, g_dense, g_dense_bias, g_out.astype(np.float32), g_out_bias]


def fit(sample: pd.DataFrame, epochs: int = 10, batch: int = 32, rate: float = 0.01, seed: int = 5) -> Net:
    """A net from rows of (text, label); both classes weigh the same. Without both: the constant share of ones, or 1."""
    net = new_net()
    label = sample["label"].to_numpy(np.float32)
    if not len(label) or label.min() == label.max():
        net.constant = float(label[0]) if len(label) else 1.0
        return net
    texts = [t.encode("utf-8", "surrogatepass") for t in sample["text"]]
    weight = np.where(label == 1, 0.5 / label.mean(), 0.5 / (1 - label.mean()))
    rng = np.random.default_rng(seed)
    first, second, step = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()], 0
    epochs = max(epochs, min(60, 12_000 // len(texts)))  # a small sample is seen more often
    total = epochs * -(-len(texts) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            step += 1
            now = rate * (1 - 0.95 * step / total)
            for k, (p, g) in enumerate(zip(net.parts(), _gradients(net, [texts[i] for i in own], label[own], weight[own]), strict=True)):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                p -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def prober(net: Net, spark) -> Column:
    """A function of a text column that gives its probability."""
    shipped = spark.sparkContext.broadcast(net)

    def run(batches):
        for texts in batches:
            yield pd.Series(probabilities(shipped.value, texts.tolist()))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")


def fit_documents(docs: DataFrame, labels: DataFrame) -> Net:
    return fit(labelled_sample(docs, labels, "quality", rows=4000))


def score_documents(docs: DataFrame, labels: DataFrame, at: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of (doc_id, text).

    A null text is the empty one, which is a chunk of zeros. Repeated rows are scored each; nothing is shuffled. Other
    columns are ignored, whatever their names; an empty table has an empty result.
    Fitted on at most 4,000 rows outside the held-out fold.
    """
    score = prober(fit_documents(docs, labels), docs.sparkSession)(F.col("text"))
    out = docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= at).cast("int"))


def good_quality(docs: DataFrame, labels: DataFrame, at: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, whose score is `at` or more; null and empty texts have a score too."""
    return docs.where(prober(fit_documents(docs, labels), docs.sparkSession)(F.col("text")) >= at)
