"""Toxic spans by a linear-chain conditional random field.

Documents carry labels, tokens don't, so the tokens are labelled first: a word form or word beginning that occurs
in significantly more toxic documents than chance allows (likelihood ratio) and nearly only in them marks its
words as toxic in toxic documents. The field has two states, emission weights for a word and its beginnings, and
transition weights, and is fitted to those labels by its exact likelihood. Forward-backward marginals then give
each token's probability; the document's score is a logistic function of the strongest marginal's
logit, and the offending offsets are the runs of tokens above one half.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import fold
from weftline.llm.labelled import labelled_sample

BITS, PREFIXES = 20, (3, 4, 5, 6, 7, 8)
#: Likelihood ratio (G2) and share of toxic documents from which a feature marks its words.
SURE, PURE = 20.0, 0.9
SEGMENT, CLIP, EXTREME, CACHE, GROUP = 32, 30.0, 4.0, 250_000, 200_000
_WORD = re.compile("[a-z\x80-\U0010ffff]+")
_APART = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def lowered(text: str) -> str:
    """Lower case with every character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def tokens(text: str) -> list[bytes]:
    return lowered(text).encode("utf-8", "surrogatepass").translate(_APART).split()


def features(word: bytes) -> list[int]:
    """Hashes of the word itself and of its beginnings."""
    mask = (1 << BITS) - 1
    return [zlib.crc32(b"=" + word) & mask, *[zlib.crc32(word[:k]) & mask for k in PREFIXES if len(word) >= k]]


@dataclass
class Crf:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS, np.float32))
    bias: float = -8.0
    transition: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: float = 0.0
    combine: tuple[float, float] = (1.0, 0.0)  # of the strongest marginal's logit, and 1


def marginals(e: np.ndarray, bound: np.ndarray, transition: np.ndarray, start: float) -> np.ndarray:
    """P(toxic) of every token of sequences laid end to end, by exact forward-backward.

    Sequences are cut into segments whose transfer matrices are multiplied out side by side; a scan over the
    segments of each sequence then gives the messages at their ends, and one more pass fills them.
    """
    sizes = np.diff(bound)
    segments = -(-sizes // SEGMENT)
    seg_bound = np.concatenate(([0], np.cumsum(segments)))
    n = int(seg_bound[-1])
    if not n:
        return np.zeros(len(e))
    # segments by falling length, so that at each step those still running are a prefix; arrays are step by segment
    length = np.full(n, SEGMENT)
    full = np.flatnonzero(sizes)
    length[seg_bound[1:][full] - 1] = (sizes[full] - 1) % SEGMENT + 1
    order = np.argsort(-length, kind="stable")
    spot = np.empty(n, np.int64)
    spot[order] = np.arange(n)
    running = np.searchsorted(-length[order], -np.arange(SEGMENT), side="left")
    within = np.arange(len(e)) - np.repeat(bound[:-1] - seg_bound[:-1] * SEGMENT, sizes)
    place = (within % SEGMENT) * n + spot[within // SEGMENT]
    g = np.ones(SEGMENT * n)
    g[place] = np.exp(np.clip(e, -CLIP, CLIP))
    g = g.reshape(SEGMENT, n)
    (a00, a01), (a10, a11) = np.exp(transition)
    m = np.zeros((4, n))  # the transfer matrices m00, m01, m10, m11
    m[0] = m[3] = 1
    if len(full) < n:  # sequences of one segment need none
        for t in range(SEGMENT):
            c = running[t]
            x = m[:, :c]
            x0, x2 = x[0] * a00 + x[1] * a10, x[2] * a00 + x[3] * a10
            x[1] = (x[0] * a01 + x[1] * a11) * g[t, :c]
            x[3] = (x[2] * a01 + x[3] * a11) * g[t, :c]
            x[0], x[2] = x0, x2
            if t % 8 == 7:
                m /= m.sum(axis=0)
    into, back = np.full(n, np.exp(start)), np.ones(n)  # messages as ratios of state 1 to state 0
    live = np.argsort(-segments, kind="stable")
    left = segments[live]
    v, w = np.full(len(live), np.exp(start)), np.ones(len(live))
    for k in range(int(segments.max())):
        c = int(np.searchsorted(-left, -k, side="left"))  # sequences with more than k segments
        live, left, v, w = live[:c], left[:c], v[:c], w[:c]
        at, end = spot[seg_bound[live] + k], spot[seg_bound[live + 1] - 1 - k]
        into[at], back[end] = v, w
        v = (m[1, at] + v * m[3, at]) / (m[0, at] + v * m[2, at])
        w = (m[2, end] + w * m[3, end]) / (m[0, end] + w * m[1, end])
    odds = np.empty((SEGMENT, n))
    for t in range(SEGMENT):
        c = running[t]
        into[:c] = (a01 + into[:c] * a11) / (a00 + into[:c] * a10) * g[t, :c]
        odds[t, :c] = into[:c]
    for t in range(SEGMENT - 1, -1, -1):
        c = running[t]
        odds[t, :c] *= back[:c]
        w = back[:c] * g[t, :c]
        back[:c] = (a10 + w * a11) / (a00 + w * a01)
    odds = odds.ravel()[place]
    return odds / (1 + odds)


def _offending(words: list[list[bytes]], label: np.ndarray, forms: list[bytes]) -> bytes:
    """Which features mark toxic words."""
    number = {w: i for i, w in enumerate(forms)}
    table = np.full((len(forms), len(PREFIXES) + 1), 1 << BITS, np.int32)
    for i, w in enumerate(forms):
        c = features(w)
        table[i, : len(c)] = c
    count = np.zeros((2, (1 << BITS) + 1), np.float32)
    for w, y in zip(words, label, strict=True):
        count[y][np.unique(table[[number[x] for x in set(w)]])] += 1
    count = count[:, :-1]
    some = np.flatnonzero(count.any(axis=0))
    count = count[:, some].astype(float)
    total = np.array([(label == 0).sum(), (label == 1).sum()], float)
    k, n1, n = count[1], total[1], total.sum()
    seen = count.sum(axis=0)

    def part(x, expected):
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-300) / np.maximum(expected, 1e-300)), 0)

    g2 = 2 * (part(k, seen * n1 / n) + part(seen - k, seen * (n - n1) / n) + part(n1 - k, (n - seen) * n1 / n) + part(n - seen - n1 + k, (n - seen) * (n - n1) / n))
    out = np.zeros(1 << BITS, bool)
    out[some] = (g2 >= SURE) & (k >= PURE * seen) & (k > 0)
    return out.tobytes()


def fit(sample: pd.DataFrame, rounds: int = 60, width: int = 16, most: int = 6000, seed: int = 7) -> Crf:
    """A field from rows of (text, label). Without rows of both labels: one that finds nothing.

    The field itself is fitted on a sample of windows of `width` tokens, `most` of them: around up to eight marked words of
    a toxic document, and two at random places of any other.
    """
    label = sample["label"].to_numpy(np.int64)
    one: dict[bytes, bytes] = {}  # a single object for each word form
    words = [[one.setdefault(w, w) for w in tokens(t)] for t in sample["text"]]
    keep = [i for i, w in enumerate(words) if w]
    words, label = [words[i] for i in keep], label[keep]
    model = Crf()
    if not len(label) or label.min() == label.max():
        model.combine = (0.0, 20.0 if len(label) and label.min() == 1 else -20.0)
        return model
    forms = sorted(set().union(*words))
    marks = _offending(words, label, forms)
    toxic_word = {w: any([marks[k] for k in features(w)]) for w in forms}
    rng = np.random.default_rng(seed)
    windows, tags = [], []
    for d, y in zip(words, label, strict=True):
        hits = [i for i, w in enumerate(d) if y and toxic_word[w]][:8]
        starts = [max(0, i - int(rng.integers(width))) for i in hits] or [int(rng.integers(len(d)))] * 2
        for s in starts:
            windows.append(d[s : s + width])
            tags.append([int(bool(y) and toxic_word[w]) for w in windows[-1]])
    chosen = np.sort(rng.permutation(len(windows))[:most])
    windows, tags = [windows[i] for i in chosen], [tags[i] for i in chosen]
    n, deep = len(windows), len(PREFIXES) + 1
    feature, used, gold = np.full((n, width, deep), -1, np.int64), np.zeros((n, width), bool), np.zeros((n, width), np.int64)
    for i, (d, t) in enumerate(zip(windows, tags, strict=True)):
        used[i, : len(d)], gold[i, : len(d)] = True, t
        for j, w in enumerate(d):
            c = features(w)
            feature[i, j, : len(c)] = c
    ids, index = np.unique(feature, return_inverse=True)
    index = index.reshape(feature.shape)
    theta = np.zeros(len(ids) + 6)  # emissions, bias, four transitions, start
    fixed = ids < 0
    theta[-6] = -4.0
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    bound, flat = np.concatenate(([0], np.cumsum(used.sum(1)))), used.ravel()
    y = gold.ravel()[flat].astype(float)
    index_used = index.reshape(-1, deep)[flat]
    inner = np.ones(len(y), bool)
    inner[bound[:-1]] = False
    inner = np.flatnonzero(inner)
    for step in range(1, rounds + 1):
        weight, bias, trans, start = theta[:-6], theta[-6], theta[-5:-1].reshape(2, 2), theta[-1]
        e = weight[index_used].sum(axis=1) + bias
        p = marginals(e, bound, trans, start)
        d = y - p
        grad = np.zeros_like(theta)
        grad[:-6] = np.bincount(index_used.ravel(), np.repeat(d, deep), minlength=len(ids))
        grad[-6] = d.sum()
        # pairs: observed minus expected, the expected ones from the marginals' transfer at the current weights
        q, prev, g, a = p[inner], p[inner - 1], np.exp(np.clip(e[inner], -CLIP, CLIP)), np.exp(trans)
        joint = np.stack([(1 - prev) * a[0, 0], (1 - prev) * a[0, 1] * g, prev * a[1, 0], prev * a[1, 1] * g], 1).reshape(-1, 2, 2)
        for _ in range(4):  # scaled to both tokens' marginals, which fixes the pair marginal of a chain
            joint *= (np.stack([1 - prev, prev], 1) / np.maximum(joint.sum(2), 1e-300))[:, :, None]
            joint *= (np.stack([1 - q, q], 1) / np.maximum(joint.sum(1), 1e-300))[:, None, :]
        a0, b0 = y[inner - 1].astype(int), y[inner].astype(int)
        grad[-5:-1] = np.bincount(a0 * 2 + b0, minlength=4) - joint.sum(0).ravel()
        grad = grad / n - 1e-4 * theta
        grad[:-6][fixed] = 0
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        theta += 0.15 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        theta[:-6][fixed] = 0
    model.weights[ids[~fixed]] = theta[:-6][~fixed]
    model.bias, model.transition, model.start = float(theta[-6]), theta[-5:-1].reshape(2, 2).copy(), float(theta[-1])
    x = Tagger(model).summaries(list(sample["text"].iloc[keep]))[0]
    model.combine = _logistic(x, label)
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    z = np.column_stack([x, np.ones(len(x))])
    w = np.array([1.0, 0.0])
    for _ in range(50):  # Newton steps with a ridge, so that separable classes stay finite
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
        w = w + np.clip(np.linalg.solve(h, z.T @ (y - p) - 1e-2 * w), -1, 1)
    return float(w[0]), float(w[1])


class Tagger:
    def __init__(self, model: Crf):
        self.model, self.cache = model, {}
        self.weight = array("d", model.weights.astype(np.float64).tobytes())

    def emission(self, word: bytes) -> float:
        weight = self.weight
        return self.model.bias + sum([weight[k] for k in features(word)])

    def summaries(self, texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        """The strongest marginal's logit, within +-EXTREME, and the marginals of each text."""
        cache, emission = self.cache, self.emission
        rows, out, first = np.full(len(texts), -EXTREME), [], 0
        while first < len(texts):
            values, sizes, k, total = [], [], first, 0
            while k < len(texts) and (k == first or total + len(texts[k]) <= GROUP):
                total += len(texts[k])
                words = tokens(texts[k])
                if len(cache) > CACHE:
                    cache.clear()
                for w in set(words).difference(cache):
                    cache[w] = emission(w)
                values += [cache[w] for w in words]
                sizes.append(len(words))
                k += 1
            bound = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
            p = marginals(np.array(values), bound, self.model.transition, self.model.start)
            full = np.flatnonzero(sizes)
            if len(full):
                top = np.clip(np.maximum.reduceat(p, bound[full]), 1e-13, 1 - 1e-13)
                rows[first + full] = np.clip(np.log(top / (1 - top)), -EXTREME, EXTREME)
            out += [p[a:b] for a, b in zip(bound[:-1], bound[1:], strict=True)]
            first = k
        return rows, out

    def score(self, texts: list[str | None]) -> pd.DataFrame:
        """score and spans (start, end in characters, probability) of each text."""
        texts = [t if isinstance(t, str) else "" for t in texts]
        rows, found = self.summaries(texts)
        a, b = self.model.combine
        score = 1 / (1 + np.exp(-(a * rows + b)))
        spans = []
        for t, p in zip(texts, found, strict=True):
            own: list[list] = []
            if len(p) and p.max() > 0.5:
                last = -2
                for k, m in enumerate(_WORD.finditer(lowered(t))):
                    if p[k] > 0.5:
                        if k == last + 1:
                            own[-1][1:] = m.end(), max(own[-1][2], float(p[k]))
                        else:
                            own.append([m.start(), m.end(), float(p[k])])
                        last = k
            spans.append([{"start": x, "end": y, "probability": z} for x, y, z in own])
        return pd.DataFrame({"score": score, "spans": spans})


# pandas_udf reads the kind from the hints; the annotations here are text, so they are set as objects
def _hinted(f):
    f.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return f


def tagger(model: Crf, spark) -> Column:
    """A function of a text column that gives struct(score, spans)."""
    shipped = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Tagger(shipped.value)
        for texts in batches:
            yield own.score(texts.tolist())

    return F.pandas_udf(_hinted(run), "score double, spans array<struct<start:int,end:int,probability:double>>")


def fit_documents(docs: DataFrame, labels: DataFrame) -> Crf:
    return fit(labelled_sample(docs, labels, "toxic"))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, spans for every row of (doc_id, text).

    Null, empty and wordless texts have the score of no evidence and no spans; repeated rows are scored each;
    nothing is shuffled. Other columns are ignored, whatever their names; an empty table has an empty result. Fitted on
    at most labelled.ROWS rows outside the held-out fold.
    """
    found = tagger(fit_documents(docs, labels), docs.sparkSession)(F.col("text"))
    out = docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), found.alias("found"))
    return out.select("doc_id", "held_out", "found.score", (F.col("found.score") >= 0.5).cast("int").alias("predicted"), "found.spans")


def without_toxic(docs: DataFrame, labels: DataFrame, at: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose score is under `at`; a null or empty text has the score of no evidence."""
    found = tagger(fit_documents(docs, labels), docs.sparkSession)(F.col("text"))
    return docs.where(~(found["score"] >= at))
