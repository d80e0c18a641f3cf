"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

Leaf i of the tree holds the rank of the pair that starts at live position i; a node holds the leftmost
minimum of its leaves. A merge reads the root, joins two live neighbours and updates at most three leaves and
their ancestors, so a match of n bytes takes O(n log n). Short matches are merged many at a time, one tree each
as a row of an array; long ones one by one.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.chunks import cut
from weftline.llm.common import read_bytes

#: Pieces kept by a worker's cache; it starts anew beyond that.
CACHE = 500_000
#: Bytes of a match up to which many are merged at a time.
SHORT = 64
NONE = np.int64(1) << 40


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in data.splitlines() if line.strip())}


class SegmentTreeBpe:
    """Merges by rank; `ranks` maps the bytes of each token to its id, which is its rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for t, r in ranks.items():
            for k in range(1, len(t)):
                if (a := ranks.get(t[:k])) is not None and (b := ranks.get(t[k:])) is not None:
                    pairs[a << 32 | b] = r
        self.pairs = pairs
        code = np.fromiter(pairs.keys(), dtype=np.int64, count=len(pairs))
        rank = np.fromiter(pairs.values(), dtype=np.int64, count=len(pairs))
        bits = max(4, int(len(code) * 4).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slots, self.slot_rank = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int64)
        at, left = self._slot(code), np.arange(len(code))
        while len(left):  # open addressing: who finds the slot empty takes it, the others step on
            s = at[left]
            free = self.slots[s] < 0
            self.slots[s[free]], self.slot_rank[s[free]] = code[left[free]], rank[left[free]]
            left = left[self.slots[s] != code[left]]
            at[left] = (at[left] + 1) & ((1 << bits) - 1)

    def _slot(self, code: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, NONE where there is no such token or no neighbour (-1)."""
        code = a << 32 | b
        out = np.full(len(code), NONE, np.int64)
        left = np.flatnonzero(b >= 0)
        at = self._slot(code[left])
        while len(left):
            found = self.slots[at]
            hit = found == code[left]
            out[left[hit]] = self.slot_rank[at[hit]]
            go = ~hit & (found >= 0)
            left, at = left[go], (at[go] + 1) & (len(self.slots) - 1)
        return out

    def encode_one(self, data: bytes) -> list[int]:
        """One match of any length."""
        n = len(data)
        ids = [int(self.byte_id[b]) for b in data]
        size = 1 << max(0, (n - 1).bit_length())
        none, pairs = int(NONE), self.pairs
        leaf = [pairs.get(ids[i] << 32 | ids[i + 1], none) for i in range(n - 1)] + [none] * (size - n + 1)
        tree = [0] * size + list(range(size))  # the position of the leftmost minimum
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if leaf[a] <= leaf[b] else b
        after, before = [*range(1, n), -1], list(range(-1, n - 1))

        def put(i, rank):
            leaf[i] = rank
            k = (size + i) >> 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                tree[k] = a if leaf[a] <= leaf[b] else b
                k >>= 1

        while n > 1 and leaf[i := tree[1]] < none:
            ids[i], j = leaf[i], after[i]
            k = after[i] = after[j]
            ids[j] = -1
            put(j, none)
            if k >= 0:
                before[k] = i
            put(i, pairs.get(ids[i] << 32 | ids[k], none) if k >= 0 else none)
            if (h := before[i]) >= 0:
                put(h, pairs.get(ids[h] << 32 | ids[i], none))
        return [x for x in ids if x >= 0]

    def _encode_rows(self, words: list[bytes], size: int) -> list[list[int]]:
        """Matches of 2 to `size` bytes, one tree per row; size is a power of two."""
        m = len(words)
        width = np.fromiter(map(len, words), np.int64, m)
        raw = np.frombuffer(b"".join(w.ljust(size, b"\0") for w in words), np.uint8).reshape(m, size)
        ids = self.byte_id[raw]
        ids[np.arange(size) >= width[:, None]] = -1
        pos = np.arange(size)
        after = np.where(pos + 1 < width[:, None], pos + 1, size)  # column `size` stands for no neighbour
        before = np.broadcast_to(pos - 1, (m, size)).copy()
        ids = np.concatenate([ids, np.full((m, 1), -1)], axis=1)
        tree = np.full((m, 2 * size), NONE * size, np.int64)  # rank * size + position: the minimum is the leftmost
        tree[:, size : 2 * size - 1] = self._rank(ids[:, : size - 1].ravel(), ids[:, 1:size].ravel()).reshape(m, -1) * size + pos[:-1]
        level = size
        while level > 1:
            level >>= 1
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])

        def put(rows, at, rank):
            k = size + at
            tree[rows, k] = rank * size + at
            while len(k) and k[0] > 1:  # all leaves are equally deep
                k >>= 1
                tree[rows, k] = np.minimum(tree[rows, 2 * k], tree[rows, 2 * k + 1])

        live = np.flatnonzero(tree[:, 1] < NONE * size)
        while len(live):
            root = tree[live, 1]
            i, rank = root % size, root // size
            j = after[live, i]
            k = after[live, j]
            ids[live, i], ids[live, j] = rank, -1
            after[live, i] = k
            put(live, j, np.full(len(live), NONE))
            on = np.flatnonzero(k < size)
            before[live[on], k[on]] = i[on]
            put(live, i, self._rank(rank, ids[live, k]))
            h = before[live, i]
            on = np.flatnonzero(h >= 0)
            put(live[on], h[on], self._rank(ids[live[on], h[on]], rank[on]))
            live = live[tree[live, 1] < NONE * size]
        flat = ids[:, :size]
        keep = flat >= 0
        ends = np.cumsum(keep.sum(1)).tolist()
        ids_out = flat[keep].tolist()
        return [ids_out[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def encode_many(self, words: list[bytes]) -> dict[bytes, list[int]]:
        out, classes = {}, {}
        for w in words:
            if (r := self.ranks.get(w)) is not None:
                out[w] = [r]
            elif len(w) > SHORT:
                out[w] = self.encode_one(w)
            elif w:
                classes.setdefault(1 << (len(w) - 1).bit_length(), []).append(w)
        for size, group in classes.items():
            for at in range(0, len(group), 8192):
                part = group[at : at + 8192]
                out.update(zip(part, self._encode_rows(part, size), strict=True))
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])


class TextCodec:
    """Texts -> (ids, decoded bytes) by pattern matches, with a bounded cache of pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.bpe, self.find = SegmentTreeBpe(ranks), regex.compile(pattern).findall
        self.text_of = {i: str(i) for i in self.bpe.bytes_of}
        self.cache: dict[str, tuple[str, bytes]] = {}

    def learn(self, pieces: set[str]) -> None:
        find, text_of, bytes_of, cache = self.find, self.text_of, self.bpe.bytes_of, self.cache
        whole = [p for p in pieces if p[0] == " " and p[1:].isalpha()]
        parted = {p: [w.encode() for w in find(p)] for p in pieces.difference(whole)}
        coded = self.bpe.encode_many([*map(str.encode, whole), *set().union(*parted.values())])
        for p in whole:
            ids = coded[p.encode()]
            cache[p] = (",".join([text_of[i] for i in ids]), b"".join([bytes_of[i] for i in ids]))
        for p, matches in parted.items():
            ids = [i for w in matches for i in coded[w]]
            cache[p] = (",".join([text_of[i] for i in ids]), b"".join([bytes_of[i] for i in ids]))

    def encode(self, texts: list[str], step: int = 256) -> Iterator[tuple[str, int, bytes]]:
        """For each text the decimal ids joined by commas, their number and the bytes they decode to."""
        for at in range(0, len(texts), step):
            cuts = [cut(t) for t in texts[at : at + step]]
            if len(self.cache) > CACHE:
                self.cache.clear()
            self.learn(set().union(*cuts).difference(self.cache))
            for pieces in cuts:
                found = [self.cache[p] for p in pieces]
                ids = ",".join([f[0] for f in found])
                yield ids, ids.count(",") + 1 if ids else 0, b"".join([f[1] for f in found])


_CODECS: dict[tuple[int, str], TextCodec] = {}  # of this worker, by the vocabulary's checksum and the pattern


def cached_codec(data: bytes, pattern: str) -> TextCodec:
    key = (zlib.crc32(data), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = TextCodec(parse_ranks(data), pattern)
    return _CODECS[key]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, if asked for) of every (doc_id, text).

    Null and empty texts have no ids. Rows keep their number and repeated rows their own line; nothing is
    shuffled, and a task holds one batch and the cache. Other columns are ignored, whatever their names; an empty table has
    an empty result.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(read_bytes(docs.sparkSession, ranks_path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = cached_codec(shipped.value, pattern)
        for batch in batches:
            rows = []
            for ids, n, back in codec.encode([t if isinstance(t, str) else "" for t in batch["text"]]):
                row = (n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back).hexdigest())
                rows.append((*row, [int(i) for i in ids.split(",")] if ids else []) if with_ids else row)
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            yield out

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, schema)
