"""Words and word shingles of many texts at a time, as 64-bit hashes in arrays.

Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; everything works on UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text that are worked on together; a longer text is worked on alone.
GROUP = 400_000
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_P = np.uint64(0x9E3779B97F4A7C55)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C55, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {"p": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["p"]) < n:
        for name, base in (("p", _P), ("i", _P_INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["p"][:n], _powers["i"][:n]


def grouped(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, UTF-8 bytes) of consecutive texts, GROUP bytes together; null texts are empty."""
    first, out, size = 0, [], 0
    for k, t in enumerate(texts):
        b = t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b""
        if out and size + len(b) > GROUP:
            yield first, out
            first, out, size = k, [], 0
        out.append(b)
        size += len(b)
    if out:
        yield first, out


class Words:
    """The words of some texts: lowered bytes, word starts and ends in them, 64-bit hashes, and each text's range of words."""

    def __init__(self, texts: list[bytes]):
        self.buf = np.frombuffer((b"\n".join(texts) + b"\n").lower(), np.uint8)
        n = len(self.buf)
        space = _SPACE[self.buf]
        before = np.concatenate(([True], space[:-1]))
        self.start, self.end = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
        power, inverse = _power(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * power, out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * inverse[self.start] + (self.end - self.start).astype(np.uint64))
        self.text_end = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        self.bound = np.concatenate(([0], np.searchsorted(self.start, self.text_end)))

    def shingles(self, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct shingle hashes of each text, end to end, and the texts' bounds in them.

        A text with 1 to k - 1 words has its whole sequence as the only shingle.
        """
        n, counts = len(self.hash), np.diff(self.bound)
        last = np.repeat(self.bound[1:], counts)  # the end of each word's text
        i = np.arange(n)
        total = np.minimum(last - i, k).astype(np.uint64)
        factor = mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
        padded = np.concatenate((self.hash, np.zeros(k, np.uint64)))
        for j in range(k):
            total += np.where(i + j < last, padded[j : j + n], np.uint64(0)) * factor[j]
        total = mix(total)
        out, sizes = [], np.zeros(len(counts), np.int64)
        for d, (a, b) in enumerate(zip(self.bound[:-1].tolist(), self.bound[1:].tolist(), strict=True)):
            if b > a:
                out.append(np.unique(total[a : max(a + 1, b - k + 1)]))
                sizes[d] = len(out[-1])
        return np.concatenate(out) if out else np.empty(0, np.uint64), np.concatenate(([0], np.cumsum(sizes)))
