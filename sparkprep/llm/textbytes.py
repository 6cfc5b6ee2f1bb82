"""Vectorised work on UTF-8 bytes: words, n-grams and substring hashes.

All word rules here are byte rules: a word is a maximal run of bytes of a class,
and every byte of a non-ASCII character belongs to the class. Hashes are 64 bits
wide: sums of random byte values times powers of an odd base (mod 2**64),
finished with a mixer.
"""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Texts are processed together up to this many bytes.
CHUNK_BYTES = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """Finisher of the public splitmix64 generator."""
    x = np.asarray(x, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_values(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019) + np.uint64(seed))


VALUES = byte_values(1)
IDENTITY = np.arange(256, dtype=np.uint8)
LOWER = IDENTITY.copy()
LOWER[ord("A"):ord("Z") + 1] += 32
#: Bytes of words that end at ASCII white space.
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words of lower-cased letters, digits and non-ASCII characters.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[ord("0"):ord("9") + 1] = True
ALNUM[ord("a"):ord("z") + 1] = True
ALNUM[0x80:] = True


class Made(dict):
    """Things made once in a process; it travels to other processes empty."""

    def __reduce__(self):
        return Made, ()


class Prefix:
    """Hashes of any substring of a byte array."""

    def __init__(self, data: np.ndarray, values: np.ndarray = VALUES):
        up, down = np.full(len(data) + 1, BASE, dtype=np.uint64), np.full(len(data) + 1, BASE_INVERSE, dtype=np.uint64)
        up[0] = down[0] = 1
        self.down = np.cumprod(down, out=down)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(values[data] * np.cumprod(up, out=up)[:-1], out=self.sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


def encode(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def chunks(texts: list[str | None], limit: int = CHUNK_BYTES):
    """(first, last + 1, list of bytes) runs of texts of about ``limit`` bytes together."""
    at, size, held = 0, 0, []
    for i, t in enumerate(texts):
        b = encode(t)
        if held and size + len(b) > limit:
            yield at, i, held
            at, size, held = i, 0, []
        held.append(b)
        size += len(b)
    if held:
        yield at, len(texts), held


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on (across texts; callers cut)."""
    n = max(len(words) - k + 1, 0)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[j:j + n]
    return mix(out + np.uint64(k))


class Words:
    """Words of several texts: byte spans in ``data``, hashes, and where each text's words begin."""

    def __init__(self, texts: list[bytes], keep: np.ndarray, lower: bool = True):
        joined = b" ".join(texts) + b" "
        data = np.frombuffer(joined, dtype=np.uint8)
        self.data = (LOWER if lower else IDENTITY)[data]
        inside = np.zeros(len(data) + 1, dtype=np.int8)
        inside[1:] = keep[self.data]
        edge = np.diff(inside)
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.first = np.searchsorted(self.start, np.concatenate(([0], np.cumsum(sizes))))
        length = (self.end - self.start).astype(np.uint64)
        self.hash = mix(Prefix(self.data).raw(self.start, self.end) + length)

    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def grams(self, k: int) -> np.ndarray:
        return gram_hashes(self.hash, k)

    def text(self, i: int, j: int) -> str:
        """Words i to j - 1 with one space between."""
        return " ".join(self.data[s:e].tobytes().decode("utf-8", "surrogatepass")
                        for s, e in zip(self.start[i:j], self.end[i:j], strict=True))


def word_hashes(texts: list[str | None], keep: np.ndarray, limit: int = CHUNK_BYTES >> 1) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text's words begin."""
    parts, counts = [np.zeros(0, dtype=np.uint64)], [np.zeros(1, dtype=np.int64)]
    for _, _, held in chunks(texts, limit):
        w = Words(held, keep)
        parts.append(w.hash)
        counts.append(w.count())
    return np.concatenate(parts), np.cumsum(np.concatenate(counts))


def shingle_sets(texts: list[bytes], k: int, keep: np.ndarray = NON_SPACE, lower: bool = True) -> list[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each text. A text of fewer words has
    its whole sequence as one shingle; one without words has none."""
    w = Words(texts, keep, lower)
    full = w.grams(k)
    out = []
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(full[a:b - k + 1]))
        elif b > a:
            acc = np.uint64(0)
            for h in w.hash[a:b]:
                acc = np.uint64((int(acc) * 0xD6E8FEB86659FD93 + int(h)) & 0xFFFFFFFFFFFFFFFF)
            out.append(mix(np.array([(int(acc) + int(b - a)) & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
