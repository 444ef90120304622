"""Words of many texts at once, as 64-bit hashes in arrays.

A word's hash is a polynomial of its bytes, taken from running sums, then mixed; a window's hash is a polynomial of its
words' hashes, mixed again. All arithmetic wraps at 64 bits. Texts are worked on in blocks of about BLOCK bytes cut at
white space, so memory doesn't grow with a text's length beyond its number of words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

BLOCK = 1 << 18
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


class Powers:
    """Powers of an odd base and of its inverse, as many as asked for so far."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, 1 << 64))])
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = Powers(BYTE_BASE), Powers(WORD_BASE)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a permutation of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=out[1:])
    return out


def _block_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start offsets of the words of one block."""
    raw = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = ~_WHITE[raw]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    up, down = _BYTES.upto(len(raw) + 1)
    sums = _sums((raw.astype(np.uint64) + np.uint64(1)) * up[:-1])
    return mix((sums[end] - sums[start]) * down[start]), start


def _blocks(data: bytes) -> Iterator[bytes]:
    while len(data) > BLOCK:
        at = max(data.rfind(b, 0, BLOCK) for b in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if at < 0:
            at = min((x for b in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (x := data.find(b, BLOCK)) >= 0), default=len(data) - 1)
        yield data[: at + 1]
        data = data[at + 1 :]
    yield data


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after the other, and the number of words of each text."""
    hashes, counts = [], np.zeros(len(texts), np.int64)
    batch: list[bytes] = []
    first = size = 0

    def flush(upto: int) -> None:
        nonlocal batch, first, size
        if batch:
            found, start = _block_hashes(b"\n".join(batch))
            hashes.append(found)
            ends = np.cumsum([len(b) + 1 for b in batch])
            counts[first:upto] = np.diff(np.searchsorted(start, ends), prepend=0)
        batch, first, size = [], upto, 0

    for i, text in enumerate(texts):
        if len(text) > BLOCK:
            flush(i)
            parts = [_block_hashes(b)[0] for b in _blocks(text)]
            hashes += parts
            counts[i] = sum(map(len, parts))
            first = i + 1
            continue
        if size + len(text) > BLOCK:
            flush(i)
        batch.append(text)
        size += len(text) + 1
    flush(len(texts))
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of the window of `width` words that starts at each word (as far as one fits)."""
    if len(words) < width:
        return np.zeros(0, np.uint64)
    up, down = _WORDS.upto(len(words) + 1)
    sums = _sums(words * up[:-1])
    return mix((sums[width:] - sums[:-width]) * down[: len(words) - width + 1])


def spans(counts: Iterable[int]) -> Iterator[tuple[int, int]]:
    """Start and end of each text's words in the joint array."""
    at = 0
    for n in counts:
        yield at, at + int(n)
        at += int(n)
