"""Words of many texts at once in NumPy: boundaries and 64-bit hashes without a loop over words."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

#: Bytes that do not belong to a letter or digit; every byte of a non-ASCII character counts as a letter.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

_SEGMENT = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.int64).astype(U64)
_POWERS = np.ones(1, U64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> np.ndarray:
    """The first n or more powers of an odd base, modulo 2^64."""
    global _POWERS
    if len(_POWERS) < n:
        steps = np.full(max(n, 64), _BASE, U64)
        steps[0] = 1
        _POWERS = np.cumprod(steps, dtype=U64)
    return _POWERS


def encode(text: str | None) -> bytes:
    """UTF-8; a null is an empty text."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def groups(texts: list, limit: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of about ``limit`` bytes, so that memory follows the longest text, not the batch."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


@dataclass
class Words:
    """All words of some texts, in order.

    ``first`` has one entry more than there are texts: text d owns words first[d] to first[d + 1].
    Starts and ends are byte offsets in ``buffer``, where text d begins at ``base[d]``.
    """

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    base: np.ndarray
    buffer: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def split_words(texts: list[bytes], gap: np.ndarray = SPACE, fold: bool = True) -> Words:
    """Cut texts at the bytes of ``gap`` (a table of 256 flags) and hash each word; ``fold`` ignores the case of A-Z.

    Working memory beyond the words themselves stays below some 50 MB, whatever the length of a text.
    """
    joined = b"\n".join(texts)
    joined = joined.lower() if fold else joined
    buffer = np.frombuffer(joined, np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    base = np.cumsum(sizes + 1) - sizes - 1
    starts, ends, hashes = [], [], []
    at = 0
    while at < len(buffer):
        stop = min(at + _SEGMENT, len(buffer))
        while stop < len(buffer):  # cut at a gap, so that no word is split
            found = np.flatnonzero(gap[buffer[stop:stop + 4096]])
            if len(found):
                stop += int(found[0])
                break
            stop = min(stop + 4096, len(buffer))
        part = buffer[at:stop]
        inside = np.zeros(len(part) + 2, np.int8)
        inside[1:-1] = ~gap[part]
        edge = np.diff(inside)
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(s):
            lengths = e - s
            within = np.arange(len(part)) - np.repeat(np.r_[0, s], np.diff(np.r_[0, s, len(part)]))
            value = _BYTE[part] * powers(int(within.max()) + 1)[within]
            value[gap[part]] = 0
            total = np.add.reduceat(value, s)
            hashes.append(mix(total ^ (lengths.astype(U64) << U64(56))))
            starts.append(s + at)
            ends.append(e + at)
        at = stop
    cat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    starts, ends, hashes = cat(starts, np.int64), cat(ends, np.int64), cat(hashes, U64)
    first = np.r_[np.searchsorted(starts, base), len(starts)].astype(np.int64)
    return Words(hashes, starts, ends, first, base, buffer)


def windows(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words that stay within a text, and the index of each run's first word."""
    n = len(words.hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    total = np.zeros(n, U64)
    for j in range(width):
        total = total * U64(_BASE) + words.hashes[j:j + n]
    room = np.repeat(words.first[1:], np.diff(words.first))[:n]
    inside = np.flatnonzero(np.arange(n) + width <= room)
    return mix(total[inside]), inside


def per_text(flags: np.ndarray, words: Words) -> np.ndarray:
    """Sum a value per word over the words of each text."""
    total = np.r_[0, np.cumsum(flags, dtype=np.int64)]
    return total[words.first[1:]] - total[words.first[:-1]]


def texts_of(column) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8; null is empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def share_package(spark) -> None:
    """Let Python workers find this package where the driver found it, if it is not installed."""
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment
    if root not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join([root, *filter(None, [known.get("PYTHONPATH")])])
