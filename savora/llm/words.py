"""64-bit hashes of words and word windows of many texts at once, in numpy.

Words are runs of bytes other than ASCII white space. A word's hash is the sum of a random number
for each byte and its place in the word (tabulation; prefix sums give all words of a batch
together), mixed with its length; a window's hash is a random linear form of its words' hashes,
mixed again. A polynomial modulo 2^64 would not do: for it, Thue-Morse words are equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

SPACES = b" \t\n\x0b\x0c\r"
STEP = np.uint64(0x9E3779B97F4A7C15)  # odd: places of a word differ by it
BYTES_AT_ONCE = 2_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def randoms(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


@lru_cache(maxsize=2)
def byte_values(lower: bool) -> np.ndarray:
    values = randoms(256, 7)
    if lower:
        values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values


def prefix_sums(x: np.ndarray) -> np.ndarray:
    """0 and the sums of the first 1, 2, ... numbers, modulo 2^64 (never by way of floats)."""
    out = np.zeros(len(x) + 1, dtype=np.uint64)
    np.cumsum(x, out=out[1:])
    return out


_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(SPACES)] = True


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words one after another, and how many words each text has."""
    flat = np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8)
    space = _SPACE[flat]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    lengths = ends - starts
    solid = flat[~space]  # the words' bytes, one word after another
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(solid), dtype=np.uint64) - np.repeat(first.astype(np.uint64), lengths)
    sums = prefix_sums(mix(byte_values(lower)[solid] + place * STEP))
    words = sums[first + lengths] - sums[first]
    offsets = np.cumsum([1, *[len(t) + 1 for t in texts]])
    return mix(words + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), np.diff(np.searchsorted(starts, offsets))


def windows(words: np.ndarray, length: int, seed: int) -> np.ndarray:
    """The hash of the window that starts at each word but the last length - 1."""
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j, m in enumerate(randoms(length, seed) | np.uint64(1)):
        out += words[j : j + n] * m
    return mix(out)


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about BYTES_AT_ONCE bytes, each with the place of its first."""
    at, run, total = 0, [], 0
    for i, text in enumerate(texts):
        run.append((text or "").encode())
        total += len(run[-1])
        if total >= BYTES_AT_ONCE or i + 1 == len(texts):
            yield at, run
            at, run, total = i + 1, [], 0
