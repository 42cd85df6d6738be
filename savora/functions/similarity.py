"""Matching-block ratio of names (Ratcliff and Obershelp's), for many pairs at once in numpy.

The longest common block of two texts is matched (of equals the one that starts first in the left
text, then in the right one), then what lies left and right of it, and so on. All open parts of all
pairs make a wave: one pass over the left texts' characters finds every part's longest block. The
order of the arguments matters. In right texts of 200 characters or more, characters that make up
more than a hundredth of it (and one) start no block, but extend one.
"""

from __future__ import annotations

from collections import Counter

import numpy as np

POPULAR_FROM = 200
CELLS = 4_000_000


def _coded(texts: list[str]) -> np.ndarray:
    """Code points, padded with -1."""
    out = np.full((len(texts), max(map(len, texts), default=0)), -1, dtype=np.int64)
    for row, text in zip(out, texts, strict=True):
        row[: len(text)] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return out


def _seeds(texts: list[str], coded: np.ndarray) -> np.ndarray:
    """coded, with characters that start no block replaced by -2."""
    out = coded
    for k, text in enumerate(texts):
        if len(text) >= POPULAR_FROM:
            many = [ord(c) for c, n in Counter(text).items() if n > len(text) // 100 + 1]
            if many:
                out = out.copy() if out is coded else out
                out[k, np.isin(out[k], many)] = -2
    return out


def _longest(a: np.ndarray, b: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """size and both starts of the longest block of each part (pair, left from, to, right from, to)."""
    pair, alo, ahi, blo, bhi = parts.T
    width, height = int((bhi - blo).max()), int((ahi - alo).max())
    columns = blo[:, None] + np.arange(width)
    right = np.where(columns < bhi[:, None], b[pair[:, None], np.minimum(columns, b.shape[1] - 1)], -1)
    run = np.zeros((len(parts), width + 1), dtype=np.int64)
    size, i, j = np.zeros(len(parts), dtype=np.int64), alo.copy(), blo.copy()
    every = np.arange(len(parts))
    for k in range(height):
        at = alo + k
        left = np.where(at < ahi, a[pair, np.minimum(at, a.shape[1] - 1)], -3)
        run[:, 1:] = np.where(right == left[:, None], run[:, :-1] + 1, 0)
        best = run[:, 1:].argmax(axis=1)
        longest = run[every, best + 1]
        better = longest > size
        size = np.where(better, longest, size)
        i, j = np.where(better, at - longest + 1, i), np.where(better, blo + best - longest + 1, j)
    return size, i, j


def _extended(a: np.ndarray, b: np.ndarray, parts: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks grown by equal characters on both sides, within their parts."""
    pair, alo, ahi, blo, bhi = parts.T
    for step in (-1, 1):
        while True:
            x, y = (i - 1, j - 1) if step < 0 else (i + size, j + size)
            inside = (x >= alo) & (y >= blo) if step < 0 else (x < ahi) & (y < bhi)
            more = inside & (a[pair, np.where(inside, x, 0)] == b[pair, np.where(inside, y, 0)])
            if not more.any():
                break
            size = size + more
            i, j = (i - more, j - more) if step < 0 else (i, j)
    return size, i, j


def matching_ratios(left: list[str], right: list[str]) -> np.ndarray:
    """Twice the matched characters over all characters; 1 for two empty texts."""
    out = np.ones(len(left))
    order = sorted(range(len(left)), key=lambda k: len(left[k]) + len(right[k]))
    at = 0
    while at < len(order):
        some, widest = [], 1
        while at < len(order) and (not some or (len(some) + 1) * max(widest, len(right[order[at]])) * 2 <= CELLS):
            widest = max(widest, len(right[order[at]]))
            some.append(order[at])
            at += 1
        out[some] = _ratios([left[k] for k in some], [right[k] for k in some])
    return out


def _ratios(left: list[str], right: list[str]) -> np.ndarray:
    a, b = _coded(left), _coded(right)
    na, nb = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    matched = np.zeros(len(left), dtype=np.int64)
    if a.shape[1] and b.shape[1]:
        seeds, popular = _seeds(right, b), nb >= POPULAR_FROM
        parts = np.stack([np.arange(len(left)), 0 * na, na, 0 * nb, nb], axis=1)
        while True:
            parts = parts[(parts[:, 2] > parts[:, 1]) & (parts[:, 4] > parts[:, 3])]
            if not len(parts):
                break
            size, i, j = _longest(a, seeds, parts)
            if popular.any():
                grow = popular[parts[:, 0]]
                size[grow], i[grow], j[grow] = _extended(a, b, parts[grow], size[grow], i[grow], j[grow])
            hit = size > 0
            parts, size, i, j = parts[hit], size[hit], i[hit], j[hit]
            np.add.at(matched, parts[:, 0], size)
            pair, alo, ahi, blo, bhi = parts.T
            parts = np.concatenate([np.stack([pair, alo, i, blo, j], axis=1), np.stack([pair, i + size, ahi, j + size, bhi], axis=1)])
    total = na + nb
    return np.where(total > 0, 2.0 * matched / np.maximum(total, 1), 1.0)
