"""Bit-parallel edit distances over sequences of integers (words): banded global, and search in a text."""

from __future__ import annotations

import numpy as np


def positions(seq) -> dict[int, int]:
    """For each symbol, an integer whose bit i is set where seq[i] is that symbol."""
    out: dict[int, int] = {}
    for i, x in enumerate(seq):
        out[x] = out.get(x, 0) | (1 << i)
    return out


def trimmed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a and b without their common start and end, which cost nothing in an optimal alignment."""
    n = min(len(a), len(b))
    same = np.flatnonzero(a[:n] != b[:n])
    lead = int(same[0]) if len(same) else n
    a, b = a[lead:], b[lead:]
    n = min(len(a), len(b))
    same = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(same[0]) if len(same) else n
    return a[: len(a) - tail], b[: len(b) - tail]


def banded_distance(a, b, most: int) -> int:
    """The edit distance of a and b where it is at most ``most``, else ``most + 1``.

    One column of the alignment matrix is a machine-independent integer of ``2 * most + 1`` bits, the band of
    diagonals that an alignment within the budget can reach; the band moves down a row with each column.
    """
    a, b = trimmed(np.asarray(a), np.asarray(b))
    if len(a) < len(b):
        a, b = b, a
    m, n = len(a), len(b)
    if m - n > most:
        return most + 1
    if n == 0:
        return m
    k = min(most, m)
    where = positions(a.tolist())
    full = (1 << (2 * k + 1)) - 1
    top = 1 << (2 * k)
    up, down = (full >> k) << k, 0  # vertical steps of +1 and -1 inside the band
    score = k  # of the lowest row of the band in the column before the first
    for j, symbol in enumerate(b.tolist()):
        eq = where.get(symbol, 0)
        eq = ((eq >> (j - k)) if j >= k else (eq << (k - j))) & full
        diagonal = ((((eq & up) + up) ^ up) | eq | down) & full  # steps of 0 along the diagonal
        plus = (down | ~(diagonal | up)) & full
        minus = diagonal & up
        if j < m - k:
            if not diagonal & top:
                score += 1
            if score - (n - j - 1) - k > k:
                return most + 1
        else:
            bit = 1 << (m - 1 - j + k)
            if plus & bit:
                score += 1
            elif minus & bit:
                score -= 1
        moved = diagonal >> 1
        up = (minus | ~(moved | plus)) & full
        down = moved & plus
    return score if score <= most else most + 1


def search(pattern, text) -> tuple[int, int]:
    """(distance, end): the least edit distance of pattern to any run of text, and where the first such run ends."""
    m = len(pattern)
    where = positions(pattern)
    full, last = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, 0
    for j, symbol in enumerate(text):
        eq = where.get(symbol, 0)
        through = eq | down
        diagonal = ((((eq & up) + up) ^ up) | through) & full
        plus = (down | ~(diagonal | up)) & full
        minus = diagonal & up
        if plus & last:
            score += 1
        elif minus & last:
            score -= 1
        plus = (plus << 1) & full  # a run may start anywhere: the top row costs nothing
        minus = (minus << 1) & full
        up = (minus | ~(diagonal | plus)) & full
        down = diagonal & plus
        if score < best:
            best, end = score, j + 1
    return best, end


def find(pattern, text) -> tuple[int, int, int]:
    """(distance, start, end) of the closest run of text."""
    best, end = search(pattern, text)
    _, back = search(pattern[::-1], text[:end][::-1])
    return best, end - back, end
