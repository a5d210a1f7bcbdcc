"""Random draws of a whole set, one block of it at a time.

Rows stand in order in blocks of ``size``.  How many of the drawn rows fall into a block follows from splitting the draw down a binary
tree over the blocks: at each node the left part gets a hypergeometric (without replacement) or binomial (with) share.  A node's numbers
come from a generator seeded by the node, so every block finds its share alone and all shares of a draw add up.
"""

from __future__ import annotations

import numpy as np

#: Largest set that numpy splits exactly without replacement; beyond it a share is a rounded normal of the same mean and variance.
EXACT = 1_000_000_000


def _split(rng, left: int, right: int, need: np.ndarray, again: bool) -> np.ndarray:
    if again:
        return rng.binomial(need, left / (left + right))
    if left + right < EXACT:
        return rng.hypergeometric(left, right, need)
    n = left + right
    mean = need * (left / n)
    spread = np.sqrt(np.maximum(mean * (right / n) * ((n - need) / (n - 1)), 0))
    return np.clip(np.rint(rng.normal(mean, spread)), np.maximum(0, need - right), np.minimum(need, left)).astype(np.int64)


def shares(seed: int, draws: int, total: int, picked: int, size: int, block: int, again: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of ``picked`` rows among ``total``: how many of each draw are in the block, and how many in the blocks before it."""
    low, high = 0, max(1, -(-total // size))
    need, before = np.full(draws, picked, np.int64), np.zeros(draws, np.int64)
    while high - low > 1:
        mid = (low + high) // 2
        rng = np.random.default_rng([seed % (1 << 63), low, high])
        got = _split(rng, (mid - low) * size, min(high * size, total) - mid * size, need, again)
        if block < mid:
            need, high = got, mid
        else:
            need, before, low = need - got, before + got, mid
    return need, before


def block_generator(seed: int, block: int) -> np.random.Generator:
    return np.random.default_rng([seed % (1 << 63), block, block + 1, 7])


def members(rng, rows: int, need: np.ndarray) -> np.ndarray:
    """(rows, draws) of 0 and 1: for each draw ``need`` of the rows, every subset as likely as any other.

    Rows are passed once: a row is taken with the chance of what is still needed among the rows left.
    """
    out, left = np.empty((rows, len(need))), need.astype(float)
    for i in range(rows):
        out[i] = rng.random(len(need)) * (rows - i) < left
        left -= out[i]
    return out


def subset_sums(rng, x: np.ndarray, need: np.ndarray, step: int = 512) -> np.ndarray:
    """The sum of the rows of each draw."""
    out, left = np.zeros(len(need)), need.astype(float)
    for at in range(0, len(x), step):
        part = x[at : at + step]
        taken = np.empty((len(part), len(need)))
        for i in range(len(part)):
            taken[i] = rng.random(len(need)) * (len(x) - at - i) < left
            left -= taken[i]
        out += part @ taken
    return out


def resamples(rng, rows: int, need: np.ndarray, step: int = 1 << 20):
    """Places drawn with replacement, ``need`` for each draw: yields (first draw, end of draws, places, number of each), some draws at a time."""
    at = 0
    ends = np.cumsum(need)
    while at < len(need):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + step, "right")))
        yield at, to, rng.integers(0, rows, int(need[at:to].sum())), need[at:to]
        at = to
