"""Sorting a bucket of suffixes with a difference cover.

Suffixes are sorted by their first bytes. Where these tie, two suffixes are compared by the
ranks of two sample suffixes: positions are sampled if their residue modulo PERIOD lies in a
difference cover, so for any two positions some shift of less than PERIOD puts both into the
sample. Ranks are computed once for the bucket, for a fixed depth, so long ties cost no more
than short ones and memory stays a few words for each byte.
"""

from __future__ import annotations

import numpy as np

#: The residues of a perfect difference set: every difference modulo 31 occurs once.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)
#: Bytes that the first sort looks at.
HEAD = 32
#: Zero bytes that have to follow the text.
PADDING = 4 * PERIOD + HEAD + 8


def _shifts() -> np.ndarray:
    """For two residues the shift that takes both into the cover."""
    table = np.full((PERIOD, PERIOD), -1, dtype=np.int64)
    for x in range(PERIOD):
        for y in range(PERIOD):
            table[x, y] = next(s for s in range(PERIOD) if (x + s) % PERIOD in COVER and (y + s) % PERIOD in COVER)
    return table


_SHIFT = _shifts()


def words_at(data: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The eight bytes at each position as a number that sorts like them."""
    view = np.ndarray(shape=(len(data) - 7,), dtype=">u8", buffer=data, strides=(1,))
    return view[positions].astype(np.uint64)


def _dense(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Ranks from 1 by the keys that ``order`` sorts."""
    new = np.zeros(len(order), dtype=bool)
    for key in keys:
        ranked = key[order]
        new[1:] |= ranked[1:] != ranked[:-1]
    ranks = np.empty(len(order), dtype=np.int64)
    ranks[order] = np.cumsum(new) + 1
    return ranks


def sample_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """For each sampled position below ``length`` its suffix's rank by 125 bytes; 0 elsewhere."""
    positions = np.flatnonzero(np.isin(np.arange(PERIOD), COVER))
    positions = (np.arange(0, length, PERIOD)[:, None] + positions[None, :]).ravel()
    positions = positions[positions < length]
    ranks = np.zeros(length + 4 * PERIOD + 1, dtype=np.int64)
    keys = [words_at(data, positions + at) for at in range(0, HEAD, 8)]
    ranks[positions] = _dense(np.lexsort(keys[::-1]), *keys)
    for step in (PERIOD, 2 * PERIOD):
        key = ranks[positions] << 32 | ranks[positions + step]
        ranks[positions] = _dense(np.argsort(key), key)
    return ranks


def sort_suffixes(data: np.ndarray, length: int, starts: np.ndarray) -> np.ndarray:
    """``starts`` in the order of their suffixes; suffixes that agree in 125 bytes stand together.

    ``data`` holds ``length`` bytes and then PADDING zeros.
    """
    keys = [words_at(data, starts + at) for at in range(0, HEAD, 8)]
    order = np.lexsort(keys[::-1])
    segments = _dense(order, *keys)[order]
    starts = starts[order]
    sizes = np.bincount(segments)
    if sizes.max(initial=0) < 2:
        return starts
    ranks = sample_ranks(data, length)
    open_at = np.flatnonzero(sizes[segments] > 1)
    groups = segments[open_at]
    while len(open_at):
        # Each group is split by one of its suffixes into those before, equal and after.
        own = starts[open_at]
        heads = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
        counts = np.diff(np.r_[heads, len(groups)])
        pivots = np.repeat(own[heads + counts // 2], counts)
        shift = _SHIFT[own % PERIOD, pivots % PERIOD]
        side = np.sign(ranks[own + shift] - ranks[pivots + shift])
        key = np.repeat(np.arange(len(heads)), counts) * 3 + side + 1
        order = np.argsort(key, kind="stable")
        starts[open_at] = own[order]
        key = key[order]
        sizes = np.bincount(key)
        more = (key % 3 != 1) & (sizes[key] > 1)
        open_at, groups = open_at[more], key[more]
    return starts


def equal_classes(data: np.ndarray, length: int, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted suffixes, and a class number for each: equal if their first ``depth`` bytes are."""
    starts = sort_suffixes(data, length, starts)
    new = np.ones(len(starts), dtype=bool)
    same = np.arange(1, len(starts))
    for at in [*range(0, depth - 7, 8), depth - 8]:
        if not len(same):
            break
        same = same[words_at(data, starts[same] + at) == words_at(data, starts[same - 1] + at)]
    new[same] = False
    return starts, np.cumsum(new) - 1
