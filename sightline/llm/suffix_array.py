"""Suffix arrays in numpy: Larsson-Sadakane refinement, and Kasai's common prefixes by runs.

Texts are arrays of whole numbers below 2^64, so that a symbol can be a byte or eight of them.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of text ordered by their first depth symbols at least.

    The first sort takes one symbol; each round then doubles the sorted depth, and only the groups that are
    not yet single are sorted again, by their own and their h-th follower's group.
    """
    n = len(text)
    sa = np.argsort(text)
    new = np.concatenate([[True], text[sa[1:]] != text[sa[:-1]]]) if n else np.empty(0, bool)
    rank = np.empty(n + 1, np.int64)
    rank[sa], rank[n] = np.maximum.accumulate(np.where(new, np.arange(n), 0)), -1
    h = 1
    while h < depth:
        at = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(at):
            break
        own = sa[at]
        key = rank[own] << 32 | rank[np.minimum(own + h, n)] + 1
        order = np.argsort(key)
        key = key[order]
        sa[at] = own[order]
        new[at[1:]] |= key[1:] != key[:-1]
        rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        h *= 2
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each place in sa the common prefix with the place before, in symbols, most at most.

    In text order a suffix whose predecessor lies at the same distance as its left neighbour's has that
    neighbour's prefix less one (Kasai), until the prefix is used up; only the heads of such runs are
    compared, all at once, and to one more symbol for each place of the run.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    distance = np.where(before >= 0, np.arange(n) - before, 0)
    heads = np.flatnonzero(np.concatenate([[True], distance[1:] != distance[:-1]])) if n else np.empty(0, np.int64)
    ends = np.append(heads[1:], n)[: len(heads)]
    real = before[heads] >= 0
    own, end, at_head = heads[real], ends[real], np.zeros(n, np.int64)
    head_of = np.zeros(n, np.int64)
    head_of[heads] = heads
    while len(own):
        other = before[own]
        reach = np.minimum(most + end - own - 1, n - np.maximum(own, other))
        length, going = np.zeros(len(own), np.int64), np.flatnonzero(reach > 0)
        while len(going):
            going = going[text[own[going] + length[going]] == text[other[going] + length[going]]]
            length[going] += 1
            going = going[length[going] < reach[going]]
        at_head[own] = length
        head_of[own] = own
        more = own + length + 1 < end  # the prefix is used up within the run: its rest is a run of its own
        own, end = (own + length + 1)[more], end[more]
    head_of = np.maximum.accumulate(head_of)
    by_text = np.maximum(at_head[head_of] - (np.arange(n) - head_of), 0)
    by_text[before < 0] = 0
    return np.minimum(by_text, most)[sa]
