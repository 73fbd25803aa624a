"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

Suffixes are classified by their neighbour, leftmost-smaller substrings are ranked by packed chunks of their codes and, if
ranks tie, sorted by recursion on the string of ranks. Over bytes the whole array is then induced in two linear sweeps,
a bucket of one byte at a time; in the recursion, whose alphabet is large, the suffixes between two leftmost-smaller
places are put in order by their codes and the rank of the next such place. The end of the text is smaller than any byte.
"""

from __future__ import annotations

import numpy as np

_SMALL = 48


def classify(t: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the one behind them."""
    n = len(t)
    less, equal = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    less[:-1], equal[:-1] = t[:-1] < t[1:], t[:-1] == t[1:]
    at = np.where(equal, n, np.arange(n))
    return less[np.minimum.accumulate(at[::-1])[::-1]]


def _refined(rank: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Ranks (numbers of smaller ones) after ties are told apart by a key; ranks count from the first of a tie on."""
    order = np.lexsort((key, rank))
    r, k = rank[order], key[order]
    head = np.concatenate(([True], r[1:] != r[:-1]))
    at = np.arange(len(r))
    start = np.maximum.accumulate(np.where(head, at, 0))
    first = np.maximum.accumulate(np.where(head | np.concatenate(([True], k[1:] != k[:-1])), at, 0))
    out = np.empty(len(r), np.int64)
    out[order] = r + (first - start)
    return out


def _ranked(code: np.ndarray, begin: np.ndarray, size: np.ndarray, bits: int) -> np.ndarray:
    """Ranks of the pieces code[begin : begin + size]; a piece sorts before those that it begins."""
    per = 62 // bits
    padded = np.concatenate((code + 1, np.zeros(per + 1, np.int64)))
    rank, done, live = np.zeros(len(begin), np.int64), 0, np.arange(len(begin))
    while len(live):
        key = np.zeros(len(live), np.int64)
        for j in range(per):
            at = np.minimum(begin[live] + done + j, len(code))
            key = (key << bits) | np.where(size[live] > done + j, padded[at], 0)
        rank[live] = _refined(rank[live], key)
        done += per
        live = live[size[live] > done]
        if len(live):  # a piece alone in its rank needs no more
            r = np.sort(rank[live])
            tied = r[1:][r[1:] == r[:-1]]
            live = live[np.isin(rank[live], tied)]
    return rank


def _induced(t: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The whole array from leftmost-smaller places in order; t is of bytes."""
    n = len(t)
    count = np.bincount(t, minlength=256)
    end = np.cumsum(count)
    begin = end - count
    sa = np.full(n, -1, np.int32)
    tail_count = np.bincount(t[lms], minlength=256) if len(lms) else np.zeros(256, np.int64)
    tail = end - tail_count
    chars = t[lms].astype(np.int64)
    by = np.argsort(chars, kind="stable")
    offset = np.concatenate(([0], np.cumsum(tail_count)))
    sa[tail[chars[by]] + np.arange(len(lms)) - offset[chars[by]]] = lms[by]

    def place(found: np.ndarray, where: np.ndarray, step: int) -> None:
        """Put suffixes, in order, at the open ends of their buckets."""
        c = t[found]
        by = np.argsort(c, kind="stable")
        c, found = c[by].astype(np.int64), found[by]
        many = np.bincount(c, minlength=256)
        nth = np.arange(len(c)) - (np.cumsum(many) - many)[c]
        sa[where[c] + step * nth] = found
        where += step * many

    head = begin.copy()
    place(np.array([n - 1], np.int32), head, 1)
    for c in np.flatnonzero(count).tolist():
        done = int(begin[c])
        while done < head[c]:
            part = sa[done : head[c]]
            done = int(head[c])
            part = part[part > 0] - 1
            part = part[~small[part]]
            if len(part):
                place(part, head, 1)
        part = sa[tail[c] : end[c]]
        part = part[part > 0] - 1
        part = part[~small[part]]
        if len(part):
            place(part, head, 1)
    last = end - 1
    for c in np.flatnonzero(count).tolist()[::-1]:
        done = int(end[c]) - 1
        while done > last[c]:
            part = sa[int(last[c]) + 1 : done + 1][::-1]
            done = int(last[c])
            part = part[part > 0] - 1
            part = part[small[part]]
            if len(part):
                place(part, last, -1)
        part = sa[begin[c] : head[c]][::-1]
        part = part[part > 0] - 1
        part = part[small[part]]
        if len(part):
            place(part, last, -1)
    return sa


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Places of the suffixes of an array of numbers in ascending order."""
    n = len(t)
    if n <= _SMALL:
        held = t.tolist()
        return np.array(sorted(range(n), key=lambda i: held[i:]), np.int32)
    small = classify(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    code = t.astype(np.int64) * 2 + small
    bits = int(code.max() + 1).bit_length()
    size = np.diff(lms, append=n) + 1
    rank = _ranked(code, lms, size, bits) if len(lms) else np.zeros(0, np.int64)
    order = np.argsort(rank, kind="stable")
    if len(lms) and np.any(rank[order][1:] == rank[order][:-1]):
        dense = np.cumsum(np.concatenate(([0], rank[order][1:] != rank[order][:-1])))
        names = np.empty(len(lms), np.int64)
        names[order] = dense
        order = suffix_array(names)
    lms_sorted = lms[order].astype(np.int32)
    if t.dtype == np.uint8:
        return _induced(t, small, lms_sorted)
    place = np.zeros(n + 1, np.int64)  # rank of leftmost-smaller suffixes from 1 on; the end is 0
    place[lms_sorted] = np.arange(1, len(lms) + 1)
    behind = np.searchsorted(lms, np.arange(n), side="right")
    stop = np.append(lms, n)[behind]
    ranks = _ranked(code, np.arange(n), np.minimum(stop + 1, n) - np.arange(n), bits)
    return np.lexsort((place[stop], ranks)).astype(np.int32)


def permuted_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place the length that its suffix shares with the one before it in order; t is of bytes.

    Where the byte before both is the same, the length is one less than that of the place before; only the others are compared.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    places = np.arange(n)
    prior = t[np.maximum(before, 1) - 1]
    own = t[np.maximum(places, 1) - 1]
    fresh = (places == 0) | (before <= 0) | (prior != own)
    at = np.flatnonzero(fresh)
    length = np.zeros(len(at), np.int64)
    words = np.ndarray((n,), "<u8", buffer=np.concatenate((t, np.zeros(8, np.uint8))).tobytes(), strides=(1,))
    live = np.flatnonzero(before[at] >= 0)
    while len(live):
        i, j = at[live] + length[live], before[at[live]] + length[live]
        inside = np.maximum(i, j) < n
        live, i, j = live[inside], i[inside], j[inside]
        x = words[i] ^ words[j]
        same = np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3).astype(np.int64)
        length[live] += np.minimum(same, n - np.maximum(i, j))
        live = live[same == 8]
    which = np.cumsum(fresh) - 1
    return np.maximum(length[which] - (places - at[which]), 0)
