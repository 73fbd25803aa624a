"""Vectorised text primitives shared by the operators: words, word hashes and n-gram hashes over Arrow string batches.

Words are maximal runs of bytes other than space, tab, LF, VT, FF and CR, so UTF-8 text splits the same way as the
pattern ``[^\\x20\\x09-\\x0D]+``. A batch is cut into slices of about two megabytes, so memory does not follow batch size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_MULTIPLIER = 0x9E3779B97F4A7C15
_BYTE_CODE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_GRAM = (np.arange(64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 4096)
        inverse = pow(_MULTIPLIER, -1, 1 << 64)
        _powers[:] = [np.cumprod(np.full(size, x, dtype=np.uint64)) for x in (_MULTIPLIER, inverse)]
    return _powers[0], _powers[1]


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective scrambler of unsigned 64-bit integers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows holding about ``limit`` bytes; null texts count as empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return
    off = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(off, off[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, data[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each row boundary the number of words before it."""
    if len(buf) == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    word = ~_SEPARATOR[buf]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    at = off[(off > 0) & (off < len(buf))]
    first[at] = word[at]
    last[at - 1] = word[at - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word, the same wherever the word stands."""
    return span_hashes(buf, starts, [ends])[0]


def span_hashes(buf: np.ndarray, starts: np.ndarray, all_ends: list[np.ndarray]) -> list[np.ndarray]:
    """Hashes of spans that begin at ``starts``, for each array of ends; the first array holds the largest ends."""
    out = [np.empty(len(starts), np.uint64) for _ in all_ends]
    ends, at = all_ends[0], 0
    while at < len(starts):
        base = int(starts[at])
        stop = max(int(np.searchsorted(ends, base + SLICE_BYTES, side="right")), at + 1)
        power, inverse = _power_tables(int(ends[stop - 1]) - base)
        part = buf[base : ends[stop - 1]]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE_CODE[part] * power[: len(part)], out=total[1:])
        s = starts[at:stop] - base
        before, back = total[s], inverse[s]
        for hashes, some in zip(out, all_ends, strict=True):
            e = some[at:stop] - base
            hashes[at:stop] = mix64((total[e] - before) * back + (e - s).astype(np.uint64))
        at = stop
    return out


def gram_hashes(words: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of n words inside a row, and the index of its first word."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(count, np.uint64)
    for i in range(n):
        h += words[i : i + count] * _GRAM[i]
    inside = np.ones(count + n, dtype=bool)
    for i in range(1, n):
        at = bounds - i
        inside[at[(at >= 0) & (at < count)]] = False
    keep = np.flatnonzero(inside[:count])
    return mix64(h[keep]), keep


def counts(bounds: np.ndarray) -> np.ndarray:
    return np.diff(bounds)
