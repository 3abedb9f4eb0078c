"""Hashes over token sequences, and runs of windows that share their smallest k-gram.

A text is a sequence of tokens (bytes or words), each with a 64-bit code. ``Prefix`` answers the hash of any span in
constant time. ``segments`` cuts the windows of ``length`` tokens into runs with the same smallest k-gram: equal windows always have
the same smallest k-gram at the same place, so windows need comparing only where that k-gram (the anchor) is shared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
#: Odd codes of the 256 byte values.
BYTE_CODES = np.random.default_rng(20240).integers(0, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)

_powers = {_BASE: np.ones(1, _U), _INVERSE: np.ones(1, _U)}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers[base]
    if len(have) < n:
        have = np.full(max(n, 2 * len(have)), _U(base))
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes."""
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(29))) * _U(0xA24BAED4963EE407)
    return h ^ (h >> _U(32))


class Prefix:
    """Running polynomial sums of token codes; ``of(start, end)`` hashes spans, equal for equal token runs."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.n = n
        self.sums = np.zeros(n + 1, _U)
        np.cumsum(codes * _power(_BASE, n), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * _power(_INVERSE, self.n + 1)[start])

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k tokens from each position that has so many."""
        if self.n < k:
            return np.zeros(0, _U)
        return mix((self.sums[k:] - self.sums[: self.n + 1 - k]) * _power(_INVERSE, self.n + 1 - k))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a batch in one array, and where each begins and ends; a missing text is empty."""
    filled = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    filled = pc.fill_null(filled.cast(pa.large_string()), "").cast(pa.large_binary())
    offsets = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1]
    data = filled.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every maximal run without ASCII white space (0x20, 0x09 to 0x0D)."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
    turn = np.diff(inside)
    return np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)


def word_codes(data: np.ndarray, spans: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """A 64-bit code per word."""
    start, end = word_spans(data) if spans is None else spans
    return Prefix(BYTE_CODES[data]).of(start, end)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def segments(prefix: Prefix, length: int, k: int):
    """(anchor hash, first window, number of windows) of each run of windows with the same smallest k-gram."""
    if prefix.n < length:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, _U), empty, empty
    least = sliding_min(prefix.grams(k), length - k + 1)
    first = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    return least[first], first, np.diff(np.append(first, len(least)))


def placed_segments(prefix: Prefix, length: int, k: int):
    """As ``segments``, with the place of the smallest k-gram; runs are cut where its first place in the window changes.

    Where text has a short period, so that most windows would stand alone, the run stays whole and its place is -1. Runs of the same
    bytes are cut alike.
    """
    if prefix.n < length:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, _U), empty, empty, empty
    grams, width = prefix.grams(k), length - k + 1
    least = sliding_min(grams, width)
    # the k-grams that are smallest in a window; each belongs to one run, and those of following runs differ
    over = np.full(len(least) + 2 * width - 2, ~_U(0))
    np.invert(least, out=over[width - 1 : width - 1 + len(least)])
    at = np.flatnonzero(sliding_min(over, width) == ~grams)
    anchor = grams[at]
    new = np.ones(len(at), bool)
    np.not_equal(anchor[1:], anchor[:-1], out=new[1:])
    start = np.zeros(len(at), np.int64)
    start[1:] = at[:-1] + 1
    first = np.flatnonzero(least[1:] != least[:-1]) + 1
    start[new] = np.append(0, first)
    end = at.copy()
    end[np.append(new[1:], True)] = np.append(first - 1, len(least) - 1)
    if not new.all():  # some k-grams are there twice
        run = np.cumsum(new) - 1
        last = end[np.append(new[1:], True)]
        whole = (np.bincount(run) > 2 + (last - start[new] + 1) // 8)[run]
        end = np.where(whole, last[run], np.minimum(at, last[run]))
        kept = (start <= end) & (new | ~whole)
        anchor, start, end, at = anchor[kept], start[kept], end[kept], np.where(whole, -1, at)[kept]
    return anchor, start, end - start + 1, at


def flanks(prefix: Prefix, length: int, k: int, start: np.ndarray, count: np.ndarray, place: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (of so many bits, 0: none) of the smallest k-gram with half of the rest of a window before it, and with the other half after it.

    Every window of a run has one of the two whole, and which one is told by the place in the window: so runs that share a window share
    its hash. A run without a place has none.
    """
    half = (length - k) // 2
    low, high = np.concatenate([place - half, place]), np.concatenate([place + k, place + (length - half)])
    there = np.flatnonzero(np.concatenate([(place >= 0) & (start <= place - half), (place >= 0) & (start + count > place - half + 1)]))
    found = np.zeros(2 * len(start), np.uint32)
    found[there] = prefix.of(low[there], high[there]) >> _U(64 - bits) | _U(1)
    return found[: len(start)], found[len(start) :]


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of True."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def covered(n: int, start: np.ndarray, count: np.ndarray, length: int) -> np.ndarray:
    """Mask of the n tokens that lie in windows ``start .. start + count - 1`` of ``length`` tokens."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.clip(start, 0, n), 1)
    np.add.at(edge, np.clip(start + count - 1 + length, 0, n), -1)
    return np.cumsum(edge[:-1]) > 0


def texts_binary(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """As ``texts`` for a column of byte strings."""
    whole = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    whole = whole.cast(pa.large_binary())
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = whole.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets
