"""Simple-8b coding of unsigned integers in 64-bit words, vectorised with numpy.

A word has a 4-bit selector and 60 bits of payload; the selector says how many values
the payload holds and how wide they are. Values are coded in blocks of BLOCK, each
starting a new word, so blocks are packed and unpacked side by side. Values of 2**60 or
more don't fit any word: they stand as 0 in the words, with their place and value in a
list of escapes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Fixed values of the format: values per word and bits per value, by selector.
COUNTS = (240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)

BLOCK = 1024
_PAD = COUNTS[0]
_COUNT = np.array(COUNTS, np.int64)


@dataclass
class Coded:
    """``words`` of all blocks; block k has ``words[offsets[k]:offsets[k + 1]]``."""

    size: int
    words: np.ndarray
    offsets: np.ndarray
    escape_at: np.ndarray
    escape_value: np.ndarray


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits of each value; one too many is possible over 2**53, but never over 60."""
    return np.minimum(np.frexp(values.astype(np.float64))[1], 60)


def encode(values: np.ndarray) -> Coded:
    """Code any number of values of up to 64 bits."""
    values = np.asarray(values, np.uint64)
    size = len(values)
    big = np.flatnonzero(values >> np.uint64(60))
    escape_value = values[big]
    rows = -(-size // BLOCK)
    grid = np.zeros((rows, BLOCK + _PAD), np.uint64)
    full = size // BLOCK
    grid[:full, :BLOCK] = values[: full * BLOCK].reshape(full, BLOCK)
    if size % BLOCK:
        grid[full, : size % BLOCK] = values[full * BLOCK :]
    if len(big):
        grid[big // BLOCK, big % BLOCK] = 0
    ends = np.full(rows, BLOCK, np.int64)
    if size % BLOCK:
        ends[-1] = size % BLOCK
    selector = _selectors(_bits(grid).astype(np.int8))
    # Walk all blocks at once: each step places one word in every block that isn't finished.
    at, lane = np.zeros(rows, np.int64), np.arange(rows)
    lanes, places, chosen = [], [], []
    while len(lane):
        s = selector[lane, at]
        lanes.append(lane)
        places.append(at)
        chosen.append(s)
        at = at + _COUNT[s]
        on = at < ends[lane]
        lane, at = lane[on], at[on]
    if not rows:
        none = np.zeros(0, np.uint64)
        return Coded(0, none, np.zeros(1, np.int64), np.zeros(0, np.int64), none)
    lane, place, s = np.concatenate(lanes), np.concatenate(places), np.concatenate(chosen).astype(np.int64)
    order = np.argsort(lane, kind="stable")
    lane, place, s = lane[order], place[order], s[order]
    words = s.astype(np.uint64) << np.uint64(60)
    flat, start = grid.reshape(-1), lane * (BLOCK + _PAD) + place
    for k, (count, width) in enumerate(zip(COUNTS, WIDTHS, strict=True)):
        mine = np.flatnonzero(s == k)
        if width and len(mine):
            for j in range(count):
                words[mine] |= flat[start[mine] + j] << np.uint64(j * width)
    offsets = np.r_[0, np.cumsum(np.bincount(lane, minlength=rows))]
    return Coded(size, words, offsets, big.astype(np.int64), escape_value)


def _selectors(bits: np.ndarray) -> np.ndarray:
    """For each place, the selector whose word would hold most values from there on.

    ``bits`` has _PAD columns of 0 behind each block, so the block's end limits no word.
    The most bits in a window come from those in two shorter windows that cover it.
    """
    n = bits.shape[1] - _PAD
    out = np.full((len(bits), n), len(COUNTS) - 1, np.int8)
    most = {1: bits}
    for k in range(len(COUNTS) - 2, -1, -1):
        count = COUNTS[k]
        part = max(c for c in most if c < count)
        width = most[part].shape[1] - (count - part)
        most[count] = np.maximum(most[part][:, :width], most[part][:, count - part :])
        np.putmask(out, most[count][:, :n] <= WIDTHS[k], np.int8(k))
    return out


def decode(coded: Coded) -> np.ndarray:
    """The values, as unsigned 64-bit integers."""
    rows = len(coded.offsets) - 1
    if rows <= 0:
        return np.zeros(0, np.uint64)
    s = (coded.words >> np.uint64(60)).astype(np.int64)
    count = _COUNT[s]
    ends = np.cumsum(count)
    sizes = np.diff(coded.offsets)
    block = np.repeat(np.arange(rows), sizes)
    before = (ends - count)[coded.offsets[:-1]]
    start = block * (BLOCK + _PAD) + (ends - count) - np.repeat(before, sizes)
    grid = np.zeros(rows * (BLOCK + _PAD), np.uint64)
    for k, (count, width) in enumerate(zip(COUNTS, WIDTHS, strict=True)):
        mine = np.flatnonzero(s == k)
        if width and len(mine):
            word, at, mask = coded.words[mine], start[mine], np.uint64((1 << width) - 1)
            for j in range(count):
                grid[at + j] = (word >> np.uint64(j * width)) & mask
    out = grid.reshape(rows, BLOCK + _PAD)[:, :BLOCK].reshape(-1)[: coded.size]
    out[coded.escape_at] = coded.escape_value
    return out


def decode_block(coded: Coded, k: int) -> np.ndarray:
    """The values of block ``k`` alone, by its offset."""
    lo, hi = coded.offsets[k], coded.offsets[k + 1]
    mine = (coded.escape_at >= k * BLOCK) & (coded.escape_at < (k + 1) * BLOCK)
    return decode(Coded(min(BLOCK, coded.size - k * BLOCK), coded.words[lo:hi], np.array([0, hi - lo]), coded.escape_at[mine] - k * BLOCK, coded.escape_value[mine]))
