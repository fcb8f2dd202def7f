"""CRC-32 of words and of runs of words: each word is read once, longer runs are composed.

The CRC of a text A followed by B is the CRC of A, moved on by as many zero bytes as B has, exclusive-or the CRC of B. Moving
on by one byte is a linear map over GF(2) on the 32 bits, so any number of bytes is a product of powers of its matrix. The
matrices are kept for the digits of a number to the base 64, each as four tables of 256 entries (one for each byte of the CRC).
"""

from __future__ import annotations

import functools
import zlib

import numpy as np

#: Fixed value: the polynomial of CRC-32, lowest bit first.
POLYNOMIAL = 0xEDB88320

BASE_BITS = 6
#: Words of more bytes than this are read by zlib one by one, shorter ones side by side.
LONG = 64

#: Bytes of words after A-Z are lower-cased: digits, letters, and all of code points from 0x80 on.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _bytewise() -> np.ndarray:
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = (crc >> 1) ^ np.where(crc & 1, np.uint32(POLYNOMIAL), np.uint32(0))
    return crc


_TABLE = _bytewise()
#: The 1,024 values that the four tables of a map are the images of: each byte in each of the four places.
_UNITS = (np.arange(256, dtype=np.uint32)[None] << (8 * np.arange(4, dtype=np.uint32))[:, None]).reshape(-1)


def _apply(tables: np.ndarray, at: np.ndarray | int, crc: np.ndarray) -> np.ndarray:
    """tables: flat, 1,024 entries a map; at: where the map of each crc begins."""
    out = tables[at + (crc & 255).astype(np.int64)]
    for k in (1, 2, 3):
        out ^= tables[at + 256 * k + ((crc >> np.uint32(8 * k)) & 255).astype(np.int64)]
    return out


@functools.cache
def _digit_maps(level: int) -> np.ndarray:
    """The maps of 0 to 63 times 64**level zero bytes, flat."""
    if level:
        below = _digit_maps(level - 1)
        step = _apply(below, 63 * 1024, _apply(below, 1024, _UNITS))
    else:
        step = _TABLE[_UNITS & 255] ^ (_UNITS >> 8)
    maps = [_UNITS]
    for _ in range((1 << BASE_BITS) - 1):
        maps.append(_apply(step, 0, maps[-1]))
    return np.concatenate(maps)


def shifted(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """Each CRC moved on by a number of zero bytes."""
    level, rest = 0, n_bytes.astype(np.int64)
    while len(rest) and rest.any():
        crc = _apply(_digit_maps(level), (rest & 63) << 10, crc)
        level, rest = level + 1, rest >> BASE_BITS
    return crc


def words_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """crc, bytes and row of each word of texts: data their bytes, bounds where each one begins and the last one ends.

    Words are runs of digits, letters and whatever is not ASCII, with A-Z lower-cased.
    """
    inside = _IN_WORD[data]
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside.copy()
    before[bounds[:-1][bounds[:-1] < len(data)]] = False
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside.copy()
    ends_at = bounds[1:][bounds[1:] > 0] - 1
    after[ends_at] = False
    starts = np.flatnonzero(inside & ~before)
    sizes = np.flatnonzero(inside & ~after) + 1 - starts
    rows = np.searchsorted(bounds, starts, side="right") - 1
    return _crcs(_LOWER[data], starts, sizes), sizes, rows


def _crcs(low: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    order = np.argsort(-sizes, kind="stable")
    n_long = int(np.count_nonzero(sizes > LONG))
    short = order[n_long:]
    at, left = starts[short], len(short) - np.cumsum(np.bincount(sizes[short], minlength=LONG + 1))  # left[j]: words of more than j bytes
    crc = np.full(len(short), 0xFFFFFFFF, np.uint32)
    for j in range(LONG):
        m = left[j]
        if not m:
            break
        crc[:m] = _TABLE[(crc[:m] ^ low[at[:m] + j]) & 255] ^ (crc[:m] >> 8)
    out = np.empty(len(starts), np.uint32)
    out[short] = ~crc
    for k in order[:n_long]:
        out[k] = zlib.crc32(low[starts[k] : starts[k] + sizes[k]])
    return out


def run_crcs(word: np.ndarray, sizes: np.ndarray, rows: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length up to `most`: crc and row of all runs of so many consecutive words of a row, joined by one blank."""
    blank = np.full(len(word), zlib.crc32(b" "), np.uint32)
    tail = shifted(blank, sizes) ^ word  # of a blank and the word
    out, crc = [(word, rows)], word
    for n in range(1, most):
        crc = shifted(crc[:-1], sizes[n:] + 1) ^ tail[n:]
        same = rows[n:] == rows[: max(len(rows) - n, 0)]
        out.append((crc[same], rows[n:][same]))
    return out
