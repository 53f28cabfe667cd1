"""Word splitting and hashing of whole texts, vectorised over Arrow batches.

Words are ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 bytes with A-Z in lower case. A word's
hash is a polynomial of its bytes modulo 2**64, mixed; it doesn't depend on where the
word stands, so that a text of any length can be read in pieces.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20  # bytes of text that are hashed at a time
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX1
        x = (x ^ (x >> np.uint64(27))) * _MIX2
        return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, PIECE + (1 << 16))
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            each = np.full(size, base, np.uint64)
            each[0] = 1
            with np.errstate(over="ignore"):
                _powers[name] = np.multiply.accumulate(each)
    return _powers["up"], _powers["down"]


def _is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def _lower(data: np.ndarray) -> np.ndarray:
    return data + (((data >= 65) & (data <= 90)).view(np.uint8) << 5)


def _hash_piece(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of ``data``; a word also ends at each of ``breaks``."""
    data = _lower(data)
    word = ~_is_space(data)
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    inner = breaks[(breaks > 0) & (breaks < len(data))]
    begins[inner] = word[inner]
    ends[inner - 1] = word[inner - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
        return mix((sums[stops] - sums[starts]) * down[starts]), starts, stops


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls count as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets


class Words:
    """The words of some rows: hash, first and last byte, and the bounds of each row's words."""

    def __init__(self, first: int, hashes: np.ndarray, starts: np.ndarray, stops: np.ndarray, bounds: np.ndarray):
        self.first, self.hashes, self.starts, self.stops, self.bounds = first, hashes, starts, stops, bounds

    def __len__(self) -> int:
        return len(self.bounds) - 1


def words_of(column: pa.Array) -> Iterator[Words]:
    """Hash the words of every row, some rows at a time; a long text is read in pieces cut at white space."""
    data, offsets = text_buffers(column)
    row, last = 0, len(column)
    while row < last:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, "right")) - 1)
        stop = min(stop, last)
        low, high = int(offsets[row]), int(offsets[stop])
        if high - low <= 4 * PIECE:
            hashes, starts, stops = _hash_piece(data[low:high], offsets[row:stop] - low)
        else:
            parts, at = [], low
            while at < high:
                end = min(high, at + PIECE)
                while end < high:  # on to the next white space
                    gaps = np.flatnonzero(_is_space(data[end : end + 4096]))
                    if len(gaps):
                        end += int(gaps[0])
                        break
                    end = min(high, end + 4096)
                h, s, e = _hash_piece(data[at:end], np.zeros(0, np.int64))
                parts.append((h, s + (at - low), e + (at - low)))
                at = end
            hashes, starts, stops = (np.concatenate(x) for x in zip(*parts, strict=True))
        yield Words(row, hashes, starts, stops, np.searchsorted(starts, offsets[row : stop + 1] - low))
        row = stop


def give_back() -> None:
    """Return freed memory to the machine at the end of a task, as the Python worker goes on with other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def pack(columns: list[np.ndarray], plain: int = 0) -> bytes:
    """Integer columns as compressed differences, byte by byte; the first ``plain`` ones as they are."""
    with np.errstate(over="ignore"):
        whole = np.stack([x.astype(np.int64) for x in columns])
        steps = np.diff(whole[plain:], axis=1, prepend=0)
        whole[plain:] = (steps << 1) ^ (steps >> 63)
    return pa.Codec("zstd", 4).compress(np.ascontiguousarray(whole.view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1)).tobytes(), asbytes=True)


def unpack(data: bytes, n: int, width: int, plain: int = 0) -> list[np.ndarray]:
    raw = pa.decompress(data, decompressed_size=8 * n * width, codec="zstd", asbytes=True)
    whole = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, 8, n).transpose(0, 2, 1)).view(np.uint64)[:, :, 0]
    folded = whole[plain:]
    with np.errstate(over="ignore"):
        steps = (folded >> np.uint64(1)).view(np.int64) ^ -(folded & np.uint64(1)).view(np.int64)
        return [*whole[:plain].view(np.int64), *np.cumsum(steps, axis=1)]


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words, one for each place where such a run begins."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.full(n, np.uint64(k), np.uint64)
        for j in range(k):
            total = total * _STEP + hashes[j : j + n]
    return mix(total)


def shingle_set(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of a text's k-word shingles; of a shorter text, of the whole sequence."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    return distinct(grams(hashes, min(k, len(hashes))))


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    values = np.sort(values)
    keep = np.empty(len(values), bool)
    keep[:1] = True
    np.not_equal(values[1:], values[:-1], out=keep[1:])
    return values[keep]
