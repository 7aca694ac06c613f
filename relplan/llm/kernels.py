"""Vectorised text primitives over Arrow batches: words, hashes, sliding minima.

Texts of a batch lie in one contiguous byte buffer; the functions here work on
slices of that buffer of about ``CHUNK`` bytes, so working arrays fit the CPU's
cache and memory stays bounded however many texts a batch holds.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK = 1 << 19

_rng = np.random.Generator(np.random.PCG64(20240229))
#: A random value for each byte, for rolling hashes of short k-grams of bytes; they only find candidates.
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = int(_rng.integers(1, 2**62)) * 2 + 1
_INVERSE = pow(_BASE, -1, 2**64)
_GRAM = [int(x) * 2 + 1 for x in _rng.integers(1, 2**62, 64)]

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, U64)
    out[0] = 1
    filled = 1
    while filled < n:
        step = min(filled, n - filled)
        out[filled : filled + step] = out[:step] * U64(pow(base, filled, 2**64))
        filled += step
    return out


_POW, _INV = _powers(_BASE, 2 * CHUNK), _powers(_INVERSE, 2 * CHUNK)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n of each."""
    global _POW, _INV
    if n > len(_POW):
        _POW, _INV = _powers(_BASE, n), _powers(_INVERSE, n)
    return _POW[:n], _INV[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U64(31))
    x *= U64(0x9E3779B97F4A7C15)
    x ^= x >> U64(29)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(32)
    return x


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array, and len+1 offsets into them; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return bytes_[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes, or of one longer row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of every row, and the number of words before each row (len+1)."""
    word = ~sep[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # a word never crosses rows
    begins, ends = word.copy(), word.copy()
    if len(data):
        begins[1:] &= ~word[:-1] | edge[1:-1]
        ends[:-1] &= ~word[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)
_FIRST, _PLACE, _LENGTH = (U64(int(x) * 2 + 1) for x in _rng.integers(1, 2**62, 3))


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on as one number, zeros past the end (len+1)."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), U64, padded.data, strides=(1,))


def _further(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pieces longer than eight bytes: (piece, block) of each block of eight after the first, and where each piece's begin."""
    more = (n - 1) // 8
    begin = np.cumsum(more) - more
    return np.repeat(np.arange(len(n)), more), np.arange(int(more.sum())) - np.repeat(begin, more) + 1, begin


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each piece data[start:end]; pieces are in order and don't overlap.

    The sum of a mixed value for each block of eight bytes, keyed by its place;
    one block and a length decide it for pieces of up to eight bytes.
    """
    out = np.empty(len(starts), U64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + CHUNK, "right")))
        at = int(starts[lo])
        eight = eights(data[at : int(ends[hi - 1])])
        s, n = starts[lo:hi] - at, ends[lo:hi] - starts[lo:hi]
        total = mix((eight[s] & _MASK[np.minimum(n, 8)]) + _FIRST)
        long = np.flatnonzero(n > 8)
        if len(long):
            of, j, begin = _further(n[long])
            block = eight[s[long][of] + 8 * j] & _MASK[np.minimum(n[long][of] - 8 * j, 8)]
            total[long] += np.add.reduceat(mix(block ^ mix(j.astype(U64) * _PLACE)), begin)
        out[lo:hi] = mix(total ^ (n.astype(U64) * _LENGTH))
        lo = hi
    return out


def alike(data: np.ndarray, one: np.ndarray, two: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the n bytes from ``one`` on are those from ``two`` on, for each triple."""
    eight = eights(data)
    mask = _MASK[np.minimum(n, 8)]
    same = (eight[one] & mask) == (eight[two] & mask)
    long = np.flatnonzero((n > 8) & same)
    if len(long):
        of, j, begin = _further(n[long])
        mask = _MASK[np.minimum(n[long][of] - 8 * j, 8)]
        differs = (eight[one[long][of] + 8 * j] & mask) != (eight[two[long][of] + 8 * j] & mask)
        same[long] = np.add.reduceat(differs.astype(np.int64), begin) == 0
    return same


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(number of each piece, index of one piece for each number): equal numbers are equal bytes.

    Hashes bring candidates together, and bytes decide.
    """
    order, first = groups(hashes(data, starts, ends) if codes is None else codes)
    number = np.empty(len(order), np.int64)
    number[order] = np.repeat(np.arange(len(first)), sizes(first, len(order)))
    sample, n = order[first], ends - starts
    like = sample[number] if len(order) else order
    wrong = np.flatnonzero((n != n[like]) | ~alike(data, starts, starts[like], np.minimum(n, n[like])))
    if len(wrong):  # different pieces share a hash
        known: dict[bytes, int] = {}
        for i in wrong.tolist():
            number[i] = known.setdefault(data[starts[i] : ends[i]].tobytes(), len(sample) + len(known))
        sample = np.concatenate([sample, wrong[np.unique(number[wrong], return_index=True)[1]]])
    return number, sample


def grams(codes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k consecutive codes, whatever rows they are in (len-k+1)."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = codes[:n] * U64(_GRAM[0])
    for j in range(1, k):
        out += codes[j : j + n] * U64(_GRAM[j])
    return mix(out)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All indices of the ranges start .. start+length-1, one range after another."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def runs(*breaks: np.ndarray) -> np.ndarray:
    """First index of each run; a run ends where any of the arrays of n-1 flags is set."""
    n = len(breaks[0]) + 1
    flag = np.ones(n, bool)
    flag[1:] = breaks[0]
    for b in breaks[1:]:
        flag[1:] |= b
    return np.flatnonzero(flag)


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal keys side by side, and where each group of them begins in it."""
    order = np.argsort(keys)
    sorted_ = keys[order]
    return order, runs(sorted_[1:] != sorted_[:-1]) if len(keys) else np.zeros(0, np.int64)


def sizes(first: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(first, n))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each run of w values (len-w+1)."""
    have = 1
    while have < w:
        step = min(have, w - have)
        x = np.minimum(x[: len(x) - step], x[step:])
        have += step
    return x


def within(counts: np.ndarray, k: int) -> np.ndarray:
    """Of all positions, those from which k consecutive ones stay in a row; counts: len+1 cumulative lengths."""
    n = int(counts[-1])
    ok = np.zeros(n + 1, np.int32)
    lengths = np.diff(counts)
    full = lengths >= k
    np.add.at(ok, counts[:-1][full], 1)
    np.add.at(ok, (counts[1:] - k + 1)[full], -1)
    return np.flatnonzero(np.cumsum(ok[:-1]) > 0)


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # not glibc
    _trim = None


def give_back() -> None:
    """Return freed memory to the system; two workers share an executor, and neither should hold on to its peak."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)
