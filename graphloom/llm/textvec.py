"""Words, hashes and sets of whole texts, vectorised over the bytes of Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at once. Longer texts are cut at separators and their words put together again.
SEGMENT = 1 << 20

_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _powers(p: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate([[_U(1)], np.full(n, _U(p))]))


_POW = {}


def _pows(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POW.get("n", 0) < n:
        m = max(n, SEGMENT + 64)
        _POW.update(n=m, a=_powers(_P, m), b=_powers(_PINV, m))
    return _POW["a"], _POW["b"]


def _byte_values(fold: bool) -> np.ndarray:
    t = mix(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93))
    if fold:
        t[65:91] = t[97:123]
    return t


#: Bytes that separate words: space and 0x09 to 0x0D. All else makes words; A-Z count as a-z.
SPACE_WORDS = np.ones(256, np.uint8)
SPACE_WORDS[[32, *range(9, 14)]] = 0
#: Runs of letters, digits and non-ASCII bytes are words (1), runs of other visible bytes are marks (2).
TERMS = np.full(256, 2, np.uint8)
TERMS[:33] = 0
TERMS[127] = 0
TERMS[48:58] = TERMS[65:91] = TERMS[97:123] = 1
TERMS[128:] = 1
#: As TERMS, without the marks.
WORDS = np.where(TERMS == 1, 1, 0).astype(np.uint8)

_VALUES = _byte_values(fold=True)


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the row offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
    return data, off


def words_of(b: np.ndarray, starts: np.ndarray, kinds: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the bytes b, in order, and how many begin before each of starts (and before the end).

    With prefixes, each word's hash is followed by those of its first so many bytes (its own, where it is shorter)."""
    n = len(b)
    if not n:
        return np.zeros(0, _U), np.zeros(len(starts) + 1, np.int64)
    c = kinds[b]
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(c[1:], c[:-1], out=new[1:])
    new[starts[starts < n]] = True
    at = np.flatnonzero(new)
    end = np.append(at[1:], n)
    keep = c[at] > 0
    at, end = at[keep], end[keep]
    power, inverse = _pows(n)
    total = np.zeros(n + 1, _U)
    np.cumsum(_VALUES[b] * power[:n], out=total[1:])
    ptr = np.searchsorted(at, np.append(starts, n))
    h = mix((total[end] - total[at]) * inverse[at] + (end - at).astype(_U))
    if prefixes:
        ends = [np.minimum(at + k, end) for k in prefixes]
        h = np.column_stack([h, *[mix((total[e] - total[at]) * inverse[at] + (e - at).astype(_U)) for e in ends]]).ravel()
        ptr = ptr * (1 + len(prefixes))
    return h, ptr


def word_batches(column: pa.Array | pa.ChunkedArray, kinds: np.ndarray, prefixes: tuple[int, ...] = ()) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, word hashes, offsets of rows into them), over all rows; whole texts of any length."""
    data, off = raw(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + SEGMENT, "right")) - 1)
        hi = min(hi, n)
        a, z = int(off[lo]), int(off[hi])
        if z - a <= SEGMENT or hi > lo + 1:
            h, ptr = words_of(data[a:z], off[lo:hi] - a, kinds, prefixes)
        else:
            parts = []
            while a < z:
                cut = min(a + SEGMENT, z)
                if cut < z:  # back to a separator, or on to the next one
                    back = np.flatnonzero(kinds[data[a:cut]] == 0)
                    if len(back):
                        cut = a + int(back[-1]) + 1
                    else:
                        while cut < z and kinds[data[cut]] != 0:
                            cut += 1
                parts.append(words_of(data[a:cut], np.zeros(1, np.int64), kinds, prefixes)[0])
                a = cut
            h = np.concatenate(parts)
            ptr = np.array([0, len(h)])
        yield lo, hi, h, ptr
        lo = hi


#: distinct() keeps so many bits of a hash, beside the row number.
TERM_BITS = 44


def distinct(h: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, values (the upper TERM_BITS bits of the hashes) and counts of each row's distinct values, in order."""
    row = np.repeat(np.arange(len(ptr) - 1, dtype=_U), np.diff(ptr))
    both = np.sort((row << _U(TERM_BITS)) | (h >> _U(64 - TERM_BITS)))
    if not len(both):
        return np.zeros(0, np.int64), both, np.zeros(0, np.int64)
    first = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
    count = np.diff(np.append(first, len(both)))
    both = both[first]
    return (both >> _U(TERM_BITS)).astype(np.int64), both & _U((1 << TERM_BITS) - 1), count
