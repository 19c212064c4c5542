"""Words of whole texts as 64-bit hashes, computed over Arrow string buffers with numpy.

A word is a run of bytes other than ASCII white space (0x20, 0x09-0x0D); A-Z
are lower-cased first. UTF-8 never uses these bytes inside another character,
so working on bytes gives the words of the text. The hash of a word is a
polynomial in its bytes modulo 2**64 (read off prefix sums, so a whole buffer
costs a few array operations), then mixed. It is the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: Texts are taken together up to this many bytes (a longer text is taken alone, whole).
CHUNK_BYTES = 150_000

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_is_space = np.zeros(256, dtype=bool)
_is_space[[0x20, *range(0x09, 0x0E)]] = True
#: Also splits at ASCII control characters and punctuation; then a word is letters, digits and non-ASCII characters.
PLAIN_SPACE = np.zeros(256, dtype=bool)
PLAIN_SPACE[:128] = [not chr(c).isalnum() for c in range(128)]
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the result."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _tables(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        full = np.full(size, BASE, dtype=np.uint64)
        full[0] = 1
        _powers = np.multiply.accumulate(full)
        full = np.full(size, BASE_INVERSE, dtype=np.uint64)
        full[0] = 1
        _inverses = np.multiply.accumulate(full)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64, one more than rows) and bytes of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return offsets, np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)


def chunks(column: pa.Array, chunk_bytes: int = CHUNK_BYTES, space: np.ndarray = _is_space) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, words' hashes, word count of each row) over a string column."""
    offsets, data = buffers(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + chunk_bytes, "right")) - 1)
        end = min(end, n)
        part = data[offsets[row]:offsets[end]]
        hashes, counts = words(part, offsets[row:end + 1] - offsets[row], space)
        yield row, end, hashes, counts
        row = end


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _is_space) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of adjacent texts, and how many each text has."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    _tables(n + 1)
    space = space[data]
    first = np.zeros(n + 1, dtype=bool)  # a text begins here
    first[offsets] = True
    begins = ~space
    ends = begins.copy()
    begins[1:] &= space[:-1] | first[1:n]
    ends[:-1] &= space[1:] | first[1:n]
    starts = np.flatnonzero(begins)
    stops = np.flatnonzero(ends) + 1
    sums = np.empty(n + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((_lower[data].astype(np.uint64) + np.uint64(1)) * _powers[:n], out=sums[1:])
    h = mix((sums[stops] - sums[starts]) * _inverses[starts])
    return h, np.diff(np.searchsorted(starts, offsets))


#: Odd multipliers that keep the order of words in a shingle.
ORDER = [0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB,
         0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165]


def shingles(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of ``width`` words, text after text, and how many each text has.

    A text of fewer words has its whole sequence as one shingle; a text without words has none.
    Repeated shingles are kept.
    """
    stops = np.cumsum(counts)
    starts = stops - counts
    out_counts = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    out_stops = np.cumsum(out_counts)
    total = int(out_stops[-1]) if len(out_stops) else 0
    text = np.repeat(np.arange(len(counts)), out_counts)
    at = np.arange(total) - (out_stops - out_counts)[text] + starts[text]
    padded = np.concatenate([hashes, np.zeros(width, np.uint64)])
    h = np.zeros(total, dtype=np.uint64)
    short = counts[text] < width
    for k in range(width):
        part = padded[at + k] * np.uint64(ORDER[k])
        if short.any():
            part = np.where(k < counts[text], part, np.uint64(0))
        h += part
    h += np.where(short, counts[text], width).astype(np.uint64)
    return mix(h), out_counts


def distinct(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text, and how many each text has."""
    text = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    bits = np.uint64(max(1, int(len(counts)).bit_length()))
    # the text's number in front of the value's upper bits: one sort; equal keys are sorted out below
    key = (text << (np.uint64(64) - bits)) | (values >> bits)
    order = np.argsort(key, kind="stable")
    v, t, key = values[order], text[order], key[order]
    tied = (key[1:] == key[:-1]) & (v[1:] != v[:-1])
    if tied.any():
        order = np.lexsort((v, t))
        v, t = v[order], t[order]
    keep = np.ones(len(v), dtype=bool)
    keep[1:] = (v[1:] != v[:-1]) | (t[1:] != t[:-1])
    return v[keep], np.bincount(t[keep].astype(np.int64), minlength=len(counts)).astype(np.int64)


class Counter:
    """Counts of 64-bit keys over a partition, handed on in sorted blocks of bounded size.

    ``add`` takes keys and one or more rows of weights; once more than ``limit``
    keys are held they are summed, and if they are still too many, given out.
    """

    def __init__(self, width: int, limit: int = 3_000_000):
        self.width, self.limit = width, limit
        self.keys: list[np.ndarray] = []
        self.weights: list[np.ndarray] = []
        self.held = 0

    def add(self, keys: np.ndarray, weights: np.ndarray) -> None:
        self.keys.append(keys)
        self.weights.append(weights)
        self.held += len(keys)

    def full(self) -> bool:
        if self.held < self.limit:
            return False
        keys, weights = self.summed()
        self.keys, self.weights, self.held = [keys], [weights], len(keys)
        return self.held > self.limit // 2

    def summed(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.uint64), np.zeros((0, self.width), np.int64)
        keys, where = np.unique(np.concatenate(self.keys), return_inverse=True)
        weights = np.concatenate(self.weights)
        out = np.stack([np.bincount(where, weights[:, j], len(keys)).astype(np.int64) for j in range(self.width)], axis=1)
        return keys, out

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = self.summed()
        self.keys, self.weights, self.held = [], [], 0
        return out
