"""Periodic runs of words: multi-scale minimizers, direct lag scans for short periods.

A run is a maximal stretch of words that repeats with its smallest period q and
is at least ``max(MIN_WORDS, 3 q)`` long. Words are numbered by value within a
document, so equal numbers are equal words.

- Periods up to ``SHORT`` are scanned directly: the words are compared with
  themselves ``q`` further, and long stretches of agreement are runs.
- Longer periods are searched scale by scale; scale W takes the periods in
  (W, 2W]. A gram is W/2 words long, and a gram is selected when its hash is
  the least of a window of W/2 grams. Inside a run equal windows stand a period
  apart, so the window's minimum and its copy are both selected, have equal
  hashes and stand q apart: such pairs are the seeds. Grams that are themselves
  part of a run of a period up to a third of their length (found at earlier
  scales) are not selected; any other gram can be repeated only at distances
  beyond that third, so a gram has a bounded number of partners within 2W, and
  a longer run always holds such a gram in each period (else all of it would
  have the short period).
- A seed (m, m + d) is extended word by word to both sides. As a run is three
  periods long, its gram stands three times at distance d; seeds without a
  third one are dropped.

A stretch that has a smaller period is reported with that one only. Words are
compared themselves (hashes only choose seeds), so the result is exact.

Inputs and their results: null and empty texts and texts without words have no
runs and an empty collapsed text; texts are taken whole (memory is about ten
times the longest text); equal texts get equal runs wherever they stand, rows
that repeat a doc_id are answered each; columns other than doc_id and text are
ignored; an empty table gives no rows. In the query a null doc_id plants
nothing.
"""

from __future__ import annotations

import functools
import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lisible.llm.common import read
from lisible.llm.wordhash import BASE, BASE_INVERSE, mix

#: Shortest run in words, and periods that are scanned directly (a power of two, the first scale).
MIN_WORDS, SHORT = 24, 64
#: Words of adjacent documents that are searched together (a longer document is searched alone).
CHUNK_WORDS = 100_000

_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], equal.view(np.int8), [0]])))
    return edge[0::2], edge[1::2]


@functools.cache
def _proper(q: int) -> list[int]:
    """Largest proper divisors of q, one per prime factor."""
    out, left, p = [], q, 2
    while left > 1:
        if left % p == 0:
            out.append(q // p)
            while left % p == 0:
                left //= p
        p += 1 if p * p <= left else max(left - p, 1)
    return out


def is_smallest(ids: np.ndarray, start: int, q: int) -> bool:
    """Whether no divisor of q is a period of the stretch of period q, at least 2q long, that begins at ``start``.

    A stretch of three periods has no smaller period but a divisor of q.
    """
    for d in _proper(q):
        if ids[start] == ids[start + d] and np.array_equal(ids[start:start + 2 * q - d], ids[start + d:start + 2 * q]):
            return False
    return True


def agreement(ids: np.ndarray, at: int, d: int) -> tuple[int, int]:
    """The maximal stretch [start, end) around ``at`` whose words equal those d further; ids[at] == ids[at + d]."""
    start, step = at, 64
    while start > 0:
        low = max(0, start - step)
        bad = np.flatnonzero(ids[low:start] != ids[low + d:start + d])
        if len(bad):
            start = low + int(bad[-1]) + 1
            break
        start, step = low, 2 * step
    end, step = at, 64
    most = len(ids) - d
    while end < most:
        high = min(most, end + step)
        bad = np.flatnonzero(ids[end:high] != ids[end + d:high + d])
        if len(bad):
            end += int(bad[0])
            break
        end, step = high, 2 * step
    return start, end


def _sliding(values: np.ndarray, width: int, take) -> np.ndarray:
    """take (minimum or maximum) over each window of ``width`` (a power of two) values."""
    step = 1
    while step < width:
        values = take(values[:-step], values[step:])
        step *= 2
    return values


@functools.lru_cache(maxsize=4)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, BASE_INVERSE):
        full = np.full(1 << bits, base, dtype=np.uint64)
        full[0] = 1
        out.append(np.multiply.accumulate(full))
    return out[0], out[1]


def seeds(ids: np.ndarray, doc: np.ndarray, scale: int, periodic: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(position, distance) of equal selected grams that stand ``scale`` to ``2 * scale`` apart.

    ``ids`` are words with a value of its own after each document, ``doc`` the document's number of each word,
    ``periodic`` stretches [start, end) of gram positions that are not selected.
    """
    gram = window = scale // 2
    n = len(ids) - gram + 1
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none
    powers, inverses = _powers(max(16, len(ids).bit_length()))
    sums = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum(mix(ids.astype(np.uint64)) * powers[:len(ids)], out=sums[1:])
    value = mix((sums[gram:] - sums[:-gram]) * inverses[:n]) >> np.uint64(1)
    for start, end in periodic:
        value[start:end] = _FULL
    least = _sliding(value, window, np.minimum)
    pad = np.zeros(window - 1, np.uint64)
    # the largest of the minima of the windows that hold a position; it is the position's own value if one window has it as minimum
    chosen = _sliding(np.concatenate([pad, least, pad]), window, np.maximum) == value
    at = np.flatnonzero(chosen & (value != _FULL))
    order = np.lexsort((at, value[at]))
    at = at[order]
    v = value[at]
    found_at, found_d = [], []
    left = np.arange(len(at))
    k = 1
    while len(left):
        left = left[left + k < len(at)]
        d = at[left + k] - at[left]
        near = (v[left + k] == v[left]) & (d <= 2 * scale)
        left, d = left[near], d[near]
        take = d > scale
        found_at.append(at[left[take]])
        found_d.append(d[take])
        k += 1
    m = np.concatenate(found_at) if found_at else none
    d = np.concatenate(found_d) if found_d else none
    same = doc[m] == doc[m + d]
    m, d = m[same], d[same]
    before, after = m - d, np.minimum(m + 2 * d, len(ids) - 1)
    third = ((before >= 0) & (ids[np.maximum(before, 0)] == ids[m])) | ((m + 2 * d < len(ids)) & (ids[after] == ids[m]))
    return m[third], d[third]


def find_runs(documents: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each document, by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    long_enough = [i for i, ids in enumerate(documents) if len(ids) >= MIN_WORDS]
    scale = 0
    while long_enough:
        # words of the documents one after the other, each document closed by a value that stands nowhere else
        lengths = np.array([len(documents[i]) + 1 for i in long_enough])
        starts = np.cumsum(lengths) - lengths
        ids = np.concatenate([np.append(documents[i], -1 - j) for j, i in enumerate(long_enough)])
        doc = np.repeat(np.arange(len(long_enough)), lengths)
        found = []
        if scale == 0:
            for q in range(1, min(SHORT, (int(lengths.max()) - 1) // 3) + 1):
                begin, end = stretches(ids[q:] == ids[:-q])
                long = end - begin >= max(MIN_WORDS - q, 2 * q)
                found += [(int(s), int(e) + q, q) for s, e in zip(begin[long], end[long]) if is_smallest(ids, s, q)]
            scale = SHORT
        else:
            gram = scale // 2
            periodic = [(int(starts[j]) + s, int(starts[j]) + s + length - gram + 1)
                        for j, i in enumerate(long_enough) for s, length, q in out[i] if q <= gram // 3 and length >= gram]
            m, d = seeds(ids, doc, scale, periodic)
            last = (0, -1)
            for at, q in zip(*(x[np.lexsort((m, d))].tolist() for x in (m, d))):
                if last[0] == q and at < last[1]:
                    continue  # the stretch is known
                begin, end = agreement(ids, at, q)
                last = (q, end)
                if end - begin >= 2 * q and is_smallest(ids, begin, q):
                    found.append((begin, end + q, q))
            scale *= 2
        for begin, end, q in found:
            j = int(doc[begin])
            out[long_enough[j]].append((begin - int(starts[j]), end - begin, q))
        long_enough = [i for i in long_enough if len(documents[i]) > 3 * scale]
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        gone[start + q] += 1
        gone[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period, ties to the smallest start, then period."""
    best = None
    for r in runs:  # in order of start, then period
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def plant(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The query's words: where crc32 of the id is divisible by ten, the words from some point on repeat with a period."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * (-(-(n - a) // p)))[:n - a]


OUT = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string, collapsed string"


def _answers(doc_ids: list, texts: list[list[bytes]], with_text: bool) -> pa.RecordBatch:
    number: dict[bytes, int] = {}
    ids = [np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)) for words in texts]
    columns: list[list] = [[] for _ in range(9)]
    for doc_id, words, runs in zip(doc_ids, texts, find_runs(ids)):
        best = strongest(runs)
        kept = b" ".join(collapse(words, runs))
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        row = [doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
               hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None]
        for column, v in zip(columns, row):
            column.append(v)
    kinds = [pa.int64()] * 6 + [pa.string()] * 3
    names = [c.split()[0] for c in OUT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def periodic_runs(docs: DataFrame, planted: bool = False, with_text: bool = False) -> DataFrame:
    """doc_id, n_runs, the strongest run, the digests and, on request, the collapsed text of every row.

    ``planted`` lets the words of some documents repeat first, as the query does.
    """
    def run(batches):
        for batch in batches:
            doc_ids, texts, held = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = text.as_py().encode().split() if text.is_valid else []
                words = plant(words, doc_id) if planted else words
                if texts and held + len(words) > CHUNK_WORDS:
                    yield _answers(doc_ids, texts, with_text)
                    doc_ids, texts, held = [], [], 0
                doc_ids.append(doc_id)
                texts.append(words)
                held += len(words)
            if texts:
                yield _answers(doc_ids, texts, with_text)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, OUT)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(read(spark, sf_dir, "documents"), planted=True).drop("collapsed")
