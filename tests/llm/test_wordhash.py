import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lisible.llm import wordhash as wh


def plain(text, width):
    words = (text or "").encode().lower().split()
    if len(words) < width:
        return [tuple(words)] if words else []
    return [tuple(words[i:i + width]) for i in range(len(words) - width + 1)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="abÀé \n\x0b\x1fZ", max_size=40)), min_size=1, max_size=12), st.integers(1, 5), st.integers(1, 200))
def test_words_and_shingles(texts, width, chunk):
    seen, rows = {}, 0
    for start, stop, hashes, counts in wh.chunks(pa.array(texts, pa.string()), chunk):
        values, n = wh.shingles(hashes, counts, width)
        sets, sizes = wh.distinct(values, n)
        at = to = 0
        for text, k, size in zip(texts[start:stop], n, sizes):
            own = plain(text, width)
            assert len(own) == k and len(set(own)) == size
            for shingle, h in zip(own, values[at:at + k]):
                assert seen.setdefault(shingle, h) == h
            assert list(sets[to:to + size]) == sorted({h for h in values[at:at + k]})
            at, to = at + k, to + size
        rows += stop - start
    assert rows == len(texts) and len(set(seen.values())) == len(seen)


def test_counter():
    c = wh.Counter(2, limit=10)
    total = {}
    rng = np.random.default_rng(0)
    for _ in range(20):
        keys = rng.integers(0, 8, 5).astype(np.uint64)
        weights = rng.integers(0, 3, (5, 2))
        c.add(keys, weights)
        for k, w in zip(keys, weights):
            total[int(k)] = total.get(int(k), 0) + w
        if c.full():
            for k, w in zip(*c.take()):
                total[int(k)] = total[int(k)] - w
    for k, w in zip(*c.take()):
        total[int(k)] = total[int(k)] - w
    assert all((w == 0).all() for w in total.values())
