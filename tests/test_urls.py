"""URL resolution against urllib's urljoin for bases with an authority."""

from urllib.parse import urljoin

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lisible.functions.urls import resolve

BASES = ["http://a.example.com/b/c/d;p?q=1#frag", "https://x.org", "https://x.org/dir/", "http://h/a//b/c"]
REFS = ["", "/z", "z", "../z", "../../../../z", "./z", "//q/r", "?k=1", "#f", "mailto:me@x",
        "https://other/p/../q", "z/./y/../w", ".", "..", "/a/b/..", "/a/./b/.", "g?y#s", "../.."]


def _resolve_all(spark, pairs):
    df = spark.createDataFrame(pairs, "base string, ref string")
    return [r["o"] for r in df.select(resolve(F.col("base"), F.col("ref")).alias("o")).collect()]


def test_fixture_hrefs(spark):
    pairs = [(b, r) for b in BASES for r in REFS]
    assert _resolve_all(spark, pairs) == [urljoin(b, r) for b, r in pairs]


def test_unparsable_base(spark):
    assert _resolve_all(spark, [("http://[bad/x", "/z"), ("http://[bad/x", "")]) == [None, "http://[bad/x"]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "/", ".", "..", "?", "#", "x=1"]), max_size=8),
       st.sampled_from(BASES))
def test_random_refs(spark, parts, base):
    ref = "".join(parts)
    if ref.startswith("//") or ":" in ref:
        return
    assert _resolve_all(spark, [(base, ref)]) == [urljoin(base, ref)]
