"""Reference resolution (relative → absolute URL) as one column expression.

Follows RFC 3986 section 5.2 the way Python's ``urllib.parse.urljoin``
applies it: empty reference → base; a reference with its own scheme stays
as is; ``//host`` takes the base scheme; ``/path`` keeps the base
authority; ``?query`` and ``#fragment`` keep the base path (and the base query when
the reference has none); empty ``?``/``#`` parts are dropped;
anything else merges with the base directory (empty inner segments
dropped). A base without ``scheme://authority`` leaves the reference as
is; a base with a malformed authority gives null. Dot segments are removed by folding over the path segments with
``aggregate`` — exact for any depth, no UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEME_PREFIX = "^[A-Za-z][A-Za-z0-9+.-]*:"
BASE_SCHEME = "^([A-Za-z][A-Za-z0-9+.-]*):"
BASE_AUTHORITY = "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
BASE_PATH = "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
BASE_QUERY = "^[^?#]*[?]([^#]*)"
REF_QUERY = "^[^?#]*[?]([^#]*)"
REF_FRAGMENT = "^[^#]*#(.*)$"
REF_PATH = "^([^?#]*)"
BAD_AUTHORITY = "\\[[^\\]]*$"
DOT_TAIL = "(^|/)[.][.]?$"
LAST_SEGMENT = "/[^/]*$"
SLASH_RUN = "/{2,}"


def remove_dot_segments(path: Column) -> Column:
    tailed = F.when(path.rlike(DOT_TAIL), F.concat(path, F.lit("/"))).otherwise(path)
    segs = F.split(tailed, "/")
    inner = F.slice(segs, 2, F.greatest(F.size(segs) - 1, F.lit(0)))
    folded = F.aggregate(
        inner, F.lit(""),
        lambda acc, s: F.when(s == "..", F.regexp_replace(acc, LAST_SEGMENT, ""))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.lit("/"), s)))
    return F.when(folded == "", F.lit("/")).otherwise(folded)


def _tail(query: Column, fragment: Column) -> Column:
    """``?query#fragment``, each part only when non-empty."""
    return F.concat(F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
                    F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(F.lit("")))


def resolve(base: Column, ref: Column) -> Column:
    """``ref`` made absolute against ``base``; both, and their parts, are computed once, also inside lambdas."""
    def parts(x):
        b, r = x["base"], x["ref"]
        return F.struct(
            b.alias("base"), r.alias("ref"), F.regexp_extract(b, BASE_SCHEME, 1).alias("scheme"), F.regexp_extract(b, BASE_AUTHORITY, 1).alias("authority"),
            F.regexp_extract(b, BASE_PATH, 1).alias("b_path"), F.regexp_extract(b, BASE_QUERY, 1).alias("b_query"), b.rlike(BASE_AUTHORITY).alias("has_authority"),
            F.regexp_extract(r, REF_PATH, 1).alias("path"), F.regexp_extract(r, REF_QUERY, 1).alias("query"), F.regexp_extract(r, REF_FRAGMENT, 1).alias("fragment"))

    def absolute(p):
        base, ref, path = p["base"], p["ref"], p["path"]
        prefix = F.concat(p["scheme"], F.lit("://"), p["authority"])
        rest = _tail(p["query"], p["fragment"])
        base_dir = F.regexp_replace(F.when(p["b_path"] == "", F.lit("/")).otherwise(p["b_path"]), "[^/]*$", "")
        merged = F.regexp_replace(F.concat(base_dir, path), SLASH_RUN, "/")
        return (
            F.when(ref.isNull() | base.isNull(), F.lit(None))
            .when(ref == "", base)
            .when(p["has_authority"] & p["authority"].rlike(BAD_AUTHORITY), F.lit(None))
            .when(ref.rlike(SCHEME_PREFIX), ref)
            .when(~p["has_authority"], ref)
            .when(ref.startswith("//"), F.concat(p["scheme"], F.lit(":"), ref))
            .when(ref.startswith("/"), F.concat(prefix, remove_dot_segments(path), rest))
            .when(path == "", F.concat(prefix, p["b_path"], _tail(F.when(p["query"] != "", p["query"]).otherwise(p["b_query"]), p["fragment"])))
            .otherwise(F.concat(prefix, remove_dot_segments(merged), rest)))

    # lambdas over arrays of one element, whose variables are values
    one = F.array(F.struct(base.alias("base"), ref.alias("ref")))
    return F.transform(F.transform(one, parts), absolute)[0]
