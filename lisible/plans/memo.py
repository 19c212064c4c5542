"""Per-query reuse of derived tables.

A query often needs the same derived table (the text catalog, the stored
versions) in several branches. Inside one query call it is built once;
every call starts with an empty memo, so queries stay independent.
"""

from __future__ import annotations

import contextvars
import functools

_memo: contextvars.ContextVar[dict | None] = contextvars.ContextVar("lisible_memo", default=None)


def memoized(fn):
    """Cache ``fn(spark, sf_dir)`` for the duration of the current query call."""
    @functools.wraps(fn)
    def wrapper(spark, sf_dir, *args, **kwargs):
        memo = _memo.get()
        if memo is None or args or kwargs:
            return fn(spark, sf_dir, *args, **kwargs)
        key = (fn.__module__, fn.__qualname__, sf_dir)
        if key not in memo:
            memo[key] = fn(spark, sf_dir)
        return memo[key]
    return wrapper


def query(fn):
    """Run a query builder with a fresh memo."""
    @functools.wraps(fn)
    def wrapper(spark, sf_dir):
        token = _memo.set({})
        try:
            return fn(spark, sf_dir)
        finally:
            _memo.reset(token)
    return wrapper
