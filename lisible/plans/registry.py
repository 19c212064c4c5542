"""Name → query and name → oracle SQL, over every plan module."""

from __future__ import annotations

import importlib

MODULES = ["lisible.plans.documents", "lisible.plans.boundaries", "lisible.plans.ordinal", "lisible.plans.pages", "lisible.plans.page_tree", "lisible.plans.catalog_store", "lisible.plans.simplify", "lisible.plans.lexical", "lisible.plans.streams"]


def all_queries() -> dict:
    from lisible.plans.memo import query
    out = {}
    for m in MODULES:
        out.update({k: query(v) for k, v in importlib.import_module(m).QUERIES.items()})
    return out


def all_oracle_sql() -> dict:
    out = {}
    for m in MODULES:
        out.update(importlib.import_module(m).oracle())
    return out
