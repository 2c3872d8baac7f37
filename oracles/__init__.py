"""SQL twins of the registered queries, by area."""

import importlib

AREAS = ["venue", "geo", "wikitext", "evaluation"]


def all_sql():
    out = {}
    for area in AREAS:
        out.update(importlib.import_module(f"oracles.{area}").SQL)
    return out
