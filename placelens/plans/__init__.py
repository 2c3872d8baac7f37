"""Registered queries by area."""

import importlib

AREAS = ["venue_queries", "geo_queries", "wikitext_queries", "evaluation_queries"]


def all_queries():
    from placelens.plans.registry import QUERIES
    for area in AREAS:
        importlib.import_module(f"placelens.plans.{area}")
    return dict(QUERIES)
