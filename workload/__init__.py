"""Queries over the test tables: the operators in use, each with an equivalent SQL where SQL can say it."""

import importlib

MODULES = ["catalogue_queries", "text_queries", "matching_queries", "page_queries", "source_queries"]


def load():
    """The registry with all query modules imported."""
    for name in MODULES:
        importlib.import_module(f"workload.{name}")
    return importlib.import_module("workload.registry")
