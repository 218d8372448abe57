"""Catalogue integration on Spark: price sheets, store pages and brochures in, a publishable catalogue out."""

__version__ = "0.1.0"
