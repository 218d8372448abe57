"""Catalogue operators: DataFrame in, DataFrame out."""
