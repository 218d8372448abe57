"""Operators for preparing large training corpora, each built by one named method. Nothing else in the library imports this."""
