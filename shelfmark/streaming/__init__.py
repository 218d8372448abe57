"""Continuous arrival of price sheets."""
