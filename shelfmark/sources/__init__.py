"""Readers and writers for the tables around the catalogue."""
