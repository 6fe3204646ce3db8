"""Readers."""

from rarefield.sources.tables import read_table

__all__ = ["read_table"]
