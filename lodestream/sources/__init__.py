"""Readers of tables."""

from lodestream.sources.parquet import read_table

__all__ = ["read_table"]
