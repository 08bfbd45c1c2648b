"""Retail supply-chain analytics on Spark: reports, lists, stock and document jobs."""

from depotline.sources.tables import Tables, load_tables

__all__ = ["Tables", "load_tables"]
