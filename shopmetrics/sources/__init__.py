"""Readers for the canonical tables and adapters from the test tables."""

from shopmetrics.sources.convert import convert_csv
from shopmetrics.sources.publish import publish_marts, published
from shopmetrics.sources.readers import load_tables, read_table
from shopmetrics.sources.sinks import export_marts

__all__ = ["convert_csv", "export_marts", "load_tables", "publish_marts", "published", "read_table"]
