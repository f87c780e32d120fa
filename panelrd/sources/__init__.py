"""Table sources and sinks."""

from panelrd.sources.tables import load_table, save_table, promote_header

__all__ = ["load_table", "save_table", "promote_header"]
