"""Event booking analytics on Spark: capacity, prices, reports, rules, bulk jobs and streams."""

from eventbook.sources.tables import BookingTables, read_tables, write_tables

__all__ = ["BookingTables", "read_tables", "write_tables"]
