"""Whole queries: the driver's tables seen as records, and the registered queries with their SQL."""
