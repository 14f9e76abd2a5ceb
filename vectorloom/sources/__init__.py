"""Scans and sinks: driver tables, derived run records, JSON run files, exports."""
