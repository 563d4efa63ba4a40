"""Operators for preparing training text: rules, counts, deduplication, formatting, scans, packing, archives."""
