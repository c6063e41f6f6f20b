"""Operators for preparing training text: mixing, decontamination, deduplication, scans, filters, files."""
