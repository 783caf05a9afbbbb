"""Operators for large text corpora: filters, deduplication, decontamination, packing and output formats."""
