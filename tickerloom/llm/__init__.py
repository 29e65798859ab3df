"""Operators for large training corpora: fingerprints, archives, scoring, filters, joins, token files."""
