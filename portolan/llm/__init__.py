"""Operators for preparing training text: scans, filters, de-duplication, tokens and classifiers."""
