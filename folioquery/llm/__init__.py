"""Operators for preparing training corpora at scale; nothing outside this package imports it."""
