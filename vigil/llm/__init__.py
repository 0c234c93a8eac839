"""Operators for preparing training corpora at scale (one module per operator)."""
