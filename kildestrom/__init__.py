"""Kildestrom: a DataFrame-first engine for curated news and document feeds."""
