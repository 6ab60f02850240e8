"""Palimpsest: web-archive and corpus analytics on PySpark."""
