"""Barloom: market-series analytics expressed as Spark plans."""
