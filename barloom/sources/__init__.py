"""Readers and writers of bars, trades and caches."""
