"""Readers, the Parquet store and the proxy bars of the test tables."""
