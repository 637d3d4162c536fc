"""Disclosure analytics on Spark: filings and tax returns parsed, joined, searched and reported with DataFrames."""
