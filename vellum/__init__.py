"""Corpus integrity, extraction, assembly and reconciliation on Spark DataFrames."""
