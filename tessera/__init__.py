"""Tessera: stability-first clustering analytics and table processing on Spark DataFrames."""
