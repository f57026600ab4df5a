"""Operators over tick-indexed event tables, as functions from DataFrames to DataFrames."""
